"""sparkloom: structural, historical and text analytics as Spark DataFrame operators."""
