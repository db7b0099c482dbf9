"""Materialised steps of iterative operators, and numbers for rows in order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a table below the session's checkpoint folder; lost executors do no harm.

    A checkpoint would hand on the estimated size, which for a join is the product
    of both sides' sizes: in a loop of self joins its digits double from step to
    step, until planning takes longer than the work.  A table has the size it has,
    so small steps are broadcast and large ones are not.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="sparkloom-"))
    base = context.getCheckpointDir()
    folder = f"{base if ':' in base else 'file://' + base}/settled-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Bits of a row's place within its partition in `monotonically_increasing_id`.
_PLACE = 33


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df, settled, with each row's place from 0 in an order, as column `name`.

    Rows are range-partitioned and sorted; the driver gets one count a partition,
    so no task sees more than its share, which a window over all rows would.
    """
    spark = df.sparkSession
    rows = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, _PLACE).cast("int")
    before, total = [], 0
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        before.append((r.part, total))
        total += r.n
    starts = F.broadcast(spark.createDataFrame(before, "part_ int, before_ long"))  # one row a partition
    place = F.col("before_") + F.col(name).bitwiseAND((1 << _PLACE) - 1)
    return rows.withColumn("part_", part).join(starts, "part_").withColumn(name, place).drop("part_", "before_")
