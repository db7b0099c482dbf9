"""Line-level security scan of sources (path, language, module_type, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import rules
from sparkloom.functions.text import redact, shorten


def eligible(sources: DataFrame) -> DataFrame:
    """Sources that the scan reads: no tests, fixtures, samples or declarations, and of bounded size."""
    return sources.where((F.coalesce("module_type", F.lit("")) != "test") & ~F.col("path").rlike(rules.SKIPPED_FILES) & (F.octet_length("text") <= rules.MOST_BYTES))


def _found(line: Column, language: Column, escapes: Column, wanted: set[str] | None) -> list[Column]:
    out = []
    for r in rules.SECURITY_RULES:
        if wanted is not None and r.id not in wanted:
            continue
        hit = line.rlike(rules.java(r.pattern))
        if r.languages:
            hit = language.isin(*r.languages) & hit
        if r.id == "secret":
            hit = hit & ~line.rlike(rules.TYPE_LINE) & ~line.rlike(rules.TYPE_FIELD)
        else:
            hit = hit & ~line.rlike(rules.COMMENT_LINE)
        if r.id.startswith("eval"):
            hit = hit & ~line.rlike(rules.java(rules.IMPORT_LINE))
        if r.id == "xss-innerhtml":
            hit = hit & ~escapes
        shown = redact(line) if r.id == "secret" else shorten(F.trim(line))
        out.append(F.when(hit, F.struct(F.lit(r.id).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.severity).alias("severity"), shown.alias("match"))))
    return out


def findings(sources: DataFrame, wanted: set[str] | None = None) -> DataFrame:
    """(path, line, rule, kind, severity, match): the rules are unrolled into one projection per line, no join.

    wanted: ids of the rules that are tried, if not all.
    """
    some = eligible(sources).withColumn("escapes", F.col("text").rlike(rules.ESCAPE_FUNCTION))
    lines = some.select("path", F.coalesce("language", F.lit("")).alias("language"), "escapes", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    found = F.array_compact(F.array(*_found(F.col("line"), F.col("language"), F.col("escapes"), wanted)))
    return lines.select("path", (F.col("at") + 1).alias("line"), F.posexplode(found).alias("nth", "f")).select("path", "line", "nth", "f.*")


def issues(sources: DataFrame, shown: int = 3) -> DataFrame:
    """One issue per file and kind: the worst severity, the first findings and how many more there are.

    Findings are ranked in a window, so a file of very many does not become one
    long array.
    """
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("path", "kind").orderBy("line", "nth"))
    ranked = findings(sources).withColumn("n", nth)
    first = F.when(F.col("n") <= shown, F.struct("n", F.format_string("L%d: %s", "line", "match").alias("text")))
    grouped = ranked.groupBy("path", "kind").agg(F.count("*").alias("total"), F.bool_or(F.col("severity") == "error").alias("bad"), F.array_sort(F.collect_list(first)).alias("first"))
    extra = F.when(F.col("total") > shown, F.format_string(" (+%d more)", F.col("total") - shown)).otherwise("")
    message = F.concat(F.lit("Security: "), F.array_join(F.transform("first", lambda x: x["text"]), "; "), extra)
    return grouped.select(F.col("kind").alias("type"), F.when(F.col("bad"), "error").otherwise("warning").alias("severity"), message.alias("message"), F.array("path").alias("files"))
