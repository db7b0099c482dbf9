"""Change history: frequency, co-change, contributors, staleness, hotspots.

changes has one row per (commit_id, path) and, where needed, author and ts.
`now` and all windows are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def since(changes: DataFrame, months: int, now: Column) -> DataFrame:
    return changes.where(F.col("ts") >= F.add_months(now, -months))


def change_frequency(changes: DataFrame) -> DataFrame:
    """(path, changes, frequency): frequency is the share of the greatest count in the whole log."""
    counts = changes.groupBy("path").agg(F.count("*").alias("changes"))
    top = counts.agg(F.max("changes").alias("top"))
    return counts.crossJoin(F.broadcast(top)).select("path", "changes", (F.col("changes") / F.col("top")).alias("frequency"))


#: Files of a commit that meet in one task.
BLOCK = 1000


def _pairs(one: DataFrame, block: int) -> DataFrame:
    """(file_a, file_b) of the files of each commit, a < b, one row for each commit that has both.

    The files of a commit are dealt into blocks of about so many, and a file is
    sent to every pair of blocks that its own is part of.  What meets in a task is
    two blocks, however many files a commit has; a commit of one block is joined
    with itself as it is.
    """
    sizes = one.groupBy("commit_id").agg(F.count("*").alias("files")).where(F.col("files") > block)
    blocks = F.coalesce(F.ceil(F.col("files") / block).cast("int"), F.lit(1))
    dealt = one.join(sizes, "commit_id", "left").select("commit_id", "path", blocks.alias("k"), F.pmod(F.xxhash64("path"), blocks).cast("int").alias("own"))
    a = dealt.select("commit_id", F.col("path").alias("a"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("k") - 1)).alias("j"))
    b = dealt.select("commit_id", F.col("path").alias("b"), F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"))
    met = a.join(b, ["commit_id", "i", "j"]).where("i <> j or a < b")
    return met.select(F.least("a", "b").alias("file_a"), F.greatest("a", "b").alias("file_b"))


def co_changes(changes: DataFrame, least: int = 1, block: int = BLOCK) -> DataFrame:
    """(file_a, file_b, co_changes, confidence) of pairs in one commit, confidence by the greater of the two counts.

    A file with fewer than `least` changes is in no pair of that support, so it
    goes before the join.  Pairs are counted before they are shuffled.
    """
    one = changes.select("commit_id", "path").distinct()
    counts = one.groupBy("path").agg(F.count("*").alias("n"))
    if least > 1:
        one = one.join(counts.where(F.col("n") >= least).select("path"), "path", "left_semi")
    pairs = _pairs(one, block).groupBy("file_a", "file_b").agg(F.count("*").alias("co_changes")).where(F.col("co_changes") >= least)
    na, nb = (counts.select(F.col("path").alias(f"file_{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    return pairs.join(na, "file_a").join(nb, "file_b").select("file_a", "file_b", "co_changes", (F.col("co_changes") / F.greatest("na", "nb")).alias("confidence"))


def temporal_coupling(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, least: int = 3, confidence: float = 0.5) -> DataFrame:
    """Pairs that change together but are not joined by an edge in either direction."""
    ids = nodes.select("id")
    linked = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    found = pairs.where((F.col("co_changes") >= least) & (F.col("confidence") >= confidence))
    found = found.join(ids, F.col("file_a") == F.col("id"), "left_semi").join(ids, F.col("file_b") == F.col("id"), "left_semi")
    return found.join(linked, (F.least("file_a", "file_b") == F.col("a")) & (F.greatest("file_a", "file_b") == F.col("b")), "left_anti")


def temporal_issues(couplings: DataFrame) -> DataFrame:
    message = F.format_string("Temporal coupling (%.0f%% confidence, %d co-changes): %s ↔ %s", F.col("confidence") * 100, "co_changes", "file_a", "file_b")
    return couplings.select(F.lit("temporal-coupling").alias("type"), F.when(F.col("confidence") >= 0.8, "warning").otherwise("info").alias("severity"), message.alias("message"), F.array("file_a", "file_b").alias("files"))


def bus_factor(changes: DataFrame, share: float = 0.1) -> DataFrame:
    """(path, bus_factor, commits, top_author): authors with at least `share` of a file's commits."""
    per = changes.groupBy("path", "author").agg(F.count("*").alias("commits"))
    total = F.sum("commits").over(W.partitionBy("path"))
    return per.withColumn("total", total).groupBy("path").agg(F.count_if(F.col("commits") >= share * F.col("total")).alias("bus_factor"), F.sum("commits").alias("commits"), F.min_by("author", F.struct(-F.col("commits"), F.col("author"))).alias("top_author"))


def bus_factor_issues(factors: DataFrame) -> DataFrame:
    alone = factors.where("bus_factor <= 1 and top_author is not null")
    return alone.select(F.lit("bus-factor").alias("type"), F.lit("warning").alias("severity"), F.concat(F.lit("Bus factor 1 — only "), F.col("top_author"), F.lit(" contributes to: "), F.col("path")).alias("message"), F.array("path").alias("files"))


def staleness(changes: DataFrame, now: Column, dusty_months: int = 6, abandoned_months: int = 12) -> DataFrame:
    """(path, last_change, stale_days, stale_level), months of 30 days."""
    last = changes.groupBy("path").agg(F.max(F.col("ts").cast("timestamp")).alias("last_change"))
    days = F.floor((F.unix_micros(now) - F.unix_micros("last_change")) / 86_400_000_000).cast("int")
    level = F.when(F.col("stale_days") >= abandoned_months * 30, "abandoned").when(F.col("stale_days") >= dusty_months * 30, "dusty").otherwise("active")
    return last.withColumn("stale_days", days).withColumn("stale_level", level)


def stale_issues(stale: DataFrame) -> DataFrame:
    return stale.where("stale_level <> 'active'").select(F.lit("stale-code").alias("type"), F.lit("info").alias("severity"), F.format_string("Stale code (%s, %d days): %s", "stale_level", "stale_days", "path").alias("message"), F.array("path").alias("files"))


def normalised(table: DataFrame, column: str, name: str, floor: float = 1.0) -> DataFrame:
    """The share of a column in its greatest value, or in `floor` if that is more."""
    top = table.agg(F.greatest(F.max(column), F.lit(floor)).alias("_top"))
    return table.crossJoin(F.broadcast(top)).withColumn(name, F.col(column) / F.col("_top")).drop("_top")


def hotspots(nodes: DataFrame, complexity: DataFrame, frequency: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, complexity, normalized_complexity, change_frequency, changes, hotspot_score, is_hotspot).

    complexity: (path, branches); frequency: (path, changes, frequency).
    """
    c = normalised(complexity, "branches", "normalized_complexity").withColumnRenamed("path", "id")
    f = frequency.withColumnRenamed("path", "id")
    joined = nodes.select("id").join(c, "id", "left").join(f, "id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    score = zero("normalized_complexity") * zero("frequency")
    return joined.select("id", zero("branches").alias("complexity"), zero("normalized_complexity").alias("normalized_complexity"), zero("frequency").alias("change_frequency"), zero("changes").alias("changes"), score.alias("hotspot_score"), (score >= threshold).alias("is_hotspot"))


def hotspot_issues(spots: DataFrame) -> DataFrame:
    hot = spots.where("is_hotspot")
    return hot.select(F.lit("hotspot").alias("type"), F.when(F.col("hotspot_score") >= 0.75, "error").otherwise("warning").alias("severity"), F.format_string("Hotspot (score: %.2f): %s", "hotspot_score", "id").alias("message"), F.array("id").alias("files"))
