"""Betweenness of a large graph: shortest paths from many sources at once, level by level, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import settle

#: (source, node) pairs that are worked on together; sources are taken in batches of so many pairs at most.
PAIRS = 200_000_000
#: Levels after which the pairs that have been reached are put into one table.
GATHER = 20


def _levels(sources: DataFrame, links: DataFrame, most: int) -> list[DataFrame]:
    """(s, v, paths) by distance: the nodes at each distance from each source, and how many shortest paths lead there."""
    front = settle(sources.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))
    levels, seen = [front], front.select("s", "v")
    while len(levels) <= most:
        step = front.join(links, front.v == links.source).groupBy("s", F.col("target").alias("v")).agg(F.sum(F.col("paths") * F.col("k")).alias("paths"))
        front = settle(step.join(seen, ["s", "v"], "left_anti"))
        if front.isEmpty():
            return levels
        levels.append(front)
        seen = seen.union(front.select("s", "v"))
        if len(levels) % GATHER == 0:
            seen = settle(seen)
    raise RuntimeError(f"paths are longer than {most} steps")


def _shares(levels: list[DataFrame], links: DataFrame) -> DataFrame:
    """(id, b): what each node gets of all paths from the sources, summed back from the farthest level."""
    total = None
    below = settle(levels[-1].withColumn("share", F.lit(0.0)))
    for level in reversed(levels[:-1]):
        gained = below.groupBy(F.col("v").alias("id")).agg(F.sum("share").alias("b"))
        total = gained if total is None else total.union(gained)
        each = below.select("s", F.col("v").alias("target"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
        given = each.join(links, "target").groupBy("s", F.col("source").alias("v")).agg(F.sum(F.col("part") * F.col("k")).alias("given"))
        below = settle(level.join(given, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("given", F.lit(0.0))).alias("share")))
    return levels[0].select(F.col("v").alias("id"), F.lit(0.0).alias("b")) if total is None else total


def betweenness(nodes: DataFrame, edges: DataFrame, scaled: bool = True, pairs: int = PAIRS, most: int = 100_000) -> DataFrame:
    """(id, betweenness): directed shortest paths, parallel edges counted; over the greatest.

    Sources are taken in batches.  In a batch all sources advance by one edge a
    step, by a join of the pairs reached last with the edges; then dependencies
    are summed back level by level.  Edges, pairs and sums stay in tables.
    """
    ids = settle(nodes.select("id").distinct())
    links = settle(
        edges.where("source <> target")
        .groupBy("source", "target")
        .agg(F.count("*").cast("double").alias("k"))
        .join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    )
    n = ids.count()
    batches = max(1, -(-n * n // pairs))
    total = ids.withColumn("b", F.lit(0.0))
    for k in range(batches):
        sources = ids.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k)
        parts = _shares(_levels(sources, links, most), links)
        total = settle(total.union(parts).groupBy("id").agg(F.sum("b").alias("b")))
    found = total.select("id", F.col("b").alias("betweenness"))
    if not scaled:
        return found
    top = found.agg(F.max("betweenness").alias("top"))
    return found.crossJoin(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("betweenness") / F.col("top")).otherwise(0.0).alias("betweenness"))
