"""Neighbours and weakly connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import settle


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of different neighbours in both directions, once."""
    return edges.select("source", "target").union(edges.select("target", "source")).where("source <> target").distinct()


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(id, component): weakly connected, the component being its least id; shortcuts make rounds logarithmic in most graphs."""
    near = settle(undirected(edges))
    label = settle(nodes.select("id", F.col("id").alias("component")))
    for _ in range(most_rounds):
        seen = near.join(label, near.source == label.id).groupBy("target").agg(F.min("component").alias("least"))
        step = label.join(seen, label.id == seen.target, "left").select("id", F.least("component", F.coalesce("least", "component")).alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("far"))
        now = settle(step.join(jump, "component").select("id", F.col("far").alias("component"), F.col("component").alias("mid")))
        now = settle(now.select("id", F.least("component", "mid").alias("component")))
        if now.join(label, ["id", "component"], "left_anti").isEmpty():
            return now
        label = now
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")
