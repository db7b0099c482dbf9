"""Graph results carried on from the last run: only components that a change touches are computed anew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .communities import first_labels, propagated, seeded_labels
from .connected import components, undirected
from .iterate import numbered, settle


def changed_ends(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id) of the ends of edges (source, target, both ways) that are in one of two graphs only."""
    gone = before.join(after, ["source", "target"], "left_anti")
    come = after.join(before, ["source", "target"], "left_anti")
    return gone.select(F.col("source").alias("id")).union(come.select("source")).distinct()


def touched(home: DataFrame, nodes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(id) of the nodes of this run whose component a change touches: nodes that are new, and all of each component that lost or got an edge or node.

    home: (id, component) of the last run; before, after: `undirected` edges of the two runs.
    """
    ids = nodes.select("id").distinct()
    new = ids.join(home, "id", "left_anti")
    gone = home.join(ids, "id", "left_anti").select("id")
    hit = changed_ends(before, after).union(gone)
    parts = home.join(hit, "id", "left_semi").select("component").distinct()
    return new.union(home.join(parts, "component", "left_semi").join(ids, "id", "left_semi").select("id")).distinct()


def components_after(home: DataFrame, nodes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, component) as `components` gives for this run, from that of the last run and both runs' edges."""
    old, now = settle(undirected(before)), settle(undirected(after))
    some = settle(touched(home, nodes, old, now))
    inside = now.join(some.withColumnRenamed("id", "source"), "source", "left_semi")
    fresh = components(some, inside)
    kept = home.join(nodes.select("id").distinct(), "id", "left_semi").join(some, "id", "left_anti").select("id", "component")
    return settle(kept.unionByName(fresh.select("id", "component")))


def communities_after(state: DataFrame, home: DataFrame, nodes: DataFrame, before: DataFrame, after: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community) as `communities` gives for this run with the last run's communities as seeds.

    state: (id, community) of the last run, in which no round would change anything; home: its components.  A component that
    nothing touches has the same labels, neighbours and ties as when it came to rest, so it stays as it is.
    """
    old, now = settle(undirected(before)), settle(undirected(after))
    some = settle(touched(home, nodes, old, now))
    near = settle(now.join(some.withColumnRenamed("id", "source"), "source", "left_semi").join(some.withColumnRenamed("id", "target"), "target", "left_semi"))
    rows = nodes.join(some, "id", "left_semi")
    known = state.select("id", "community")
    first = seeded_labels(rows, near, known.join(some, "id", "left_semi"), known) if not known.isEmpty() else first_labels(rows)
    found = propagated(near, first, rounds, True)
    rest = known.join(nodes.select("id").distinct(), "id", "left_semi").join(some, "id", "left_anti")
    label = F.struct(F.col("community").cast("long").alias("k"), F.lit("").alias("of"))
    every = settle(found.select("id", "label").unionByName(rest.select("id", label.alias("label"))))
    number = numbered(every.select("label").distinct(), ["label"], "community")
    return every.join(number, "label").select("id", F.col("community").cast("int").alias("community"))
