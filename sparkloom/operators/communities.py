"""Label propagation in visiting order, as a wavefront of joins.

Within a round a node takes the commonest label among its neighbours: of those
before it in id order the label they have got in this round, of those after it
the label of the round before.  The labels of a round are thus determined along
edges that all point from smaller to greater ids, which is a graph without
cycles.  A step computes every node whose inputs have changed from the labels
that are known so far; nodes whose smaller neighbours are final become final, and
the wave goes on only where a label changed.  When nothing changes any more, the
round's labels are exactly those of visiting the nodes one after another.

A step is an equi-join of edges and labels and an aggregation by node and label,
which combines before the shuffle, so a node of very many neighbours is spread
over all tasks.  A round takes at most as many steps as the longest rising path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .connected import undirected
from .iterate import numbered, settle


def _commonest(near: DataFrame, state: DataFrame, inertia: bool) -> DataFrame:
    """(id, found): what each source of `near` takes from the labels of its neighbours."""
    seen = near.join(state.select(F.col("id").alias("target"), "old", "now"), "target")
    votes = seen.select("source", F.when(F.col("target") < F.col("source"), F.col("now")).otherwise(F.col("old")).alias("label")).groupBy("source", "label").agg(F.count("*").alias("n"))
    if inertia:  # of equally common labels the node's own comes first
        votes = votes.join(state.select(F.col("id").alias("source"), F.col("old").alias("own")), "source").withColumn("other", F.col("label") != F.col("own"))
    else:
        votes = votes.withColumn("other", F.lit(False))
    best = votes.groupBy("source").agg(F.min(F.struct(-F.col("n"), "other", "label")).alias("best"))
    return best.select(F.col("source").alias("id"), F.col("best.label").alias("found"))


def _round(near: DataFrame, state: DataFrame, dirty: DataFrame, inertia: bool, most_steps: int) -> DataFrame:
    """The state after a round: `now` is the label each node gets; dirty: ids whose inputs differ from when they were last computed."""
    for _ in range(most_steps):
        found = _commonest(near.join(dirty.select(F.col("id").alias("source")), "source", "left_semi"), state, inertia)
        stepped = state.join(found, "id", "left").withColumn("found", F.coalesce("found", "now"))
        state = settle(stepped.select("id", "old", F.col("found").alias("now"), (F.col("found") != F.col("now")).alias("moved")))
        moved = state.where("moved").select("id")
        if moved.isEmpty():
            return state
        dirty = near.join(moved.withColumnRenamed("id", "target"), "target").where("target < source").select(F.col("source").alias("id")).distinct()
    raise RuntimeError(f"labels of a round are not settled after {most_steps} steps")


def propagated(near: DataFrame, labels: DataFrame, rounds: int, inertia: bool, most_steps: int = 100_000) -> DataFrame:
    """(id, label) after at most so many rounds over all nodes in id order, or when a round changes nothing.

    near: both directions of each pair of neighbours, once; labels: (id, label) to begin with, of any type that has an order.
    """
    near = settle(near)
    state = settle(labels.select("id", F.col("label").alias("old"), F.col("label").alias("now"), F.lit(False).alias("moved")))
    dirty = state.select("id")
    for _ in range(rounds):
        state = _round(near, state, dirty, inertia, most_steps)
        turned = settle(state.where(F.col("old") != F.col("now")).select("id"))
        if turned.isEmpty():
            break
        state = state.select("id", F.col("now").alias("old"), "now", F.lit(False).alias("moved"))
        dirty = near.join(turned.withColumnRenamed("id", "target"), "target").where("target > source").select(F.col("source").alias("id"))
        dirty = (dirty.union(turned) if inertia else dirty).distinct()
    return state.select("id", F.col("now").alias("label"))


def first_labels(nodes: DataFrame) -> DataFrame:
    """(id, label): a label of its own for each node, in the order of `ord` if there is one and of the ids."""
    place = F.col("ord").cast("long") if "ord" in nodes.columns else F.lit(0).cast("long")
    return nodes.select("id", F.struct(place.alias("k"), F.col("id").alias("of")).alias("label"))


def seeded_labels(nodes: DataFrame, near: DataFrame, seeds: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(id, label): a node's seed, else the commonest seed among its neighbours, else a label of its own after all seeds.

    taken: (id, community) after which labels of their own begin, where that is more than the seeds.
    """
    last = (seeds if taken is None else taken).agg(F.coalesce(F.max("community"), F.lit(-1)).cast("long").alias("top")).first()[0]
    seeds = seeds.select(F.col("id").alias("seeded"), F.col("community").cast("long").alias("community"))
    votes = near.join(seeds, near.target == seeds.seeded).groupBy("source", "community").agg(F.count("*").alias("n"))
    adopted = votes.groupBy("source").agg(F.min(F.struct(-F.col("n"), "community")).alias("best")).select("source", F.col("best.community").alias("adopted"))
    own = first_labels(nodes).select("id", F.struct((F.lit(last + 1) + F.col("label.k")).alias("k"), F.col("label.of").alias("of")).alias("own"))
    known = own.join(seeds, own.id == seeds.seeded, "left").join(adopted, own.id == adopted.source, "left").withColumn("k", F.coalesce("community", "adopted"))
    return known.select("id", F.when(F.col("k").isNull(), F.col("own")).otherwise(F.struct(F.col("k").alias("k"), F.lit("").alias("of"))).alias("label"))


def communities(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, rounds: int = 20) -> DataFrame:
    """(id, community): label propagation in id order; labels start in the order of `ord`, else of ids, or from seeds (id, community).

    With seeds, a new node takes the commonest label of its seeded neighbours or
    a fresh one, ties keep the label there is, and there are half as many rounds.
    Communities are numbered by label.
    """
    ids = nodes.select("id").distinct()
    near = settle(undirected(edges).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))
    first = first_labels(nodes) if seeds is None else seeded_labels(nodes, near, seeds)
    found = propagated(near, first, rounds if seeds is None else min(rounds, 10), seeds is not None)
    number = numbered(found.select("label").distinct(), ["label"], "community")
    return found.join(number, "label").select("id", F.col("community").cast("int").alias("community"))
