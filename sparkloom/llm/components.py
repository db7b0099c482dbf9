"""Connected components of a link table: unions within tasks, one exchange a round.

A round deals the links (a, b), a > b, by a.  Each task joins what it holds and
hangs every node on the least one of its part, so a node met as `a` has one
parent afterwards, and its other neighbours become links of their own.  When no
node has two parents left the links are a forest with the least nodes as roots;
its paths are then halved until all nodes point to roots.

Before the first round tasks join what they already hold: a node with very many
links is hung up once per task, so it is not dealt to one task with all of them.
Tasks look at ROWS links together; a node whose links are cut by that counts as
one with two parents and goes on to the next round.  Rounds are kept in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import settle

#: Links that a task joins together.
ROWS = 1 << 20


def joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """(a, b, torn): every node below the least of its part; torn where an `a` of these links had several parents."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield _hung(held, last)
            last, held = batch.column(0)[-1], []
    if held:
        yield _hung(held, last)


def _hung(held: list[pa.RecordBatch], last: pa.Scalar | None) -> pa.RecordBatch:
    """last: the `a` that the links before ended with; it may have had other parents there."""
    links = pa.Table.from_batches(held).combine_chunks()
    a, b = links.column(0).combine_chunks(), links.column(1).combine_chunks()
    nodes = pc.unique(pa.concat_arrays([a, b]))
    nodes = nodes.take(pc.array_sort_indices(nodes))
    ai, bi = (pc.index_in(x, nodes).to_numpy().astype(np.int64) for x in (a, b))
    parent = np.arange(len(nodes))
    while True:
        low, high = np.minimum(parent[ai], parent[bi]), np.maximum(parent[ai], parent[bi])
        apart = low != high
        if not apart.any():
            break
        np.minimum.at(parent, high[apart], low[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]
    below = np.flatnonzero(parent != np.arange(len(nodes)))
    several = np.bincount(np.unique(ai * len(nodes) + bi) // max(len(nodes), 1), minlength=len(nodes)) > 1
    if len(a) and last == a[0]:
        several[ai[0]] = True
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(below)), nodes.take(pa.array(parent[below])), pa.array(several[below])], names=["a", "b", "torn"])


def components(links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """From links (a, b) to (node, component), the component being its least node; nodes without links do not occur."""
    kind = links.schema["a"].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("torn", T.BooleanType())])
    rows, n = ROWS, links.count()
    run = lambda batches: joined(batches, rows)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(run, schema)
    for _ in range(most_rounds):
        edges = settle(edges.select("a", "b").repartition("a").sortWithinPartitions("a").mapInArrow(run, schema), n)
        if edges.where("torn").isEmpty():
            break
    else:
        raise RuntimeError(f"components: links are still torn after {most_rounds} rounds")
    # Chunks that cut a run, or parts that meet in one node, leave copies of a pair.
    tree = edges.groupBy("a").agg(F.min("b").alias("b"))
    for _ in range(most_rounds):
        above = tree.select(F.col("a").alias("b"), F.col("b").alias("up"))
        tree = settle(tree.join(above, "b", "left").select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("moved")), n)
        if tree.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"components: nodes are still below others after {most_rounds} rounds")
    return tree.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tree.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
