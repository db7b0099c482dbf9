"""Articulation points of a large graph by the method of Tarjan and Vishkin, as joins and aggregations.

A depth-first search is sequential; this method takes any spanning forest:

1. Boruvka's rounds give the forest: each part takes its least edge to another
   part, and parts that are joined so are contracted by pointer jumping.
2. Every tree edge in both directions, each followed by the next one around the
   node that it enters, makes an Euler tour.  List ranking by pointer jumping
   gives places in it, and from these come parents, a preorder and sizes.
3. low and high, the least and greatest preorder number that a subtree reaches by
   edges outside the forest, are minima and maxima over ranges of the preorder,
   taken from tables of ranges whose length doubles.
4. Tree edges, each named by its lower node, that lie on a common cycle are linked;
   connected components of these links are the blocks.  A node is an articulation
   point if tree edges of two blocks or more meet at it.

Each part takes a number of rounds that is logarithmic in the graph's size, and
every round is a shuffle of rows of a few numbers.  A node of very many edges is
no group of its own anywhere: successors around a node come from dense numbers of
a sorted table, not from a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .connected import components, undirected
from .iterate import numbered, settle


def _jumped(parent: DataFrame, most: int = 100) -> DataFrame:
    """(id, up) with every id at the end of its way up; parent: (id, up), ends point at themselves."""
    for _ in range(most):
        above = parent.select(F.col("id").alias("up"), F.col("up").alias("top"))
        now = settle(parent.join(above, "up").select("id", F.col("top").alias("up"), (F.col("up") != F.col("top")).alias("moved")))
        parent = now.select("id", "up")
        if now.where("moved").isEmpty():
            return parent
    raise RuntimeError(f"ways up are longer than 2 ** {most}")


def spanning_forest(ids: DataFrame, near: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(a, b) with a < b of the forest's edges, and (id, root) of all nodes; near has both directions of each edge."""
    part = settle(ids.select("id", F.col("id").alias("root")))
    links = settle(near.select("source", "target", F.col("source").alias("cs"), F.col("target").alias("ct")))
    tree = None
    for _ in range(most):
        edge = F.struct(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
        picks = settle(links.groupBy("cs").agg(F.min(F.struct(edge.alias("edge"), F.col("ct").alias("ct"))).alias("pick")).select(F.col("cs").alias("id"), "pick.ct", "pick.edge.a", "pick.edge.b"))
        if picks.isEmpty():
            return (tree if tree is not None else near.select(F.col("source").alias("a"), F.col("target").alias("b")).limit(0)), part
        chosen = picks.select("a", "b").distinct()
        tree = settle(chosen if tree is None else tree.union(chosen))
        # two parts may pick the same edge: the lesser of them is the root
        back = picks.select(F.col("id").alias("ct"), F.col("ct").alias("back"))
        hooked = picks.join(back, "ct").select("id", F.when((F.col("back") == F.col("id")) & (F.col("id") < F.col("ct")), F.col("id")).otherwise(F.col("ct")).alias("up"))
        tops = settle(_jumped(hooked))
        part = settle(part.join(tops.select(F.col("id").alias("root"), "up"), "root", "left").select("id", F.coalesce("up", "root").alias("root")))
        for c in ("cs", "ct"):
            links = links.join(tops.select(F.col("id").alias(c), "up"), c, "left").withColumn(c, F.coalesce("up", c)).drop("up")
        links = settle(links.where("cs <> ct"))
    raise RuntimeError(f"parts are left after {most} rounds")


def _ranked(successor: DataFrame, most: int = 100) -> DataFrame:
    """(at, left): steps to the end of its list of every element; successor: (at, next), next is null at an end."""
    state = settle(successor.select("at", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("left")))
    for _ in range(most):
        if state.where(F.col("next").isNotNull()).isEmpty():
            return state.select("at", "left")
        ahead = state.select(F.col("at").alias("next"), F.col("next").alias("after"), F.col("left").alias("more"))
        state = settle(state.join(ahead, "next", "left").select("at", F.col("after").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    raise RuntimeError(f"lists are longer than 2 ** {most}")


def rooted(tree: DataFrame, part: DataFrame) -> DataFrame:
    """(id, parent, pre, size) of all nodes: preorder numbers from 0 that run through one tree after another, sizes of subtrees."""
    arcs = tree.select(F.col("a").alias("u"), F.col("b").alias("v")).union(tree.select("b", "a"))
    arcs = settle(numbered(arcs, ["u", "v"], "at"))
    first = arcs.groupBy("u").agg(F.min("at").alias("first"))
    # after entering v from u comes the arc that leaves v next after the one back to u, around v
    back = arcs.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("at").alias("back"))
    follow = arcs.select(F.col("at").alias("cand"), F.col("u").alias("cu"))
    turned = arcs.join(back, ["u", "v"]).withColumn("cand", F.col("back") + 1).join(follow, "cand", "left")
    turned = turned.join(first.withColumnRenamed("u", "v"), "v").withColumn("next", F.when(F.col("cu") == F.col("v"), F.col("cand")).otherwise(F.col("first")))
    roots = part.where("id = root").select(F.col("id").alias("u"))
    starts = first.join(roots, "u").select(F.col("first").alias("next"), F.lit(True).alias("ends"))
    open_ = turned.select("at", "next").join(starts, "next", "left").select("at", F.when(F.col("ends"), F.lit(None)).otherwise(F.col("next")).alias("next"))
    placed = settle(arcs.join(_ranked(open_), "at").select("u", "v", "left"))
    other = placed.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("left").alias("up_left"))
    # the arc into a node from its parent has more steps left than the one back
    down = placed.join(other, ["u", "v"]).where("left > up_left").select(F.col("v").alias("id"), F.col("u").alias("parent"), "left", ((F.col("left") - F.col("up_left") + 1) / 2).cast("long").alias("size"))
    whole = part.groupBy("root").agg(F.count("*").alias("all"))
    nodes = part.join(down, "id", "left").join(whole, "root").select("id", "root", "parent", F.coalesce("size", "all").alias("size"), F.coalesce(-F.col("left"), F.lit(-(2**62))).alias("place"))
    return settle(numbered(nodes, ["root", "place"], "pre").select("id", "parent", "pre", "size"))


def _reach(tree: DataFrame, outside: DataFrame) -> DataFrame:
    """(id, parent, pre, size, low, high): low and high over each subtree; outside: (source, target) that are no tree edges, both ways."""
    pre = tree.select(F.col("id").alias("target"), F.col("pre").alias("to"))
    beyond = outside.join(pre, "target").groupBy("source").agg(F.min("to").alias("least"), F.max("to").alias("most"))
    own = tree.join(beyond.withColumnRenamed("source", "id"), "id", "left")
    table = settle(own.select("pre", F.least("pre", F.coalesce("least", "pre")).alias("low"), F.greatest("pre", F.coalesce("most", "pre")).alias("high")))
    asked = settle(tree.withColumn("level", F.length(F.bin("size")) - 1))
    top = asked.agg(F.max("level")).first()[0] or 0
    out = None
    for level in range(top + 1):
        span = 1 << level
        here = asked.where(F.col("level") == level).drop("level")
        last = here.select("id", (F.col("pre") + F.col("size") - span).alias("pre"))
        ends = settle(here.select("id", "pre").union(last).join(table, "pre").groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high")))
        both = here.join(ends, "id").select("id", "parent", "pre", "size", "low", "high")
        out = both if out is None else out.unionByName(both)
        if level < top:
            ahead = table.select((F.col("pre") - span).alias("pre"), F.col("low").alias("low2"), F.col("high").alias("high2"))
            table = settle(table.join(ahead, "pre", "left").select("pre", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")))
    return settle(out)


def blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, parent, block): every node but the roots stands for the tree edge to its parent, which lies in one block."""
    ids = settle(nodes.select("id").distinct())
    near = undirected(edges)
    near = settle(near.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))
    forest, part = spanning_forest(ids, near)
    tree = rooted(forest, part)
    arcs = forest.select(F.col("a").alias("source"), F.col("b").alias("target")).union(forest.select("b", "a"))
    outside = settle(near.join(arcs, ["source", "target"], "left_anti"))
    found = _reach(tree, outside)
    a, b = (tree.select(F.col("id").alias(c), F.col("pre").alias(f"pre_{c}"), F.col("size").alias(f"size_{c}")) for c in ("source", "target"))
    across = outside.where("source < target").join(a, "source").join(b, "target")
    across = across.where((F.col("pre_source") + F.col("size_source") <= F.col("pre_target")) | (F.col("pre_target") + F.col("size_target") <= F.col("pre_source"))).select("source", "target")
    above = tree.where("parent is not null").select(F.col("id").alias("parent"), F.col("pre").alias("above"), F.col("size").alias("span"))  # no root
    leaves = found.join(above, "parent").where((F.col("low") < F.col("above")) | (F.col("high") >= F.col("above") + F.col("span"))).select(F.col("parent").alias("source"), F.col("id").alias("target"))
    below = tree.where("parent is not null")
    label = components(below.select("id"), across.union(leaves))
    return below.select("id", "parent").join(label, "id").select("id", "parent", F.col("component").alias("block"))


def articulation_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of the nodes without which their component falls apart."""
    found = settle(blocks(nodes, edges))
    meet = found.select("id", "block").union(found.select("parent", "block"))
    return meet.groupBy("id").agg(F.min("block").alias("x"), F.max("block").alias("y")).where("x <> y").select("id")
