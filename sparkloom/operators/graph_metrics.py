"""Graph algorithms: strongly connected components, PageRank, layers, reachability, and all metrics of a graph at once.

All are loops of joins and aggregations whose steps are kept in the shared
folder.  Communities, betweenness and cut nodes have modules of their own.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .betweenness import betweenness
from .communities import communities
from .connected import components
from .cut_nodes import articulation_points
from .iterate import settle


#: Edges up to which a graph algorithm runs in one task, which then holds the whole graph.
SMALL_EDGES = 500_000


def _in_one_task(edges: DataFrame, run, schema: str) -> DataFrame:
    """run(adjacency) -> rows, over edges that are known to be few."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pdf["source"], pdf["target"], strict=True):
            near.setdefault(a, []).append(b)
            near.setdefault(b, [])
        return pd.DataFrame(run(near), columns=[c.split()[0] for c in schema.split(", ")])

    return edges.select("source", "target").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(one, schema)


def tarjan(near: dict) -> list:
    """(id, component) of strongly connected components of two nodes or more, without recursion."""
    order, low, on, stack, out = {}, {}, set(), [], []
    for root in sorted(near):
        if root in order:
            continue
        work = [(root, iter(near[root]))]
        order[root] = low[root] = len(order)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in order:
                    order[other] = low[other] = len(order)
                    stack.append(other)
                    on.add(other)
                    work.append((other, iter(near[other])))
                    break
                if other in on:
                    low[node] = min(low[node], order[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    members = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        members.append(x)
                        if x == node:
                            break
                    if len(members) > 1:
                        out += [(x, max(members)) for x in members]
    return out


def strong_components(edges: DataFrame, most_rounds: int = 200, small: int = SMALL_EDGES) -> DataFrame:
    """(id, component) of nodes on directed cycles through at least two nodes; the component is its greatest id.

    Up to `small` edges one task walks the graph.  Beyond, nodes without a way in or out are peeled off; then the greatest reachable
    label of each node colours the graph, and walking back from each colour's
    root within its colour gives one component per colour, which goes; repeat.
    """
    left = settle(edges.select("source", "target").where("source <> target").distinct())
    if left.count() <= small:
        return _in_one_task(left, tarjan, "id string, component string")
    found = None
    for _ in range(most_rounds):
        while True:
            kept = settle(left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"))
            n, before = kept.count(), left.count()
            left = kept
            if n == before or n == 0:
                break
        if n == 0:
            break
        colour = settle(left.select(F.col("source").alias("id")).distinct().withColumn("colour", F.col("id")))
        while True:
            into = left.join(colour, left.source == colour.id).groupBy("target").agg(F.max("colour").alias("c"))
            now = settle(colour.join(into, colour.id == into.target, "left").select("id", F.greatest("colour", F.coalesce("c", "colour")).alias("colour")))
            if now.join(colour, ["id", "colour"], "left_anti").isEmpty():
                break
            colour = now
        same = left.join(colour.withColumnsRenamed({"id": "source", "colour": "cs"}), "source").join(colour.withColumnsRenamed({"id": "target", "colour": "ct"}), "target")
        within = settle(same.where("cs = ct").select("source", "target", F.col("cs").alias("colour")))
        reach = settle(colour.where("id = colour"))
        front = reach
        while True:
            back = within.join(front.select(F.col("id").alias("target"), "colour"), ["target", "colour"]).select(F.col("source").alias("id"), "colour").distinct()
            front = settle(back.join(reach, ["id", "colour"], "left_anti"))
            if front.isEmpty():
                break
            reach = settle(reach.unionByName(front))
        sizes = reach.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
        part = reach.join(sizes, "colour").select("id", F.col("colour").alias("component"))
        found = part if found is None else found.unionByName(part)
        gone = reach.select("id")
        left = settle(left.join(gone, left.source == gone.id, "left_anti").join(gone, left.target == gone.id, "left_anti"))
    else:
        if not left.isEmpty():
            raise RuntimeError(f"strong components may be left after {most_rounds} rounds")
    return found if found is not None else left.select(F.col("source").alias("id"), F.col("source").alias("component")).limit(0)


def cycles(edges: DataFrame) -> DataFrame:
    """(component, members): one row per strongly connected component, members in order."""
    return strong_components(edges).groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members"))


def cycle_issues(edges: DataFrame) -> DataFrame:
    message = F.concat(F.lit("Circular dependency: "), F.array_join("members", " → "))
    return cycles(edges).select(F.lit("circular-dependency").alias("type"), F.lit("error").alias("severity"), message.alias("message"), F.col("members").alias("files"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, most: int = 50, tolerance: float = 1e-6, scaled: bool = True) -> DataFrame:
    """(id, rank): parallel edges count, rank without a way out spreads over all nodes; scaled by the greatest.

    One join and one aggregation a round; out-degrees are joined to the edges
    once, and the loop stops when the ranks change by less than the tolerance.
    """
    ids = nodes.select("id")
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    inside = edges.select("source", "target").join(ids, edges.source == ids.id, "left_semi").join(ids, edges.target == ids.id, "left_semi")
    out = inside.groupBy("source").agg(F.count("*").alias("out"))
    links = settle(inside.groupBy("source", "target").agg(F.count("*").alias("k")).join(out, "source").select("source", "target", (F.col("k") / F.col("out")).alias("share")))
    ends = out.select(F.col("source").alias("id"), F.lit(False).alias("dangling"))
    rank = settle(ids.join(ends, "id", "left").select("id", F.lit(1.0 / n).alias("rank"), F.coalesce("dangling", F.lit(True)).alias("dangling")))
    for _ in range(most):
        lost = rank.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        given = links.join(rank, links.source == rank.id).groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        base = (1 - damping) / n + damping * lost / n
        moved = rank.join(given, rank.id == given.node, "left").select("id", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("new"), "rank", "dangling")
        moved = settle(moved)
        change = moved.agg(F.sum(F.abs(F.col("new") - F.col("rank")))).first()[0]
        rank = moved.select("id", F.col("new").alias("rank"), "dangling")
        if change < tolerance:
            break
    if not scaled:
        return rank.select("id", "rank")
    top = rank.agg(F.max("rank").alias("top"))
    return rank.crossJoin(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("rank") / F.col("top")).otherwise(F.col("rank")).alias("rank"))


def dependency_layers(nodes: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """(id, layer): the longest way out of each node; nodes of one cycle share a layer.

    Cycles are contracted first, so the answer does not depend on visiting order.
    """
    ids = nodes.select("id")
    strong = strong_components(edges)
    home = settle(ids.join(strong, "id", "left").select("id", F.coalesce("component", "id").alias("home")))
    a, b = home.withColumnsRenamed({"id": "source", "home": "hs"}), home.withColumnsRenamed({"id": "target", "home": "ht"})
    dag = settle(edges.select("source", "target").join(a, "source").join(b, "target").where("hs <> ht").select("hs", "ht").distinct())
    inner = strong.select("component").distinct().withColumn("in_cycle", F.lit(1))
    layer = settle(home.select("home").distinct().join(inner, F.col("home") == F.col("component"), "left").select("home", F.coalesce("in_cycle", F.lit(0)).alias("own")).withColumn("layer", F.col("own")))
    for _ in range(most):
        best = dag.join(layer, dag.ht == layer.home).groupBy("hs").agg((F.max("layer") + 1).alias("up"))
        now = settle(layer.join(best, layer.home == best.hs, "left").select("home", "own", F.greatest("layer", F.coalesce(F.col("up") + F.col("own"), F.lit(0))).alias("layer")))
        if now.join(layer, ["home", "layer"], "left_anti").isEmpty():
            break
        layer = now
    else:
        raise RuntimeError(f"layers are not settled after {most} rounds")
    return home.join(layer, "home").select("id", F.col("layer").cast("int").alias("layer"))


def reachable(edges: DataFrame, start: str, most: int = 100_000, small: int = SMALL_EDGES) -> DataFrame:
    """(id, distance) of the nodes that can be reached from one; by one task up to `small` edges, else step by step."""
    spark = edges.sparkSession
    links = settle(edges.select("source", "target").distinct())
    if links.count() <= small:

        def walk(near: dict) -> list:
            far, queue = {start: 0}, deque([start])
            while queue:
                x = queue.popleft()
                for y in near.get(x, ()):
                    if y not in far:
                        far[y] = far[x] + 1
                        queue.append(y)
            return list(far.items())

        return _in_one_task(links, walk, "id string, distance int")
    seen = front = settle(spark.createDataFrame([(start, 0)], "id string, distance int"))
    for d in range(1, most):
        step = links.join(front, links.source == front.id).select(F.col("target").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("distance", F.lit(d))
        front = settle(step)
        if front.isEmpty():
            break
        seen = settle(seen.unionByName(front))
    else:
        raise RuntimeError(f"nodes may be left after {most} steps")
    return seen


def graph_metrics(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(id, page_rank, community, layer, betweenness, is_articulation)."""
    cut = articulation_points(nodes, edges).withColumn("cut", F.lit(True))
    return (
        pagerank(nodes, edges)
        .withColumnRenamed("rank", "page_rank")
        .join(communities(nodes, edges, seeds), "id")
        .join(dependency_layers(nodes, edges), "id")
        .join(betweenness(nodes, edges), "id")
        .join(cut, "id", "left")
        .select("id", "page_rank", "community", "layer", "betweenness", F.coalesce("cut", F.lit(False)).alias("is_articulation"))
    )
