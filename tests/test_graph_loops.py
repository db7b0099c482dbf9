"""Communities, cut nodes and betweenness against sequential versions on random graphs."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import betweenness, communities, cut_nodes, graph_metrics
from sparkloom.operators.connected import undirected
from sparkloom.operators.iterate import numbered


def graph(spark, names, pairs):
    rows = spark.createDataFrame([(a, b, "import") for a, b in pairs], "source string, target string, type string")
    return spark.createDataFrame([(x, k) for k, x in enumerate(names)], "id string, ord long"), rows


def neighbours(names, pairs):
    near = {x: set() for x in names}
    for a, b in pairs:
        if a != b and a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    return near


def in_turn(near, labels, rounds, inertia):
    for _ in range(rounds):
        changed = False
        for node in sorted(near):
            count = defaultdict(int)
            for other in near[node]:
                count[labels[other]] += 1
            ties = [x for x, k in count.items() if k == max(count.values())]
            if ties:
                best = labels[node] if inertia and labels[node] in ties else min(ties)
                changed |= best != labels[node]
                labels[node] = best
        if not changed:
            break
    number = {x: k for k, x in enumerate(sorted(set(labels.values())))}
    return {x: number[label] for x, label in labels.items()}


CASES = {"sparse": (30, 34), "dense": (18, 60), "loose": (24, 12)}


def drawn(case, seed):
    rnd = random.Random(f"{case}{seed}")
    n, m = CASES[case]
    names = [f"n{i:02d}" for i in range(n)]
    rnd.shuffle(names)
    return names, [(rnd.choice(names), rnd.choice(names)) for _ in range(m)]


@pytest.mark.parametrize("case", ["sparse", "dense"])
def test_communities_equal_the_visiting_order(spark, case):
    names, pairs = drawn(case, 1)
    n, e = graph(spark, names, pairs)
    got = {r.id: r.community for r in communities.communities(n, e).collect()}
    assert got == in_turn(neighbours(names, pairs), {x: k for k, x in enumerate(names)}, 20, False)


def test_a_wave_runs_through_a_chain_in_one_round(spark):
    names = [f"n{i:02d}" for i in range(12)]
    n, e = graph(spark, names, list(zip(names, names[1:])))
    got = {r.id: r.community for r in communities.communities(n, e, rounds=1).collect()}
    assert got == in_turn(neighbours(names, list(zip(names, names[1:]))), {x: k for k, x in enumerate(names)}, 1, False)
    assert len(set(got.values())) < 3
    with pytest.raises(RuntimeError):
        communities.propagated(undirected(e), communities.first_labels(n), 1, False, most_steps=2)


@pytest.mark.parametrize("case", ["sparse"])
def test_seeded_communities_equal_the_visiting_order(spark, case):
    names, pairs = drawn(case, 2)
    near = neighbours(names, pairs)
    seeds = {x: k % 4 + 3 for k, x in enumerate(names) if k % 3}
    n, e = graph(spark, names, pairs)
    labels, fresh = dict(seeds), 7
    for x in names:
        if x not in seeds:
            votes = defaultdict(int)
            for y in near[x]:
                if y in seeds:
                    votes[seeds[y]] += 1
            labels[x] = min(votes, key=lambda v: (-votes[v], v)) if votes else (fresh := fresh + 1)
    got = {r.id: r.community for r in communities.communities(n, e, spark.createDataFrame(list(seeds.items()), "id string, community int")).collect()}
    assert got == in_turn(near, labels, 10, True)


@pytest.mark.parametrize("case", ["sparse", "loose"])
def test_cut_nodes_equal_removal(spark, case):
    names, pairs = drawn(case, 3)
    pairs += [(names[0], x) for x in names[1:4]] + [(names[1], "outside")]
    n, e = graph(spark, names, pairs)
    near = neighbours(names, pairs)
    got = {r.id for r in cut_nodes.articulation_points(n, e).collect()}
    # a node whose removal leaves its only neighbours alone cuts as well: count nodes left alone as parts
    want = set()
    for x in near:
        rest = {y: near[y] - {x} for y in near if y != x}
        count = lambda g: len({frozenset(_part(g, y)) for y in g})
        if count(rest) > count(near) - (0 if near[x] else 1):
            want.add(x)
    assert got == want


def _part(near, x):
    seen, todo = set(), [x]
    while todo:
        y = todo.pop()
        if y not in seen:
            seen.add(y)
            todo += near[y]
    return seen


def test_blocks_of_two_rings_and_a_bridge(spark):
    ring = lambda p: [(f"{p}{i}", f"{p}{(i + 1) % 5}") for i in range(5)]
    pairs = ring("a") + ring("b") + [("a0", "b0"), ("b3", "c")]
    names = sorted({x for p in pairs for x in p} | {"alone"})
    n, e = graph(spark, names, pairs)
    assert {r.id for r in cut_nodes.articulation_points(n, e).collect()} == {"a0", "b0", "b3"}
    sizes = sorted(r.n for r in cut_nodes.blocks(n, e).groupBy("block").agg(F.count("*").alias("n")).collect())
    assert sizes == [1, 1, 4, 4]  # tree edges of a ring, of a bridge
    assert cut_nodes.articulation_points(n.limit(0), e).count() == 0 and cut_nodes.articulation_points(n, e.limit(0)).count() == 0


def through(names, pairs):
    out, total = defaultdict(list), dict.fromkeys(names, 0.0)
    for a, b in pairs:
        out[a].append(b)
    for s in names:
        order, before, paths, far, queue = [], defaultdict(list), {s: 1.0}, {s: 0}, deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in far:
                    far[w], paths[w] = far[v] + 1, 0.0
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                total[w] += share[w]
    return total


@pytest.mark.parametrize("pairs_at_once", [10**9, 300])
def test_betweenness_equals_brandes(spark, pairs_at_once):
    names, pairs = drawn("sparse", 4)
    pairs += pairs[:9] + [(names[0], names[0])]
    n, e = graph(spark, names, pairs)
    got = {r.id: r.betweenness for r in betweenness.betweenness(n, e, scaled=False, pairs=pairs_at_once).collect()}
    assert got == pytest.approx(through(names, pairs))
    assert betweenness.betweenness(n, e.limit(0)).where("betweenness <> 0").count() == 0 and betweenness.betweenness(n.limit(0), e).count() == 0


def test_all_metrics_of_a_graph(spark):
    names, pairs = drawn("sparse", 5)
    n, e = graph(spark, names, pairs)
    got = graph_metrics.graph_metrics(n, e)
    assert got.columns == ["id", "page_rank", "community", "layer", "betweenness", "is_articulation"]
    assert sorted(r.id for r in got.collect()) == sorted(names)


def test_rows_are_numbered_through_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    assert sorted((r.x, r.place) for r in numbered(rows, ["x"], "place").collect()) == [(i, i) for i in range(1000)]
    assert numbered(rows.limit(0), ["x"], "place").count() == 0
