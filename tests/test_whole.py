"""Queries over the whole tables, with figures that a part of the rows does not give."""

import math
import time

import numpy as np

from sparkloom.operators import layout
from sparkloom.plans import catalogue
from sparkloom.plans.roles import parts, successions, table

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return catalogue.QUERIES[name](spark, SF).collect()


def test_graph_queries_see_every_line(spark):
    edges = [(r.source, r.target) for r in successions(spark, SF).collect()]
    degree = {}
    for e in edges:
        for x in e:
            degree[x] = degree.get(x, 0) + 1
    median = sorted(degree.values())[len(degree) // 2]
    quiet = {e for e in edges if max(degree[x] for x in e) > median}
    assert {(r.source, r.target) for r in rows(spark, "quiet_edges")} == quiet

    god, high = ({r.id for r in rows(spark, n)} for n in ("god_modules", "high_coupling"))
    threats = rows(spark, "threat_log")
    assert {r.id for r in threats if r.type == "god-module"} == god and {r.id for r in threats if r.type == "high-coupling"} == high
    assert {r.type: r.n for r in rows(spark, "issue_help") if r.type != "orphan-module"} == {k: len(v) for k, v in (("god-module", god), ("high-coupling", high)) if v}
    fan_in = {r.id: r.fan_in for r in rows(spark, "degree_fan_in_out")}
    assert {r.id for r in rows(spark, "verdicts") if r.verdict == "blast-radius"} == {i for i, n in fan_in.items() if n >= 8}
    n = parts(spark, SF).count()
    orphans = sum(r.type == "orphan-module" for r in threats)
    penalty = 3 * (len(god) + len(high)) + orphans
    assert rows(spark, "health_score")[0].score == max(0, int(100 - penalty / (5 * n) * 100 + 0.5))
    sizes = {r.id: r.size_category for r in rows(spark, "importance_size")}
    assert all(sizes[i] == "large" for i, d in degree.items() if d > 8)


def test_orphans_are_orders_without_lines(spark):
    with_lines = {r[0] for r in table(spark, SF, "lineitem").select("l_orderkey").collect()}
    want = {f"o{r[0]}" for r in table(spark, SF, "orders").select("o_orderkey").collect() if r[0] not in with_lines}
    assert want and {r.id for r in rows(spark, "orphans")} == want


def test_circles_of_every_directory_are_packed(spark):
    got = rows(spark, "packed_circles")
    assert sorted((r.id, r.directory) for r in got) == sorted((r.id, r.directory) for r in parts(spark, SF).collect())


def test_packing_hundreds_takes_seconds_and_keeps_circles_apart():
    began = time.process_time()
    placed = layout.pack([(f"p{i}", float(i * 37 % 50 + 1)) for i in range(400)])
    assert time.process_time() - began < 20
    for i, (_, x, y, r) in enumerate(placed):
        gaps = [math.hypot(x - ox, y - oy) - r - o for _, ox, oy, o in placed[:i]]
        assert min(gaps, default=0) > -1e-6 and sum(abs(g) < 1e-6 for g in gaps) >= min(i, 2)


def test_packing_thousands_takes_seconds_and_keeps_circles_apart():
    began = time.process_time()
    placed = layout.pack([(f"p{i}", float(40 * (i * 37 % 50 + 1))) for i in range(4000)])
    assert time.process_time() - began < 20
    at = np.array([p[1:] for p in placed])
    for i in range(1, len(at)):
        gaps = np.hypot(*(at[:i, :2] - at[i, :2]).T) - at[:i, 2] - at[i, 2]
        assert gaps.min() > -1e-6 and (abs(gaps) < 1e-6).sum() >= min(i, 2)


def test_packing_is_that_of_all_pairs():
    """Against trying every pair's spots anew, for sizes far apart, close together, and none."""
    for values in ([float(3**i) for i in range(12)], [float(i * 5 % 13 + 1) for i in range(25)], [5.0, 1.0, 0.0, 0.0]):
        want = []
        for r in sorted((math.sqrt(v) for v in values), reverse=True):
            if len(want) < 2:
                want.append((want[0][2] + r if want else 0.0, 0.0, r))
                continue
            spots = []
            for i, (ax, ay, a) in enumerate(want):
                for bx, by, b in want[i + 1 :]:
                    d, p, q = math.hypot(bx - ax, by - ay), a + r, b + r
                    if 0 < d <= p + q + 1e-12:
                        along = (p * p - q * q + d * d) / (2 * d)
                        up = math.sqrt(max(p * p - along * along, 0.0))
                        ux, uy = (bx - ax) / d, (by - ay) / d
                        spots += [(ax + along * ux - s * up * uy, ay + along * uy + s * up * ux) for s in (1, -1)]
            free = [(x, y) for x, y in spots if all(math.hypot(x - ox, y - oy) >= o + r - 1e-9 for ox, oy, o in want)]
            want.append((*min(free, key=lambda s: (round(math.hypot(*s), 7), round(s[0], 7), round(s[1], 7))), r))
        got = layout.pack([(f"p{i:02d}", v) for i, v in enumerate(values)])
        assert [tuple(round(x, 5) + 0.0 for x in g[1:]) for g in got] == [tuple(round(x, 5) + 0.0 for x in w) for w in want]
