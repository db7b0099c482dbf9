"""Operators on small graphs whose answers are known."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import enrich, graph, graph_metrics, history, layout
from sparkloom.plans import catalogue, export

NODE = "id string, file_path string, label string, module_type string, loc int, directory string, language string, ord long"


def nodes(spark, *rows):
    """Rows of (id, type, loc, language)."""
    return spark.createDataFrame([(i, i, i, t, n, i.rpartition("/")[0], lang, k) for k, (i, t, n, lang) in enumerate(rows)], NODE)


def edges(spark, *pairs, kind="import"):
    return spark.createDataFrame([(a, b, kind, k) for k, (a, b) in enumerate(pairs)], "source string, target string, type string, ord long")


def ids(df, column="id"):
    return {r[column] for r in df.collect()}


def test_cycles(spark):
    two = edges(spark, ("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("d", "e"))
    assert sorted(r.members for r in graph_metrics.cycles(two).collect()) == [["a", "b"], ["c", "d"]]
    assert graph_metrics.cycles(edges(spark, ("a", "b"), ("b", "c"), ("c", "c"))).count() == 0
    assert graph_metrics.cycle_issues(two).where("severity = 'error'").count() == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_distributed_components_equal_the_small_form(spark, seed):
    rnd = random.Random(seed)
    pairs = [(f"n{rnd.randrange(14):02d}", f"n{rnd.randrange(14):02d}") for _ in range(20)]
    e = edges(spark, *pairs)
    small = {tuple(r) for r in graph_metrics.strong_components(e).collect()}
    assert {tuple(r) for r in graph_metrics.strong_components(e, small=0).collect()} == small
    near = {tuple(r) for r in graph_metrics.reachable(e, "n00", small=0).collect()}
    assert near == {tuple(r) for r in graph_metrics.reachable(e, "n00").collect()}


def test_orphans_and_degrees(spark):
    n = nodes(spark, ("orphan.ts", "util", 10, None), ("used.ts", "util", 10, None), ("page.ts", "page", 1, None), ("src/loading.ts", "util", 1, None))
    e = edges(spark, ("index.ts", "used.ts"))
    assert ids(graph.orphans(n, e)) == {"orphan.ts"}
    assert graph.orphan_issues(n, e, spark.createDataFrame([("orphan.ts",)], "id string")).count() == 0
    assert {r.id: (r.fan_in, r.fan_out) for r in graph.with_degrees(n, e).collect()}["used.ts"] == (1, 0)
    assert ids(graph.known_edges(e, n), "source") == set()


def star(spark, centre, kind, fan, language, loc=10):
    n = nodes(spark, (centre, kind, loc, language), *[(f"x{i}", "util", 10, language) for i in range(fan)])
    return n, edges(spark, *[(centre, f"x{i}") for i in range(fan)])


def test_coupling_thresholds(spark):
    assert graph.god_modules(*star(spark, "A", "service", 25, "java")).count() == 0
    assert graph.god_modules(*star(spark, "a", "service", 18, "python")).count() == 1
    assert graph.god_modules(*star(spark, "a", "entry-point", 40, "python")).count() == 0
    assert graph.god_modules(*star(spark, "a", "controller", 22, "python")).count() == 0  # 15 and half as much
    both = graph.god_modules(*star(spark, "a", "service", 25, "typescript", 1200)).collect()
    assert len(both) == 1 and " AND " in both[0].message
    lone = nodes(spark, ("big", "util", 1200, None), *[(f"m{i}", "util", 500, None) for i in range(20)])
    assert graph.god_modules(lone, edges(spark, ("big", "m1"))).count() == 0
    lone = nodes(spark, ("big", "util", 1100, None), *[(f"m{i}", "util", 50, None) for i in range(20)])
    assert graph.god_modules(lone, edges(spark, ("big", "m1"))).count() == 1


def test_median_is_the_upper_element(spark):
    for values, want in (([1, 2, 3, 4], 3), ([5], 5), ([0, 0], 100), ([2, 2, 9], 2)):
        assert graph.upper_median(spark.createDataFrame([(v,) for v in values], "loc int"), "loc", 100).first()[0] == want


def test_patterns_layers_groups_labels(spark):
    n = nodes(spark, ("m", "model", 1, None), ("c", "controller", 1, None), ("v", "component", 1, None))
    assert graph.architecture_pattern(n).first()[0] == "mvc"
    assert graph.architecture_pattern(nodes(spark, ("src/domain/a", "util", 1, None))).first()[0] == "hexagonal"
    assert graph.layer_violations(n, edges(spark, ("m", "v"), ("v", "m"), ("c", "m"))).collect()[0].source == "m"
    g = nodes(spark, *[(f"ui/c{i}", "component", x, None) for i, x in enumerate((50, 30, 40, 35))], *[(f"lib/u{i}", "util", 10, None) for i in range(3)], ("a/x", "hook", 1, None), ("b/y", "hook", 1, None))
    groups = graph.apply_grouping(g)
    info = {r.group_id: r for r in graph.group_info(g, groups).collect()}
    assert (info["auto:ui|component"].total_loc, info["auto:ui|component"].member_count, info["auto:lib|util"].member_count, len(info)) == (155, 4, 3, 2)
    assert graph.apply_grouping(g, threshold=5).count() == graph.apply_grouping(g, threshold=0).count() == 0
    e = edges(spark, ("ui/c0", "lib/u0"), ("ui/c1", "lib/u1"), ("ui/c0", "ui/c1"), ("a/x", "ui/c0"))
    assert {(r.source, r.target, r.weight) for r in graph.group_edges(e, groups).collect()} == {("auto:ui|component", "auto:lib|util", 2), ("a/x", "auto:ui|component", 1)}
    assert ids(graph.group_by_patterns(g, {"one": ["ui/**"], "two": ["*c0"]})) == {f"ui/c{i}" for i in range(4)}
    paths = spark.createDataFrame([("1", "src/app/learn/practice/page.tsx", "page"), ("2", "src/app/quiz/practice/page.tsx", "page"), ("3", "x/only.ts", "only"), ("4", "root.ts", "root")], "id string, file_path string, label string")
    assert {r.id: r.label for r in graph.label_nodes(paths).collect()} == {"1": "learn/practice/page", "2": "quiz/practice/page", "3": "only", "4": "root"}


def test_edges_and_nodes_are_kept_once(spark):
    e = edges(spark, ("a", "b"), ("a", "b"), ("b", "c"))
    assert graph.distinct_edges(e).count() == 2
    n = spark.createDataFrame([("a", "first", 0), ("b", "x", 1), ("a", "last", 2)], "id string, label string, ord long")
    assert [tuple(r) for r in graph.upsert_nodes(n).orderBy("ord").collect()] == [("a", "last", 0), ("b", "x", 1)]


def test_metrics_on_small_graphs(spark):
    n = nodes(spark, *[(x, "util", 1, None) for x in "ABC"])
    chain = edges(spark, ("A", "B"), ("B", "C"))
    rank = {r.id: r["rank"] for r in graph_metrics.pagerank(n, chain).collect()}
    assert rank["C"] > rank["A"] and max(rank.values()) == pytest.approx(1)
    assert {r.id: r.layer for r in graph_metrics.dependency_layers(n, chain).collect()} == {"A": 2, "B": 1, "C": 0}
    assert ids(graph_metrics.articulation_points(n, chain)) == {"B"}
    triangle = edges(spark, ("A", "B"), ("B", "C"), ("C", "A"))
    assert ids(graph_metrics.articulation_points(n, triangle)) == set()
    out = {r.id: r.betweenness for r in graph_metrics.betweenness(n, chain).collect()}
    assert out == {"A": 0, "B": 1, "C": 0}
    assert graph_metrics.pagerank(n.limit(0), chain.limit(0)).count() == 0


def test_communities_with_and_without_seeds(spark):
    tri = [("a1", "a2"), ("a2", "a3"), ("a3", "a1"), ("b1", "b2"), ("b2", "b3"), ("b3", "b1")]
    n = nodes(spark, *[(x, "util", 1, None) for x in ("a1", "a2", "a3", "b1", "b2", "b3")])
    got = {r.id: r.community for r in graph_metrics.communities(n, edges(spark, *tri)).collect()}
    assert len(set(got.values())) == 2 and got["a1"] == got["a3"] != got["b1"]
    seeds = spark.createDataFrame([("a1", 4), ("a2", 4), ("b1", 7), ("b2", 7), ("b3", 7)], "id string, community int")
    got = {r.id: r.community for r in graph_metrics.communities(n, edges(spark, *tri, ("a1", "b1")), seeds).collect()}
    assert got["a3"] == got["a1"] != got["b1"] and len(set(got.values())) == 2


@pytest.mark.parametrize("seed", [3, 4])
def test_cut_nodes_and_betweenness_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    names = [f"n{i:02d}" for i in range(12)]
    pairs = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(16)})
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def parts(without):
        seen, k = set(), 0
        for x in names:
            if x != without and x not in seen and near[x]:
                k, todo = k + 1, [x]
                while todo:
                    y = todo.pop()
                    if y not in seen:
                        seen.add(y)
                        todo += [z for z in near[y] if z != without]
        return k

    lonely = lambda x: sum(1 for y in near[x] if near[y] == {x})  # noqa: E731, F841
    n = nodes(spark, *[(x, "util", 1, None) for x in names])
    want = {x for x in names if parts(x) > parts(None)}
    assert ids(graph_metrics.articulation_points(n, edges(spark, *pairs))) == want


def test_co_change_and_temporal_coupling(spark):
    ch = spark.createDataFrame([(c, p) for c, ps in {"1": "ab", "2": "ab", "3": "abc", "4": "a", "5": "cd"}.items() for p in ps], "commit_id string, path string")
    pairs = {(r.file_a, r.file_b): (r.co_changes, round(r.confidence, 3)) for r in history.co_changes(ch).collect()}
    assert pairs[("a", "b")] == (3, 0.75) and pairs[("c", "d")] == (1, 0.5)
    assert set(pairs) >= {(r.file_a, r.file_b) for r in history.co_changes(ch, 2).collect()} == {("a", "b")}
    given = spark.createDataFrame([("auth", "user", 12, 0.8), ("auth", "config", 5, 0.6), ("auth", "db", 2, 0.3), ("db", "user", 8, 0.7), ("auth", "unknown", 10, 0.9)], "file_a string, file_b string, co_changes int, confidence double")
    n = nodes(spark, *[(x, "util", 1, None) for x in ("auth", "user", "config", "db")])
    e = edges(spark, ("auth", "user"), ("user", "db"))
    assert [(r.file_a, r.file_b) for r in history.temporal_coupling(given, n, e).collect()] == [("auth", "config")]
    assert history.temporal_coupling(given, n, e, 100, 0.99).count() == 0
    assert history.temporal_issues(given).where("severity = 'warning'").count() == 2


def test_bus_factor_and_staleness(spark):
    ch = spark.createDataFrame([("a", "Alice"), ("a", "Alice"), ("b", "Alice"), ("b", "Alice"), ("b", "Bob"), ("b", "Bob")], "path string, author string")
    got = {r.path: r for r in history.bus_factor(ch).collect()}
    assert (got["a"].bus_factor, got["b"].bus_factor, got["a"].top_author) == (1, 2, "Alice")
    assert history.bus_factor_issues(history.bus_factor(ch)).count() == 1
    rows = spark.sql("select 'n' as path, timestamp'2024-01-25' as ts union all select 'm', timestamp'2023-06-01' union all select 'o', timestamp'2022-01-01'")
    got = {r.path: r.stale_level for r in history.staleness(rows, F.lit("2024-02-01").cast("timestamp")).collect()}
    assert got == {"n": "active", "m": "dusty", "o": "abandoned"}


def test_hotspots(spark):
    n = nodes(spark, ("complex", "util", 1, None), ("simple", "util", 1, None), ("never", "util", 1, None))
    c = spark.createDataFrame([("complex", 40), ("simple", 4)], "path string, branches long")
    f = spark.createDataFrame([("complex", 50, 1.0), ("simple", 5, 0.1)], "path string, changes long, frequency double")
    got = history.hotspots(n, c, f, 0.3)
    assert {r.id for r in got.where("is_hotspot").collect()} == {"complex"} and got.count() == 3
    assert history.hotspot_issues(got).first().severity == "error"


def test_state_diff_and_rename(spark):
    table = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = {(r.path, r.previous_path, r.status) for r in enrich.diff_state(table("src/foo.ts", "src/old/helpers.ts", "gone.ts"), table("src/foo.ts", "src/new/helpers.ts", "fresh.ts")).collect()}
    assert got == {("src/foo.ts", "src/foo.ts", "retained"), ("src/new/helpers.ts", "src/old/helpers.ts", "renamed"), ("fresh.ts", None, "added"), (None, "gone.ts", "removed")}


def test_treemap_and_circles():
    rects = layout.squarify([("a", 100), ("b", 60), ("c", 30), ("d", 10), ("zero", 0)], 0, 0, 800, 600)
    assert sum(r[4] * r[5] for r in rects) == pytest.approx(480_000) and len(rects) == 4
    assert all(r[2] >= -1e-9 and r[3] >= -1e-9 and r[2] + r[4] <= 800 + 1e-6 and r[3] + r[5] <= 600 + 1e-6 for r in rects)
    two = layout.squarify([("a", 300), ("b", 100)], 0, 0, 400, 300)
    assert two[0][4] * two[0][5] == pytest.approx(3 * two[1][4] * two[1][5])
    assert layout.squarify([], 0, 0, 1, 1) == []
    circles = layout.pack([(str(i), float(v)) for i, v in enumerate((100, 50, 25, 25, 10, 5, 1))])
    for i, (_, x, y, r) in enumerate(circles):
        for _, a, b, q in circles[i + 1 :]:
            assert ((x - a) ** 2 + (y - b) ** 2) ** 0.5 >= r + q - 1e-6
    draw = layout.mulberry32(1)
    assert all(0 <= draw() < 1 for _ in range(100))


def test_routes_are_whole_walks(spark):
    places = spark.createDataFrame([("a", 0, 0, 1, 2.0, 0), ("b", 3, 2, 1, 4.0, 1)], "id string, grid_x int, grid_y int, tile_size int, importance double, community int")
    r = enrich.routes(places, edges(spark, ("a", "b"), ("b", "a"), ("a", "a"))).collect()
    walks = {(x.source, x.target): [(p.x, p.y) for p in x.points] for x in r}
    assert walks[("a", "b")] == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2)] and walks[("a", "a")] == [(0, 0)]
    assert all(x.importance == 3.0 for x in r if x.source != x.target)
    assert all(x.n_points == len(x.points) for x in r)


def test_length_of_a_route_takes_no_points(spark):
    places = spark.createDataFrame([("a", 0, 0, 1, 2.0, 0), ("b", 900_000_000, -500_000_000, 1, 4.0, 1)], "id string, grid_x int, grid_y int, tile_size int, importance double, community int")
    assert enrich.routes(places, edges(spark, ("a", "b"))).select("n_points").first().n_points == 1_400_000_001
    plan = catalogue.QUERIES["manhattan_paths"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan


def test_react_detectors(spark):
    rows = [("App", "a", ["user"], ["Mid"], [], 0), ("Mid", "m", ["user"], ["Leaf"], [], 1), ("Leaf", "l", ["user"], [], [f"useX{i}" for i in range(16)], 2)]
    comps = spark.createDataFrame(rows, "name string, file_path string, props array<string>, children array<string>, hooks array<string>, ord long")
    assert ["App", "Mid", "Leaf"] in [r.chain for r in graph.prop_drilling(comps).collect()]
    assert [r.type for r in graph.god_components(comps).collect()] == ["high-coupling"]


def test_views_and_exports(spark, tmp_path):
    n = nodes(spark, ("src/a.ts", "util", 10, None), ("src/b.ts", "component", 30, None), ("c.ts", "page", 5, None))
    e = edges(spark, ("src/a.ts", "src/b.ts"), ("src/b.ts", "src/a.ts"))
    issues = graph_metrics.cycle_issues(e).unionByName(graph.orphan_issues(n, e))
    wide = enrich.wide_nodes(n, e, issues).withColumns({"is_hotspot": F.lit(True), "hotspot_score": F.lit(0.8), "complexity": F.lit(1)})
    links = enrich.wide_edges(n, e, graph_metrics.cycles(e))
    assert links.where("is_circular").count() == 2
    shown, only = enrich.view(wide, links, "issues")
    assert shown.count() == 3 and only.count() == 2
    assert enrich.threats(wide, issues).where("type = 'hotspot' and severity = 'error'").count() == 3
    text = [r.value for r in export.mermaid_dependencies(n, links).orderBy("place").collect()]
    assert text[0] == "flowchart LR" and sum("-.->" in t for t in text) == 2
    assert "</script" not in "".join(r.value for r in export.as_json(n.withColumn("label", F.lit("</script>")), e).collect())
    for lines in (export.svg(n, e), export.issue_table(issues), export.markdown(n, e, issues, graph.architecture_pattern(n))):
        export.write(lines, str(tmp_path / "out"))
        assert spark.read.text(str(tmp_path / "out")).count() > 1
    (tmp_path / "proj").mkdir()
    (tmp_path / "proj" / "go.mod").write_text("module x")
    with pytest.raises(ValueError):
        export.write(export.issue_table(issues), str(tmp_path / "proj"))
    assert enrich.health(issues, n).first().score == 33
