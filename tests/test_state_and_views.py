"""State carried on from the last run, hot commits, upserts by parts, drill-down and the import table function."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import udtf
from sparkloom.operators import communities, connected, drilldown, enrich, extract, history, incremental
from sparkloom.streaming import windows


def test_one_commit_of_very_many_files(spark):
    rnd = random.Random(5)
    rows = [("hot", f"f{i:03d}") for i in range(230)] + [(f"c{k}", f"f{rnd.randrange(40):03d}") for k in range(60) for _ in range(4)]
    changes = spark.createDataFrame(rows + rows[:50], "commit_id string, path string")
    for least in (1, 3):
        whole = {tuple(r) for r in history.co_changes(changes, least).collect()}
        assert {tuple(r) for r in history.co_changes(changes, least, block=17).collect()} == whole
    commits = {}
    for c, p in rows:
        commits.setdefault(c, set()).add(p)
    want = {}
    for ps in commits.values():
        for a in ps:
            for b in ps:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(a, b): n for a, b, n, _ in {tuple(r) for r in history.co_changes(changes, 1, block=17).collect()}} == want
    blocks = history._pairs(changes.distinct(), 17)
    assert blocks.count() == sum(len(p) * (len(p) - 1) // 2 for p in commits.values())


def graph(spark, names, pairs):
    return spark.createDataFrame([(x,) for x in names], "id string"), spark.createDataFrame(pairs, "source string, target string")


def test_components_and_communities_after_changes(spark):
    rnd = random.Random(9)
    names = [f"{p}{i}" for p in "abcde" for i in range(6)]
    pairs = [(f"{p}{rnd.randrange(6)}", f"{p}{rnd.randrange(6)}") for p in "abcde" for _ in range(8)]
    n, e = graph(spark, names, pairs)
    home = connected.components(n, e)
    state = communities.communities(n, e)
    later = [x for x in names if x != "e3"] + ["new1", "new2", "new3"]
    changed = [p for p in pairs if "e3" not in p][1:] + [("a0", "b0"), ("new1", "c2"), ("new2", "new3")]
    n2, e2 = graph(spark, later, changed)
    got = incremental.components_after(home, n2, e, e2)
    assert {tuple(r) for r in got.select("id", "component").collect()} == {tuple(r) for r in connected.components(n2, e2).select("id", "component").collect()}
    some = {r.id for r in incremental.touched(home, n2, connected.undirected(e), connected.undirected(e2)).collect()}
    assert {"a0", "b0", "new1", "new2"} <= some and not any(x.startswith("d") for x in some)
    again = incremental.communities_after(state, home, n2, e, e2)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in communities.communities(n2, e2, state).collect()}


def test_upserts_rewrite_only_touched_parts(spark, tmp_path):
    folder = str(tmp_path / "seen")
    rows = lambda *r: spark.createDataFrame(r, "user_id long, event_type string, ts timestamp")
    at = lambda d: __import__("datetime").datetime(2024, 1, d)
    sink = windows.upsert_into(folder, parts=8)
    sink(rows(*[(i, "a", at(5)) for i in range(40)]), 0)
    sink(rows((3, "a", at(2)), (3, "b", at(9))), 1)
    assert len(list((tmp_path / "seen" / "b1").glob("part_of=*"))) == 1
    sink(rows((3, "a", at(2)), (3, "b", at(9))), 1)  # the same batch once more
    sink(rows((3, "b", at(1))), 2)
    got = {(r.user_id, r.event_type): r.first_seen.day for r in windows.read_upserted(spark, folder).collect()}
    assert len(got) == 41 and got[3, "a"] == 2 and got[3, "b"] == 1 and got[4, "a"] == 5
    assert not list((tmp_path / "seen" / "b0").glob(f"part_of={[p.name for p in (tmp_path / 'seen' / 'b2').glob('part_of=*')][0][8:]}"))
    assert windows.read_upserted(spark, str(tmp_path / "none")).count() == 0


def test_drill_down_to_any_depth(spark, monkeypatch):
    files = [("a.ts", 5), ("src/b.ts", 10), ("src/x/c.ts", 20), ("src/x/y/d.ts", 40), ("src/x/y/e.ts", 0), ("lib/f.ts", None)]
    n = spark.createDataFrame(files, "file_path string, loc int")
    got = {r.path: (r.parent, r.depth, r.is_file, r.files, r["loc"]) for r in drilldown.subtrees(n).collect()}
    assert got["src"] == ("", 0, False, 4, 70) and got["src/x"] == ("src", 1, False, 3, 60) and got["src/x/y"] == ("src/x", 2, False, 2, 40)
    assert got["src/x/y/e.ts"] == ("src/x/y", 3, True, 1, 0) and got["a.ts"] == ("", 0, True, 1, 5) and len(got) == 10
    rects = {r.id: r for r in drilldown.drill(n, "src", 100, 50).collect()}
    assert set(rects) == {"src/b.ts", "src/x"} and rects["src/x"].value == 60
    assert sum(r.w * r.h for r in rects.values()) == pytest.approx(5000) and rects["src/x"].w * rects["src/x"].h == pytest.approx(5000 * 6 / 7)
    assert drilldown.drill(n, "nowhere").count() == 0
    monkeypatch.setattr(drilldown, "MOST_CHILDREN", 2)
    assert {r.id for r in drilldown.drill(n).collect()} == {"src", "a.ts", None}
    assert drilldown.crumbs("src/x/y") == ["", "src", "src/x", "src/x/y"] and drilldown.crumbs("") == [""]


SOURCES = {
    "typescript": 'import a from "./a";\nimport {\n b } from "../b"\nconst c = require(\'c\'); export * from "./d"; await import("e")',
    "python": "import os.path\nfrom . import x\nfrom ..a.b import c\n  import no",
    "go": 'import "fmt"\nimport (\n q "a/b"\n "c"\n)',
    "java": "import static a.B;\nimport c.*;",
    "rust": "use crate::a::b;\nmod m;\nuse super::c::d;",
    "csharp": "using System;\nusing static App.X;",
    "php": "use App\\X;\nrequire_once 'a.php'; include('b.php');",
    "ruby": "require 'json'\nrequire_relative '../x'",
    "cobol": "import x",
}


def test_the_table_function_finds_what_the_columns_find(spark):
    udtf.register(spark)
    spark.createDataFrame(list(SOURCES.items()) + [("ruby", None)], "language string, text string").createOrReplaceTempView("sources_")
    got = {(r.language, r.kind, r.spec) for r in spark.sql("SELECT language, kind, spec FROM sources_, LATERAL import_edges(text, language)").collect()}
    want = set()
    for language, text in SOURCES.items():
        found = spark.range(1).select(extract.specifiers(language, F.lit(text)).alias("s")).first().s
        want |= {(language, s.kind, s.spec) for s in found}
    assert got == want and len(got) > 20


def test_lenses_of_the_map(spark):
    rows = [("a", 4, 0, 10, 0.8, True), ("b", 1, 6, 5, 0.2, False), ("c", 0, 0, 0, 0.05, False)]
    wide = spark.createDataFrame(rows, "id string, fan_in int, fan_out int, complexity int, hotspot_score double, is_hotspot boolean")
    threats = spark.createDataFrame([("a", "warning"), ("a", "error"), ("b", "info")], "id string, severity string")
    of = lambda name: {r.id: (r.value, r.alpha) for r in enrich.map_lens(wide, name, threats).collect()}
    assert of("dependencies") == {"a": (0.4, 1.0), "b": (0.7, 1.0), "c": (0.0, 1.0)} and of("complexity")["b"] == (0.5, 1.0)
    assert of("hotspots") == {"a": (1.0, 1.0), "b": (0.25, 1.0), "c": (None, 0.35)}
    assert of("threats") == {"a": (1.0, 1.0), "b": (0.0, 1.0), "c": (None, 0.35)} and of("kingdom")["a"] == (None, 1.0)
    paths = spark.createDataFrame([("a", "b", "import", False), ("b", "c", "import", True), ("c", "b", "temporal", False), ("b", "a", "import", False), ("c", "c", "import", False)], "source string, target string, type string, is_circular boolean")
    issues = spark.createDataFrame([("layering-violation", ["b", "a"]), ("layering-violation", ["c"]), ("orphan", ["c", "c"])], "type string, files array<string>")
    flagged = enrich.flag_violations(paths, issues)
    shown = lambda name: sorted((r.source, r.target) for r in enrich.lens_paths(flagged, wide, name).collect())
    assert shown("threats") == [("b", "a"), ("b", "c"), ("c", "b")] and shown("hotspots") == [("a", "b"), ("b", "a")] and len(shown("kingdom")) == 5
