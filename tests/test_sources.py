"""Sources, classification, extraction, scans and streams on literal inputs."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import rules, text
from sparkloom.operators import extract, security
from sparkloom.plans import analyze, catalogue, project_queries
from sparkloom.sources import project
from sparkloom.streaming import windows

CLASSES = {
    "internal/services/user.go": "service", "pkg/utils/hash.go": "util", "src/db/user_repo.rs": "repository", "database/migrations/001_create.php": "migration", "src/users.test.ts": "test",
    "src/hooks/useAuth.ts": "hook", "src/lib/useThing.ts": "hook", "src/user.controller.ts": "controller", "src/user.controller.spec.ts": "test", "api/user.proto": "schema", "src/pages/home.ts": "page",
    "src/pages/components/x.tsx": "component", "src/app/layout.tsx": "layout", "src/main.ts": "entry-point", "main.ts": "entry-point", "README.md": "unknown", "src/Widget.vue": "component", "app/views.py": "view",
}


def test_path_and_content_rules(spark):
    got = {r.p: r.t for r in spark.createDataFrame([(p,) for p in CLASSES], "p string").select("p", rules.classify_path(F.col("p")).alias("t")).collect()}
    assert got == CLASSES
    sources = {"@Controller('x')": "controller", "class A extends Model {}": "model", "router.get('/')": "controller", "nothing": "unknown", "": "unknown", "\n" * 151 + "@Entity": "unknown"}
    got = {r.p: r.t for r in spark.createDataFrame([(p,) for p in sources], "p string").select("p", rules.classify_content(F.col("p")).alias("t")).collect()}
    assert got == sources


def column(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_scalar_functions(spark):
    assert column(spark, "a\n\n \t\nb\u00a0", text.loc) == 2 and column(spark, "\u00a0\n\ufeff", text.loc) == 0 and column(spark, None, text.loc) == 0
    assert column(spark, "src/x/index.ts", text.module_name) == "x" and column(spark, "src/x/foo.bar.ts", text.module_name) == "foo.bar"
    assert column(spark, "a/./b/../../../c", text.normalise) == "c"
    assert column(spark, "A.TSX", text.language_of) == "typescript" and column(spark, "x.md", text.language_of) is None
    assert column(spark, '  password = "abcdefghi"', text.redact) == "password = [redacted]"
    assert column(spark, "x" * 61, text.shorten) == "x" * 57 + "..."
    assert column(spark, "-a.b/c-", text.identifier) == "a_b_c"
    assert text.glob_to_regex("src/**/*.ts") == r"src/.*/[^/]*\.ts"


@pytest.mark.parametrize(("source", "language", "n"), [("a && b || c && d", "typescript", 3), ('// if\n/* for */ "while"', "typescript", 0), ("", "typescript", 0), ("if x:\n  pass\nelif y and z:\n  pass", "python", 3), ('"' + "x" * 200_000 + '"', "go", 0)])
def test_branches(spark, source, language, n):
    assert column(spark, source, lambda c: text.branches(c, F.lit(language))) == n


def scan_one(spark, source, language="javascript", path="src/a.js", kind="util"):
    df = spark.createDataFrame([(path, language, kind, source)], "path string, language string, module_type string, text string")
    return security.issues(df).collect()


def test_security_rules(spark):
    found = scan_one(spark, 'const password = "supersecretpass123";')
    assert [(i.type, i.severity) for i in found] == [("security-secret", "error")] and "supersecret" not in found[0].message
    for quiet in ("readonly password: string;", 'token = "abc"', '// password = "realSecretValue123"', "// eval(x)", "/* eval(x) */", "import { evaluate } from 'x'"):
        assert scan_one(spark, quiet) == []
    assert len(scan_one(spark, "eval(x)")) == len(scan_one(spark, "eval(x)", "python", "a.py")) == 1 and scan_one(spark, "eval(x)", "go", "a.go") == []
    assert scan_one(spark, "subprocess.run(cmd, shell=True)", "python", "a.py")[0].severity == "error"
    assert scan_one(spark, "el.innerHTML = x") and not scan_one(spark, "function esc(s) {}\nel.innerHTML = x")
    for path, kind in (("a.test.js", "test"), ("x.d.ts", "util"), ("src/__fixtures__/a.js", "util"), ("src/security-scanner.ts", "util")):
        assert scan_one(spark, "eval(x)", path=path, kind=kind) == []
    assert scan_one(spark, "eval(x)\n" + "y" * 100_001) == []
    assert "(+2 more)" in scan_one(spark, "\n".join(["eval(x)"] * 5))[0].message


FILES = {
    "src/App.tsx": 'import { Header } from "./components/Header";\nimport { useAuth } from "@/hooks/useAuth";\nexport default function App() {\n  const user = useAuth();\n  return <div><Header title="x"/></div>;\n}\n',
    "src/components/Header.tsx": 'import util from "../util.js";\ninterface HeaderProps {\n  title: string;\n  sub?: number;\n}\nexport const Header = ({ title }: HeaderProps) => {\n  const [s, set] = useState(0);\n  return <h1>{title}</h1>;\n};\n',
    "src/hooks/useAuth.ts": 'const x = require("../util");\nexport const useAuth = () => fetch("/api");\n',
    "src/util.ts": "export default 1;\n",
    "pkg/__init__.py": "", "pkg/a.py": "from .b import x\nimport pkg.c.deep\nfrom pkg import a\n", "pkg/b.py": "import os\n", "pkg/c.py": "",
    "cmd/main.go": 'package main\nimport (\n  "example.com/m/store"\n  "fmt"\n)\n', "store/s.go": "package store\n", "store/t.go": "package store\n",
    "src/main.rs": "mod net;\nuse crate::db::pool::Pool;\n", "src/net.rs": "use super::x;\n", "src/db/pool.rs": "",
    "j/A.java": "package com.x;\nimport com.x.B;\nimport static java.util.List;\n", "j/B.java": "package com.x;\n",
    "c/A.cs": "using My.Space;\nnamespace Other;\n", "c/B.cs": "namespace My.Space { }\n", "c/C.cs": "namespace My.Space;\n",
    "p/a.php": "<?php\nuse App\\Models\\User;\nrequire_once '../p/inc.php';\n", "p/User.php": "<?php\nnamespace App\\Models;\n", "p/inc.php": "",
    "lib/app/u.rb": "", "r.rb": 'require "app/u"\nrequire_relative "lib/app/u"\n',
}


@pytest.fixture(scope="module")
def files(spark):
    rows = [(p, t, None, i) for i, (p, t) in enumerate(sorted(FILES.items()))]
    df = spark.createDataFrame(rows, "path string, text string, language string, ord long")
    return df.withColumn("language", text.language_of(F.col("path"))).cache()


def test_imports_of_all_languages(files):
    got = {(r.source, r.target) for r in extract.import_edges(files, project.path_aliases({}, True), "example.com/m").collect()}
    assert got == {
        ("src/App.tsx", "src/components/Header.tsx"), ("src/App.tsx", "src/hooks/useAuth.ts"), ("src/components/Header.tsx", "src/util.ts"), ("src/hooks/useAuth.ts", "src/util.ts"),
        ("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/c.py"), ("pkg/a.py", "pkg/__init__.py"), ("cmd/main.go", "store/s.go"), ("src/main.rs", "src/net.rs"), ("src/main.rs", "src/db/pool.rs"),
        ("j/A.java", "j/B.java"), ("c/A.cs", "c/B.cs"), ("c/A.cs", "c/C.cs"), ("p/a.php", "p/User.php"), ("p/a.php", "p/inc.php"), ("r.rb", "lib/app/u.rb"),
    }


SCRIPTS = ("a.ts", "a.tsx", "a.js", "b.js", "b/index.ts", "c/index.jsx", "c/index.cjs", "d.jsx", "d.tsx", "e.js.ts", "e.ts", "f.mjs", "x.js/index.tsx", "odd.TS", "g.cjs", "lib/a.ts", "src/lib/a.js", "src/n.ts")


def _tried(base):
    """Paths of a script base in the order of trying."""
    ends = list(extract.SCRIPT_EXTENSIONS)
    source = [base[:-3] + e for e in (".ts", ".tsx")] if base.endswith(".js") else [base[:-4] + ".tsx"] if base.endswith(".jsx") else []
    return [base, *[base + e for e in ends], *source, *[f"{base}/index{e}" for e in ends]]


def test_scripts_are_found_in_the_order_of_trying(spark):
    specs = ["a", "a.js", "a.jsx", "a.ts", "b", "b.js", "c", "d", "d.jsx", "d.js", "e", "e.js", "e.ts", "f", "f.js", "x", "x.js", "odd", "odd.TS", "g", "b/index", "c/index", "none", ".."]
    rows = [(f"main{i}.ts", f'import x from "{"./" if s != ".." else ""}{s}";', i) for i, s in enumerate(specs)]
    rows += [("bare.ts", 'import x from "lib/a";\nimport y from "@/n.js";', 90), *[(p, "", 100 + i) for i, p in enumerate(SCRIPTS)]]
    df = spark.createDataFrame(rows, "path string, text string, ord long")
    got = {(r.source, r.target) for r in extract.import_edges(df, extract.Aliases([("@/", ["gone/", "src/"])], "src")).collect()}
    there = {r[0] for r in rows}
    want = {(f"main{i}.ts", next((p for p in _tried("" if s == ".." else s) if p in there), None)) for i, s in enumerate(specs)}
    assert got == {w for w in want if w[1]} | {("bare.ts", "src/lib/a.js"), ("bare.ts", "src/n.ts")}


def test_generated_rows_are_not_broadcast(spark):
    for name in ("import_edges_javascript", "import_resolution", "import_edges_php", "import_edges_python", "import_edges_rust"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan, name


@pytest.mark.parametrize("name, scans", [("import_resolution", 4), ("import_edges_php", 2), ("import_edges_python", 2), ("import_edges_rust", 2)])
def test_files_are_read_once_for_their_keys(spark, name, scans):
    # Once for what they import and once for the keys they are found by, not once more for each kind of key.
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == scans


def test_a_file_of_few_bytes_is_dealt_to_many_tasks(spark):
    files = project_queries._files(spark, "/root/testdata/sf0.001", *project_queries.LANGUAGES["rust"][:2])
    assert files.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_the_last_file_of_a_key_counts_and_of_go_the_first(spark):
    rows = [("a/x.go", "package a"), ("a/y.go", "package a"), ("j/A.java", "package p;"), ("k/A.kt", "package p"), ("lib/r.rb", ""), ("r.rb", ""), ("q.php", "namespace N;"), ("m/q.php", "namespace N;"), ("c.cs", "namespace S"), ("d.cs", "namespace S"), ("src/n.rs", ""), ("src/n/mod.rs", ""), ("t.py", ""), ("t/__init__.py", ""), ("s.ts", ""), ("s.TXT", "")]
    df = spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(rows)], "path string, text string, ord long")
    got = sorted((r.kind, r.key, r.target) for r in extract.keys_of(df).where("kind <> 'script'").collect())
    want = [("go", "a", "a/x.go"), ("java", "p", "k/A.kt"), ("java", "p.A", "k/A.kt"), ("php", "N", "m/q.php"), ("php", "N\\q", "m/q.php"), ("csharp", "S", "c.cs"), ("csharp", "S", "d.cs")]
    want += [("include", "m/q.php", "m/q.php"), ("include", "q.php", "q.php"), ("python", "t", "t/__init__.py"), ("crate", "crate::n", "src/n/mod.rs")]
    want += [(k, p, p) for k in ("mod", "super") for p in ("src/n.rs", "src/n/mod.rs")] + [("ruby", "r", "r.rb"), ("ruby", "lib/r", "lib/r.rb"), *[("ruby_relative", p, p) for p in ("lib/r.rb", "r.rb")]]
    assert got == sorted(want)
    assert {(r.key, r.target, r.place) for r in extract.keys_of(df).where("kind = 'script'").collect()} == {("s.ts", "s.ts", 0), ("s", "s.ts", 1), ("s.js", "s.ts", 7)}


def test_a_base_is_tried_by_one_key(spark):
    spec = spark.createDataFrame([("script", "lib/a", "m.ts")], "kind string, spec string, path string")
    keys = spec.select(extract.candidates(F.col("kind"), F.col("spec"), F.col("path"), extract.Aliases([("lib/", ["x/", "y/"])], "src"), None).alias("keys")).first().keys
    assert keys == ["x/a", "y/a", "src/lib/a", "lib/a"]


def test_components_and_flows(files):
    comps = {r.name: r for r in extract.components(files).collect()}
    assert set(comps) == {"App", "Header"} and comps["App"].hooks == ["useAuth"] and comps["App"].children == ["Header"] and comps["App"].is_default_export
    assert [(p.name, p.is_required) for p in comps["Header"].props] == [("title", True), ("sub", False)]
    assert {(r.source, r.target) for r in extract.render_edges(extract.components(files)).collect()} == {("src/App.tsx", "src/components/Header.tsx")}
    assert {(r.component_name, r.type) for r in extract.data_flows(files).collect()} == {("Header", "local-state"), ("Header", "props")}


def test_user_parsers(spark):
    extract.register_parser("lua", (".lua",), lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"load\('([^']+)'\)"), F.lit(1)), lambda s: F.struct(F.lit("script").alias("kind"), s.alias("spec"))))
    try:
        df = spark.createDataFrame([("a.lua", "load('./b')", 0), ("b.ts", "", 1)], "path string, text string, ord long")
        assert [(r.source, r.target) for r in extract.import_edges(df).collect()] == [("a.lua", "b.ts")]
    finally:
        extract.PARSERS.clear()


def test_tree_scan_and_whole_analysis(spark, tmp_path):
    for p, t in {**FILES, "node_modules/x/i.js": "", "src/x.d.ts": "", "package.json": '{"dependencies": {"react": "1"}}', "tsconfig.json": '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"],}}}'}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(t)
    tree = project.read_tree(spark, str(tmp_path))
    full = set(FILES)
    assert {r.path for r in project.scan(tree).collect()} == full
    assert {r.path for r in project.scan(tree, 0).collect()} == {"r.rb"}
    langs = [r.language for r in project.languages(tree).collect()]
    assert langs[0] in ("python", "typescript") and "javascript" in langs
    assert project.has_typescript(tree).first()[0]
    a = analyze.analyze_tree(spark, str(tmp_path))
    assert a.nodes.count() == len(full) and a.edges.where("type = 'renders'").count() == 1
    assert a.issues.where("type = 'circular-dependency'").count() == 0 and a.pattern.first()[0] in ("mvc", "layered", "modular", "hexagonal")
    wide, links = analyze.wide(a)
    assert wide.count() == len(full) and links.count() == a.edges.count()
    with pytest.raises(Exception):
        analyze.analyze_tree(spark, str(tmp_path / "nowhere"))


def test_project_facts(spark):
    assert project.frameworks({"package.json": '{"dependencies": {"next": "1", "react": "1"}}', "requirements.txt": "Django==4\nflask"}) == ["nextjs", "django", "flask"]
    assert project.primary_framework(["express", "react"]) == "react" and project.primary_framework([]) == "unknown"
    assert project.parse_jsonc('\ufeff{"a": "//x", /* c */ "b": [1, 2,],}') == {"a": "//x", "b": [1, 2]} and project.parse_jsonc("{") is None
    assert project.group_config("{")[2] and project.group_config('{"groups": {"a": ["x"]}}')[0] == {"a": ["x"]}
    pats = project.ignore_patterns("*.log\n/dist/\n!keep.log\n# c\n")
    rows = {r.p: r.i for r in spark.createDataFrame([("a/x.log",), ("dist/y",), ("b/dist/y",), ("keep.log",)], "p string").select("p", project.ignored_by(F.col("p"), pats).alias("i")).collect()}
    assert rows == {"a/x.log": True, "dist/y": True, "b/dist/y": False, "keep.log": False}
    names = ["src/app/page.tsx", "src/index.ts", "x/manage.py", "cmd/main.go", "src/a.ts"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r.id for r in project.entry_points(df).collect()} == {"src/index.ts", "x/manage.py"} | {"cmd/main.go"}
    assert "src/app/page.tsx" in {r.id for r in project.entry_points(df, "nextjs").collect()}


def test_history_source(spark, tmp_path):
    (tmp_path / "log").write_text("commit 1|||Ann|||2024-01-02T03:04:05+00:00\n\na.ts\nb/c.ts\ncommit 2|||Bo|||2024-02-02T03:04:05+00:00\n\na.ts\n")
    rows = project.parse_log(project.read_log(spark, str(tmp_path / "log"))).collect()
    assert sorted((r.commit_id, r.author, r.path) for r in rows) == [("1", "Ann", "a.ts"), ("1", "Ann", "b/c.ts"), ("2", "Bo", "a.ts")]
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(["commit x", "a", "", "commit y", "b"])], "file string, line_no int, value string")
    assert sorted(tuple(r) for r in project.carry_headers(lines).collect()) == [("x", "a"), ("y", "b")]


def test_state_table(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert project.load_state(spark, folder) is None
    now = F.lit("2024-01-01").cast("timestamp")
    rows = spark.createDataFrame([("a", 1, 2, 0, "plains")], "path string, grid_x int, grid_y int, community int, biome string")
    first = project.next_state(None, rows, now)
    assert not first.first().is_new
    project.save_state(first.drop("is_new"), folder)
    more = rows.unionByName(spark.createDataFrame([("b", 3, 4, 0, "plains")], rows.schema))
    second = {r.path: r for r in project.next_state(project.load_state(spark, folder), more, F.lit("2024-06-01").cast("timestamp")).collect()}
    assert second["b"].is_new and not second["a"].is_new and second["a"].first_seen.year == 2024 and second["a"].first_seen.month == 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text('{"version": 2, "path": "a"}')
    assert project.load_state(spark, str(tmp_path / "bad")) is None


def test_streams_agree_with_tables(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name)

    got = {tuple(r) for r in run(windows.counts(stream, "1 day"), "daily", "complete").select("start", "event_type", "n").collect()}
    assert got == {tuple(r) for r in windows.counts(events, "1 day").select("start", "event_type", "n").collect()}
    assert run(windows.without_repeats(stream), "once", "append").count() == events.select("event_id").distinct().count()
    new = run(windows.track_new(stream), "fresh", "append")
    assert {(r.user_id, r.event_type, r.first_seen) for r in new.collect()} == {tuple(r) for r in windows.first_seen(events).collect()}
    stream.writeStream.foreachBatch(windows.upsert_into(str(tmp_path / "seen"))).option("checkpointLocation", str(tmp_path / "c_seen")).trigger(availableNow=True).start().awaitTermination(120)
    assert windows.read_upserted(spark, str(tmp_path / "seen")).count() == windows.first_seen(events).count()
