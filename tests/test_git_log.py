"""The git log source against the text reader, in ranges of any size, with filters and as a stream; headers with state."""

import itertools
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import gitlog, listing, project
from sparkloom.streaming import logs

SIZE = itertools.cycle([1, 3, 0, 2])


def log_text(n, first=0):
    out = []
    for i in range(first, first + n):
        day = 28 - i % 28
        out.append(f"commit {i:040x}|||Ann {'|||' if i % 5 == 0 else 'é'} B|||2024-{12 - i // 28:02d}-{day:02d}T10:00:00+02:00\n")
        out += [f"src/d{i % 4}/f{k}.ts\n" for k in range(i % 4)] + ["\n"] * (i % 3) + (['"docs/a b.md"\r\n'] if i % 7 == 0 else [])
    return "".join(out)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text(log_text(60), encoding="utf-8")
    (tmp_path / "logs" / "b.log").write_text(log_text(20, 60), encoding="utf-8")
    (tmp_path / "logs" / ".hidden").write_text("commit x|||y|||2024-01-01T00:00:00Z\nz\n")
    return str(tmp_path / "logs")


def rows(df):
    return sorted((r.commit_id, r.path) for r in df.collect())


def want(n=80):
    out = []
    for i in range(n):
        out += [(f"{i:040x}", f"src/d{i % 4}/f{k}.ts") for k in range(i % 4)] + ([(f"{i:040x}", "docs/a b.md")] if i % 7 == 0 else [])
    return sorted(out)


@pytest.mark.parametrize("size", [1, 37, 1000, 1 << 20])
def test_every_range_gives_each_commit_once(folder, size):
    reader = gitlog.LogReader({"path": folder, "rangebytes": str(size)})
    got = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert sorted((r["commit_id"], r["path"]) for r in got) == want()
    assert {r["author"] for r in got} == {"Ann ||| B", "Ann é B"}


def test_filters_and_order_are_pushed_down(spark, folder):
    since = "2024-11-20T00:00:00+00:00"
    whole = gitlog.git_log(spark, folder, range_bytes=300)
    late = rows(whole.where(F.col("ts") >= F.lit(since).cast("timestamp")))
    assert rows(gitlog.git_log(spark, folder, since=since, range_bytes=300)) == late and 0 < len(late) < len(want())
    assert rows(gitlog.git_log(spark, folder, under="docs/")) == [r for r in want() if r[1].startswith("docs/")]
    every = gitlog.LogReader({"path": folder, "rangebytes": "300"}).partitions()
    pruned = gitlog.LogReader({"path": folder, "rangebytes": "300", "since": since, "ordered": "true"})
    assert len(every) == 30 and len(pruned.partitions()) == 15
    assert sorted((r["commit_id"], r["path"]) for part in pruned.partitions() for b in pruned.read(part) for r in b.to_pylist()) == late
    taken = gitlog.git_log(spark, folder).where((F.col("ts") >= F.lit(since).cast("timestamp")) & F.col("path").startswith("src/d1") & (F.col("author") == "Ann é B"))
    assert rows(taken) == [r for r in late if r[1].startswith("src/d1") and int(r[0], 16) % 5]
    filters = taken._jdf.queryExecution().executedPlan().toString().split("Filter", 1)[1].split("\n")[0]
    assert "author" in filters and "StartsWith(path" not in filters  # Spark itself filters only what the source gave back


def test_pushed_filters_are_taken_or_given_back():
    reader = gitlog.LogReader({"path": "/x"})
    left = list(reader.pushFilters([gitlog.GreaterThanOrEqual(("ts",), datetime(2024, 1, 1)), gitlog.StringStartsWith(("path",), "src/"), gitlog.EqualTo(("path",), "src/a"), gitlog.EqualTo(("author",), "x")]))
    assert [f.attribute for f in left] == [("path",), ("author",)] and reader.under == ["src/", "src/a"] and reader.since.year == 2024


def test_nothing_to_read(spark, tmp_path):
    assert gitlog.git_log(spark, str(tmp_path)).count() == 0
    (tmp_path / "x.log").write_text("no header\nhere\n")
    assert gitlog.git_log(spark, str(tmp_path)).count() == 0


def test_a_stream_reads_what_is_appended(spark, tmp_path):
    source = tmp_path / "logs"
    source.mkdir()
    file, sink = source / "a.log", str(tmp_path / "out")

    def run():
        stream = gitlog.git_log_stream(spark, str(source), range_bytes=200)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(sink).awaitTermination(120)
        return rows(spark.read.parquet(sink))

    file.write_text(log_text(30), encoding="utf-8")
    assert run() == want(30)
    with file.open("a", encoding="utf-8") as f:
        f.write(log_text(30, 30))
    (source / "b.log").write_text(log_text(20, 60), encoding="utf-8")
    assert run() == want(80) == rows(gitlog.git_log(spark, str(source)))


def test_a_log_that_became_shorter_is_an_error():
    with pytest.raises(ValueError):
        gitlog.LogStream({"path": "/x"}).partitions({"files": '{"a": 9}'}, {"files": '{"a": 3}'})


def test_headers_are_carried_over_batches(spark, tmp_path):
    lines = []
    for file in "xyz":
        text = ("orphan\n" if file == "z" else "") + log_text(12)
        lines += [(file, n, v) for n, v in enumerate(text.split("\n"))]
    schema = "file string, line_no long, value string"
    cuts = [0, 7, 8, 30, len(lines)]
    source, sink = tmp_path / "in", str(tmp_path / "out")
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        # of each file a part of its lines, in any order within a batch
        rows_ = [r for f in "xyz" for r in [x for x in lines if x[0] == f][a:b]]
        spark.createDataFrame(rows_[::-1], schema).coalesce(1).write.parquet(str(source / str(k)))
        stream = logs.carry_headers(spark.readStream.schema(schema).parquet(str(source / "*")))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(sink)
        try:  # timers by the clock run batches without end, so there is no waiting for the last one
            end = time.time() + 60
            while sum(p.numInputRows for p in query.recentProgress) < len(rows_) and time.time() < end and not query.exception():
                time.sleep(0.2)
            assert not query.exception()
        finally:
            query.stop()
    whole = project.carry_headers(spark.createDataFrame(lines, schema))
    got = sorted((r.commit_id, r.path) for r in spark.read.parquet(sink).collect())
    assert got == sorted((r.commit_id, r.path) for r in whole.collect()) and len(got) > 20


def test_a_tree_is_listed_without_content(spark, tmp_path):
    for name, text in {"a.ts": "x", "empty.ts": "", "src/b.ts": "y", "src/deep/none.py": "", "node_modules/m/c.ts": "z", "src/node_modules/e.ts": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    every = {r.path: r.n_bytes for r in listing.listed(spark, str(tmp_path)).collect()}
    assert every == {"a.ts": 1, "empty.ts": 0, "src/b.ts": 1, "src/deep/none.py": 0, "node_modules/m/c.ts": 1, "src/node_modules/e.ts": 0}
    kept = {r.path for r in listing.listed(spark, str(tmp_path), project.pruned_folder(F.col("path"))).collect()}
    assert kept == {"a.ts", "empty.ts", "src/b.ts", "src/deep/none.py"}
    tree = project.read_tree(spark, str(tmp_path))
    scanned = {r.path: r.text for r in project.scan(tree).collect()}
    assert scanned == {"a.ts": "x", "empty.ts": "", "src/b.ts": "y", "src/deep/none.py": ""}
    assert {r.path for r in project.scan(project.read_tree(spark, str(tmp_path), focus="src")).collect()} == {"src/b.ts", "src/deep/none.py"}
    with pytest.raises(Exception):
        listing.listed(spark, str(tmp_path / "missing")).count()
