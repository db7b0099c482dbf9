"""Line dedup against a plain version, run by run and whole."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from sparkloom.llm import lines


def plain_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(lines.STRIPPED))


def plain(texts, threshold=lines.THRESHOLD):
    split = [(t or "").split("\n") for t in texts]
    held = Counter(k for ls in split for k in {plain_key(x) for x in ls} if k)
    out = []
    for ls in split:
        kept = [x for x in ls if held[plain_key(x)] < threshold]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


AWKWARD = ["", "\n", "\n\n", " \t\x0b\f\r ", "Menu\n\nbody É\n menu \n", "MENU", "menu\nmenu\nmenu", "É\né", "\x00\nmenu\x00", "🎉 menu\r\nmenu\r", "menu"] + [f"menu {i}\n menu \nfoot\r\n" for i in range(12)] + ["foot", "x\nfoot"]


def test_rows_match_a_plain_version(spark, documents, edge):
    df = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text")).unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(AWKWARD)], "doc_id long, text string")).repartition(7)
    rows = [tuple(r) for r in df.collect()]
    want = plain([t for _, t in rows])
    assert sum(d for _, d, _ in want) > 20
    got = lines.dedup(df).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, *w)) for (i, _), w in zip(rows, want, strict=True))
    digests = lines.report(df).collect()
    assert sorted(str(tuple(r)) for r in digests) == sorted(str((i, n, d, hashlib.sha256(k.encode()).hexdigest())) for (i, _), (n, d, k) in zip(rows, want, strict=True))


def test_edges_and_clashing_columns(spark, edge, empty):
    many = edge.withColumns({"n_lines": F.lit("mine"), "r1_": F.lit(1), "h1": F.lit(2), "places_": F.lit(3)})
    for _ in range(2):
        many = many.unionByName(many)
    got = lines.dedup(many, threshold=4)
    assert got.columns == [*many.columns, "n_lines_", "n_dropped"] and got.count() == many.count()
    assert {r.text for r in got.where("k = 4").collect()} == {""}  # the repeated row's only line
    assert lines.dedup(empty).count() == 0 and lines.report(empty).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_every_number_of_batches_gives_the_same(spark):
    texts = [f"a{i % 40}\nb{i % 7}\nc{i % 31}\nonly {i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, *w) for i, w in zip(range(400), plain(texts), strict=True))
    for batches in (1, 2, 5):
        got = lines.dedup(df, batches=batches).select("doc_id", "n_lines", "n_dropped", "text").collect()
        assert sorted(map(tuple, got)) == want


def test_runs_are_levelled_and_leave_out_what_is_frequent(spark):
    runs = lines.Runs(spark, threshold=3, buckets=2)
    sizes = []
    for n in range(5):
        texts = ["hot"] * 4 + [f"new {n}", "slow"] if n else ["hot"] * 4
        runs.add(lines.hashed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), batches=1))
        sizes.append(sorted(runs.levels))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2]]
    counted = Counter(r.n for name in runs.levels.values() for r in spark.table(name).collect())
    assert counted == Counter({4: 1, 3: 1, 1: 4})  # neither key is counted on once a run shows it to be frequent
    assert runs.frequent().count() == 2
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_merging_runs_shuffles_nothing(spark):
    runs = lines.Runs(spark, buckets=4)
    a, b = (runs._written(spark.range(n, n + 500).select(F.col("id").alias("h1"), F.col("id").alias("h2"), F.lit(1).cast("long").alias("n"))) for n in (0, 250))
    both = spark.table(a).join(spark.table(b).withColumnRenamed("n", "m"), lines.HASH, "full")
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
    merged = runs._merged(a, b)
    assert spark.table(merged).agg(F.sum("n"), F.count("*")).first() == (1000, 750)
    runs._drop(merged)
    runs.close()
