"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, n=2):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, n=2, least=20, percent=25, seed=7):
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    have, want = (Counter(bucket(g) for t in ts for g in grams(t, n)[1]) for ts in ([t for _, t in rows], target))
    size, aim = sum(have.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (size + 10000) / ((have[b] + 1) * (aim + 10000))))
    out = []
    for i, t in rows:
        words, found = grams(t, n)
        weight = sum(gain(bucket(g)) for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    may = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(may[: percent * len(may) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


AWKWARD = ["É é É 漢字 漢字 x1 X1", "a" * 3000, "one", "one two", "A_b-c\x00d\x7fe", "\n\n", "🎉🎉 🎉🎉", "word " * 19, "word " * 20, "Word\tword " * 40]


def test_rows_match_a_plain_version(spark, documents, edge):
    df = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text")).unionByName(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(AWKWARD)], "doc_id long, text string")).repartition(5)
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows, aim = [tuple(r) for r in df.collect()], [r.text for r in target.collect()]
    got = [tuple(r) for r in resample.resample(df, target).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain(rows, aim)))


@pytest.mark.parametrize("n", [1, 3])
def test_other_lengths_and_targets(spark, documents, n):
    df = documents.select("doc_id", "text").limit(40)
    rows = [tuple(r) for r in df.collect()]
    got = resample.resample(df, df.limit(0), n=n, percent=100).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows, [], n=n, percent=100)))


def test_equal_rows_and_edges(spark, edge, empty):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit(1).alias("rank"), F.lit(2).alias("k")).repartition(9)
    got = resample.resample(df, df.limit(1)).collect()
    assert len(got) == 400 and sorted(r.rank for r in got if r.rank) == list(range(1, 101)) and len({r.score for r in got}) == 1
    assert resample.resample(edge, edge).count() == edge.count() and resample.resample(empty, edge).count() == 0


def test_ranks_run_through_many_partitions(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("score"))
    got = resample.ranked(rows, [F.desc("score"), F.col("doc_id")], 4000).collect()
    want = sorted(((r.doc_id, r.score) for r in got), key=lambda r: (-r[1], r[0]))
    place = {r.doc_id: r.rank for r in got}
    assert [place[i] for i, _ in want] == [*range(1, 4001), *[None] * 1000]


def test_a_slice_hashes_each_tuple_once(monkeypatch):
    import pyarrow as pa

    seen = []
    monkeypatch.setattr(resample.zlib, "crc32", lambda b: seen.append(b) or len(b))
    row, bucket = resample.Coded(pa.array(["b a b a b", None, "a b", "b"])).buckets()
    assert sorted(seen) == [b"a", b"a b", b"b", b"b a"] and len(row) == len(bucket) == 9 + 3 + 1
