"""Similarity classes and repeated substrings against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import components as components_module
from sparkloom.llm import bpe, decontaminate, ngram_join, quality, suffix_dedup
from sparkloom.llm.components import components


def plain_set(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def plain_classes(rows, k=3, percent=90):
    """(id, size, component) by comparing all pairs that share anything."""
    by_set = defaultdict(list)
    for i, t in rows:
        by_set[plain_set(t, k)].append(i)
    keys = [s for s in by_set if s]
    root = list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for n, s in enumerate(keys):
        for g in s:
            holders[g].append(n)
    for n, s in enumerate(keys):
        for m in {m for g in s for m in holders[g] if m < n}:
            both = len(s & keys[m])
            if 100 * both >= percent * (len(s) + len(keys[m]) - both):
                root[find(n)] = find(m)
    least = defaultdict(list)
    for n, s in enumerate(keys):
        least[find(n)] += [i for i in by_set[s] if i is not None]
    named = {s: min(least[find(n)], default=None) for n, s in enumerate(keys)}
    return sorted(str((i, len(plain_set(t, k)), named[plain_set(t, k)] if plain_set(t, k) else i)) for i, t in rows)


def families(seed, n=6, size=40):
    """Groups of near copies around the threshold, with a passage that all share."""
    rnd = random.Random(seed)
    shared = " ".join(f"s{i}" for i in range(30))
    out = []
    for f in range(n):
        base = [f"f{f}w{i}" for i in range(120)]
        for _ in range(size):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
                words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
            out.append(" ".join(words) + (f" {shared}" if rnd.random() < 0.5 else ""))
    return out


@pytest.mark.parametrize(("block", "width", "percent"), [(4, 3, 90), (2048, 3, 90), (8, 5, 80)])
@pytest.mark.parametrize("by_keys", [True, False])
def test_classes_equal_brute_force(spark, documents, edge, block, width, percent, by_keys, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    if not by_keys:  # the prefix join alone
        monkeypatch.setattr(ngram_join.Join, "by_keys", lambda join: join.verified(spark.createDataFrame([], "a binary, b binary, na int, nb int")))
    made = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(families(block))], "doc_id long, text string")
    df = documents.select("doc_id", "text").unionByName(made).unionByName(edge.selectExpr("doc_id + 50000 as doc_id", "text"))
    rows = [tuple(r) for r in df.collect()]
    assert sorted(str(tuple(r)) for r in ngram_join.classify(df, width=width, percent=percent).collect()) == plain_classes(rows, width, percent)


def test_one_row_of_each_class_stays(spark, edge):
    made = spark.createDataFrame([(i, t) for i, t in enumerate(families(1, 2, 10))], "doc_id long, text string")
    kept = {r.doc_id for r in ngram_join.one_of_each(made).collect()}
    assert kept == {r.component_id for r in ngram_join.classify(made).collect()}
    out = ngram_join.one_of_each(edge)
    assert out.columns == edge.columns and out.where("doc_id is null").count() == 1
    assert ngram_join.classify(edge.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [1, 7, 1 << 20])
def test_components_of_random_links(spark, rows, monkeypatch):
    monkeypatch.setattr(components_module, "ROWS", rows)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3" if rows < 10 else batch)
    rnd = random.Random(5)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(700, i) for i in range(620, 680)]
    got = dict((r.node, r.component) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert got == {x: find(x) for x in root}


def plain_dedup(rows, span=200):
    places = defaultdict(list)
    data = [(t or "").encode() for _, t in rows]
    for r, d in enumerate(data):
        for i in range(len(d) - span + 1):
            places[d[i : i + span]].append((r, i))
    gone = [bytearray(len(d)) for d in data]
    for at in places.values():
        if len(at) > 1:
            for r, i in at:
                gone[r][i : i + span] = b"\1" * span
    out = []
    for (k, _), d, g in zip(rows, data, gone, strict=True):
        kept = bytes(x for x, y in zip(d, g, strict=True) if not y)
        out.append(str((k, len(d), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def repetitive(seed):
    rnd = random.Random(seed)
    base = "".join(rnd.choice("abcdef é") for _ in range(3000))
    out = ["ab" * 400, "a" * 700, base[:199], base[:200], base[100:300], base[:900] + "x" + base[901:], base, None, "", base[500:699] + "q" + base[700:900]]
    for _ in range(12):
        a = rnd.randrange(2500)
        out.append("".join(rnd.choice("uvw") for _ in range(rnd.randrange(50))) + base[a : a + rnd.randrange(150, 500)] + "".join(rnd.choice("xyz") for _ in range(rnd.randrange(50))))
    return out + [base, base]


@pytest.mark.parametrize("hot", [3, 200_000])
def test_removed_bytes_equal_brute_force(spark, documents, hot):
    made = [(10_000 + i // 2, t) for i, t in enumerate(repetitive(hot))]
    df = documents.select("doc_id", "text").where("length(text) < 6000").unionByName(spark.createDataFrame([*made, (None, "ab" * 150), (None, "cd" * 150)], "doc_id long, text string"))
    rows = [tuple(r) for r in df.collect()]
    got = suffix_dedup.dedup(df, hot=hot)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_dedup(rows)


def test_rows_of_one_key_are_told_apart(spark):
    """Two equal texts and a third whose 32-bit hash is theirs, all without a key."""
    text = F.concat(F.lit("x" * 100), *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(i)), 256) for i in range(3)])
    texts = spark.range(200_000).select(text.alias("text"))
    one, other = texts.groupBy(F.hash("text").alias("h")).agg(F.collect_set("text").alias("t")).where("size(t) > 1").first().t[:2]
    rows = [(None, one), (None, one), (None, other), (1, other[:150])]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_dedup(rows)
    assert sorted(r.n_removed for r in got) == [0, 0, len(one), len(one)]


def test_dedup_edges(edge):
    assert suffix_dedup.dedup(edge.limit(0)).count() == 0
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert sorted(str(tuple(r)) for r in suffix_dedup.dedup(edge).collect()) == plain_dedup(rows)


def test_construction_is_a_suffix_order_per_column():
    rng = np.random.default_rng(2)
    texts = rng.integers(97, 99, (40, 12)).astype(np.uint8)
    group = np.sort(rng.integers(0, 4, 40))
    for back, (order, symbols, common) in enumerate(suffix_dedup.construct(texts, group, 12, span=6)):
        t = 11 - back
        keys = [(group[i], texts[i, t:].tobytes()) for i in order]
        assert keys == sorted(keys)
        for x in range(1, 40):
            a, b = keys[x - 1], keys[x]
            want = 0 if a[0] != b[0] else next((k for k in range(len(a[1])) if a[1][k] != b[1][k]), len(a[1]))
            assert common[x] == min(want, 6)
        assert t == 0 or (symbols == texts[order, t - 1]).all()


def test_few_rows_are_a_literal(spark):
    from sparkloom.llm import shared

    rows = spark.range(5).select(F.col("id").alias("token"), F.lit(True).alias("hot"), F.when(F.col("id") > 0, F.col("id").cast("int")).alias("blocks"))
    for df in (rows, rows.limit(0)):
        got = shared.few(df)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "LocalRelation" in plan and "RDD" not in plan  # no Python workers to read it
        assert got.schema == df.schema and got.collect() == df.collect()


def test_more_than_few_rows_are_shuffled(spark, monkeypatch):
    from sparkloom.llm import shared

    monkeypatch.setattr(shared, "FEW", 4)
    rows = spark.range(5)
    assert shared.few(rows) is rows


def test_a_block_is_looked_at_in_little_memory():
    """All pairs of a block of near copies: it once took 532 MB."""
    import tracemalloc

    n = ngram_join.BLOCK
    rng = np.random.default_rng(3)
    maps = np.repeat(rng.integers(-(2**62), 2**62, (1, ngram_join.MAP_WORDS)), n, axis=0)
    maps[np.arange(n), rng.integers(0, ngram_join.MAP_WORDS, n)] ^= 1 << rng.integers(0, 60, n)
    name = pa.array([rng.bytes(16) for _ in range(n)], pa.binary())
    same = lambda x, kind: pa.array(np.full(n, x), kind)
    columns = {"token": same(7, pa.int64()), "i": same(0, pa.int32()), "j": same(0, pa.int32()), "side": same(2, pa.int32()), "c": name, "n": same(500, pa.int32()), "pos": same(0, pa.int32()), "label": pa.nulls(n, pa.int64()), "maps": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * ngram_join.MAP_WORDS, pa.int32()), pa.array(maps.ravel()))}
    batch = pa.RecordBatch.from_pydict(columns)
    tracemalloc.start()
    try:
        (found,) = ngram_join.forest(iter([batch]), 90, False)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.num_rows == n - 1 and peak < 250 << 20, peak >> 20


def test_the_join_hands_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(ngram_join, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_pydict({"t": ["a b c d"] * 5})
    assert sum(p.num_rows for p in ngram_join.slices(batch, "t")) == 5 and calls == [1]


@pytest.mark.parametrize("stage", ["quality", "decontaminate", "bpe"])
def test_stages_hand_memory_back(stage, monkeypatch):
    """What a stage maps over the batches, taken from it and run here."""
    import importlib

    module = importlib.import_module(f"sparkloom.llm.{stage}")
    calls, taken = [], []
    monkeypatch.setattr(module, "give_back", lambda: calls.append(1))

    class Rows:
        """As much of a table as a stage asks for."""

        columns, schema = ["text"], None
        sparkSession = property(lambda self: self)
        sparkContext = property(lambda self: self)
        broadcast = staticmethod(lambda value: type("Sent", (), {"value": value}))
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: taken.append(run) or self

    monkeypatch.setattr(module, "texts", lambda df: df)
    batch = pa.RecordBatch.from_pydict({"text": ["some words of a text"] * 5})
    if stage == "quality":
        none = np.empty(0)
        quality.keep(Rows(), quality.Model(none, none, 0.5, none, np.zeros(quality.BUCKETS, np.float32), 0.0))
    elif stage == "decontaminate":
        monkeypatch.setattr(decontaminate, "blocks_of", lambda *_: [decontaminate.Items([1], ["an item of some five words"])])
        decontaminate.clean(Rows(), None)
    else:
        monkeypatch.setattr(bpe.F, "col", lambda name: type("Column", (), {"cast": lambda self, _: self, "alias": lambda self, _: self})())
        bpe.encode_table(Rows())
        batch = pa.RecordBatch.from_pydict({"k": pa.array(range(5), pa.int64()), "t": batch.column(0)})
    assert sum(b.num_rows for b in taken[0](iter([batch, batch]))) == 10 and len(calls) == 2
