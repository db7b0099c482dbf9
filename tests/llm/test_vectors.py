"""Vector codes against full search in plain Python, and the filter's bounds."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from sparkloom.llm import vectors


def plain(rows, parts=8, entries=16, rounds=6):
    kept = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(4096 * x) for x in v] for _, v, _ in kept]
    size = len(ints[0]) // parts
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), e) for e, y in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(assign(p, c[p])[1], []).append(c[p])
            for e, xs in mine.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs, strict=True)]
    found = [[assign(p, c[p]) for p in range(parts)] for c in cut]
    return [(k[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), k[2]) for k, f in zip(kept, found, strict=True)], books


SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def test_codes_match_a_full_search(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=16).round(1)], int(i) % 3 if i % 5 else None) for i in range(60)]
    rows += [(2, None, 1), (4, [], 1), (5, [None] * 16, 1), (6, [math.nan] * 16, None), (7, [0.0] * 15 + [math.inf], 2), (None, [0.5] * 16, None), (3, [0.5] * 16, 1), (3, [0.5] * 16, 1)]
    want, books = plain(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = vectors.compress(df).collect()
    total = {}
    for _, _, error, label in want:
        total[label] = total.get(label, 0) + error
    text = ",".join(str(x) for book in books for e in book for x in e)
    import hashlib

    assert sorted(str((r.vec_id, r.code, r.error, r.label_error)) for r in got) == sorted(str((i, c, e, total[label])) for i, c, e, label in want)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(text.encode()).hexdigest()}


def test_few_rows_other_lengths_and_none(spark):
    rows = [(1, [1.0] * 8, 0), (2, [2.0] * 8, 0), (3, [1.0] * 16, 0), (0, [1.0] * 7, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.vec_id, r.code, r.error) for r in vectors.compress(df).collect()) == [(1, "00" * 8, 0), (2, "01" * 8, 0)]
    assert vectors.compress(df.limit(0)).count() == 0 and vectors.compress(df.where("vec_id = 0")).count() == 0
    books = vectors.train(df)
    assert vectors.decode("01" * 8, books).tolist() == [2.0] * 8
    with pytest.raises(Exception, match="64 bits"):
        vectors.compress(spark.createDataFrame([(1, [1e30] * 8, 0)], SCHEMA)).count()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 16), st.integers(1, 5), st.integers(1, 60), st.integers(0, 2**31), st.sampled_from([3, 400]), st.integers(1, 4))
def test_the_filter_changes_nothing(entries, size, rows, seed, spread, bits):
    rng = np.random.default_rng(seed)
    book, x = rng.integers(-spread, spread, (entries, size)), rng.integers(-2 * spread, 2 * spread, (rows, size))
    away = ((x[:, None] - book[None]) ** 2).sum(2)
    cells = vectors.Cells(book, bits)
    lower, upper = cells.bounds(x)
    assert (lower <= away).all() and (away <= upper).all()
    entry, least = cells.nearest(x)
    assert entry.tolist() == away.argmin(1).tolist() and least.tolist() == away.min(1).tolist()


def test_the_filter_leaves_few_candidates():
    rng = np.random.default_rng(1)
    book, x = rng.integers(-2000, 2000, (16, 8)), rng.integers(-2000, 2000, (2000, 8))
    lower, upper = vectors.Cells(book).bounds(x)
    assert (lower <= upper.min(1)[:, None]).mean() < 0.5


def test_slices_of_arrow_lists_keep_their_rows():
    column = pa.array([[9.0] * 8, None, [0.5] * 8, [0.5] * 7, [None] * 8, [0.25] * 8], pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([column], names=["v"]).slice(1, 5)
    rows, x = vectors.integers(batch, 8, 0)
    assert rows.tolist() == [1, 4] and x.tolist() == [[2048] * 8, [1024] * 8]
