"""Resharding and media columns."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import media, reshard


def test_flow_is_cheapest_on_small_cases():
    import itertools

    cost = [[0, 3, 2], [4, 0, 1]]
    got = reshard.min_cost_flow([3, 4], [2, 3, 3], lambda i, j: cost[i][j])
    assert [sum(r) for r in got] == [3, 4]
    spent = sum(cost[i][j] * got[i][j] for i in range(2) for j in range(3))
    best = min(
        sum(cost[0][j] * a[j] + cost[1][j] * b[j] for j in range(3))
        for a in itertools.product(range(4), repeat=3) if sum(a) == 3
        for b in itertools.product(range(5), repeat=3) if sum(b) == 4 and all(x + y <= c for x, y, c in zip(a, b, [2, 3, 3], strict=True))
    )
    assert spent == best


def test_shards_are_even_and_slots_gapless(documents, edge):
    df = documents.select("doc_id", "text", "source")
    rows = reshard.reshard(df, reshard.by_source()).collect()
    size = [0] * 16
    for s in range(16):
        mine = [r for r in rows if r.shard == s]
        size[s] = sum(r["size"] for r in mine)
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
    assert len(rows) == df.count() and max(size) - min(size) <= 0.02 * sum(size) / 16
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    assert reshard.reshard(edge, reshard.by_source()).count() == edge.count()
    assert reshard.reshard(edge.limit(0), reshard.by_source()).count() == 0


@pytest.mark.parametrize(("before", "after"), [(4, 2), (2, 4), (3, 3), (16, 5), (1, 1)])
def test_rewrite_keeps_every_row(spark, documents, edge, before, after, tmp_path, monkeypatch):
    """Shrinks and grows shards with null and repeated keys and clashing columns; rows before are rows after."""
    monkeypatch.setattr(reshard, "FILE_BYTES", 100_000)
    df = documents.select("doc_id", "text", "source").withColumns({"shard": F.pmod(F.xxhash64("source"), F.lit(before)).cast("int"), "file": F.lit("x"), "block": F.lit(None).cast("int")})
    df = df.unionByName(edge.select("doc_id", "text", "source").withColumns({"shard": F.lit(before - 1), "file": F.lit(None).cast("string"), "block": F.lit(3)}))
    folder = f"file://{tmp_path}/new"
    moves = reshard.plan(df, F.col("shard"), after)
    wanted = reshard.rewrite(df, F.col("shard"), moves, folder)
    got, at = reshard.rewritten(df, F.col("shard"), moves, folder)
    assert at not in df.columns and got.columns == [*df.columns, at]
    assert sorted(str(tuple(r)) for r in got.drop(at).collect()) == sorted(str(tuple(r)) for r in df.collect())
    rows = [(r[at], r.shard, len((r.text or "").encode()) + 1) for r in got.collect()]
    assert {a for a, _, _ in rows} <= set(range(after)) and {x for a, o, _ in rows if a != o for x in (a, o)} == wanted
    total, sizes = sum(x for *_, x in rows), {o: sum(x for _, s, x in rows if s == o) for _, o, _ in rows}
    least = sum(max(0, size - (total // after + (o < total % after) if o < after else 0)) for o, size in sizes.items())
    moved, largest = sum(x for a, o, x in rows if a != o), max(m[3] for m in moves)
    assert abs(moved - least) <= 2 * after * largest  # the flow's value, give or take whole blocks
    assert before != 1 or not wanted


@pytest.mark.parametrize("key", [None, 5])
def test_rows_without_keys_or_of_one_key_are_spread(spark, key):
    """A third of the bytes may have no key, or one; the law holds all the same."""
    df = spark.range(1500).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(F.lit(key)).alias("doc_id"), F.concat(F.lit("text "), F.col("id"), F.repeat(F.lit("x"), (F.col("id") % 7 * 100).cast("int"))).alias("text"), F.lit("s").alias("source"))
    rows = reshard.reshard(df, reshard.by_source()).collect()
    size = [sum(r["size"] for r in rows if r.shard == s) for s in range(16)]
    assert len(rows) == 1500 and max(size) - min(size) <= 0.05 * sum(size) / 16
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_an_empty_table_writes_nothing(empty, tmp_path):
    assert reshard.reshard(empty, reshard.by_source(), folder=f"file://{tmp_path}/none").count() == 0


def test_media_round_trip(spark, documents, edge):
    df = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    got = media.media_columns(df).collect()
    want = []
    for i, t in ((r.doc_id, r.text) for r in df.collect()):
        data = (t or "").encode()
        padded = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        want.append(str((i, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))))
    assert sorted(str((r.key, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in got) == sorted(want)
    same = [r for r in got if r.key == 4 and r.n_bytes == 21]
    assert len(same) == 2 and same[0].media_sha256 == same[1].media_sha256 and same[0].feature == same[1].feature
    assert media.media_columns(edge.limit(0)).count() == 0


def test_ranges_cover_every_member_once(spark, documents, tmp_path):
    folder = f"file://{tmp_path}/archives"
    media.store(documents.select("doc_id", "text"), folder)
    small = media.members(spark, folder, range_bytes=10_000, batch_bytes=5_000)
    assert small.count() == documents.count() == small.select("archive", "offset").distinct().count()


def test_a_member_is_retried_by_offset():
    reader = media.MemberReader({"path": "x", "retries": "2"})

    class Flaky:
        left = 1

        def read(self, info):
            if Flaky.left:
                Flaky.left -= 1
                raise OSError("lost")
            return b"ok"

    class Files:
        def open_input_file(self, path):
            return path

    original, media.zipfile.ZipFile = media.zipfile.ZipFile, lambda f: Flaky()
    try:
        assert reader._member(Files(), Flaky(), "p", None) == b"ok"
        Flaky.left = 9
        with pytest.raises(OSError):
            reader._member(Files(), Flaky(), "p", None)
    finally:
        media.zipfile.ZipFile = original


def test_damaged_media_is_refused():
    whole = media.encode(b"abc")
    assert media.decode(whole).tobytes()[:3] == b"abc"
    with pytest.raises(ValueError):
        media.decode(whole[:40] + b"?" + whole[41:])
