"""Exact repeated substrings by column-wise construction of collection suffix orders.

A byte string of SPAN bytes that starts at two places is removed at both.  The
windows of SPAN bytes are dealt to collections by content: a window belongs to
its anchor, the run of GRAM bytes in it with the least hash, so equal windows
meet, at the same distance from equal anchors, and windows whose anchor occurs
once need no more work.  Neighbouring windows of one anchor form one fragment.

A collection's fragments stand aligned at their anchors.  Its suffix order is
built from the last column to the first: each round inserts one symbol of every
fragment, which re-sorts the fragments stably by that symbol, gives the next
segment of the collection's Burrows-Wheeler transform, and updates the common
prefixes of neighbours by range minima over the round before.  Aligned suffixes
of different columns are never compared, since equal windows have equal columns;
so the transform falls into one segment per column.  Segments go to a sequential
file outside memory, from which a second pass reads, column by column, the runs
of neighbours with SPAN bytes in common; a run with two places or more repeats.

The steps over all rows: count anchors; mark the repeated ones in a bit map
sized by their number, up to a bound beyond which more fragments travel; write the places of fragments with a marked anchor; send each task's
distinct fragments to their anchors' collections; join the repeated windows to
the places; cut them from the texts.  An anchor with more than HOT places would
make one large collection; its windows become fragments of their own, dealt by
their own hash, to as many collections as there are tasks.

Edge cases: a null text is an empty one; a text under SPAN bytes loses nothing;
equal rows count as places of their own; null and repeated keys are told apart
by 128 bits of hash of their texts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_folder, new_folder, texts
from .textbatch import U64, mix, slices, span_hashes, utf8

SPAN, GRAM = 200, 32
#: Places of an anchor above which its windows are dealt one by one; fragments built together; least and most bits of a map of anchors.
HOT, CHUNK, LEAST_BITS, MOST_BITS = 200_000, 20_000, 1 << 20, 1 << 29
PIECE = 1 << 16
#: Fragments that a task remembers having sent.
MET = 1 << 20


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on, by doubling from 8 bytes."""
    n = len(raw)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = raw
    h = mix(np.ndarray((n,), np.uint64, padded.data, 0, (1,)))
    size = 8
    while size < GRAM:
        h = mix(h[: len(h) - size] * U64(3) + h[size:])
        size *= 2
    return h[: n - GRAM + 1]


def fragments(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, windows, place of the anchor after the start, anchor) of each fragment; starts count from the slice's first byte."""
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, U64),)
    n, width = len(raw), SPAN - GRAM + 1
    if n < SPAN:
        return none
    h = gram_hashes(raw)
    m = len(h)
    tagged = np.full(-(-m // width) * width, U64(2**64 - 1))
    tagged[:m] = (h & ~U64(0xFFFFFFFF)) | np.arange(m, dtype=U64)
    block = tagged.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - SPAN + 1
    at = (np.minimum(back[:last], ahead[width - 1 : width - 1 + last]) & U64(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[:last]
    whole = np.arange(last) + SPAN <= rows[row + 1]
    first = whole.copy()
    first[1:] &= (at[1:] != at[:-1]) | ~whole[:-1] | (row[1:] != row[:-1])
    start = np.flatnonzero(first)
    edge = np.flatnonzero(first | ~whole)
    after = np.searchsorted(edge, start, side="right")
    end = np.where(after < len(edge), edge[np.minimum(after, len(edge) - 1)], last)
    return row[start], start, end - start, at[start] - start, h[at[start]]


def _refined(raw: np.ndarray, found: tuple, hot: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Fragments of hot anchors as fragments of one window each, with the window's hash as anchor."""
    row, start, windows, anchor_at, anchor = found
    if hot is None or not len(start):
        return found
    split = _has(hot, anchor)
    if not split.any():
        return found
    keep, n = ~split, windows[split]
    begin = np.repeat(start[split] - np.cumsum(n) + n, n) + np.arange(n.sum())
    mine = span_hashes(raw, begin, begin + SPAN)
    one, zero = np.ones(len(begin), np.int64), np.zeros(len(begin), np.int64)
    return tuple(np.concatenate([a[keep], b]) for a, b in zip(found, (np.repeat(row[split], n), begin, one, zero, mine), strict=True))


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & U64(8 * len(bits) - 1)).astype(np.int64)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def bit_map(keys: DataFrame, rows: int) -> np.ndarray | None:
    """Bits of the keys (longs), 16 for each within LEAST_BITS and MOST_BITS; None if there are none."""
    size = min(max(LEAST_BITS, 1 << (16 * max(rows, 1)).bit_length()), MOST_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = (batch.column(0).to_numpy().view(U64) & U64(size - 1)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        used = [k for k in range(0, len(bits), PIECE) if bits[k : k + PIECE].any()]
        yield pa.RecordBatch.from_pydict({"at": pa.array([k // PIECE for k in used], pa.int32()), "bits": pa.array([bits[k : k + PIECE].tobytes() for k in used], pa.binary())})

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, b in zip(batch.column("at").to_pylist(), batch.column("bits"), strict=True):
                data = np.frombuffer(b.as_buffer(), np.uint8)
                sums[at] = sums[at] | data if at in sums else data.copy()
        yield pa.RecordBatch.from_pydict({"at": pa.array(list(sums), pa.int32()), "bits": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    out, any_ = np.zeros(size // 8, np.uint8), False
    for r in keys.mapInArrow(mark, "at int, bits binary").repartition("at").mapInArrow(unite, "at int, bits binary").collect():
        out[r[0] * PIECE : (r[0] + 1) * PIECE] = np.frombuffer(r[1], np.uint8)
        any_ = True
    return out if any_ else None


def count_anchors(df: DataFrame) -> DataFrame:
    """(anchor, n) of the anchors of column t, summed per slice before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                anchor, n = np.unique(fragments(*utf8(part.column(0)))[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n, pa.int32())], names=["anchor", "n"])

    return df.select("t").mapInArrow(run, "anchor long, n int").groupBy("anchor").agg(F.sum("n").alias("n"))


PLACES = "k long, th long, tl long, start int, anchor long, fh long"
PIECES = "anchor long, fh long, windows int, rel int, weight int, bytes binary"


def _marked(part: pa.RecordBatch, maps) -> tuple[np.ndarray, np.ndarray, tuple, np.ndarray]:
    raw, rows = utf8(part.column(3))
    repeated, hot = maps.value
    found = fragments(raw, rows)
    keep = _has(repeated, found[4])
    found = _refined(raw, tuple(x[keep] for x in found), hot)
    return raw, rows, found, span_hashes(raw, found[1], found[1] + found[2] + SPAN - 1)


def places(df: DataFrame, maps) -> DataFrame:
    """Where each fragment with a marked anchor stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                _, rows, (row, start, _, _, anchor), fh = _marked(part, maps)
                row_of = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(row_of) for i in range(3)), pa.array(start - rows[row], pa.int32()), pa.array(anchor.view(np.int64)), pa.array(fh.view(np.int64))], names=[c.split()[0] for c in PLACES.split(", ")])

    return df.mapInArrow(run, PLACES)


def pieces(df: DataFrame, maps) -> DataFrame:
    """The distinct marked fragments of each task, with their bytes, and a second row without bytes for those that a task meets again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, bool] = {}
        for batch in batches:
            for part in slices(batch, "t"):
                raw, _, (_, start, windows, rel, anchor), fh = _marked(part, maps)
                name = mix(anchor) ^ fh
                _, first, n = np.unique(name, return_index=True, return_counts=True)
                fresh, again = [], []
                for x, i, k in zip(name[first].tolist(), first.tolist(), n.tolist(), strict=True):
                    told = met.get(x)
                    if told is None:
                        fresh.append(i)
                        met[x] = k > 1
                        if k > 1:
                            again.append(i)
                    elif not told:
                        again.append(i)
                        met[x] = True
                if len(met) > MET:  # what is forgotten is sent with its bytes once more
                    met.clear()
                take = np.array(fresh + again, np.int64)
                data = [raw[start[i] : start[i] + windows[i] + SPAN - 1].tobytes() for i in fresh] + [None] * len(again)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[take].view(np.int64)), pa.array(fh[take].view(np.int64)), pa.array(windows[take], pa.int32()), pa.array(rel[take], pa.int32()), pa.array(np.ones(len(take)), pa.int32()), pa.array(data, pa.binary())],
                    names=[c.split()[0] for c in PIECES.split(", ")],
                )

    return df.mapInArrow(run, PIECES)


class Rounds:
    """The sequential file of a construction: order, transform symbols and common prefixes of each column."""

    def __init__(self, rows: int):
        self.rows, self.file = rows, tempfile.TemporaryFile()

    def append(self, order: np.ndarray, symbols: np.ndarray, common: np.ndarray) -> None:
        for part in (order.astype(np.int32), symbols, common):
            self.file.write(part.tobytes())

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self.file.seek(0)
        while part := self.file.read(self.rows * 6):
            yield np.frombuffer(part, np.int32, self.rows), np.frombuffer(part, np.uint8, self.rows, 4 * self.rows), np.frombuffer(part, np.uint8, self.rows, 5 * self.rows)


def construct(texts: np.ndarray, group: np.ndarray, columns: int, span: int = SPAN) -> Rounds:
    """Suffix order, transform and common prefixes (up to span) of aligned rows, column by column from the right.

    texts: one row of bytes per fragment, rows of a group together.  Segments of
    the first `columns` columns are kept, the highest column first.
    """
    n, width = texts.shape
    out, order, common = Rounds(n), np.arange(n), np.zeros(n + 1, np.int64)
    by_column = np.ascontiguousarray(texts.T)
    rank = group.astype(np.int64) << 8
    for t in range(width - 1, -1, -1):
        symbol = by_column[t]
        key = rank[order] | symbol[order]
        step = np.argsort(key, kind="stable")
        key = key[step]
        fresh = np.zeros(n + 1, np.int64)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        low, high = step[same - 1] + 1, step[same] + 1
        least = common[high - 1]
        far = np.flatnonzero(high - low > 1)
        if len(far):
            ends = np.empty(2 * len(far), np.int64)
            ends[::2], ends[1::2] = low[far], high[far]
            least[far] = np.minimum.reduceat(common, ends)[::2]
        fresh[same] = np.minimum(least + 1, span)
        order, common = order[step], fresh
        if t < columns:
            out.append(order, by_column[t - 1][order] if t else np.zeros(n, np.uint8), common[:n].astype(np.uint8))
    return out


def repeated_windows(rows: list[tuple[int, int, int, int, int, bytes | None]]) -> list[tuple[int, int, list[int]]]:
    """(anchor, fh, window runs as start, end, start, end ...) of the fragments with windows that stand in two places or more."""
    weight: dict[tuple[int, int], int] = {}
    shape: dict[tuple[int, int], tuple[int, int, bytes]] = {}
    for anchor, fh, windows, rel, w, data in rows:
        weight[anchor, fh] = weight.get((anchor, fh), 0) + w
        if data is not None:
            shape[anchor, fh] = (windows, rel, data)
    names = sorted(shape)
    if not names:
        return []
    windows = np.array([shape[x][0] for x in names])
    rel = np.array([shape[x][1] for x in names])
    begin = rel.max() - rel
    texts = np.zeros((len(names), int((begin + windows).max()) + SPAN - 1), np.uint8)
    for i, x in enumerate(names):
        data = shape[x][2]
        texts[i, begin[i] : begin[i] + len(data)] = np.frombuffer(data, np.uint8)
    group = np.unique([x[0] for x in names], return_inverse=True)[1]
    many = np.array([weight[x] for x in names])
    columns = int((begin + windows).max())
    hit = np.zeros((len(names), int(windows.max()) + 2), bool)
    for back, (order, _, common) in enumerate(construct(texts, group, columns)):
        t = columns - 1 - back
        run = np.cumsum(common < SPAN) - 1
        here = (begin[order] <= t) & (t < begin[order] + windows[order])
        total = np.bincount(run, weights=np.where(here, many[order], 0))
        found = order[here & (total[run] >= 2)]
        hit[found, t - begin[found] + 1] = True
    out = []
    for i in np.flatnonzero(hit.any(1)):
        edges = np.flatnonzero(hit[i][1:] != hit[i][:-1])
        out.append((*names[i], edges.tolist()))
    return out


def repeats(parts: DataFrame) -> DataFrame:
    """Builds each collection in turn, some collections together, and returns their repeated windows."""

    def emit(rows: list) -> pa.RecordBatch:
        got = repeated_windows(rows)
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.list_(pa.int32()))], names=["anchor", "fh", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= CHUNK and row[0] != held[-1][0]:
                    yield emit(held)
                    held = []
                held.append(row)
        if held:
            yield emit(held)

    return parts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, fh long, runs array<int>")


OUTPUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut(joined: DataFrame, with_text: bool = False) -> DataFrame:
    """From (k, t, spans as struct(start, runs)) to the contract's columns, and the text that is left if asked for."""
    schema = OUTPUT + (", kept binary" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist(), strict=True):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                ranges = sorted((s["start"] + a, s["start"] + b - 1 + SPAN) for s in spans or [] for a, b in zip(s["runs"][::2], s["runs"][1::2], strict=True))
                kept, at, n = [], 0, 0
                for a, b in ranges:
                    if n == 0 or a > at:
                        n += 1
                        kept.append(data[at:a])
                    at = max(at, b)
                left = b"".join([*kept, data[at:]])
                out.append((k, len(data), len(data) - len(left), n, hashlib.sha256(left).hexdigest(), left)[: 5 + with_text])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 + with_text]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in schema.split(", ")])

    return joined.mapInArrow(run, schema)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes if asked for)."""
    spark = df.sparkSession
    docs = texts(df).select(F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("th"), F.xxhash64(F.lit(7), text).alias("tl"), F.col(text).alias("t"))
    folder = new_folder(spark, "anchors")
    count_anchors(docs).where("n > 1").write.parquet(folder)
    anchors = spark.read.schema("anchor long, n long").parquet(folder)
    none = np.zeros(LEAST_BITS // 8, np.uint8)
    repeated = bit_map(anchors.select("anchor"), anchors.count())
    hottest = anchors.where(F.col("n") > hot)
    many = bit_map(hottest.select("anchor"), hottest.count())
    drop_folder(spark, folder)
    maps = spark.sparkContext.broadcast((none if repeated is None else repeated, many))
    windows = repeats(pieces(docs, maps))
    found = places(docs, maps).join(windows, ["anchor", "fh"]).groupBy("k", "th", "tl").agg(F.collect_set(F.struct("start", "runs")).alias("spans"))
    found = found.withColumnsRenamed({"k": "_k", "th": "_th", "tl": "_tl"})
    joined = docs.join(found, F.col("k").eqNullSafe(F.col("_k")) & (F.col("th") == F.col("_th")) & (F.col("tl") == F.col("_tl")), "left").select("k", "t", "spans")
    return cut(joined, with_text)
