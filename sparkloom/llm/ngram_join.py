"""Grouped prefix join: classes of documents by Jaccard similarity of word shingles, exact.

Shingles are hashed to 64 bits and put in one global order, rare before common,
by a count sketch of the whole table.  Two sets of similarity t share a shingle
among the first n - ceil(t n) + 1 of each.

1. Documents with equal sets are one class (two 64-bit sums of mixed hashes).
2. Classes that share a min-wise key are compared with the key's most common
   class, one comparison for each class and key.  Whatever is linked here, and it
   is most of what can be, needs no further comparison among itself.
3. Classes with equal prefix and size are one group.  Only groups are indexed by
   their prefix shingles.  Groups on one shingle are paired if their sizes and
   the places of the shingle allow the similarity and they are not linked yet;
   the members of those that find a partner are expanded.
4. Members on one shingle are paired by the same bounds and by parity maps, whose
   Hamming distance no difference of sets can fall below.  A shingle of more than
   BLOCK members is dealt in pairs of blocks, in which ids, sizes, places and
   parity maps travel, never sets.  Each task returns a spanning forest of what
   it finds, likeliest links first.
5. Those pairs are verified on whole sets.  Where one of a forest's pairs proves
   too far apart, all remaining pairs between the parts are verified.
6. Links give components by alternating stars.

So no table of all pairs exists, a common shingle spreads over tasks and nothing
is capped.  What is broadcast is the sketch and a bit map, sized by a count up to
a fixed bound; beyond it more rows are shuffled and results are the same.

Edge cases: a null or empty text, or one of blanks, has no shingles and is a
component of its own; fewer words than a shingle make one shingle of all words;
equal rows share a component; null ids do not become a component's id unless
all its ids are null; an empty table gives no rows; other columns are not read
by `classify` and pass through `one_of_each`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import compact, few, fresh, settle, texts
from .textbatch import BLANK, LOWER, U64, distinct_by_row, give_back, mix, shingle_hashes, span_hashes, utf8, word_spans
from .textbatch import slices as _slices

#: Words of a shingle; least similarity in hundredths.
WIDTH, PERCENT = 3, 90
#: Buckets of the sketch, dealt in rows of ROW bytes; least and most bits of the map of wanted rows.
BUCKETS, ROW, LEAST_BITS, MOST_BITS = 1 << 22, 1 << 16, 1 << 20, 1 << 29
#: Min-wise keys of a class, 64-bit words of its parity map, members of a block, rows and pairs that a task looks at together.
KEYS, MAP_WORDS, BLOCK, ROWS, PAIRS = 3, 8, 2048, 1 << 16, 1 << 18
#: Pairs whose parity maps a task compares at a time.
LOOKS = 1 << 15
#: Bytes of text that a task hashes at a time; what it makes of them takes many times as much.
SLICE = 1 << 18


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of SLICE bytes; what they took goes back to the system after each batch."""
    yield from _slices(batch, text, SLICE)
    give_back()


def sets_of(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row, sizes): the distinct shingle hashes of each row, ascending."""
    raw, rows = utf8(column)
    raw = LOWER[raw]
    starts, ends, row = word_spans(raw, rows, BLANK)
    hashes, row = distinct_by_row(*shingle_hashes(span_hashes(raw, starts, ends), row, len(column), width))
    return hashes, row, np.bincount(row, minlength=len(column))


def signatures(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """A 128-bit signature of each row's set, as 16 bytes."""
    out = np.zeros((n, 2), ">u8")
    for k, salt in enumerate((0x51ED270B, 0x7FEB352D)):
        total = np.concatenate([[U64(0)], np.cumsum(mix(hashes ^ U64(salt * 0x100000001)))])
        at = np.searchsorted(row, np.arange(n + 1))
        out[:, k] = mix(total[at[1:]] - total[at[:-1]] + U64(k))
    return out


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - (-(-n * percent // 100)) + (n > 0)


def _smallest(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def sketch(df: DataFrame, text: str, width: int) -> np.ndarray:
    """How many shingles of the table fall in each bucket, up to 2 ** 32 - 1; never less than any one of its shingles has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for part in slices(batch, "t"):
                raw, rows = utf8(part.column(0))
                raw = LOWER[raw]
                starts, ends, row = word_spans(raw, rows, BLANK)
                hashes, _ = shingle_hashes(span_hashes(raw, starts, ends), row, part.num_rows, width)
                np.add.at(total, (hashes & U64(BUCKETS - 1)).astype(np.int64), 1)
        parts = [_smallest(total[k : k + ROW]).tobytes() for k in range(0, BUCKETS, ROW)]
        from pyspark import TaskContext

        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(parts)), pa.int32()), "salt": pa.array([TaskContext.get().partitionId() // 32] * len(parts), pa.int32()), "n": pa.array(parts, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, n in zip(batch.column("at").to_pylist(), batch.column("n"), strict=True):
                sums[at] = np.minimum(sums.get(at, 0) + _counts(n.as_buffer()).astype(np.int64), 2**32 - 1)
        yield pa.RecordBatch.from_pydict({"at": pa.array(list(sums), pa.int32()), "salt": pa.array([0] * len(sums), pa.int32()), "n": pa.array([_smallest(s).tobytes() for s in sums.values()], pa.binary())})

    schema = "at int, salt int, n binary"
    rows = df.select(F.col(text).alias("t")).mapInArrow(count, schema)
    rows = rows.repartition("at", "salt").mapInArrow(add, schema).repartition("at").mapInArrow(add, schema)
    out = np.zeros(BUCKETS, np.uint32)
    for r in rows.select("at", "n").collect():  # BUCKETS counts in all
        out[r[0] * ROW : (r[0] + 1) * ROW] = _counts(r[1])
    return out


def _counts(data) -> np.ndarray:
    return np.frombuffer(data, {ROW: np.uint8, 2 * ROW: np.uint16, 4 * ROW: np.uint32}[len(data)])


def parity_maps(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """MAP_WORDS longs a row: bit by bit, whether the set has an odd number of shingles there.  Two sets differ in as many shingles as their maps in bits, at least."""
    size = 64 * MAP_WORDS
    odd = np.bincount(row * size + ((hashes >> U64(40)) % U64(size)).astype(np.int64), minlength=n * size) & 1
    return np.packbits(odd.reshape(n, size).astype(bool), axis=1, bitorder="little").view(np.int64)


def prefixes(df: DataFrame, key: str, text: str, width: int, percent: int, counts) -> DataFrame:
    """Per row: id, n, c (signature of the set), g (signature of prefix and size), prefix in global order and how many of it are surely rarer than BLOCK, min-wise keys, parity map, and how common its shingles are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts.value
        for batch in batches:
            for part in slices(batch, "t"):
                rows = part.num_rows
                hashes, row, n = sets_of(part.column(1), width)
                sig = signatures(hashes, row, rows)
                maps = parity_maps(hashes, row, rows)
                seen = count[(hashes & U64(BUCKETS - 1)).astype(np.int64)]
                common = np.bincount(row, weights=np.log2(seen + 1.0), minlength=rows) / np.maximum(n, 1)
                keys = np.zeros((rows, KEYS), np.int64)
                some = np.flatnonzero(n)
                for k in range(KEYS if len(some) else 0):
                    keys[some, k] = np.minimum.reduceat(mix(hashes ^ U64(0xA24BAED4963EE407 + k)), (np.cumsum(n) - n)[some]).view(np.int64)
                order = np.lexsort((hashes, seen, row))
                hashes, row, seen = hashes[order], row[order], seen[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                head = place < prefix_length(n, percent)[row]
                group = signatures(hashes[head] + U64(1), row[head], rows)
                group[:, 0] ^= mix(n.astype(U64) + U64(17))
                at = np.searchsorted(row[head], np.arange(rows + 1)).astype(np.int32)
                rare = np.bincount(row[head][seen[head] < BLOCK], minlength=rows)
                cols = [
                    part.column(0),
                    pa.array(n, pa.int32()),
                    *(pa.array([s.tobytes() for s in x], pa.binary()) for x in (sig, group)),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(hashes[head].view(np.int64))),
                    pa.array(rare, pa.int32()),
                    *(pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (keys, maps)),
                    pa.array(common),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in BASE.split(", ")])

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, BASE)


BASE = "doc_id long, n int, c binary, g binary, prefix array<long>, rare int, keys array<long>, maps array<long>, common double"


def bit_map(keys: DataFrame, rows: int) -> np.ndarray:
    """A map with the bit of each key (column `rep`) set, of 16 bits a row within LEAST_BITS and MOST_BITS; tasks make their own and only whole maps' parts meet."""
    size = min(max(LEAST_BITS, 1 << (16 * max(rows, 1)).bit_length()), MOST_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        used = False
        for batch in batches:
            at = _bit(batch.column(0), size)
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
            used = used or batch.num_rows > 0
        parts = range(0, len(bits), ROW) if used else []
        full = [k for k in parts if bits[k : k + ROW].any()]
        yield pa.RecordBatch.from_pydict({"at": pa.array([k // ROW for k in full], pa.int32()), "bits": pa.array([bits[k : k + ROW].tobytes() for k in full], pa.binary())})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, b in zip(batch.column("at").to_pylist(), batch.column("bits"), strict=True):
                data = np.frombuffer(b.as_buffer(), np.uint8)
                sums[at] = sums[at] | data if at in sums else data.copy()
        yield pa.RecordBatch.from_pydict({"at": pa.array(list(sums), pa.int32()), "bits": pa.array([s.tobytes() for s in sums.values()], pa.binary())})

    out = np.zeros(size // 8, np.uint8)
    for r in keys.select("rep").mapInArrow(mark, "at int, bits binary").repartition("at").mapInArrow(join, "at int, bits binary").collect():  # size in all
        out[r[0] * ROW : (r[0] + 1) * ROW] = np.frombuffer(r[1], np.uint8)
    return out


def _bit(keys: pa.Array, size: int) -> np.ndarray:
    return (mix(keys.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(U64) + U64(29)) & U64(size - 1)).astype(np.int64)


def _marks(keys: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Whether the bit of each key is set."""
    at = _bit(keys, 8 * len(bits))
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)


def sets(df: DataFrame, key: str, text: str, width: int, wanted) -> DataFrame:
    """(c, tokens) of the rows whose key's bit is set: one row of each wanted class, and perhaps a few more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(pa.array(_marks(batch.column(0), wanted.value))), "t"):
                hashes, row, n = sets_of(part.column(1), width)
                sig = [s.tobytes() for s in signatures(hashes, row, part.num_rows)]
                first = {sig[i]: i for i in reversed(np.flatnonzero(n).tolist())}
                take = sorted(first.values())
                keep = np.isin(row, take)
                at = np.concatenate([[0], np.cumsum(n[take])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([sig[i] for i in take], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(hashes[keep].view(np.int64)))], names=["c", "tokens"])

    return df.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "c binary, tokens array<long>").dropDuplicates(["c"])


def whole_runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """The batches, sorted by their first `by` columns, in tables of about ROWS rows that do not cut a run of equal ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            rows = pa.Table.from_batches(held).combine_chunks()
            start = np.flatnonzero(_run_starts(rows, by))[-1]
            if start:
                yield rows.slice(0, start)
            held = rows.slice(start).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _run_starts(rows: pa.Table, by: int) -> np.ndarray:
    first = np.zeros(rows.num_rows, bool)
    first[:1] = True
    for k in range(by):
        x = rows.column(k).to_numpy()
        first[1:] |= x[1:] != x[:-1]
    return first


def pairs_within(ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All x < y < ends[x], about PAIRS at a time; ends[x] is where x's run ends."""
    count = ends - np.arange(len(ends)) - 1
    total = np.concatenate([[0], np.cumsum(count)])
    first = 0
    while first < len(ends):
        last = max(first + 1, int(np.searchsorted(total, total[first] + PAIRS, side="right")) - 1)
        x = np.repeat(np.arange(first, last), count[first:last])
        if len(x):
            yield x, np.arange(len(x)) - np.repeat(total[first:last] - total[first], count[first:last]) + x + 1
        first = last


def _run_ends(first: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero(first)
    return np.append(starts[1:], len(first))[np.cumsum(first) - 1]


def able(n: np.ndarray, pos: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes allow the similarity, and places do if this is the first shingle that x and y share."""
    nx, ny = n[x], n[y]
    return (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & ((percent + 100) * np.minimum(nx - pos[x], ny - pos[y]) >= percent * (nx + ny))


def partnered(index: DataFrame, percent: int) -> DataFrame:
    """(token, g, pos) of the groups that have a partner on the token, by size and place, that is not linked to them yet; hot tokens pass whole."""
    schema = "token long, g long, pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cold(hot: list) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                flag = batch.column(4)
                hot.append(out(batch.filter(flag)))
                yield batch.filter(pa.compute.invert(flag))

        def out(rows) -> pa.RecordBatch:
            pos = (rows.column(2).to_numpy() >> 1 & 0x7FFFFFFF).astype(np.int32)
            cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows.column(0), rows.column(1))]
            return pa.RecordBatch.from_arrays([*cols, pa.array(pos)], names=["token", "g", "pos"])

        hot: list[pa.RecordBatch] = []
        for rows in whole_runs(cold(hot), 1):
            while hot:
                yield hot.pop()
            meta = rows.column(2).to_numpy()
            n, pos, several = meta >> 32, meta >> 1 & 0x7FFFFFFF, (meta & 1).astype(bool)
            label, linked = rows.column(3).fill_null(0).to_numpy(), rows.column(3).is_valid().to_numpy()
            keep = several & (pos == 0)
            for x, y in pairs_within(_run_ends(_run_starts(rows, 1))):
                fit = able(n, pos, x, y, percent) & ~(linked[x] & linked[y] & (label[x] == label[y]))
                keep[x[fit]] = keep[y[fit]] = True
            yield out(rows.filter(pa.array(keep)))
        yield from hot

    return index.mapInArrow(run, schema)


def forest(batches: Iterator[pa.RecordBatch], percent: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, na, nb) of members of one token and pair of blocks that sizes, places and parity maps allow and that are not linked yet.

    batches: token, i, j, side (2 where both blocks are the same), c, n, pos, label, maps, sorted by token, i, j.
    All such pairs if `whole`, else a spanning forest of them, the smallest differences first.
    """
    for rows in whole_runs(batches, 3):
        side, n, pos = (rows.column(k).to_numpy().astype(np.int64) for k in (3, 5, 6))
        name = np.frombuffer(b"".join(rows.column(4).to_pylist()), ">u8").reshape(-1, 2)
        order = np.lexsort((name[:, 1], name[:, 0]))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (name[order][1:] != name[order][:-1]).any(1)
        who = np.empty(len(order), np.int64)
        who[order] = np.cumsum(fresh) - 1
        one = order[fresh]  # a row of each class
        size = n[one]
        label = rows.column(7).fill_null(0).to_numpy()[one]
        linked = rows.column(7).is_valid().to_numpy()[one]
        maps = rows.column(8).combine_chunks().flatten().to_numpy().view(U64).reshape(-1, MAP_WORDS)[one]
        found = [np.empty(0, np.int64)]
        for x, y in pairs_within(_run_ends(_run_starts(rows, 3))):
            fit = able(n, pos, x, y, percent) & ((side[x] == 2) | (side[x] != side[y]))
            a, b = who[x[fit]], who[y[fit]]
            a, b = np.minimum(a, b), np.maximum(a, b)
            apart = (a != b) & ~(linked[a] & linked[b] & (label[a] == label[b]))
            key = np.unique(a[apart] * len(one) + b[apart])
            a, b = np.divmod(key, len(one))
            found.append(key[_slack(maps, size, a, b, percent) >= 0])
        a, b = np.divmod(np.unique(np.concatenate(found)), len(one))
        if not whole:
            a, b = _spanning(a, b, _slack(maps, size, a, b, percent) / (size[a] + size[b]), np.where(linked, label, 0), linked)
        names = [one[k] for k in (a, b)]
        pick = [rows.column(4).combine_chunks().take(pa.array(k)) for k in names]
        yield pa.RecordBatch.from_arrays([*pick, pa.array(size[a], pa.int32()), pa.array(size[b], pa.int32())], names=["a", "b", "na", "nb"])
        give_back()


def _slack(maps: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Of each pair of sets, below 0 if their parity maps show that they differ too much; LOOKS pairs at a time, as a map is many times a pair."""
    apart = np.empty(len(a), np.int64)
    for k in range(0, len(a), LOOKS):
        part = slice(k, k + LOOKS)
        apart[part] = np.bitwise_count(maps[a[part]] ^ maps[b[part]]).sum(axis=1, dtype=np.int64)
    both = size[a] + size[b]
    return (100 + percent) * (both - apart) - 2 * percent * both


def _spanning(a: np.ndarray, b: np.ndarray, slack: np.ndarray, label: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, those that join something new, most slack first; nodes of one label are joined before."""
    root = np.arange(len(label))
    if linked.any():
        _, first, at = np.unique(label[linked], return_index=True, return_inverse=True)
        root[linked] = np.flatnonzero(linked)[first][at]
    order, keep = np.argsort(-slack, kind="stable"), []
    for k in range(0, len(order), 1 << 14):
        while (root[root] != root).any():
            root = root[root]
        part = order[k : k + (1 << 14)]
        part = part[root[a[part]] != root[b[part]]]
        up = root.tolist() if len(part) else []

        def top(x: int, up=up) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for i in part.tolist():
            x, y = top(a[i]), top(b[i])
            if x != y:
                up[y] = x
                keep.append(i)
        root = np.array(up) if up else root
    keep = np.array(keep, np.int64)
    return a[keep], b[keep]


def index_rows(groups: DataFrame) -> DataFrame:
    """(token, g, meta, label, wide) of the prefix shingles of (g, n, prefix, rare, label, several); meta holds n, the place and whether the group has several members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column(2)
            sizes = np.diff(np.asarray(prefix.offsets))
            row = np.repeat(np.arange(batch.num_rows), sizes)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n, rare = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 3))
            meta = n[row] << 32 | pos << 1 | batch.column(5).to_numpy(zero_copy_only=False)[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([prefix.flatten(), batch.column(0).take(take), pa.array(meta), batch.column(4).take(take), pa.array(pos >= rare[row])], names=["token", "g", "meta", "label", "wide"])

    return groups.select("g", "n", "prefix", "rare", "label", "several").mapInArrow(run, "token long, g long, meta long, label long, wide boolean")


def _differ(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


class Join:
    """One similarity join over the rows of df."""

    def __init__(self, df: DataFrame, key: str, text: str, width: int, percent: int):
        self.spark, self.percent = df.sparkSession, percent
        self.source = (texts(df), key, text, width)
        counts = self.spark.sparkContext.broadcast(sketch(df, text, width))
        rows = df.count()
        self.base = settle(prefixes(df, key, text, width, percent, counts), rows, wide=True)
        counts.destroy()
        some = self.base.where("n > 0")
        first = [F.first(x).alias(x) for x in ("n", "g", "keys", "maps", "common")]
        self.member = settle(some.groupBy("c").agg(F.min("doc_id").alias("rep"), *first).withColumn("g", F.xxhash64("g")), rows)
        self.classes = self.member.count()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b, na, nb): those whose whole sets are similar enough."""
        wanted = self.member.join(pairs.select(F.explode(F.array("a", "b")).alias("c")), "c", "left_semi").select("rep")
        most = min(2 * pairs.count(), self.classes)
        bits = self.spark.sparkContext.broadcast(bit_map(wanted, most))
        found = settle(sets(*self.source, bits), most, wide=True)
        bits.destroy()
        right = found.select(F.col("c").alias("b"), F.col("tokens").alias("tb"))
        left = found.select(F.col("c").alias("a"), F.col("tokens").alias("ta"))
        shared = F.size(F.array_intersect("ta", "tb"))
        near = pairs.join(right, "b").join(left, "a").where((100 + self.percent) * shared >= self.percent * (F.col("na") + F.col("nb")))
        return settle(near.select("a", "b"), self.classes, wide=True)

    def by_keys(self) -> DataFrame:
        """Links of classes to the class of the commonest shingles that shares a min-wise key."""
        keyed = self.member.select("c", "common", F.explode("keys").alias("key"))
        top = keyed.groupBy("key").agg(F.max(F.struct("common", "c"))["c"].alias("a"), F.count("*").alias("k")).where("k > 1").select("key", "a")
        pairs = keyed.join(top, "key").where("a <> c").select("a", F.col("c").alias("b")).distinct()
        for x in "ab":
            pairs = pairs.join(self.member.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("maps").alias(f"m{x}")), x)
        size = F.col("na") + F.col("nb")
        near = (100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")) & ((100 + self.percent) * (size - _differ("ma", "mb")) >= 2 * self.percent * size)
        return self.verified(settle(pairs.where(near).select("a", "b", "na", "nb"), self.classes))

    def labelled(self, label: DataFrame) -> DataFrame:
        """Members with their component (`label`, null if there is none) of (node, component)."""
        named = label.select(F.col("node").alias("c"), F.xxhash64("component").alias("label"))
        return self.member.select("c", "g", "n", "maps").join(named, "c", "left")

    def rows_of(self, member: DataFrame) -> DataFrame:
        """(token, g, pos): the prefix index, less the groups that have nobody to be paired with."""
        low, high = F.min(F.coalesce("label", F.xxhash64("c"))), F.max(F.coalesce("label", F.xxhash64("c")))
        facts = member.groupBy("g").agg(F.when(low == high, F.max("label")).alias("label"), (low != high).alias("several"))
        prefix = self.base.where("n > 0").groupBy(F.col("g").alias("whole")).agg(*(F.first(x).alias(x) for x in ("n", "prefix", "rare"))).withColumn("g", F.xxhash64("whole"))
        wide = index_rows(self.base.where("n > 0 and rare < size(prefix)").withColumns({"g": F.lit(0).cast("long"), "label": F.lit(None).cast("long"), "several": F.lit(False)})).where("wide")
        hot = few(wide.groupBy("token").count().where(F.col("count") > BLOCK).select("token", F.lit(True).alias("hot")))
        index = index_rows(prefix.join(facts, "g")).drop("wide").join(hot, "token", "left").select("token", "g", "meta", "label", F.coalesce("hot", F.lit(False)).alias("hot"))
        salt = F.when(F.col("hot"), F.col("g")).otherwise(0)
        return settle(partnered(index.repartition("token", salt).sortWithinPartitions("token"), self.percent), self.classes, wide=True)

    def candidates(self, rows: DataFrame, member: DataFrame, whole: bool = False) -> DataFrame:
        """Pairs (a, b, na, nb) of members not linked yet; a spanning forest of each block's, or all."""
        found = rows.join(member, "g").drop("g")
        many = few(found.groupBy("token").count().where(F.col("count") > BLOCK).select("token", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
        dealt = found.join(many, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("c", F.lit(5)), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
        dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "c", "n", "pos", "label", "maps")
        percent = self.percent
        pairs = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(lambda batches: forest(batches, percent, whole), "a binary, b binary, na int, nb int")
        return pairs.distinct()

    def links(self) -> DataFrame:
        """Verified links (a, b) between classes; they connect whatever similarity connects."""
        links = self.by_keys()
        member = self.labelled(components(links))
        rows = self.rows_of(member)
        pairs = settle(self.candidates(rows, member), self.classes)
        links = settle(links.unionByName(self.verified(pairs)), self.classes)
        label = components(links)
        # A forest of which no pair proved too far apart has connected all that its blocks could.
        at = [label.select(F.col("node").alias(x), F.col("component").alias(f"l{x}")) for x in "ab"]
        apart = pairs.join(at[0], "a", "left").join(at[1], "b", "left").where(~F.coalesce(F.col("la") == F.col("lb"), F.lit(False))).select("a", "b")
        if apart.isEmpty():
            return links
        maybe = components(links.unionByName(pairs.select("a", "b"))).withColumnsRenamed({"node": "c", "component": "part"})
        parts = apart.select(F.col("a").alias("c")).join(maybe, "c").select("part").distinct()
        member = self.labelled(label).join(maybe.join(parts, "part", "left_semi").select("c"), "c", "left_semi")
        rest = self.candidates(rows, member, whole=True).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
        return links.unionByName(self.verified(settle(rest, self.classes)))


def _classes(df: DataFrame, key: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their signatures, the linked classes, and per class (c, least, component)."""
    join = Join(df, key, text, width, percent)
    label = components(join.links()).withColumnsRenamed({"node": "c"})
    least = join.member.select("c", F.col("rep").alias("least"))
    return join.base.select("doc_id", "n", "c"), label, least.join(label, "c", "left").withColumn("component", F.coalesce("component", "c"))


def classify(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    base, label, named = _classes(df, key, text, width, percent)
    of_component = named.join(label.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("least").alias("component_id"))
    final = named.join(of_component, "component", "left").select("c", F.coalesce("component_id", "least").alias("component_id"))
    some = base.where("n > 0").select("doc_id", "n", "c").join(final, "c")
    none = base.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return some.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(none.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id"))


def _unmarked(df: DataFrame, key: str, bits) -> DataFrame:
    """Rows of df whose key's bit is not set, or that have no key."""
    at = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~(_marks(batch.column(at), bits.value) & _present(batch.column(at)))))

    return df.mapInArrow(run, df.schema)


def _present(keys: pa.Array) -> np.ndarray:
    return keys.is_valid().to_numpy(zero_copy_only=False)


def _marked(df: DataFrame, key: str, text: str, width: int, bits, name: str) -> DataFrame:
    """Rows of df whose key's bit is set, with the signature of each one's set, null where there are no shingles."""
    names = [*df.columns, name]
    at, key_at = names.index(text), names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(pa.array(_marks(batch.column(key_at), bits.value) & _present(batch.column(key_at)))), text):
                hashes, row, n = sets_of(part.column(at), width)
                sig = [s.tobytes() if k else None for s, k in zip(signatures(hashes, row, part.num_rows), n, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sig, pa.binary())], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.BinaryType())]))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """df with, of each component, the row of its least key; rows without shingles and rows without a key stay.

    A key may stand in rows of several components: a row is chosen by key and
    signature, of those that have both in common the one of the least text.

    Keys of rows that go and keys that stand in several rows are marked in a bit
    map.  Rows without a mark stay where they are; only marked ones, whose marks
    may be chance, are shuffled and joined.
    """
    base, _, named = _classes(df, key, text, width, percent)
    chosen = settle(named.where("least is not null").groupBy("component").agg(F.min(F.struct("least", "c")).alias("k")).select("k.c", "k.least"), base.count())
    keyed = base.where("doc_id is not null")
    some = keyed.where("n > 0").join(chosen, "c", "left").select("doc_id", F.coalesce(F.col("doc_id") == F.col("least"), F.lit(False)).alias("stays"))
    rows = some.unionByName(keyed.where("n = 0").select("doc_id", F.lit(True).alias("stays")))
    doubtful = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and("stays").alias("stays")).where("n > 1 or not stays").select(F.col("doc_id").alias("rep"))
    bits = df.sparkSession.sparkContext.broadcast(bit_map(doubtful, base.count()))
    c, k, row = (fresh(df, x) for x in ("_c", "_key", "_row"))
    marked = _marked(df, key, text, width, bits, c)
    one = marked.where(F.col(c).isNotNull()).groupBy(F.col(key).cast("long").alias(k), c).agg(F.min_by(F.struct(*df.columns), text).alias(row))
    kept = one.join(chosen, (one[k] == chosen["least"]) & (one[c] == chosen["c"]), "left_semi").select(f"{row}.*")
    return compact(_unmarked(df, key, bits).unionByName(marked.where(F.col(c).isNull()).select(df.columns)).unionByName(kept), base.count(), wide=True)
