"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z folded, so
punctuation and line breaks do not hide a passage.  Seeds are shared runs of
SEED words.  Every tile is made of seeds, so a text is looked at for an item only
if the seeds that they share cover COVERAGE of the item's words: an item that
merely begins like a thousand others costs nothing more.  For such a pair the
matches are tiled greedily: longest first, none overlapping, by running
Karp-Rabin over the words that no tile has taken yet, with the window going down
from the longest possible match to the least.  An item is leaked if its tiles
cover COVERAGE of its words, in whatever order they stand in the text.

The benchmark is read in blocks of about BLOCK_BYTES of text, one at a time on
the driver, each broadcast by itself, so what is held and sent is bounded by a
constant and every text meets every block.  Texts are never shuffled.

Edge cases: null and empty texts are clean; an item of fewer than SEED words
matches as a whole; an item without words matches nothing; null item ids are
kept as null; repeated items and rows give their rows each; an empty benchmark
or table gives no rows; other columns pass through `clean` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts
from .textbatch import LOWER, U64, give_back, mix, shingle_hashes, slices, span_hashes, utf8, word_spans

#: Words of a seed and of the least tile; share of an item's words that makes it leaked.
SEED, COVERAGE = 5, 0.8
#: Benchmark text in one broadcast block.
BLOCK_BYTES = 4 << 20
#: All bytes that are no part of a word.
APART = np.zeros(256, bool)
APART[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


class Items:
    """One block of the benchmark: word hashes by item, and which items hold which seed where."""

    def __init__(self, ids: list, texts: list[str | None]):
        raw, rows = utf8(pa.array(texts, pa.string()))
        raw = LOWER[raw]
        starts, ends, row = word_spans(raw, rows, APART)
        words = span_hashes(raw, starts, ends)
        bounds = np.searchsorted(row, np.arange(len(texts) + 1))
        self.ids = ids
        self.words = [words[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in range(1, SEED + 1):  # short items are seeds of their own length
            mine = np.flatnonzero(np.diff(bounds) == k) if k < SEED else np.flatnonzero(np.diff(bounds) >= SEED)
            if len(mine):
                w = np.concatenate([self.words[i] for i in mine])
                r = np.repeat(np.arange(len(mine)), [len(self.words[i]) for i in mine])
                h, r = shingle_hashes(w, r, len(mine), k)
                order = np.argsort(h, kind="stable")
                place = np.arange(len(r)) - np.searchsorted(r, r)
                self.seeds[k] = (h[order], mine[r[order]], place[order])


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word sequences: (start in item, start in text, words), longest first.

    For each window length from the longest possible one down, the hashes of the
    windows without taken words are rolled from the length before and compared;
    equal windows become tiles from left to right.
    """
    n, m = len(item), len(text)
    free_i, free_t = np.ones(n, bool), np.ones(m, bool)
    out: list[tuple[int, int, int]] = []
    size = min(n, m)
    while size >= least:
        wi, ai = _windows(item, free_i, size)
        wt, at = _windows(text, free_t, size)
        common = np.intersect1d(wi, wt)
        if not len(common):
            longest = _longest(item, text, free_i, free_t, size - 1, least)
            if longest < least:
                break
            size = longest
            continue
        where: dict[int, list[int]] = {}
        keep = np.isin(wt, common)
        for h, p in zip(wt[keep].tolist(), at[keep].tolist(), strict=True):
            where.setdefault(h, []).append(p)
        keep = np.isin(wi, common)
        for h, p in zip(wi[keep].tolist(), ai[keep].tolist(), strict=True):
            if not free_i[p : p + size].all():
                continue
            for q in where[h]:
                if free_t[q : q + size].all() and (item[p : p + size] == text[q : q + size]).all():
                    free_i[p : p + size] = False
                    free_t[q : q + size] = False
                    out.append((p, q, size))
                    break
        size -= 1
    return out


def _longest(item: np.ndarray, text: np.ndarray, free_i: np.ndarray, free_t: np.ndarray, high: int, low: int) -> int:
    """Length of the longest match of free words, by bisection: a match of some length holds one of any lesser length."""
    best = low - 1
    while low <= high:
        size = (low + high) // 2
        if len(np.intersect1d(_windows(item, free_i, size)[0], _windows(text, free_t, size)[0])):
            best, low = size, size + 1
        else:
            high = size - 1
    return best


def _windows(words: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of the windows of free words, and their starts."""
    n = len(words)
    if n < size:
        return np.empty(0, U64), np.empty(0, np.int64)
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    up = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n - 1, base, U64)]))
    down = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(n - 1, inverse, U64)]))
    total = np.concatenate([[U64(0)], np.cumsum(words * up)])
    taken = np.concatenate([[0], np.cumsum(~free)])
    start = np.flatnonzero(taken[size:] == taken[:-size])
    return mix((total[start + size] - total[start]) * down[start]), start


def leaks(part: pa.RecordBatch, column: int, items: Items) -> list[tuple[int, int, float, int, int]]:
    """(row, item, coverage, tiles, longest tile) of every leaked pair of a slice."""
    raw, rows = utf8(part.column(column))
    raw = LOWER[raw]
    starts, ends, row = word_spans(raw, rows, APART)
    words = span_hashes(raw, starts, ends)
    bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
    out = []
    for k, (seed, holder, place) in items.seeds.items():
        if len(words) < k:
            continue
        h = words[: len(words) - k + 1].copy()
        for j in range(1, k):
            h = mix(h * U64(0xC2B2AE3D27D4EB4F) + U64(j)) + words[j : len(words) - k + 1 + j]
        h = mix(h + U64(k))
        lo = np.searchsorted(seed, h)
        hit = np.flatnonzero((seed[np.minimum(lo, len(seed) - 1)] == h) & (row[: len(h)] == row[k - 1 :][: len(h)]))
        if not len(hit):
            continue
        shared = np.unique(row[hit] * (len(seed) + 1) + lo[hit])  # a seed counts once in a text
        for r in np.unique(shared // (len(seed) + 1)).tolist():
            mine = shared[np.searchsorted(shared, r * (len(seed) + 1)) : np.searchsorted(shared, (r + 1) * (len(seed) + 1))] % (len(seed) + 1)
            for i in _covered(items, seed, holder, place, mine, k):
                text, window = words[bounds[r] : bounds[r + 1]], h[bounds[r] : bounds[r + 1] - k + 1]
                near = np.flatnonzero(np.isin(window, shingle_hashes(items.words[i], np.zeros(len(items.words[i]), np.int64), 1, k)[0]))
                near = np.unique((near[:, None] + np.arange(k)).ravel())  # all words of all seeds
                found = tiles(items.words[i], _apart(text, near), k)
                covered = sum(t[2] for t in found) / len(items.words[i])
                if covered >= COVERAGE:
                    out.append((r, i, covered, len(found), found[0][2]))
    return out


def _covered(items: Items, seed: np.ndarray, holder: np.ndarray, place: np.ndarray, first: np.ndarray, k: int) -> list[int]:
    """Items of whose words the seeds that begin at `first` in the index cover enough."""
    count = np.searchsorted(seed, seed[first], side="right") - first
    at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
    size = max(map(len, items.words)) + 1
    key = np.unique(holder[at] * size + place[at])
    item, place = key // size, key % size
    fresh = np.full(len(key), k)
    same = item[1:] == item[:-1]
    fresh[1:][same] = np.minimum(k, (place[1:] - place[:-1])[same])
    covered = np.bincount(item, weights=fresh, minlength=len(items.words))
    return [i for i in np.unique(item).tolist() if covered[i] >= COVERAGE * len(items.words[i])]


def _apart(words: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Only the words near seeds; a word that is in no item stands between runs that are apart."""
    gap = np.flatnonzero(np.diff(near) > 1) + 1
    return np.insert(words[near], gap, np.arange(len(gap), dtype=U64))


def blocks_of(benchmark: DataFrame, item: str, text: str) -> Iterator[Items]:
    """The benchmark in blocks of bounded size; each is fetched by itself when it is asked for."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = int(size // BLOCK_BYTES) + 1
    at = F.pmod(F.xxhash64(item, text), F.lit(n))
    for k in range(n):
        rows = benchmark.where(at == k).select(F.col(item).cast("long"), text).collect()
        yield Items([r[0] for r in rows], [r[1] for r in rows])


SCHEMA = "doc_id long, item_id long, coverage double, n_tiles int, longest int"


def contaminated(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each text and leaked item."""
    spark = df.sparkSession
    out = None
    for items in blocks_of(benchmark, item, item_text):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                rows = []
                for part in slices(batch, "t"):
                    ids = part.column(0).to_pylist()
                    rows += [(ids[r], items.ids[i], round(c, 6), n, longest) for r, i, c, n, longest in leaks(part, 1, items)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], k) for j, k in enumerate(kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])

        part = texts(df).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """df without the rows whose text leaks an item; its columns stay as they are."""
    spark, at = df.sparkSession, df.columns.index(text)
    for items in blocks_of(benchmark, item, item_text):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text):
                    keep = np.ones(part.num_rows, bool)
                    keep[[x[0] for x in leaks(part, at, sent.value)]] = False
                    yield part.filter(pa.array(keep))
                give_back()

        df = texts(df).mapInArrow(run, df.schema)
    return df
