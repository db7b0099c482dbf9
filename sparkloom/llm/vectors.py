"""Vector code compression: each vector becomes one byte a part, by codebooks whose search is filtered as in a VA-file.

A vector is cut into equal parts and every part position has a codebook.  To
assign parts, the coordinates of the codebook's entries are quantised to BITS
bits, which puts each entry in a cell.  A part gets one lookup table a
coordinate, with the least and the greatest distance to each of the 2 ** BITS
slices; summed over the coordinates they bound the distance to every entry from
below and above.  Only entries whose lower bound does not exceed the least upper
bound are refined by exact integer distances, so the result is that of a full
search.

Codebooks are trained over all rows: every task sums its parts by entry and the
driver receives one row for each component of each entry, whatever the table's
size.  All arithmetic is in integers, so the result does not depend on the
number of tasks or their order.

Edge cases: rows whose vector is null, empty or has a null or non-finite
component are dropped; so are rows of another length than the kept vector of
least id, and vectors that cannot be cut into equal parts.  Of equal ids the
lesser vector comes first, null ids come last.  Fewer rows than entries make a
smaller codebook.  Equal vectors get equal codes, ties go to the lower index, an
empty table gives no rows.  A component so large that a squared distance would
not fit in 64 bits raises an error.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import few, settle

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Bits to which an entry's coordinate is quantised.
BITS = 3
#: Vectors that are searched together.
BLOCK = 4096
SCHEMA = "vec_id long, label int, code string, error long"


def scaled(block: np.ndarray) -> np.ndarray:
    """Components as integers, if squared distances of their rows fit in 64 bits."""
    out = np.floor(block * SCALE)
    if out.size and np.abs(out).max() > math.isqrt((2**63 - 1) // out.shape[1]) // 2:
        raise OverflowError(f"squared distances of vectors with a component of {np.abs(block).max():g} do not fit in 64 bits")
    return out.astype(np.int64)


def integers(batch: pa.RecordBatch, dim: int, at: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that are kept, and their components as integers."""
    column = batch.column(at)
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))[:-1]]).astype(np.int64) if len(sizes) else sizes
    rows = np.flatnonzero(sizes == dim)
    block = values[begin[rows][:, None] + np.arange(dim)]
    whole = np.isfinite(block).all(1)
    return rows[whole], scaled(block[whole])


class Cells:
    """A codebook's entries (one a row) and the cells of their coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        self.n = 1 << bits
        self.low = entries.min(0)
        self.width = np.maximum(1, -(-(entries.max(0) - self.low + 1) // self.n))
        self.cell = (entries - self.low) // self.width
        first = self.low[:, None] + np.arange(self.n) * self.width[:, None]
        self.first, self.last = first, first + self.width[:, None] - 1

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the distance of each row to each entry, from a table a row and coordinate."""
        lower = np.zeros((len(x), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for j in range(x.shape[1]):
            below, above = self.first[j] - x[:, j, None], x[:, j, None] - self.last[j]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            lower += (near * near)[:, self.cell[:, j]]
            upper += (far * far)[:, self.cell[:, j]]
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, the first of equally near ones, and its squared distance."""
        if not len(x):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lower, upper = self.bounds(x)
        row, entry = np.nonzero(lower <= upper.min(1)[:, None])
        away = x[row] - self.entries[entry]
        away = (away * away).sum(1)
        least = np.minimum.reduceat(away, np.searchsorted(row, np.arange(len(x))))
        best = np.flatnonzero(away == least[row])
        return entry[best[np.unique(row[best], return_index=True)[1]]], least


def _parted(x: np.ndarray, parts: int) -> np.ndarray:
    return x.reshape(len(x), parts, x.shape[1] // parts)


def starting(df: DataFrame, key: str, vector: str, parts: int, entries: int) -> np.ndarray | None:
    """The components of the kept vectors of least id, as many as a codebook has entries; None if no vector is kept."""
    v = F.col(vector)
    whole = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.select(F.col(key).alias("k"), v.alias("v")).where(whole)
    order = [F.col("k").asc_nulls_last(), "v"]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return None
    got = rows.where(F.size("v") == len(first[0].v)).orderBy(*order).limit(entries).collect()
    return scaled(np.array([r.v for r in got], np.float64))


def train(df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks as an array of (part, entry, component), from rounds of assigning all parts and averaging."""
    start = starting(df, key, vector, parts, entries)
    if start is None:
        return None
    dim, books = start.shape[1], np.swapaxes(_parted(start, parts), 0, 1).copy()
    rows = df.select(F.col(vector).alias("v"))
    for _ in range(rounds):
        summed = rows.mapInArrow(_summing(books, dim), "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect()
        flat = np.zeros(books.shape[0] * books.shape[1] * (books.shape[2] + 1), np.int64)
        for slot, total in summed:
            flat[slot] = total
        flat = flat.reshape(books.shape[0], books.shape[1], books.shape[2] + 1)
        count, sums = flat[:, :, :1], flat[:, :, 1:]
        books = np.where(count > 0, sums // np.maximum(count, 1), books)
    return books


def _summing(books: np.ndarray, dim: int):
    """Sums of the parts nearest to each entry: of slot 0 of an entry their number, then one slot a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        total = np.zeros((books.shape[0], books.shape[1], books.shape[2] + 1), np.int64)
        for batch in batches:
            _, x = integers(batch, dim, 0)
            for at in range(0, len(x), BLOCK):
                some = _parted(x[at : at + BLOCK], len(books))
                for p, c in enumerate(cells):
                    entry, _ = c.nearest(some[:, p])
                    np.add.at(total[p, :, 1:], entry, some[:, p])
                    total[p, :, 0] += np.bincount(entry, minlength=books.shape[1])
        slots = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(total.ravel()[slots])], names=["slot", "total"])

    return run


def encode(df: DataFrame, books: np.ndarray | None, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of each kept row."""
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"), F.col(label).cast("int").alias("g"))
    if books is None:
        return rows.select(F.col("k").alias("vec_id"), F.col("g").alias("label"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    dim = books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            kept, x = integers(batch, dim)
            codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for at in range(0, len(x), BLOCK):
                some = _parted(x[at : at + BLOCK], len(books))
                for p, c in enumerate(cells):
                    entry, away = c.nearest(some[:, p])
                    codes[at : at + BLOCK, p] = entry
                    error[at : at + BLOCK] += away
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, SCHEMA)


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(code))]) / SCALE


def digest(books: np.ndarray | None) -> str:
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over rows of equal labels, nulls together) and codebooks_sha256."""
    if entries > 256:
        raise ValueError("an entry's number is one byte")
    books = train(df, key, vector, parts, entries, rounds)
    rows = settle(encode(df, books, key, vector, label))
    sums = few(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    joined = rows.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
