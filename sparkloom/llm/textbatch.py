"""Vectorised text primitives shared by the corpus operators.

Everything works on slices of Arrow string columns: the UTF-8 bytes of a slice
are one uint8 array plus row offsets, so tokenising and hashing are numpy calls
over the whole slice, never loops over characters or words.  Slices are bounded
in bytes, so memory does not depend on how many rows Arrow puts in a batch.
A null text counts as an empty one everywhere.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows, one after another, and len + 1 row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


#: What operators keep in a Python worker beyond a task: by operator, what lets go of it.
HELD: dict[str, Callable[[], None]] = {}


def _let_go(owner: str) -> None:
    others = [name for name in HELD if name != owner]
    for name in others:
        HELD.pop(name)()
    if others:
        gc.collect()
        give_back()


def give_back() -> None:
    """Hands memory that was freed, but kept for later, back to the system: a worker stays between tasks, and each executor has several."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Row ranges of about `limit` text bytes; a longer text is a slice by itself.

    What operators other than `owner` have kept in this worker goes: an executor's
    workers serve all operators of a session in turn.
    """
    _let_go(owner)
    if not batch.num_rows:
        return
    _, at = utf8(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POW.get("up")
    if have is None or len(have) < n + 1:
        size = max(n + 1, SLICE_BYTES + 65_536)
        for name, base in (("up", _BASE), ("down", _INV)):
            steps = np.full(size, base & (2**64 - 1), U64)
            steps[0] = 1
            _POW[name] = np.multiply.accumulate(steps)
    return _POW["up"], _POW["down"]


#: ASCII capitals to small letters; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The blanks that end a word: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def word_spans(raw: np.ndarray, rows: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of non-blank bytes within a row, and its row."""
    n = len(raw)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    solid = ~blank[raw]
    cut = np.zeros(n + 1, bool)
    cut[rows] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(rows, starts, side="right") - 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span, finalised."""
    n = len(raw)
    up, down = _powers(n)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum((raw.astype(U64) + U64(1)) * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_hashes(words: np.ndarray, word_row: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of k words within a row; a row of fewer words gives its whole sequence as one."""
    n = len(words)
    counts = np.bincount(word_row, minlength=n_rows)
    hashes, rows = np.empty(0, U64), np.empty(0, np.int64)
    if n >= k:
        h = words[: n - k + 1].copy()
        for j in range(1, k):
            h = mix(h * U64(0xC2B2AE3D27D4EB4F) + U64(j)) + words[j : n - k + 1 + j]
        whole = word_row[: n - k + 1] == word_row[k - 1 :]
        hashes, rows = mix(h[whole] + U64(k)), word_row[: n - k + 1][whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(word_row, short)
        h = np.zeros(len(short), U64)
        for j in range(k - 1):
            more = counts[short] > j
            h[more] = mix(h[more] * U64(0xC2B2AE3D27D4EB4F) + U64(j + 101)) + words[first[more] + j]
        hashes, rows = np.concatenate([hashes, mix(h + counts[short].astype(U64))]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    return hashes, rows


def distinct_by_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by row, then hash, each pair once."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    if len(hashes):
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        hashes, rows = hashes[keep], rows[keep]
    return hashes, rows
