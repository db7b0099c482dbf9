"""Quality classifier from weak labels.

Overlapping heuristic labellers vote junk, good or nothing on each text.  How
often each pattern of votes occurs is counted over the whole table; there are at
most 3 ** labellers patterns, so the counts fit the driver.  Expectation
maximisation over the patterns estimates each labeller's accuracy, within bounds,
and with them every pattern has a posterior; the share of good texts comes out
too, but classes count as equally likely (see `estimate`).  A linear scorer over hashed features (word shapes, pairs of shapes,
binned statistics) is then trained on the posteriors of a sample of at most
SAMPLE rows, drawn by hash of the row, and scores every text.

Edge cases: a text that is null, empty or without words is scored 0 and
rejected; equal rows get equal scores; an empty table trains nothing and gives
no rows; when all labellers agree everywhere the posterior is that vote; columns
other than key and text pass through `keep` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts
from .textbatch import BLANK, U64, give_back, mix, slices, span_hashes, utf8, word_spans

#: Rows that train the scorer, buckets of hashed features, and the score from which a text is kept.
SAMPLE, BUCKETS, KEEP = 4000, 1 << 16, 0.5
#: Words of a window in which distinct words are counted.
WINDOW = 3000
ROUNDS, STEPS = 50, 200

# Byte classes of a word's shape: a small letter, A capital, 0 digit, other ASCII as it is.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = ord("a")
SHAPE[65:91] = ord("A")
SHAPE[48:58] = ord("0")
ODD = np.zeros(256, bool)
ODD[[ord(c) for c in "#$%&*|{}<>~^\\=_@`"]] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True

#: Labellers: (name, statistic, from, to, vote), vote 1 for junk and 2 for good.  Each says one thing or nothing:
#: a text is junk in one way mostly, so not being junk in another way is no sign of a good one.
LABELLERS = [
    ("odd", 0, 0.10, 9.0, 1),
    ("caps", 1, 0.25, 9.0, 1),
    ("repeats", 2, 0.10, 9.0, 1),
    ("poor", 3, -1.0, 0.30, 1),
    ("lines", 4, 0.40, 9.0, 1),
    ("stops", 5, 0.60, 99.0, 1),
    ("signs", 6, -1.0, 0.70, 1),
    ("thirds", 7, 0.30, 9.0, 1),
    ("prose", 8, 1.0, 1.0, 2),
    ("varied", 9, 1.0, 1.0, 2),
]
NAMES = [x[0] for x in LABELLERS]


def _share(row: np.ndarray, flags: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    return np.bincount(row, weights=flags, minlength=n) / np.maximum(total, 1)


class Slice:
    """Statistics, votes and hashed features of the texts of a slice."""

    def __init__(self, column: pa.Array):
        raw, rows = utf8(column)
        n = self.n = len(column)
        starts, ends, row = word_spans(raw, rows, BLANK)
        self.row, self.raw, self.starts, self.ends = row, raw, starts, ends
        self.words = np.bincount(row, minlength=n)
        zero = np.zeros(1, np.int64)
        tally = lambda mask: np.concatenate([zero, np.cumsum(mask)])
        odd, caps, small = (tally(m[raw]) for m in (ODD, (SHAPE == ord("A")), (SHAPE == ord("a"))))
        stops = tally(STOP[raw])
        inside = lambda t: t[ends] - t[starts]
        hashes = span_hashes(raw, starts, ends)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        solid = _spread(ends - starts, row, n)
        # Runs of three words seen before in the same text.
        triple = np.empty(0, U64)
        if len(hashes) > 2:
            triple = mix(mix(hashes[:-2] * U64(3)) + mix(hashes[1:-1] * U64(5)) + hashes[2:] * U64(7))
            ok = row[:-2] == row[2:]
            triple, trow = triple[ok], row[:-2][ok]
        else:
            trow = np.empty(0, np.int64)
        line_s, line_e, line_r = word_spans(raw, rows, _NEWLINE)
        lines = span_hashes(raw, line_s, line_e)
        self.stats = np.stack(
            [
                _share(row, inside(odd) > 0, n, self.words),
                _share(row, (inside(caps) >= 2) & (inside(small) == 0), n, self.words),
                _share(row, same, n, self.words),
                _variety(hashes, self.words),
                1 - _distinct(lines, line_r, n) / np.maximum(np.bincount(line_r, minlength=n), 1),
                _share(row, inside(stops), n, self.words),
                _share(row, inside(small) + inside(caps), n, solid),
                1 - _distinct(triple, trow, n) / np.maximum(np.bincount(trow, minlength=n), 1),
            ]
        )
        odd_, caps_, repeats_, distinct_, lines_, stops_, letters_, thirds_ = self.stats
        prose = (stops_ >= 0.02) & (stops_ <= 0.35) & (letters_ >= 0.9) & (odd_ < 0.05) & (repeats_ < 0.06)
        varied = (distinct_ >= 0.5) & (thirds_ < 0.15) & (caps_ < 0.1) & (odd_ < 0.05)
        self.stats = np.vstack([self.stats, prose, varied])

    def votes(self) -> np.ndarray:
        """The pattern of each text: base 3 digits, 0 nothing, 1 junk, 2 good."""
        code = np.zeros(self.n, np.int64)
        for k, (_, stat, low, high, vote) in enumerate(LABELLERS):
            code += 3**k * vote * ((self.stats[stat] >= low) & (self.stats[stat] <= high))
        return np.where(self.words > 0, code, 0)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, value) of the hashed features."""
        shape = SHAPE[self.raw]
        first = np.ones(len(shape), bool)
        first[1:] = shape[1:] != shape[:-1]
        first[self.starts] = True
        place = np.concatenate([[0], np.cumsum(first)])
        h = span_hashes(shape[first], place[self.starts], place[self.ends]) if len(shape) else np.empty(0, U64)
        pairs = mix(h[:-1] * U64(11) + h[1:]) if len(h) > 1 else np.empty(0, U64)
        beside = self.row[:-1] == self.row[1:] if len(h) > 1 else np.empty(0, bool)
        per_word = 1 / np.maximum(self.words, 1)
        rows = [self.row, self.row[:-1][beside] if len(h) > 1 else self.row[:0]]
        marks = [h, pairs[beside] if len(h) > 1 else pairs]
        values = [per_word[r] for r in rows]
        for k in range(len(self.stats)):
            bins = np.minimum(self.stats[k] * 20, 40).astype(np.int64)
            rows.append(np.arange(self.n))
            marks.append(mix(bins.astype(U64) + U64(1000 * (k + 1))))
            values.append(np.full(self.n, 0.5))
        row, value = np.concatenate(rows), np.concatenate(values)
        bucket = (np.concatenate(marks) & U64(BUCKETS - 1)).astype(np.int64)
        return row, bucket, value


_NEWLINE = np.zeros(256, bool)
_NEWLINE[[10, 13]] = True


def _spread(sizes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=sizes, minlength=n)


def _distinct(hashes: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    if not len(hashes):
        return np.zeros(n)
    key = hashes ^ mix(row.astype(U64) + U64(1))  # rows are few, so one 64-bit key tells them apart
    first = np.unique(key, return_index=True)[1]
    return np.bincount(row[first], minlength=n).astype(float)


def _variety(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Share of distinct words in consecutive windows of WINDOW words, mean over the whole text; the last window ends with the text and so is as long as the others."""
    count = -(-words // WINDOW)
    row = np.repeat(np.arange(len(words)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(words, WINDOW)[row]
    start = (np.cumsum(words) - words)[row] + np.minimum(at * WINDOW, words[row] - size)
    window = np.repeat(np.arange(len(row)), size)
    place = np.arange(len(window)) + np.repeat(start - (np.cumsum(size) - size), size)
    return _share(row, _distinct(hashes[place], window, len(row)) / np.maximum(size, 1), len(words), count)


def digits(codes: np.ndarray) -> np.ndarray:
    """Votes by labeller of each pattern."""
    return (codes[:, None] // 3 ** np.arange(len(NAMES))) % 3


def estimate(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns: posterior of good per pattern, share of good, and each labeller's accuracy when it votes.

    Whether a labeller votes at all is taken to say nothing about the class, as
    each looks for one kind of text; a vote is right with the labeller's
    accuracy, which is held above one half, so the classes cannot swap.  Classes
    count as equally likely, or the many good texts would outvote a labeller that
    alone finds its kind of junk.
    """
    votes = digits(codes)
    posterior = np.where((votes == 1).any(1), 0.05, 0.95)  # to begin with, one vote of junk is believed
    accuracy, share = np.full(len(NAMES), 0.8), 0.5
    for _ in range(ROUNDS):
        share = float((posterior * counts).sum() / max(counts.sum(), 1e-9))
        right = ((votes == 2) * posterior[:, None] + (votes == 1) * (1 - posterior[:, None])) * counts[:, None]
        accuracy = np.clip((right.sum(0) + 2) / (((votes > 0) * counts[:, None]).sum(0) + 3), 0.55, 0.98)
        weight = np.log(accuracy / (1 - accuracy))
        odds = ((votes == 2) * weight - (votes == 1) * weight).sum(1)
        posterior = 1 / (1 + np.exp(-odds))
    return posterior, share, accuracy


def train(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by gradient steps with per-weight rates."""
    weights, bias = np.zeros(BUCKETS), 0.0
    n = max(len(target), 1)
    seen, seen_bias = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(np.bincount(row, weights=weights[bucket] * value, minlength=len(target)) + bias))) - target
        slope = np.bincount(bucket, weights=error[row] * value, minlength=BUCKETS) / n + 1e-6 * weights
        seen += slope**2
        weights -= 0.5 * slope / np.sqrt(seen)
        seen_bias += error.mean() ** 2
        bias -= 0.5 * error.mean() / np.sqrt(seen_bias)
    return weights.astype(np.float32), float(bias)


class Model:
    """What `fit` learns: posterior of each vote pattern, weights and bias of the scorer."""

    def __init__(self, codes: np.ndarray, posterior: np.ndarray, share: float, accuracy: np.ndarray, weights: np.ndarray, bias: float):
        self.codes, self.posterior, self.share, self.accuracy, self.weights, self.bias = codes, posterior, share, accuracy, weights, bias

    def scores(self, s: Slice) -> np.ndarray:
        row, bucket, value = s.features()
        score = 1 / (1 + np.exp(-(np.bincount(row, weights=self.weights[bucket] * value, minlength=s.n) + self.bias)))
        return np.where(s.words > 0, score, 0.0)

    def posteriors(self, votes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, votes), max(len(self.codes) - 1, 0))
        return self.posterior[at] if len(self.codes) else np.full(len(votes), self.share)


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Counts patterns over all rows, runs EM, trains the scorer on at most `sample` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for part in slices(batch, "t"):
                s = Slice(part.column(0))
                for c, k in zip(*np.unique(s.votes()[s.words > 0], return_counts=True), strict=True):
                    total[int(c)] = total.get(int(c), 0) + int(k)
        yield pa.RecordBatch.from_pydict({"code": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})

    counted = texts(df).select(F.col(text).alias("t")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n")).collect()
    counted = sorted((r[0], r[1]) for r in counted)
    codes, counts = np.array([c for c, _ in counted], np.int64), np.array([n for _, n in counted], float)
    posterior, share, accuracy = estimate(codes, counts) if len(codes) else (np.empty(0), 0.5, np.full(len(NAMES), 0.5))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                s = Slice(part.column(1))
                row, bucket, value = s.features()
                packed = row * BUCKETS + bucket
                u, at = np.unique(packed, return_inverse=True)
                value = np.bincount(at, weights=value)
                bounds = np.searchsorted(u // BUCKETS, np.arange(s.n + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v)) for v in ((u % BUCKETS).astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.votes()), *lists], names=["h", "code", "bucket", "value"])

    rows = df.count()
    drawn = F.xxhash64(F.col(key), F.col(text))
    share_of = min(1.0, 1.3 * sample / max(rows, 1))
    chosen = texts(df).select(drawn.alias("h"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    if share_of < 1:
        chosen = chosen.where(F.col("h") <= int(-(2**63) + share_of * (2**64 - 1)))
    got = chosen.mapInArrow(describe, "h long, code long, bucket array<int>, value array<float>").orderBy("h", "code").limit(sample).toArrow()
    if not got.num_rows or not len(codes):
        return Model(codes, posterior, share, accuracy, np.zeros(BUCKETS, np.float32), 0.0)
    sizes = np.array([len(x) for x in got["bucket"]])
    flat = [np.concatenate([np.asarray(x.values) for x in got[c]]) for c in ("bucket", "value")]
    blank = Model(codes, posterior, share, accuracy, None, 0.0)
    target = blank.posteriors(got["code"].to_numpy())
    weights, bias = train(np.repeat(np.arange(len(sizes)), sizes), flat[0].astype(np.int64), flat[1].astype(float), target)
    return Model(codes, posterior, share, accuracy, weights, bias)


SCHEMA = "doc_id long, score double, posterior double, keep boolean"


def classify(df: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, score, posterior of the votes alone, keep."""
    sent = df.sparkSession.sparkContext.broadcast(model or fit(df, key, text))  # BUCKETS weights, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                s = Slice(part.column(1))
                score = np.round(sent.value.scores(s), 6)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(np.round(sent.value.posteriors(s.votes()), 6)), pa.array(score >= KEEP)], names=["doc_id", "score", "posterior", "keep"])

    return texts(df).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, SCHEMA)


def keep(df: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows that the classifier rejects; its columns stay as they are."""
    sent = df.sparkSession.sparkContext.broadcast(model or fit(df, key, text))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.filter(pa.array(sent.value.scores(Slice(part.column(at))) >= KEEP))
            give_back()

    return texts(df).mapInArrow(run, df.schema)
