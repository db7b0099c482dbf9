"""Target-distribution importance resampling: documents are drawn by how much more their n-grams are those of a target.

Features are hashed through an integer word dictionary.  Of a slice of texts the
distinct words get ids, an n-gram is the tuple of its words' ids, and each
distinct tuple's bytes are put together and hashed once; its bucket is joined
back to the places where it stands and counted for each document.  The buckets
and counts of every document are kept in the shared folder, so that texts are
read, cut into words and hashed once; what follows works on numbers.

All documents and all of the target are counted.  What the driver gets is one
number for each bucket, and for the order one for each score partition.  The
ranks come from a range partition by score and id, whose partitions are counted;
no task sees more than its share, however many rows have one score.

Edge cases: a null or empty text has no words, no features and weight 0, and is
never drawn; a null id counts as an empty one in the draw and comes last among
equal scores; equal rows have one score and places next to each other; texts of
fewer words than `least` are not drawn; an empty target has no counts; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_folder, new_folder, settle, texts
from .textbatch import LOWER, slices, utf8, word_spans

BUCKETS = 10_000
N = 2
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Everything of ASCII but digits and letters ends a word.
ENDS = np.zeros(256, bool)
ENDS[:128] = True
ENDS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
#: Bits of a place in `monotonically_increasing_id` below the partition's number.
PLACE_BITS = 33
_COUNTED = "doc_id long, n_words long, n_features long, bucket array<int>, times array<int>"


class Coded:
    """A slice of texts as ids of its own dictionary of words."""

    def __init__(self, column: pa.Array):
        raw, rows = utf8(column)
        raw = LOWER[raw]
        begin, end, self.row = word_spans(raw, rows, ENDS)
        at = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
        letters = raw[~ENDS[raw]]  # the words one after another
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(letters))])
        coded = words.dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words: list[bytes] = coded.dictionary.to_pylist()
        self.n = len(column)

    def buckets(self, n: int = N, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
        """Row and bucket of every run of 1 to n words."""
        tuples, at = self.words, self.ids  # each distinct tuple's bytes, and the tuple that begins at each word
        begin = np.arange(len(self.ids))
        rows, found = [], []
        for k in range(1, n + 1):
            if k > 1:
                inside = begin + k - 1 < len(self.ids)
                begin, at = begin[inside], at[inside]
                inside = self.row[begin] == self.row[begin + k - 1]
                begin, at = begin[inside], at[inside]
                pairs, at = np.unique(at * len(self.words) + self.ids[begin + k - 1], return_inverse=True)
                head, last = np.divmod(pairs, max(len(self.words), 1))
                tuples = [tuples[a] + b" " + self.words[b] for a, b in zip(head.tolist(), last.tolist(), strict=True)]
            hashes = np.fromiter(map(zlib.crc32, tuples), np.int64, len(tuples)) % buckets
            rows.append(self.row[begin])
            found.append(hashes[at])
        return np.concatenate(rows), np.concatenate(found)


def counted(df: DataFrame, key: str | None = "doc_id", text: str = "text", n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """Per row: doc_id, n_words, n_features, its distinct buckets and how many features each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t", owner="resample"):
                coded = Coded(part.column(1))
                row, bucket = coded.buckets(n, buckets)
                pairs, times = np.unique(row * buckets + bucket, return_counts=True)
                bounds = np.searchsorted(pairs, np.arange(coded.n + 1) * buckets).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(v.astype(np.int32))) for v in (pairs % buckets, times)]
                words, features = (np.bincount(r, minlength=coded.n).astype(np.int64) for r in (coded.row, row))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(features), *lists], names=["doc_id", "n_words", "n_features", "bucket", "times"])

    keyed = F.lit(None) if key is None else F.col(key)
    return texts(df).select(keyed.cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, _COUNTED)


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket, over all rows of `counted`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            bucket, times = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
            np.add.at(total, bucket, times)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["b", "n"])

    out = np.zeros(buckets, np.int64)
    for b, n in rows.select("bucket", "times").mapInArrow(run, "b int, n long").groupBy("b").agg(F.sum("n")).collect():
        out[b] = n
    return out


def gains(have: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in what is wanted, one more of each counted."""
    size, target, n = float(have.sum()), float(wanted.sum()), len(have)
    return np.array([math.floor(1000 * math.log((t + 1) * (size + n) / ((s + 1) * (target + n)))) for s, t in zip(have.astype(float).tolist(), wanted.astype(float).tolist(), strict=True)], np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean of the gains over a document's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4))
            bounds = np.concatenate([[0], np.cumsum(np.asarray(batch.column(3).value_lengths()))]).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(gain[bucket] * times)])
            features = batch.column(2).to_numpy(zero_copy_only=False)
            weight = np.where(features > 0, (total[bounds[1:]] - total[bounds[:-1]]) // np.maximum(features, 1), 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, order: list, most: int) -> DataFrame:
    """rows with their place in the order from 1, as `rank`; null beyond `most`.

    Rows that the order leaves equal are dealt by their place in the input, so that they may fall into several partitions.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("dealt", F.monotonically_increasing_id())
    order = [*order, "dealt"]
    rows = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", PLACE_BITS).cast("int")
    before, total = [], 0
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect(), key=lambda r: r.part):
        before.append((r.part, total))
        total += r.n
    starts = F.broadcast(spark.createDataFrame(before, "part int, before long"))  # one row a partition
    rank = F.col("before") + F.col("place").bitwiseAND((1 << PLACE_BITS) - 1) + 1
    return rows.withColumn("part", part).join(starts, "part").withColumn("rank", F.when(rank <= most, rank)).drop("part", "before", "place", "dealt")


def resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = N, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; the rows with a rank are the sample."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "features")
    counted(df, key, text, n, buckets).write.parquet(folder)
    rows = spark.read.schema(_COUNTED).parquet(folder)
    gain = gains(histogram(rows, buckets), histogram(counted(target, None, target_text, n, buckets), buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    draw = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = settle(weighed(rows, gain).withColumn("score", F.col("weight") + draw.cast("long")))
    drop_folder(spark, folder)
    long_enough = scored.where(F.col("n_words") >= least)
    drawn = ranked(long_enough, [F.desc("score"), F.col("doc_id").asc_nulls_last()], percent * long_enough.count() // 100)
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(out).unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")).select(out))
