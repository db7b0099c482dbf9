"""Line dedup by levelled sorted runs of line hashes, in DataFrame functions only.

A run is a table of (h1, h2, n): the 128-bit hash of a line's key and the number
of documents that hold it, bucketed and sorted by the hash.  Each new batch of
documents counts its own hashes, is merge-anti-joined with the runs, which takes
out what a run already shows to be frequent, and is written as a run of level 0.
Two runs of one level are merged into one of the next, so there are never more
runs than levels; the merge is a full outer sort-merge join of two tables of the
same buckets, so neither side is shuffled.  A key is frequent if its counts over
all runs reach the threshold; only keys that are frequent already are ever left
out of a batch, so the sum is exact below the threshold.

Hashes are computed once, kept in the shared folder by batch and read again to
find the places of frequent lines.  A document gets the list of its places and is
cut between them, so the work is linear in its lines.  Texts are read twice and
shuffled once, or not at all where the list of places is small.

Edge cases: a null or empty text is one empty line, which has no key and stays;
each row is a document, so repeated rows and repeated or null ids count each by
itself; equal rows get equal results; a line repeated within a document counts
once; an empty table gives no rows; further columns stay, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import drop_folder, fresh, new_folder

THRESHOLD = 10
BATCHES = 4
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What is stripped from both ends of a line.
STRIPPED = " \t\n\x0b\f\r"
HASH = ["h1", "h2"]
_STAGED = "r1 long, r2 long, once array<struct<h1:long,h2:long>>, every array<struct<h1:long,h2:long>>, batch int"
_PLACES = "r1 long, r2 long, places array<int>"


def small_letters(text: Column) -> Column:
    """A-Z in small letters, all else as it is; texts of one byte a letter take the quick way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))


def _hash(*parts: Column) -> tuple[Column, Column]:
    return F.xxhash64(*parts), F.xxhash64(F.lit(17), *parts)


def hashed(df: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 1, batches: int = BATCHES) -> DataFrame:
    """A row for each document: its own hash, its batch, hashes of its distinct keys and, if they differ, of every line in order."""
    t = F.coalesce(F.col(text), F.lit(""))
    r1, r2 = _hash(F.col(key), t)
    keys = F.transform(F.split(small_letters(t), "\n", -1), lambda x: F.btrim(x, F.lit(STRIPPED)))

    def pair(k: Column) -> Column:
        h1, h2 = _hash(k)
        return F.when(F.length(k) >= shortest, F.struct(h1.alias("h1"), h2.alias("h2")))

    rows = df.select(r1.alias("r1"), r2.alias("r2"), keys.alias("keys"))
    rows = rows.withColumn("distinct", F.filter(F.array_distinct("keys"), lambda k: F.length(k) >= shortest))
    every = F.when(F.size("distinct") != F.size("keys"), F.transform("keys", pair))
    return rows.select("r1", "r2", F.transform("distinct", pair).alias("once"), every.alias("every"), F.pmod("r2", F.lit(batches)).cast("int").alias("batch"))


class Runs:
    """Levelled runs of line hashes: at most one a level, of about twice the batches of the level below."""

    def __init__(self, spark: SparkSession, threshold: int = THRESHOLD, buckets: int | None = None):
        self.spark, self.threshold = spark, threshold
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder, self.levels = new_folder(spark, "line-runs"), {}

    def _written(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.select(*HASH, "n").write.format("parquet").bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_folder(self.spark, f"{self.folder}/{name}")

    def _merged(self, one: str, other: str) -> str:
        a, b = self.spark.table(one), self.spark.table(other).withColumnRenamed("n", "m")
        both = a.join(b, HASH, "full").select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        made = self._written(both)
        self._drop(one)
        self._drop(other)
        return made

    def add(self, batch: DataFrame) -> None:
        """Counts a batch of `hashed` rows into the runs."""
        h = batch.select(F.explode("once").alias("h"))
        counts = h.groupBy(F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2")).agg(F.count("*").alias("n"))
        for name in self.levels.values():
            counts = counts.join(self.spark.table(name).where(F.col("n") >= self.threshold), HASH, "left_anti")
        level, made = 0, self._written(counts)
        while level in self.levels:
            made = self._merged(self.levels.pop(level), made)
            level += 1
        self.levels[level] = made

    def frequent(self) -> DataFrame:
        """(h1, h2) of the keys that at least `threshold` documents hold."""
        if not self.levels:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        # as files: over a union of bucketed tables Spark 4.1 may sum each table's groups by themselves
        rows = self.spark.read.schema("h1 long, h2 long, n long").parquet(*(f"{self.folder}/{name}" for name in self.levels.values()))
        return rows.groupBy(*HASH).agg(F.sum("n").alias("n")).where(F.col("n") >= self.threshold).select(*HASH)

    def close(self) -> None:
        for name in self.levels.values():
            self._drop(name)
        self.levels = {}
        drop_folder(self.spark, self.folder)


def places_of(staged: DataFrame, frequent: DataFrame) -> DataFrame:
    """(r1, r2, places): for each document that holds a frequent line, the numbers of all such lines in order."""
    lines = staged.select("r1", "r2", F.posexplode(F.coalesce("every", "once")).alias("at", "h")).select("r1", "r2", "at", "h.h1", "h.h2")
    return lines.join(frequent, HASH, "left_semi").groupBy("r1", "r2").agg(F.array_sort(F.collect_set("at")).alias("places"))


def _between(lines: Column, places: Column) -> Column:
    """The lines whose numbers are not among the places, which are in order: the slices between them."""
    n = F.size(places)

    def piece(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(places, i - 1) + 1)
        end = F.when(i == n, F.size(lines)).otherwise(F.get(places, i))
        return F.slice(lines, begin + 1, end - begin)

    return F.flatten(F.transform(F.sequence(F.lit(0), n), piece))


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, shortest: int = 1, batches: int = BATCHES) -> DataFrame:
    """df with the kept lines as its text, and n_lines and n_dropped (longer names where df has them)."""
    spark = df.sparkSession
    folder = new_folder(spark, "line-hashes")
    hashed(df, key, text, shortest, batches).write.partitionBy("batch").parquet(f"{folder}/hashes")
    staged = spark.read.schema(_STAGED).parquet(f"{folder}/hashes")
    runs = Runs(spark, threshold)
    for n in range(batches):
        runs.add(staged.where(F.col("batch") == n))
    found = f"{folder}/frequent"
    runs.frequent().write.parquet(found)
    runs.close()
    places_of(staged, spark.read.schema("h1 long, h2 long").parquet(found)).write.parquet(f"{folder}/places")
    drop_folder(spark, f"{folder}/hashes")
    drop_folder(spark, found)
    cut = spark.read.schema(_PLACES).parquet(f"{folder}/places")

    t = F.coalesce(F.col(text), F.lit(""))
    at1, at2, where, parts = (fresh(df, c) for c in ("r1_", "r2_", "places_", "lines_"))
    r1, r2 = _hash(F.col(key), t)
    rows = df.withColumns({at1: r1, at2: r2}).join(cut.toDF(at1, at2, where), [at1, at2], "left").withColumn(parts, F.split(t, "\n", -1))
    kept = F.when(F.col(where).isNull(), t).otherwise(F.array_join(_between(F.col(parts), F.col(where)), "\n"))
    dropped = F.when(F.col(where).isNull(), F.lit(0)).otherwise(F.size(where))
    columns = [kept.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    return rows.select(*columns, F.size(parts).cast("long").alias(fresh(df, "n_lines")), dropped.cast("long").alias(fresh(df, "n_dropped")))


def report(df: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    return dedup(df.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
