"""Windowed and stateful queries on events, for streams and tables alike.

The same function takes a streaming or a static DataFrame; only the watermark
differs, which a static one ignores.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Events and value per window and key; sliding if `slide` is given."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    grouped = events.withWatermark("ts", late).groupBy(w.alias("w"), key)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events no further apart than the gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame) -> DataFrame:
    """The first time of each user and type."""
    return events.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_seen"))


def without_repeats(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event id once, of a stream within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def track_new(events: DataFrame) -> DataFrame:
    """A stream of (user_id, event_type, first_seen, is_new): state per user remembers the types seen so far."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        known = bool(seen)
        out = []
        for pdf in batches:
            for kind, ts in pdf.sort_values(["ts", "event_id"])[["event_type", "ts"]].itertuples(index=False):
                if kind not in seen:
                    out.append((key[0], kind, ts, known))
                    seen.add(kind)
        state.update((sorted(seen),))
        yield pd.DataFrame(out, columns=["user_id", "event_type", "first_seen", "is_new"])

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_type string, first_seen timestamp, is_new boolean", "seen array<string>", "append", "NoTimeout")


#: Parts of a state table; a batch rewrites those that its keys fall into.
PARTS = 64


def _versions(spark, folder: str) -> dict[int, list[int]]:
    """The batches that wrote each part, in order; a batch counts only when it is complete."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    for batch in files.listStatus(path(folder)) if files.exists(path(folder)) else []:
        if files.exists(path(batch.getPath(), "_SUCCESS")):
            for part in files.listStatus(batch.getPath()):
                if part.getPath().getName().startswith("part_of="):
                    found.setdefault(int(part.getPath().getName()[8:]), []).append(int(batch.getPath().getName()[1:]))
    return {k: sorted(v) for k, v in found.items()}


_SEEN = "user_id long, event_type string, first_seen timestamp"


def _read_parts(spark, folder: str, newest: dict[int, int]) -> DataFrame:
    paths = [f"{folder}/b{n}/part_of={k}" for k, n in newest.items()]
    return spark.read.schema(_SEEN).parquet(*paths) if paths else spark.createDataFrame([], _SEEN)


def read_upserted(spark, folder: str) -> DataFrame:
    """(user_id, event_type, first_seen): the state that `upsert_into` has written so far."""
    return _read_parts(spark, folder, {k: v[-1] for k, v in _versions(spark, folder).items()})


def upsert_into(folder: str, parts: int = PARTS):
    """A foreachBatch sink that keeps the least first_seen per key in a table of its own.

    The state lies in parts by a hash of the key.  A batch reads and writes only the
    parts that its own keys fall into; parts that no key falls into stay as they
    are, and versions of a part older than the last two are deleted.  A batch that
    runs again reads what was there before it and writes the same place.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int")
        new = first_seen(batch).persist()
        touched = {r[0] for r in new.select(part).distinct().collect()}  # at most `parts`
        before = {k: [n for n in v if n < number] for k, v in _versions(spark, folder).items()}
        old = _read_parts(spark, folder, {k: v[-1] for k, v in before.items() if v and k in touched})
        merged = old.unionByName(new.select(*old.columns)).groupBy("user_id", "event_type").agg(F.min("first_seen").alias("first_seen"))
        merged.withColumn("part_of", part).repartition("part_of").write.mode("overwrite").partitionBy("part_of").parquet(f"{folder}/b{number}")
        new.unpersist()
        path = spark._jvm.org.apache.hadoop.fs.Path
        files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for k in touched:
            for n in before.get(k, [])[:-1]:
                files.delete(path(f"{folder}/b{n}/part_of={k}"), True)

    return run
