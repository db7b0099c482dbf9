"""A log parser with state: the last header of each file holds for the lines that follow, whatever batch they come in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HEADER = "commit "
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "file string, line_no long, commit_id string, path string"


class CarryHeader(StatefulProcessor):
    """Keeps a file's last header; a timer lets it go when the file has been silent for `idle_ms`."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.header = handle.getValueState("header", "commit_id string")
        self.alarm = handle.getValueState("alarm", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("line_no")
        heads = got["value"].str.startswith(HEADER)
        carried = got["value"].where(heads).str.slice(len(HEADER), len(HEADER) + 40).ffill()
        if self.header.exists():
            carried = carried.fillna(self.header.get()[0])
        if isinstance(carried.iloc[-1], str):
            self.header.update((carried.iloc[-1],))
            self._wait(timerValues)
        kept = ~heads & (got["value"].str.strip() != "") & carried.notna()
        yield pd.DataFrame({"file": key[0], "line_no": got["line_no"][kept], "commit_id": carried[kept], "path": got["value"][kept]})

    def _wait(self, timerValues) -> None:
        if self.alarm.exists():
            self.handle.deleteTimer(self.alarm.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(at)
        self.alarm.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.header.clear()
        self.alarm.clear()
        yield pd.DataFrame({"file": [], "line_no": [], "commit_id": [], "path": []})

    def close(self) -> None:
        return None


def carry_headers(lines: DataFrame, idle_ms: int = 86_400_000) -> DataFrame:
    """(file, line_no, commit_id, path) from a stream of lines (file, line_no, value) that come in the order of their file.

    A batch may hold a file's lines in any order.  State is one short row a file,
    kept in RocksDB, which is set here where the session has another store.  Timers
    by the clock need a query that goes on; one that ends with the available data
    would wait for them.
    """
    spark = lines.sparkSession
    if spark.conf.get(_PROVIDER, "") != _ROCKS:
        spark.conf.set(_PROVIDER, _ROCKS)
    given = lines.select("file", F.col("line_no").cast("long").alias("line_no"), F.coalesce("value", F.lit("")).alias("value"))
    return given.groupBy("file").transformWithStateInPandas(CarryHeader(idle_ms), SCHEMA, "append", "ProcessingTime")
