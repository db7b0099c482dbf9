"""Git logs as a data source: split at commit bounds, filters pushed down, batch and stream.

A log is what `git log --name-only --format=GIT_FORMAT` writes: a header line for
each commit and a line for each path that it changed.  The driver plans byte
ranges over the files of a folder without reading them; a range gives the commits
whose header begins in it and reads on to the end of the last of them, so every
commit is read once, wherever the ranges are cut.

`since` and `under` (options, or filters on `ts` and `path`) are applied while reading: paths of a commit
that is too old are passed over without being parsed.  A log that is `ordered`,
newest first as git writes it, lets the driver look at the first header of each
range and drop all ranges after the first one that is too old.

As a stream, the offset is the number of bytes of each file that end with whole
commits; what is appended after them is the next batch.  A file that becomes
shorter was written anew, which is an error.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, StringStartsWith

from .listing import address

HEADER = b"commit "
RANGE_BYTES = 32 << 20
#: Rows of a batch to the JVM.
BATCH_ROWS = 10_000
SCHEMA = "commit_id string, author string, ts timestamp, path string"
_FIELDS = pa.schema([("commit_id", pa.string()), ("author", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("path", pa.string())])


class Range(InputPartition):
    """Commits whose header begins at `start` or later and before `end`, read up to `limit`."""

    def __init__(self, path: str, start: int, end: int, limit: int):
        super().__init__((path, start, end, limit))
        self.path, self.start, self.end, self.limit = path, start, end, limit


def _time(text: str | datetime | None) -> datetime | None:
    if text is None or isinstance(text, datetime):
        return text if text is None or text.tzinfo else text.replace(tzinfo=timezone.utc)
    found = datetime.fromisoformat(text.strip())
    return found if found.tzinfo else found.replace(tzinfo=timezone.utc)


def _head(line: bytes) -> tuple[str, str, datetime | None]:
    """Commit, author and time of a header line; an author's name may hold anything but the separator."""
    parts = line[len(HEADER) :].decode("utf-8", "replace").rstrip("\r\n").split("|||")
    try:
        ts = _time(parts[-1]) if len(parts) > 1 else None
    except ValueError:
        ts = None
    return parts[0], "|||".join(parts[1:-1]), ts


class _Log:
    """What batch and stream have in common: where logs are, how ranges are cut and read."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.since, self.after, self.under = _time(options.get("since")), None, [options["under"]] if "under" in options else []
        self.is_ordered = options.get("ordered", "false").lower() == "true"

    def _files(self):
        return pafs.FileSystem.from_uri(self.folder if ":" in self.folder else f"file://{self.folder}")

    def sizes(self) -> dict[str, int]:
        files, root = self._files()
        top = files.get_file_info(root)
        found = [top] if top.is_file else files.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path: f.size for f in found if f.is_file and not f.base_name.startswith((".", "_"))}

    def ranges(self, spans: dict[str, tuple[int, int]]) -> list[Range]:
        return [Range(path, at, min(at + self.range_bytes, end), end) for path, (start, end) in sorted(spans.items()) for at in range(start, end, self.range_bytes)]

    def _lines(self, part: Range) -> Iterator[tuple[int, bytes]]:
        """(place, line) from the first line that begins in the range on."""
        files, _ = self._files()
        with files.open_input_file(part.path) as raw:
            at = max(part.start - 1, 0)
            raw.seek(at)
            lines = io.BufferedReader(_Raw(raw), 1 << 20)
            if part.start:
                at += len(lines.readline())  # the line that holds the byte before the range is another range's
            while at < part.limit and (line := lines.readline()):
                yield at, line
                at += len(line)

    def first_time(self, part: Range) -> datetime | None:
        for at, line in self._lines(part):
            if at >= part.end:
                return None
            if line.startswith(HEADER) and b"|||" in line:
                return _head(line)[2]
        return None

    def wants(self, ts: datetime | None) -> bool:
        if self.since is None and self.after is None:
            return True
        return ts is not None and (self.since is None or ts >= self.since) and (self.after is None or ts > self.after)

    def rows(self, part: Range) -> Iterator[pa.RecordBatch]:
        out, head = [], None
        for at, line in self._lines(part):
            if line.startswith(HEADER) and b"|||" in line:
                if at >= part.end:
                    break
                head = _head(line)
                if not self.wants(head[2]):
                    head = None
            elif head is not None and (path := line.strip()):
                name = path.decode("utf-8", "replace")
                name = (name[1:-1] if len(name) > 1 and name[0] == name[-1] == '"' else name).replace("\\", "/")
                if all(name.startswith(u) for u in self.under):
                    out.append((*head, name))
                    if len(out) >= BATCH_ROWS:
                        yield _batch(out)
                        out = []
        if out:
            yield _batch(out)


class _Raw(io.RawIOBase):
    """An Arrow file as one that Python can buffer."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


class LogReader(_Log, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes lower bounds of `ts` and beginnings of `path`; Spark keeps the others."""
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("ts",):
                self.since = max(filter(None, (self.since, _time(f.value))))
            elif isinstance(f, GreaterThan) and f.attribute == ("ts",):
                self.after = max(filter(None, (self.after, _time(f.value))))
            elif isinstance(f, StringStartsWith | EqualTo) and f.attribute == ("path",):
                self.under.append(f.value)
                if isinstance(f, EqualTo):
                    yield f
            else:
                yield f

    def partitions(self) -> list[Range]:
        found = self.ranges({path: (0, size) for path, size in self.sizes().items()})
        if self.is_ordered and (self.since or self.after):
            kept, over = [], set()
            for part in found:
                if part.path not in over:
                    first = self.first_time(part)
                    if first is not None and not self.wants(first) and part.start:
                        over.add(part.path)  # all further commits of this file are older
                    else:
                        kept.append(part)
            found = kept
        return found or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition) if partition.path else iter(())


class LogStream(_Log, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({path: self._whole(path, size) for path, size in sorted(self.sizes().items())})}

    def _whole(self, path: str, size: int) -> int:
        """Bytes up to the end of the last line feed; a line that is still being written waits."""
        files, _ = self._files()
        with files.open_input_file(path) as f:
            end = size
            while end > 0:
                begin = max(0, end - 65_536)
                f.seek(begin)
                at = f.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        shorter = [path for path, n in before.items() if after.get(path, n) < n]
        if shorter:
            raise ValueError(f"{shorter[0]} has become shorter since the stream read it")
        return self.ranges({path: (before.get(path, 0), n) for path, n in after.items() if n > before.get(path, 0)})

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return self.rows(partition)


class GitLog(DataSource):
    """`spark.read.format("git_log").load(path)` and `spark.readStream...`: commit_id, author, ts, path."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LogReader:
        return LogReader(dict(self.options))

    def streamReader(self, schema) -> LogStream:
        return LogStream(dict(self.options))


def _options(since: str | None, under: str | None, range_bytes: int, ordered: bool) -> dict[str, str]:
    out = {"since": since, "under": under, "rangebytes": str(range_bytes), "ordered": str(ordered).lower()}
    return {k: v for k, v in out.items() if v is not None}


def git_log(spark: SparkSession, path: str, since: str | None = None, under: str | None = None, range_bytes: int = RANGE_BYTES, ordered: bool = False) -> DataFrame:
    """Changes of the commits since a time (ISO), of the paths that begin so, in logs at a path.

    The session is told to push filters down to data sources in Python, as Spark refuses a reader that takes filters otherwise.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitLog)
    return spark.read.format("git_log").options(**_options(since, under, range_bytes, ordered)).load(address(spark, path))


def git_log_stream(spark: SparkSession, path: str, since: str | None = None, under: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same as a stream of what is appended; writers append whole commits."""
    spark.dataSource.register(GitLog)
    return spark.readStream.format("git_log").options(**_options(since, under, range_bytes, False)).load(address(spark, path))
