"""Media columns: payloads stored as grey images in archives, read by a custom data source.

`store` packs one lossless image per row into ZIP archives (members stored, not
deflated again) in a folder.  `ArchiveMembers` is a Spark data source over such
a folder: the driver plans byte ranges over the archive files without opening
them, a task takes the members whose header starts inside its range, streams
them as Arrow batches of bounded size, and retries a member by its own offset
when reading it fails.  `features` decodes the stored bytes and describes them.

Edge cases: a null or empty text is a payload of 64 zero bytes; repeated rows
give one member each; a null key comes back as null; an empty table gives an
empty folder and no rows; columns other than key and payload are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import new_folder, texts

#: Pixels in a row of the image, so payloads are padded to a multiple of it.
WIDTH = 64
#: An archive is closed when it holds this much and the next one begins.
ARCHIVE_BYTES = 256 << 20
#: Planned range of an archive for one task, and bytes of one Arrow batch.
RANGE_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(data: bytes) -> bytes:
    """PNG, 8-bit grey, of the data and zero bytes up to a positive multiple of WIDTH."""
    rows = max(1, -(-len(data) // WIDTH))
    image = np.zeros((rows, WIDTH + 1), np.uint8)  # column 0: filter type none
    flat = np.zeros(rows * WIDTH, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    image[:, 1:] = flat.reshape(rows, WIDTH)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(image.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> np.ndarray:
    """Pixels by row; ValueError if the bytes are not an image of `encode` or are damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("not an image")
    at, body, size = 8, b"", None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        part = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack(">II", part[:8])
        elif kind == b"IDAT":
            body += part
        at += 12 + n
    image = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], size[0] + 1)
    if image[:, 0].any():
        raise ValueError("filtered rows")
    return image[:, 1:]


def store(df: DataFrame, folder: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes one member per row of df; a task's archives get their names when they are whole.

    A task that is run again writes the same names again, so retries leave no
    second copy; unfinished files begin with a dot and are never read.
    """
    n_key, n_text = key, text

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        part, number, seq, out = TaskContext.get().partitionId(), 0, 0, None
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), strict=True):
                if out is None:
                    hidden = f"{root}/.{part:06d}-{number:04d}-{uuid.uuid4().hex}"
                    stream = files.open_output_stream(hidden)
                    out, held = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED), 0
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                media = encode(data)
                out.writestr(zipfile.ZipInfo(f"{seq}.{'' if k.as_py() is None else k.as_py()}.{len(data)}.png"), media)
                seq, held = seq + 1, held + len(media)
                if held >= ARCHIVE_BYTES:
                    out = _finish(files, out, stream, hidden, f"{root}/{part:06d}-{number:04d}.zip")
                    number += 1
        if out is not None:
            _finish(files, out, stream, hidden, f"{root}/{part:06d}-{number:04d}.zip")
        yield pa.RecordBatch.from_pydict({"members": pa.array([seq], pa.int64())})

    texts(df).select(F.col(n_key).cast("long").alias("k"), F.col(n_text).alias("t")).mapInArrow(write, "members long").write.format("noop").mode("overwrite").save()
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)


def _finish(files, out, stream, hidden: str, name: str) -> None:
    out.close()
    stream.close()
    files.move(hidden, name)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[Range]:
        files, root = pafs.FileSystem.from_uri(self.folder)
        found = sorted((f.path, f.size) for f in files.get_file_info(pafs.FileSelector(root, recursive=True)) if f.path.endswith(".zip"))
        return [Range(path, at, at + self.range_bytes) for path, size in found for at in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def _member(self, files, archive, path: str, info: zipfile.ZipInfo) -> bytes:
        """The member that starts at info.header_offset; each failed try opens the archive anew."""
        for left in range(self.retries, -1, -1):
            try:
                return archive.read(info)  # seeks to the offset and checks the CRC
            except (OSError, zipfile.BadZipFile, zlib.error, EOFError):
                if not left:
                    raise
                archive = zipfile.ZipFile(files.open_input_file(path))
        raise AssertionError

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        files, _ = pafs.FileSystem.from_uri(self.folder)
        archive = zipfile.ZipFile(files.open_input_file(partition.path))
        inside = [i for i in archive.infolist() if partition.start <= i.header_offset < partition.end]
        rows, held = [], 0
        for info in inside:
            media = self._member(files, archive, partition.path, info)
            rows.append((partition.path, info.header_offset, info.filename, media))
            held += len(media)
            if held >= self.batch_bytes:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "offset", "member", "media"])


class ArchiveMembers(DataSource):
    """`spark.read.format("archive_members").load(folder)`: archive, offset, member, media."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, offset long, member string, media binary"

    def reader(self, schema) -> MemberReader:
        return MemberReader(dict(self.options))


def members(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").options(**options).load(folder)


def describe(pixels: np.ndarray) -> str:
    """Rows, mean and deviation of the samples and, per column, whether it is brighter than the whole."""
    columns = pixels.mean(axis=0)
    bright = np.packbits(columns > pixels.mean()).tobytes().hex()
    return f"{pixels.shape[0]}:{pixels.mean():.3f}:{math.sqrt(float(pixels.astype(np.float64).var())):.3f}:{bright}"


FEATURES = "key long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_bytes long"


def features(stored: DataFrame) -> DataFrame:
    """Digests and features of each member, from the bytes read back; n_bytes is the length before padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, media in zip(batch.column("member").to_pylist(), batch.column("media"), strict=True):
                media = media.as_buffer().to_pybytes()
                pixels = decode(media)
                data = pixels.tobytes()
                _, key, n, _ = name.split(".")
                out.append((int(key) if key else None, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), describe(pixels), int(n)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = [x.split()[0] for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names=names)

    return stored.select("member", "media").mapInArrow(run, FEATURES)


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Stores df's payloads in a new folder below the shared one (or in `folder`) and returns `features` of what is read back."""
    folder = folder or new_folder(df.sparkSession, "media")
    store(df, folder, key, text)
    return features(members(df.sparkSession, folder))
