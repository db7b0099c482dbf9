"""Listing a source tree in parallel, without reading any content.

Directories are listed level by level: the directories of a level are rows, tasks
list them, and what they hold are the files of the result and the directories of
the next level.  A directory that is ignored is dropped before it is listed, so a
vendored or built tree costs nothing.  Any file system that Arrow opens by its
address will do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.iterate import settle

SCHEMA = "path string, is_file boolean, n_bytes long, modified timestamp"
#: Directories that one task lists at a time.
DIRECTORIES = 1000


def address(spark: SparkSession, root: str) -> str:
    """The root with its scheme, as the session's file systems understand it, in the form that Arrow opens."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/(?!/)", "file:///", whole)


def listed(spark: SparkSession, root: str, pruned: Column | None = None) -> DataFrame:
    """(path, n_bytes, modified) of all files below root; paths are relative, also of files of no bytes.

    pruned: of the column `path`, whether a directory (its path ends in a slash) or a file is passed over.
    """
    base = address(spark, root)
    drop = F.lit(False) if pruned is None else F.coalesce(pruned, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = pafs.FileSystem.from_uri(base)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                where = f"{top}/{folder}".rstrip("/")
                found = files.get_file_info(pafs.FileSelector(where, allow_not_found=bool(folder)))  # a directory may go meanwhile, the root may not be missing
                names = [f"{folder}{f.base_name}{'' if f.is_file else '/'}" for f in found]
                columns = [pa.array(names, pa.string()), pa.array([f.is_file for f in found], pa.bool_()), pa.array([f.size for f in found], pa.int64()), pa.array([f.mtime for f in found], pa.timestamp("us", "UTC"))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "is_file", "n_bytes", "modified"])

    level, n, out = spark.createDataFrame([("",)], "path string"), 1, None
    while n:
        spread = level.repartition(max(1, min(n, -(-n // DIRECTORIES) * spark.sparkContext.defaultParallelism)))
        found = settle(spread.mapInArrow(run, SCHEMA).where(~drop))
        files = found.where("is_file").drop("is_file")
        out = files if out is None else out.unionByName(files)
        level = found.where("not is_file").select("path")
        n = level.count()
    return out


def empty_files(spark: SparkSession, root: str, pruned: Column | None = None) -> DataFrame:
    """(path, n_bytes, content) of the files of no bytes, which Spark's readers of content pass over."""
    return listed(spark, root, pruned).where("n_bytes = 0").select("path", "n_bytes", F.lit(b"").alias("content"))
