"""What the corpus operators need from the session: the shared folder and materialised steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor shares: `spark.checkpoint.dir` of the session.

    Only where a session has none (tests, notebooks in local mode) one is set.
    """
    have = spark.sparkContext.getCheckpointDir()
    if have is None:
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="sparkloom-"))
        have = spark.sparkContext.getCheckpointDir()
    return have


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own below the shared one, as a URI."""
    base = shared_folder(spark)
    return f"{base if ':' in base else 'file://' + base}/{kind}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that is no longer read, on any file system that Spark writes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows in one file of the shared folder, of narrow tables and of tables with texts or sets.
NARROW, WIDE = 200_000, 20_000


def compact(df: DataFrame, rows: int, wide: bool = False) -> DataFrame:
    """df in no more partitions than files of a decent size need, for about so many rows at most.

    Partitions follow the input's or the session's number otherwise; each is a
    file to make, open and clear away, however little it holds.
    """
    return df.coalesce(max(24, -(-rows // WIDE)) if wide else max(4, -(-rows // NARROW)))


def settle(df: DataFrame, rows: int | None = None, wide: bool = False) -> DataFrame:
    """The same rows, computed once and kept in the shared folder, so lost executors cost no recomputation.

    rows: about how many there are at most, where that is known (see `compact`).
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else compact(df, rows, wide)).checkpoint(eager=True)


#: Rows of a table that may be collected and broadcast.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """The rows of a small aggregate as a literal to broadcast; if there are more than FEW, df as it is, to be shuffled.

    They come and go as Arrow: of rows as Python objects Spark makes an RDD, for
    which each executor starts a second daemon and workers that stay for a minute.
    """
    rows = df.limit(FEW + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows.num_rows <= FEW else df


#: Bytes of an Arrow batch between the JVM and a Python worker; both sides hold a few at a time.
BATCH_BYTES, _BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def texts(df: DataFrame) -> DataFrame:
    """df, with the session's limit on Arrow batches lowered to BATCH_BYTES if it is higher; rows of texts vary too much to be limited by number."""
    have = df.sparkSession.conf.get(_BATCH_CONF, None)
    if have is None or not have.rstrip("b").isdigit() or int(have.rstrip("b")) > BATCH_BYTES:
        df.sparkSession.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """The name, made longer until no column has it, in any case."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
