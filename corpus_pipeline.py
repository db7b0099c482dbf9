"""From raw documents to tokens: classify, join near copies, decontaminate, redact secrets, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the
columns of `documents`, and further ones that a table has, whatever their names.

Edge cases: rows whose text is null, empty or blank are rejected by the first
stage; later stages alone let them pass.  Equal rows are copies of each other, so
one of them stays.  A row without an id is never a copy's representative and
stays; rows of one id and different texts are told apart by their texts.  An
empty table gives no rows, from every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import bpe, decontaminate, ngram_join, quality, secrets
from sparkloom.llm.shared import compact, drop_folder, new_folder, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return compact(quality.keep(docs), docs.count(), wide=True)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, on five-word shingles from a similarity of 0.8, the document of the least id stays."""
    return ngram_join.one_of_each(docs, width=5, percent=80)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return compact(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")), docs.count(), wide=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay."""
    return compact(secrets.redacted(docs, length="n_chars"), docs.count(), wide=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document."""
    return compact(bpe.encode_table(docs, with_ids=True).withColumnRenamed("key", "doc_id"), docs.count(), wide=True)


STAGES = [
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", remove_benchmark),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", encode),
]

#: SQL cannot express the trained classifier; tests compare each stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, before = new_folder(spark, "pipeline"), None
    for n, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{n}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            drop_folder(spark, before)
        before = out
    return docs
