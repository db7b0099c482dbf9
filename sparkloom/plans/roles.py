"""The driver's tables in the roles of modules, imports and commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LANGUAGES = ("java", "python", "go", "ruby", "typescript", "kotlin", "rust")
TYPES = ("controller", "service", "config", "util", "test", "model", "component", "repository", "hook", "handler")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names)).cast("int") + 1)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as modules: loc by size, language and type by number, directories of about forty."""
    k = F.col("p_partkey")
    folder = F.concat(F.lit("src/d"), k % 50)
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), k).alias("id"), F.concat(folder, F.lit("/"), F.lit("p"), k, F.lit(".ts")).alias("file_path"), F.concat(F.lit("p"), k).alias("label"),
        _pick(TYPES, k).alias("module_type"), (F.col("p_size") * 40).alias("loc"), folder.alias("directory"), _pick(LANGUAGES, k).alias("language"), k.alias("ord"),
    )


PARTS_SQL = f"""SELECT 'p' || p_partkey AS id, 'src/d' || (p_partkey % 50) || '/p' || p_partkey || '.ts' AS file_path, 'p' || p_partkey AS label,
  ({list(TYPES)})[p_partkey % {len(TYPES)} + 1] AS module_type, p_size * 40 AS loc, 'src/d' || (p_partkey % 50) AS directory,
  ({list(LANGUAGES)})[p_partkey % {len(LANGUAGES)} + 1] AS language, p_partkey AS ord FROM part"""


def successions(spark: SparkSession, sf_dir: str, since: str | None = None) -> DataFrame:
    """Imports between parts: a part and the next one of its order."""
    lines = table(spark, sf_dir, "lineitem")
    if since:
        lines = lines.where(F.col("l_shipdate") >= F.lit(since).cast("timestamp"))
    follows = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    pairs = lines.select("l_partkey", follows.alias("n")).where("n is not null and n <> l_partkey").distinct()
    return pairs.select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("p"), "n").alias("target"), F.lit("import").alias("type"), F.lit(0).cast("long").alias("ord"))


def successions_sql(since: str | None = None) -> str:
    where = f"WHERE l_shipdate >= TIMESTAMP '{since}'" if since else ""
    return f"""SELECT DISTINCT 'p' || l_partkey AS source, 'p' || n AS target, 'import' AS type FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem {where}) WHERE n IS NOT NULL AND n <> l_partkey"""


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations and an edge from a supplier's nation to a customer's where enough orders join them (more than the mean)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    pairs = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "c_nationkey").agg(F.count("*").alias("n"))
    mean = pairs.agg(F.avg("n").alias("mean"))
    edges = pairs.where("s_nationkey <> c_nationkey").crossJoin(F.broadcast(mean)).where("n > mean").select(F.format_string("n%02d", "s_nationkey").alias("source"), F.format_string("n%02d", "c_nationkey").alias("target"), F.lit("import").alias("type"))
    return table(spark, sf_dir, "nation").select(F.format_string("n%02d", "n_nationkey").alias("id"), "n_name"), edges


TRADE_SQL = """pairs AS (SELECT s_nationkey, c_nationkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
 nodes AS (SELECT printf('n%02d', n_nationkey) AS id FROM nation),
 edges AS MATERIALIZED (SELECT printf('n%02d', s_nationkey) AS source, printf('n%02d', c_nationkey) AS target FROM pairs WHERE s_nationkey <> c_nationkey AND n > (SELECT avg(n) FROM pairs))"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes: a user's day is a commit, the type of event a path."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("commit_id"), F.col("user_id").cast("string").alias("author"), "ts", F.col("event_type").alias("path"))


COMMITS_SQL = "SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS commit_id, CAST(user_id AS VARCHAR) AS author, ts, event_type AS path FROM events"
