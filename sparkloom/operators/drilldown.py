"""Directories of any depth: which files lie below which, sums of subtrees, and the map of any one of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .layout import squarify

#: Children of a directory that are laid out as rectangles of their own; the rest share one.
MOST_CHILDREN = 5000


def ancestors(nodes: DataFrame) -> DataFrame:
    """(ancestor, child, depth, is_file, loc): for each file and each directory above it, the root being '', the child of the directory that leads to it."""
    parts = nodes.select("file_path", "loc", F.split("file_path", "/").alias("parts"))
    level = parts.select("file_path", "loc", "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - 1)).alias("depth"))
    upto = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    return level.select(upto(F.col("depth")).alias("ancestor"), upto(F.col("depth") + 1).alias("child"), "depth", (F.col("depth") == F.size("parts") - 1).alias("is_file"), F.greatest(F.coalesce("loc", F.lit(0)), F.lit(0)).cast("long").alias("loc"))


def subtrees(nodes: DataFrame) -> DataFrame:
    """(path, parent, depth, is_file, files, loc) of every directory and file below the root, with the sums of all that lies below; one aggregation for all depths."""
    return ancestors(nodes).groupBy("ancestor", "child", "depth", "is_file").agg(F.count("*").alias("files"), F.sum("loc").alias("loc")).select(F.col("child").alias("path"), F.col("ancestor").alias("parent"), "depth", "is_file", "files", "loc")


def drill(nodes: DataFrame, at: str = "", width: float = 1200, height: float = 800) -> DataFrame:
    """(id, value, x, y, w, h) of what lies directly in a directory, laid out anew in the whole area; value is a subtree's loc, 1 at least.

    Beyond MOST_CHILDREN the least share one rectangle, of id null, as none of them could be seen.
    """
    below = subtrees(nodes).where(F.col("parent") == at).select(F.col("path").alias("id"), F.greatest("loc", F.lit(1)).cast("double").alias("value"))
    most = below.orderBy(F.desc("value"), "id").limit(MOST_CHILDREN)
    rest = below.join(most.select("id"), "id", "left_anti").agg(F.lit(None).cast("string").alias("id"), F.sum("value").alias("value")).where("value is not null")

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(((i, v) for i, v in zip(pdf["id"], pdf["value"], strict=True)), key=lambda r: (r[0] is None, r[0] or ""))
        return pd.DataFrame(squarify(rows, 0, 0, width, height), columns=["id", "value", "x", "y", "w", "h"])

    return most.unionByName(rest).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lay, "id string, value double, x double, y double, w double, h double")


def crumbs(path: str) -> list[str]:
    """The directories from the root to a path, for the way back up."""
    parts = path.split("/") if path else []
    return ["", *("/".join(parts[: n + 1]) for n in range(len(parts)))]
