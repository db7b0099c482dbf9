"""Reading a source tree and its history as tables."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import dims
from sparkloom.functions.text import basename, directory, language_of, posix
from sparkloom.operators.extract import Aliases
from sparkloom.operators.iterate import settle
from sparkloom.sources import listing


def ignored(path: Column) -> Column:
    """Whether a scan passes over a relative path: built, vendored and declaration files."""
    inside = lambda names: "|".join(re.escape(n) for n in names)
    hit = path.rlike(rf"(^|/)({inside(dims.COMMON_IGNORES)})/") | path.rlike(r"\.d\.ts$|\.config\.(ts|js|mjs|cjs)$")
    for language, names in dims.LANGUAGE_IGNORES.items():
        hit = hit | ((language_of(path) == language) & path.rlike(rf"(^|/)({inside(names)})/"))
    return hit


def pruned_folder(path: Column) -> Column:
    """Whether a scan never enters a directory (its path ends in a slash), whatever the language."""
    inside = "|".join(re.escape(n) for n in dims.COMMON_IGNORES)
    return path.endswith("/") & path.rlike(rf"(^|/)({inside})/$")


def ignore_patterns(text: str) -> list[tuple[str, bool]]:
    """(regex, keep) of the lines of an ignore file, in order; a later match overrides an earlier one."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        body = line[1:] if keep else line
        anchored = "/" in body.rstrip("/")
        folder = body.endswith("/")
        body = body.strip("/")
        expr = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or re.escape(p) for p in re.split(r"(\*\*/|\*\*|\*|\?)", body) if p)
        out.append((("^" if anchored else "(?:^|.*/)") + expr + ("/.*$" if folder else "(?:/.*)?$"), keep))
    return out


def ignored_by(path: Column, patterns: list[tuple[str, bool]]) -> Column:
    out = F.lit(False)
    for expr, keep in patterns:
        out = F.when(path.rlike(expr), F.lit(not keep)).otherwise(out)
    return out


def read_tree(spark: SparkSession, root: str, focus: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """(path, n_bytes, content) of the files below root; paths are relative and content is read only where it is used.

    Spark's reader passes over files of no bytes; they come from the listing.
    """
    top = root if focus is None else f"{root.rstrip('/')}/{focus}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(top)
    base = re.escape(re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^{base}/", "")
    inside = "" if focus is None else f"{focus.strip('/')}/"
    none = listing.empty_files(spark, top, pruned_folder(F.concat(F.lit(inside), F.col("path")))).withColumn("path", posix(F.concat(F.lit(inside), F.col("path"))))
    out = files.select(posix(rel).alias("path"), F.col("length").alias("n_bytes"), "content").unionByName(none)
    return out if most_bytes is None else out.where(F.col("n_bytes") <= most_bytes)


#: Extensions that a scan falls back to where no language is found.
SCRIPTS = r"(?i)\.(ts|tsx|js|jsx)$"


def numbered(paths: DataFrame) -> DataFrame:
    """(path, ord): the place of each distinct path in path order, without one task that holds them all.

    Ranges of paths are numbered apart and shifted by how many stand before them;
    as many numbers as there are ranges come to the driver.
    """
    from pyspark.sql import Window as W

    ranged = paths.select("path").distinct().repartitionByRange("path").withColumn("range", F.spark_partition_id())
    ranged = settle(ranged)
    counts = sorted((r[0], r[1]) for r in ranged.groupBy("range").count().collect())
    before, shifts = 0, []
    for number, n in counts:
        shifts.append((number, before))
        before += n
    shift = paths.sparkSession.createDataFrame(shifts, "range int, before long")
    place = F.row_number().over(W.partitionBy("range").orderBy("path")) - 1
    return ranged.withColumn("place", place).join(F.broadcast(shift), "range").select("path", (F.col("before") + F.col("place")).cast("long").alias("ord"))


def scan(files: DataFrame, depth: int | None = None, exact_depth: bool = False, ignore_text: str | None = None) -> DataFrame:
    """Source files (path, text, language, ord) of a tree from `read_tree`, in path order.

    depth keeps files at most so many directories deep, or exactly so many.
    Where no file has a known language and no manifest names one, script files by
    extension are what is left.
    """
    p = F.col("path")
    known = language_of(p)
    if files.where(known.isNotNull()).isEmpty():
        known = F.when(p.rlike(SCRIPTS), "javascript")
    some = files.where(known.isNotNull() & ~ignored(p))
    if ignore_text:
        some = some.where(~ignored_by(p, ignore_patterns(ignore_text)))
    if depth is not None:
        deep = F.size(F.split(p, "/")) - 1
        some = some.where(deep == depth if exact_depth else deep <= depth)
    text = F.decode(F.col("content"), "UTF-8")
    # Only paths are numbered; texts stay where they are read.
    return some.select("path", text.alias("text"), known.alias("language")).join(numbered(some), "path")


def languages(files: DataFrame) -> DataFrame:
    """(language, files, manifest): languages with files or a manifest at the root, most files first."""
    spark = files.sparkSession
    known = spark.createDataFrame([(n, i, list(m)) for i, (n, _, m) in enumerate(dims.LANGUAGES)], "language string, place int, manifests array<string>")
    counts = files.where(~ignored(F.col("path"))).groupBy(language_of(F.col("path")).alias("language")).agg(F.count("*").alias("files"))
    names = sorted({m for _, _, ms in dims.LANGUAGES for m in ms})
    found = files.where(F.col("path").isin(*names)).agg(F.coalesce(F.collect_set("path"), F.array().cast("array<string>")).alias("found"))  # a dozen names at most
    joined = known.join(counts, "language", "left").crossJoin(found)
    manifest = F.get(F.filter("manifests", lambda m: F.array_contains("found", m)), 0)
    return joined.select("language", F.coalesce("files", F.lit(0)).alias("files"), manifest.alias("manifest"), "place").where("files > 0 or manifest is not null").orderBy(F.col("files").desc(), "place").drop("place")


def frameworks(manifests: dict[str, str]) -> list[str]:
    """Frameworks by the manifests of a project (path to text), which are a few small files."""
    out: list[str] = []

    def by_key(deps: dict, table: list) -> None:
        for name, keys, unless in table:
            if any(deps.get(k) for k in keys) and not set(unless) & set(out):
                out.append(name)

    def parsed(name: str) -> dict:
        try:
            found = json.loads(manifests.get(name, "{}"))
            return found if isinstance(found, dict) else {}
        except ValueError:
            return {}

    package = parsed("package.json")
    by_key({**package.get("dependencies", {}), **package.get("devDependencies", {})}, dims.JS_FRAMEWORKS)
    words = set()
    for name in ("requirements.txt", "pyproject.toml", "Pipfile"):
        words |= set(re.findall(r"[a-z][a-z0-9_-]*", manifests.get(name, "").lower()))
    out += [f for f in dims.PYTHON_FRAMEWORKS if f in words]
    for _, name, framework, mark in dims.TEXT_FRAMEWORKS:
        if mark in manifests.get(name, "") and framework not in out:
            out.append(framework)
    if {"AndroidManifest.xml", "app/build.gradle", "app/build.gradle.kts"} & set(manifests):
        out.append("android")
    project = next((manifests[p] for p in sorted(manifests) if p.endswith(".csproj")), "")
    out += [f for f, mark in (("aspnet", "Microsoft.AspNetCore"), ("blazor", "Microsoft.AspNetCore.Components")) if mark in project]
    composer = parsed("composer.json")
    by_key({**composer.get("require", {}), **composer.get("require-dev", {})}, dims.PHP_FRAMEWORKS)
    return out


def primary_framework(found: list[str]) -> str:
    return next((f for f in dims.PRIMARY if f in found), found[0] if found else "unknown")


def has_typescript(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.bool_or(F.col("path").isin("tsconfig.json", "tsconfig.app.json")), F.lit(False)).alias("has_typescript"))


def entry_points(files: DataFrame, framework: str = "unknown") -> DataFrame:
    """Paths where programs begin, by name and place."""
    p = F.concat(F.lit("/"), F.col("path"))
    name, low, folder = basename(p), F.lower(basename(p)), directory(p)
    hit = (
        (name.rlike(r"^(index|main|app|App)\.(tsx?|jsx?)$") & folder.rlike("/(src|app)$"))
        | low.isin("manage.py", "wsgi.py", "asgi.py", "program.cs", "startup.cs", "index.php", "artisan", "config.ru")
        | (low.isin("app.py", "main.py") & (folder.rlike("/src$") | ~folder.contains("/src/")))
        | ((low == "main.go") & (folder.contains("/cmd/") | folder.rlike("/(cmd|src)$")))
        | name.endswith("Application.java")
        | (name == "Main.java")
        | (low.isin("main.rs", "lib.rs") & folder.rlike("/src$"))
        | p.contains("/bin/rails")
    )
    if framework == "nextjs":
        hit = hit | name.rlike(r"^(page|layout)\.(tsx|jsx|ts|js)$") | folder.contains("/pages/") | folder.rlike("/pages$")
    return files.where(hit).select(F.col("path").alias("id")).distinct()


def parse_jsonc(text: str) -> dict | None:
    """JSON with comments, trailing commas and a byte order mark; None if it is none."""
    text = text.lstrip("﻿")
    strings_or_comments = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
    bare = strings_or_comments.sub(lambda m: m[0] if m[0][0] == '"' else "", text)
    tidy = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[\]}])', lambda m: m[1] or "", bare)
    try:
        out = json.loads(tidy)
    except ValueError:
        return None
    return out if isinstance(out, dict) else None


def path_aliases(configs: dict[str, str], has_src: bool) -> Aliases:
    """Aliases of tsconfig.json or jsconfig.json among small files (path to text), with one level of `extends`."""
    for name in ("tsconfig.json", "tsconfig.app.json", "jsconfig.json"):
        config = parse_jsonc(configs[name]) if name in configs else None
        if config is None:
            continue
        parent = config.get("extends")
        inherited = parse_jsonc(configs.get(re.sub(r"^\./", "", parent), "")) if isinstance(parent, str) else None
        options = {**((inherited or {}).get("compilerOptions") or {}), **(config.get("compilerOptions") or {})}
        base = re.sub(r"^\./", "", options["baseUrl"]) if options.get("baseUrl") else None
        root = "" if base in (None, "", ".") else base.rstrip("/") + "/"
        found = [(re.sub(r"\*$", "", k), [root + re.sub(r"^\./|\*$", "", t) for t in v]) for k, v in (options.get("paths") or {}).items()]
        if found or base:
            return Aliases(found or [("@/", ["src/" if has_src else ""])], base or None)
    return Aliases([("@/", ["src/" if has_src else ""])])


GIT_FORMAT = "commit %H|||%an|||%aI"


def parse_log(log: DataFrame) -> DataFrame:
    """(commit_id, author, ts, path) from a log of whole commits, one row `value` per commit.

    Read with the text reader and a line separator between commits (`read_log`),
    so no order between rows is needed.
    """
    lines = F.split("value", "\n", -1)
    head = F.split(F.get(lines, 0), r"\|\|\|", 3)
    paths = F.filter(F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x)), lambda x: x != "")
    return log.where(F.col("value").contains("|||")).select(F.get(head, 0).alias("commit_id"), F.get(head, 1).alias("author"), F.to_timestamp(F.get(head, 2)).alias("ts"), F.explode(paths).alias("path")).withColumn("path", posix(F.regexp_replace("path", '^"(.*)"$', "$1")))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a file written by `git log --name-only --format=GIT_FORMAT`."""
    return spark.read.option("lineSep", "\ncommit ").text(path).select(F.regexp_replace("value", "^commit ", "").alias("value"))


def carry_headers(lines: DataFrame, order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """(commit_id, path) from single lines (file, line_no, value): the last header before each path, per file."""
    from pyspark.sql import Window as W

    header = F.when(F.col("value").startswith("commit "), F.substring("value", 8, 40))
    carried = F.last(header, ignorenulls=True).over(W.partitionBy("file").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return lines.withColumn("commit_id", carried).where(~F.col("value").startswith("commit ") & (F.trim("value") != "") & F.col("commit_id").isNotNull()).select("commit_id", F.col("value").alias("path"))


def group_config(text: str) -> tuple[dict[str, list[str]], int | None, str | None]:
    """(groups, threshold, warning) of a group configuration; one that cannot be read gives nothing and a warning."""
    try:
        found = json.loads(text)
        groups = {str(k): [str(g) for g in v] for k, v in (found.get("groups") or {}).items()}
        return groups, found.get("autoGroupThreshold"), None
    except (ValueError, AttributeError, TypeError) as e:
        return {}, None, f"group config is not usable: {e}"


STATE = T.StructType([T.StructField("path", T.StringType()), T.StructField("grid_x", T.IntegerType()), T.StructField("grid_y", T.IntegerType()), T.StructField("community", T.IntegerType()), T.StructField("biome", T.StringType()), T.StructField("first_seen", T.TimestampType()), T.StructField("version", T.IntegerType())])


def load_state(spark: SparkSession, folder: str) -> DataFrame | None:
    """The state table of the last run, or None if there is none of version 1."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.schema(STATE).json(folder).where("version = 1 and path is not null")
        return None if found.isEmpty() else found
    except (AnalysisException, Py4JJavaError):
        return None


def save_state(state: DataFrame, folder: str) -> None:
    """Writes the state beside the old one and then puts it in its place, on any file system that Spark writes."""
    spark = state.sparkSession
    new = f"{folder}.new"
    state.withColumn("version", F.lit(1)).write.mode("overwrite").json(new)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    old = f"{folder}.old"
    files.delete(hadoop(old), True)
    if files.exists(hadoop(folder)):
        files.rename(hadoop(folder), hadoop(old))  # at no time is there neither the old state nor the new one
    files.rename(hadoop(new), hadoop(folder))
    files.delete(hadoop(old), True)


def next_state(previous: DataFrame | None, current: DataFrame, now: Column) -> DataFrame:
    """Places of this run with the first_seen of the run that first had them; is_new only if there was a run before."""
    if previous is None:
        return current.withColumn("first_seen", now).withColumn("is_new", F.lit(False))
    old = previous.select(F.col("path").alias("_p"), F.col("first_seen").alias("_f"))
    joined = current.join(old, current.path == F.col("_p"), "left")
    return joined.withColumn("is_new", F.col("_p").isNull()).withColumn("first_seen", F.coalesce("_f", now)).drop("_p", "_f")
