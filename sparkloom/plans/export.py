"""Exports: JSON, Mermaid, SVG, HTML and summaries.  Text is assembled in Spark; files are written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions.text import embed_json, escape_markup, identifier
from sparkloom.operators import graph, layout
from sparkloom.operators.enrich import quiet_edges

# Main colour of a few families of module types.
COLOURS = {"component": "#4A7AE8", "page": "#B050D0", "hook": "#30B868", "store": "#E04848", "controller": "#E88030", "service": "#4890E0", "repository": "#A07050", "model": "#B88060", "config": "#3898C0", "entry-point": "#E8B020", "type": "#8088C0", "util": "#7080A8", "test": "#606878", "unknown": "#585E70"}
FORMATS = ("json", "mermaid", "svg", "html", "markdown")


def colour_of(module_type):
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv]), module_type), F.lit(COLOURS["unknown"]))


def as_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row `value` per node and edge, safe inside a script element."""
    n = nodes.select(embed_json(F.struct(F.lit("node").alias("kind"), *nodes.columns)).alias("value"))
    return n.unionByName(edges.select(embed_json(F.struct(F.lit("edge").alias("kind"), *edges.columns)).alias("value")))


def mermaid_dependencies(nodes: DataFrame, edges: DataFrame, least: int = 2, grouped_from: int = 20) -> DataFrame:
    """(place, value): lines of a flowchart, sub-graphs by top directory where there are many nodes."""
    name = identifier(F.col("id"))
    top = F.get(F.split("directory", "/"), 0)
    many = nodes.limit(grouped_from + 1).count() > grouped_from
    head = nodes.sparkSession.createDataFrame([("0", "flowchart LR")], "place string, value string")
    line = F.concat(name, F.lit('["'), F.replace(F.col("label"), F.lit('"'), F.lit("'")), F.lit('"]'))
    if many:
        big = nodes.where("directory <> ''").groupBy(top.alias("top")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("top")
        opened = big.select(F.concat(F.lit("1"), F.col("top"), F.lit("\u00010")).alias("place"), F.concat(F.lit("subgraph "), F.col("top")).alias("value"))
        closed = big.select(F.concat(F.lit("1"), F.col("top"), F.lit("\u00012")).alias("place"), F.lit("end").alias("value"))
        inside = nodes.join(big.withColumn("b", F.lit(True)), top == F.col("top"), "left")
        rows = inside.select(F.when(F.col("b"), F.concat(F.lit("1"), F.col("top"), F.lit("\u00011"), F.col("id"))).otherwise(F.concat(F.lit("2"), F.col("id"))).alias("place"), line.alias("value"))
        body = opened.unionByName(closed).unionByName(rows)
    else:
        body = nodes.select(F.concat(F.lit("2"), F.col("id")).alias("place"), line.alias("value"))
    arrow = F.when(F.coalesce(F.col("is_circular"), F.lit(False)) if "is_circular" in edges.columns else F.lit(False), " -.-> ").otherwise(" --> ")
    links = edges.select(F.concat(F.lit("3"), F.col("source"), F.lit("\u0001"), F.col("target")).alias("place"), F.concat(identifier(F.col("source")), arrow, identifier(F.col("target"))).alias("value"))
    return head.unionByName(body).unionByName(links)


def mermaid_components(comps: DataFrame) -> DataFrame:
    uses = comps.select("name", F.explode("children").alias("child")).join(comps.select(F.col("name").alias("child")).distinct(), "child")
    head = comps.sparkSession.createDataFrame([("0", "flowchart TD")], "place string, value string")
    return head.unionByName(uses.select(F.concat(F.lit("1"), F.col("name"), F.col("child")).alias("place"), F.concat(identifier(F.col("name")), F.lit(" --> "), identifier(F.col("child"))).alias("value")).distinct())


def mermaid_flows(flows: DataFrame) -> DataFrame:
    head = flows.sparkSession.createDataFrame([("0", "flowchart LR")], "place string, value string")
    line = F.concat(identifier(F.concat(F.col("type"), F.lit("_"), F.col("name"))), F.lit('(["'), F.replace(F.col("name"), F.lit('"'), F.lit("'")), F.lit('"]) --> '), identifier(F.col("component_name")))
    return head.unionByName(flows.select(F.concat(F.lit("1"), F.col("component_name"), F.col("type"), F.col("name")).alias("place"), line.alias("value")).distinct())


def svg(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, value): circles packed per directory, in a row of directories, and the edges that are not quiet."""
    circles = layout.pack_circles(nodes)
    bounds = circles.groupBy("directory").agg(F.max(F.hypot("x", "y") + F.col("r")).alias("reach"))
    before = F.coalesce(F.sum(2 * F.col("reach") + 20).over(W.orderBy("directory").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    placed = circles.join(bounds.withColumn("left", before), "directory").select("id", (F.col("left") + F.col("reach") + F.col("x")).alias("cx"), (F.lit(400.0) + F.col("y")).alias("cy"), "r")
    named = placed.join(nodes.select("id", "label", "module_type"), "id")
    body = named.select(F.concat(F.lit("2"), F.col("id")).alias("place"), F.format_string('<circle cx="%.2f" cy="%.2f" r="%.2f" fill="%s"><title>%s</title></circle>', "cx", "cy", "r", colour_of(F.col("module_type")), escape_markup(F.col("label"))).alias("value"))
    kept = quiet_edges(edges.select("source", "target", "type"))
    a, b = (placed.select(F.col("id").alias(end), F.col("cx").alias(f"{end[0]}x"), F.col("cy").alias(f"{end[0]}y")) for end in ("source", "target"))
    lines = kept.join(a, "source").join(b, "target").select(F.concat(F.lit("1"), F.col("source"), F.col("target")).alias("place"), F.format_string('<line x1="%.2f" y1="%.2f" x2="%.2f" y2="%.2f" stroke="#999"/>', "sx", "sy", "tx", "ty").alias("value"))
    ends = nodes.sparkSession.createDataFrame([("0", '<svg xmlns="http://www.w3.org/2000/svg">'), ("9", "</svg>")], "place string, value string")
    return ends.unionByName(lines).unionByName(body)


def issue_table(issues: DataFrame) -> DataFrame:
    """(place, value): an HTML table of the issues with their help."""
    rank = F.array_position(F.array(*map(F.lit, ("error", "warning", "info"))), F.col("severity")).cast("string")
    row = F.concat(F.lit("<tr><td>"), escape_markup(F.col("severity")), F.lit("</td><td>"), escape_markup(F.coalesce("title", "type")), F.lit("</td><td>"), escape_markup(F.col("message")), F.lit("</td><td>"), escape_markup(F.coalesce("suggestion", F.lit(""))), F.lit("</td></tr>"))
    ends = issues.sparkSession.createDataFrame([("0", "<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>Report</title></head><body><table>"), ("9", "</table></body></html>")], "place string, value string")
    return ends.unionByName(graph.with_help(issues).select(F.concat(F.lit("1"), rank, F.col("message")).alias("place"), row.alias("value")))


def summary(nodes: DataFrame, edges: DataFrame, issues: DataFrame, pattern: DataFrame) -> DataFrame:
    """One row: files, edges, errors, warnings, infos, pattern."""
    return nodes.agg(F.count("*").alias("files"), F.sum("loc").alias("loc")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(graph.severity_counts(issues)).crossJoin(pattern)


def markdown(nodes: DataFrame, edges: DataFrame, issues: DataFrame, pattern: DataFrame, shown: int = 5) -> DataFrame:
    """(place, value): the summary and, of each issue type, the first few."""
    s = summary(nodes, edges, issues, pattern)
    head = s.select(F.lit("0").alias("place"), F.format_string("%d files, %d lines, %d edges; %d errors, %d warnings, %d infos; pattern: %s", "files", "loc", "edges", "errors", "warnings", "infos", "pattern").alias("value"))
    first = issues.withColumn("n", F.row_number().over(W.partitionBy("type").orderBy("message"))).where(F.col("n") <= shown)
    return head.unionByName(first.select(F.concat(F.lit("1"), F.col("type"), F.format_string("%05d", "n")).alias("place"), F.concat(F.lit("- "), F.col("severity"), F.lit(": "), F.col("message")).alias("value")))


def write(lines: DataFrame, folder: str) -> None:
    """Lines in order of place, as text files below a folder; a folder that holds a project is refused."""
    spark = lines.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = ("package.json", "pom.xml", "go.mod", "Cargo.toml", ".git", "pyproject.toml")
    if any(files.exists(spark._jvm.org.apache.hadoop.fs.Path(path, m)) for m in marks):
        raise ValueError(f"{folder} holds a project")
    lines.orderBy("place").select("value").write.mode("overwrite").text(folder)
