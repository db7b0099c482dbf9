"""The whole analysis of a project as one bundle of lazy tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import dims
from sparkloom.functions.text import branches
from sparkloom.operators import enrich, extract, graph, graph_metrics, history, security
from sparkloom.sources import project


@dataclass(frozen=True)
class Analysis:
    """Tables of one project; warnings say which parts were left out."""

    nodes: DataFrame
    edges: DataFrame
    issues: DataFrame
    top_coupled: DataFrame
    pattern: DataFrame
    spots: DataFrame | None = None
    couplings: DataFrame | None = None
    membership: DataFrame | None = None
    warnings: list[tuple[str, str]] = field(default_factory=list)


#: Detectors added by users: name to function of (nodes, edges) giving issues.
DETECTORS: dict = {}


def register_detector(name: str, run) -> None:
    DETECTORS[name] = run


def complexity(files: DataFrame) -> DataFrame:
    """(path, branches) of each source."""
    return files.select("path", branches(F.col("text"), F.coalesce("language", F.lit(""))).alias("branches"))


def analyze(files: DataFrame, changes: DataFrame | None = None, now: Column | None = None, aliases: extract.Aliases | None = None, go_module: str | None = None, framework: str = "unknown", groups: dict | None = None, threshold: int | None = 3, with_issues: bool = True) -> Analysis:
    """files: (path, text, language, ord) as from a scan; changes: (commit_id, author, ts, path)."""
    warnings: list[tuple[str, str]] = []
    nodes = extract.nodes_of(files).cache()
    labels = graph.label_nodes(nodes.select("id", "file_path", "label"))
    nodes = nodes.drop("label").join(labels, "id")
    edges = extract.import_edges(files, aliases, go_module)
    comps = None
    if framework in dims.COMPONENT_FRAMEWORKS:
        comps = extract.components(files)
        edges = edges.unionByName(extract.render_edges(comps))
    else:
        warnings.append(("components", f"components are not parsed for {framework}"))
    edges = edges.withColumn("ord", F.lit(0).cast("long")).cache()
    entries = project.entry_points(files, framework)
    sources = files.select("path", "language", "text").join(nodes.select(F.col("id").alias("path"), "module_type"), "path")
    detectors = [
        graph_metrics.cycle_issues(edges.where("type = 'import'")),
        graph.orphan_issues(nodes, edges, entries),
        graph.god_modules(nodes, edges),
        graph.high_coupling(nodes, edges),
        graph.layer_issues(nodes, edges),
        security.issues(sources),
        *[run(nodes, edges) for run in DETECTORS.values()],
    ]
    if comps is not None and with_issues:
        named = comps.withColumn("props", F.transform("props", lambda p: p["name"]))
        detectors += [graph.prop_issues(named), graph.god_components(comps)]
    spots = couplings = None
    if changes is not None:
        now = F.current_timestamp() if now is None else now
        half, year = history.since(changes, 6, now), history.since(changes, 12, now)
        spots = history.hotspots(nodes, complexity(files), history.change_frequency(half))
        couplings = history.temporal_coupling(history.co_changes(half, 3), nodes, edges)
        ids = nodes.select(F.col("id").alias("path"))
        detectors += [history.hotspot_issues(spots), history.temporal_issues(couplings), history.bus_factor_issues(history.bus_factor(year).join(ids, "path", "left_semi")), history.stale_issues(history.staleness(changes, now).join(ids, "path", "left_semi"))]
    else:
        warnings.append(("history", "no change history: hotspots, temporal coupling, contributors and staleness are left out"))
    issues = detectors[0]
    for d in detectors[1:]:
        issues = issues.unionByName(d)
    if not with_issues:
        issues = issues.limit(0)
    return Analysis(nodes, edges, issues, graph.top_coupled(nodes, edges), graph.architecture_pattern(nodes), spots, couplings, graph.apply_grouping(nodes, groups, threshold), warnings)


def analyze_tree(spark: SparkSession, root: str, changes: DataFrame | None = None, focus: str | None = None, depth: int | None = None, **more) -> Analysis:
    """Scans a tree and analyses it; a root without source files is an error."""
    tree = project.read_tree(spark, root, focus)
    names = [m for _, _, ms in dims.LANGUAGES for m in ms] + ["tsconfig.app.json", "jsconfig.json", "AndroidManifest.xml", "app/build.gradle", "app/build.gradle.kts"]
    small = tree.where(F.col("n_bytes") < 1_000_000)
    named = small.where(F.col("path").isin(*names)).select("path", "content")  # a few names at the root
    project_file = small.where(F.col("path").endswith(".csproj")).groupBy().agg(F.min("path").alias("path"), F.min_by("content", "path").alias("content"))
    manifests = {r.path: bytes(r.content).decode("utf-8", "replace") for r in named.unionByName(project_file).collect() if r.path is not None}
    files = project.scan(tree, depth).cache()
    if files.isEmpty():
        raise ValueError(f"no source files below {root}")
    framework = project.primary_framework(project.frameworks(manifests))
    has_src = not files.where(F.col("path").startswith("src/")).isEmpty()
    module = next((m[7:].strip() for m in manifests.get("go.mod", "").splitlines() if m.startswith("module ")), None)
    return analyze(files, changes, aliases=project.path_aliases(manifests, has_src), go_module=module, framework=framework, **more)


def wide(a: Analysis) -> tuple[DataFrame, DataFrame]:
    """The wide node and edge tables that every export reads."""
    return enrich.wide_nodes(a.nodes, a.edges, a.issues, a.spots, a.membership), enrich.wide_edges(a.nodes, a.edges, graph_metrics.cycles(a.edges.where("type = 'import'")), a.couplings)
