"""Structure of a graph of modules: degrees, coupling, orphans, layers, patterns, groups, labels.

A graph is a pair of tables: nodes (id, file_path, label, module_type, loc,
directory, language, ord) and edges (source, target, type, ord).  Only the
columns an operator names are needed.  `ord` breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions import dims
from sparkloom.functions.text import glob_to_regex, stem

from .iterate import settle


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target, type), with its least ord."""
    return edges.groupBy("source", "target", "type").agg(F.min("ord").alias("ord"))


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """One node per id: the values of the last, the place of the first."""
    rest = [c for c in nodes.columns if c not in ("id", "ord")]
    last = nodes.groupBy("id").agg(F.max_by(F.struct(*rest), "ord").alias("v"), F.min("ord").alias("ord"))
    return last.select("id", *[F.col(f"v.{c}").alias(c) for c in rest], "ord").select(nodes.columns)


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids, edges.source == ids.id, "left_semi").join(ids, edges.target == ids.id, "left_semi")


def degrees(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """(id, fan_in, fan_out) of every end of an edge, in one shuffle: each edge counts at both ends."""
    edges = edges if kind is None else edges.where(F.col("type") == kind)
    ends = F.explode(F.array(F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))))
    return edges.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def with_degrees(nodes: DataFrame, edges: DataFrame, kind: str | None = None) -> DataFrame:
    joined = nodes.join(degrees(edges, kind), "id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("fan_in", "fan_out")})


def undirected_degree(edges: DataFrame) -> DataFrame:
    return degrees(edges).select("id", (F.col("fan_in") + F.col("fan_out")).alias("degree"))


def upper_median(values: DataFrame, column: str, default: float) -> DataFrame:
    """One row `median`: the element at n // 2 of the sorted values above 0, never a mean of two.

    Counts per distinct value come first, so what is ordered is as large as the
    number of distinct values, not of rows.
    """
    counts = values.where(F.col(column) > 0).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    upto = counts.select("v", F.sum("n").over(W.orderBy("v")).alias("upto"), F.sum("n").over(W.partitionBy()).alias("total"))
    return upto.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.coalesce(F.min("v"), F.lit(default)).alias("median"))


def judged_coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are no tests with degrees, thresholds and the judgements god_reasons (array) and is_high."""
    spark = nodes.sparkSession
    base = with_degrees(nodes.where("module_type <> 'test'"), edges)
    limits = dims.thresholds(spark)
    own = limits.where("language <> 'default'")
    default = [F.lit(v) for v in dims.THRESHOLDS["default"]]
    joined = base.join(F.broadcast(own), "language", "left").crossJoin(F.broadcast(upper_median(nodes, "loc", 100)))
    for c, d in zip(("god_fan_out", "god_loc", "high_fan_in", "high_fan_out"), default, strict=True):
        joined = joined.withColumn(c, F.coalesce(c, d))
    limit = F.when(F.col("module_type").isin(*dims.ORCHESTRATORS), F.ceil(F.col("god_fan_out") * 1.5)).otherwise(F.col("god_fan_out")).cast("long")
    most = F.greatest(F.col("median") * 3, F.col("god_loc")).cast("long")
    wide = ~F.col("module_type").isin(*dims.FANOUT_EXEMPT) & (F.col("fan_out") > limit)
    reasons = F.array_compact(
        F.array(
            F.when(wide, F.format_string("fan-out %d (threshold %d)", "fan_out", limit)),
            F.when(F.col("loc") > most, F.format_string("%d LOC (threshold %d)", "loc", most)),
        )
    )
    high = (F.col("fan_in") > F.col("high_fan_in")) & (F.col("fan_out") > F.col("high_fan_out"))
    return joined.withColumn("god_reasons", reasons).withColumn("is_high", high)


def top_coupled(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of most edges; this is a report, so its limit is its meaning."""
    scored = with_degrees(nodes.where("module_type <> 'test'"), edges)
    return scored.orderBy((F.col("fan_in") + F.col("fan_out")).desc(), "ord").select("id", "fan_in", "fan_out").limit(k)


def _issue(kind: str, severity: str | Column, message: Column, files: Column) -> list[Column]:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return [F.lit(kind).alias("type"), severity.alias("severity"), message.alias("message"), files.alias("files")]


def god_modules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    bad = judged_coupling(nodes, edges).where(F.size("god_reasons") > 0)
    return bad.select(*_issue("god-module", "warning", F.concat(F.lit("God module — "), F.array_join("god_reasons", " AND "), F.lit(": "), F.col("id")), F.array("id")))


def high_coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    bad = judged_coupling(nodes, edges).where("is_high")
    return bad.select(*_issue("high-coupling", "warning", F.format_string("High coupling (fan-in: %d, fan-out: %d): %s", "fan_in", "fan_out", "id"), F.array("id")))


def orphans(nodes: DataFrame, edges: DataFrame, entry_points: DataFrame | None = None) -> DataFrame:
    """Nodes without edges that are of no type and no name that may stand alone and no entry point."""
    alone = with_degrees(nodes, edges).where("fan_in = 0 and fan_out = 0")
    alone = alone.where(~F.col("module_type").isin(*dims.STANDALONE) & ~stem(F.col("file_path")).isin(*dims.STANDALONE_NAMES))
    if entry_points is not None:
        alone = alone.join(entry_points.select(F.col("id").alias("_entry")), F.col("id") == F.col("_entry"), "left_anti")
    return alone.select(*nodes.columns)


def orphan_issues(nodes: DataFrame, edges: DataFrame, entry_points: DataFrame | None = None) -> DataFrame:
    return orphans(nodes, edges, entry_points).select(*_issue("orphan-module", "info", F.concat(F.lit("Orphan module (no imports or importers): "), F.col("id")), F.array("id")))


def layer_of(module_type: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in dims.LAYER_OF.items() for x in kv]), module_type)


def layer_violations(nodes: DataFrame, edges: DataFrame, layer: Column | None = None, order: dict[str, int] | None = None, kind: str | None = "import") -> DataFrame:
    """(source, target, source_layer, target_layer) of imports from a lower into a higher layer."""
    order = order or dims.LAYER_ORDER
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    layers = nodes.select("id", (layer_of(F.col("module_type")) if layer is None else layer).alias("layer")).where(F.col("layer").isin(*order)).withColumn("rank", F.element_at(rank, F.col("layer")))
    a = layers.select(F.col("id").alias("source"), F.col("layer").alias("source_layer"), F.col("rank").alias("ra"))
    b = layers.select(F.col("id").alias("target"), F.col("layer").alias("target_layer"), F.col("rank").alias("rb"))
    edges = edges if kind is None else edges.where(F.col("type") == kind)
    return edges.join(a, "source").join(b, "target").where("ra < rb").select("source", "target", "source_layer", "target_layer")


def layer_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    message = F.concat(F.lit("Layering violation: "), F.col("source_layer"), F.lit(" imports from "), F.col("target_layer"), F.lit(" — "), F.col("source"), F.lit(" → "), F.col("target"))
    return layer_violations(nodes, edges).select(*_issue("layering-violation", "warning", message, F.array("source", "target")))


def architecture_pattern(nodes: DataFrame, fixed: bool = True) -> DataFrame:
    """One row `pattern`: hexagonal, mvc, layered, modular or unknown, in one aggregation.

    fixed: a directory's own first and last names count as well, not only names
    with a slash on both sides.
    """
    padded = F.concat(F.lit("/"), F.lower("directory"), F.lit("/")) if fixed else F.lower("directory")
    layer = layer_of(F.col("module_type"))
    any_of = lambda *types: F.coalesce(F.bool_or(F.col("module_type").isin(*types)), F.lit(False))
    facts = nodes.agg(
        F.coalesce(F.bool_or(padded.rlike("/ports/|/adapters/|/domain/")), F.lit(False)).alias("hexagonal"),
        (any_of("model", "entity") & any_of("view", "component", "page") & any_of("controller", "handler")).alias("mvc"),
        F.count_distinct(F.when(layer != "infrastructure", layer)).alias("layers"),
    )
    pattern = F.when(F.col("hexagonal"), "hexagonal").when(F.col("mvc"), "mvc").when(F.col("layers") >= 3, "layered").when(F.col("layers") >= 1, "modular").otherwise("unknown")
    return facts.select(pattern.alias("pattern"))


def group_by_patterns(nodes: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(id, group_id) of nodes whose path matches a group's globs; the first group wins."""
    out = F.lit(None).cast("string")
    for name, globs in reversed(list(groups.items())):
        hit = F.lit(False)
        for g in globs:
            hit = hit | F.col("file_path").rlike(glob_to_regex(g))
        out = F.when(hit, f"group:{name}").otherwise(out)
    return nodes.select("id", out.alias("group_id")).where("group_id is not null")


def auto_groups(nodes: DataFrame, threshold: int = 3, taken: DataFrame | None = None) -> DataFrame:
    """(id, group_id) of nodes that share directory and module type with at least threshold - 1 others.

    Only sizes are aggregated; members come back by a join, so a large group is
    never gathered in one place.
    """
    free = nodes if taken is None else nodes.join(taken.select("id"), "id", "left_anti")
    keys = ["directory", "module_type"]
    big = free.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= threshold).select(*keys)
    return free.join(big, keys).select("id", F.concat(F.lit("auto:"), F.col("directory"), F.lit("|"), F.col("module_type")).alias("group_id"))


def apply_grouping(nodes: DataFrame, groups: dict[str, list[str]] | None = None, threshold: int | None = 3) -> DataFrame:
    """Membership by patterns first, then automatic; a threshold of 0 or less turns the latter off."""
    own = group_by_patterns(nodes, groups) if groups else None
    auto = auto_groups(nodes, threshold, own) if threshold and threshold > 0 else None
    parts = [p for p in (own, auto) if p is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else nodes.select("id", F.lit("").alias("group_id")).limit(0)


def group_info(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """Per group: member_count, total_loc, directory of its first member, module_types."""
    return nodes.join(membership, "id").groupBy("group_id").agg(F.count("*").alias("member_count"), F.sum("loc").alias("total_loc"), F.min_by("directory", "ord").alias("directory"), F.array_sort(F.collect_set("module_type")).alias("module_types"))


def group_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(source, target, type, weight) between groups; a node without a group stands for itself."""
    a, b = (membership.select(F.col("id").alias(end), F.col("group_id").alias(f"g_{end}")) for end in ("source", "target"))
    ends = edges.join(a, "source", "left").join(b, "target", "left").select(F.coalesce("g_source", "source").alias("source"), F.coalesce("g_target", "target").alias("target"), "type")
    return ends.where("source <> target").groupBy("source", "target", "type").agg(F.count("*").alias("weight"))


def label_nodes(paths: DataFrame) -> DataFrame:
    """(id, label) from (id, file_path, label): equal labels get as many parent names as tell all of them apart.

    A group's depth is the least at which all its labels differ, else the
    greatest there is; files at the root keep the plain label.
    """
    parts = F.split(F.regexp_extract("file_path", "^(.*)/[^/]*$", 1), "/")
    dirs = F.when(F.col("file_path").contains("/"), parts).otherwise(F.array().cast("array<string>"))
    base = paths.withColumn("dirs", dirs)
    clashes = base.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("dirs")).alias("deepest")).where("n > 1 and deepest > 0")
    tagged = base.join(clashes, "label")
    deep = tagged.withColumn("depth", F.explode(F.sequence(F.lit(1), F.col("deepest"))))
    named = _at_depth(F.col("depth"))
    fits = deep.groupBy("label", "depth").agg(F.count_distinct(named).alias("d"), F.first("n").alias("n")).where("d = n").groupBy("label").agg(F.min("depth").alias("depth"))
    chosen = base.join(clashes, "label", "left").join(fits, "label", "left").withColumn("depth", F.coalesce("depth", "deepest", F.lit(0)))
    return chosen.select("id", _at_depth(F.col("depth")).alias("label"))


def _at_depth(depth: Column) -> Column:
    k = F.least(depth, F.size("dirs"))
    return F.when(k > 0, F.concat(F.array_join(F.slice("dirs", F.greatest(F.size("dirs") - k + 1, F.lit(1)), k), "/"), F.lit("/"), F.col("label"))).otherwise(F.col("label"))


def with_help(issues: DataFrame) -> DataFrame:
    """Issues with their title, explanation and suggestion."""
    return issues.join(F.broadcast(dims.issue_help(issues.sparkSession)), "type", "left")


def severity_counts(issues: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s).alias(f"{s}s")
    return issues.agg(count("error"), count("warning"), count("info"))


def prop_drilling(components: DataFrame, least: int = 3) -> DataFrame:
    """Chains (prop, chain, files) of a prop handed down, by name, from component to child, at least `least` long.

    components: name, file_path, props (array of names), children (array of
    names), ord.  Each step goes to the first child, by ord, that has the prop
    and is not in the chain yet, so no chain is longer than there are names and
    the loop ends by itself.
    """
    one = components.groupBy("name").agg(F.min_by(F.struct("file_path", "props", "children"), "ord").alias("v"), F.min("ord").alias("ord")).select("name", "ord", "v.*")
    owns = one.select("name", "file_path", F.explode(F.array_distinct("props")).alias("prop"))
    child = one.select("name", F.posexplode("children").alias("pos", "child")).join(owns.select(F.col("name").alias("child"), F.col("file_path").alias("file"), "prop"), "child")
    open_ = owns.select("name", "prop", F.array("name").alias("chain"), F.array("file_path").alias("files"))
    done = None
    while True:
        step = open_.join(child.select("name", "prop", "child", "file", "pos"), ["name", "prop"], "left").withColumn("fresh", ~F.array_contains("chain", F.col("child")))
        best = settle(step.groupBy("name", "prop", "chain", "files").agg(F.min_by(F.struct("child", "file"), F.when(F.col("fresh"), F.col("pos"))).alias("to")))
        ended = best.where("to is null").select("prop", "chain", "files")
        done = ended if done is None else done.unionByName(ended)
        open_ = best.where("to is not null").select(F.col("to.child").alias("name"), "prop", F.concat("chain", F.array("to.child")).alias("chain"), F.concat("files", F.array("to.file")).alias("files"))
        if open_.isEmpty():
            break
    return done.where(F.size("chain") >= least)


def prop_issues(components: DataFrame, least: int = 3) -> DataFrame:
    """An issue for each chain of `prop_drilling`."""
    chains = prop_drilling(components, least)
    return chains.select(*_issue("prop-drilling", "warning", F.format_string('Prop "%s" drilled through %d levels: %s', "prop", F.size("chain"), F.array_join("chain", " \u2192 ")), F.col("files")))


def god_components(components: DataFrame, children: int = 20, hooks: int = 15) -> DataFrame:
    """Components of very many children or hooks."""
    many = components.where(F.size("children") > children).select(*_issue("god-module", "warning", F.format_string('God component "%s" renders %d child components', "name", F.size("children")), F.array("file_path")))
    hooked = components.where(F.size("hooks") > hooks).select(*_issue("high-coupling", "warning", F.format_string('Component "%s" uses %d hooks (consider splitting)', "name", F.size("hooks")), F.array("file_path")))
    return many.unionByName(hooked)
