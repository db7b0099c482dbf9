"""Wide node rows, map locations, state diffs, health, lenses and the interactive queries, as projections and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions import dims
from sparkloom.functions.text import basename, directory, fixed, jaccard, posix, round_half_up

from .graph import with_degrees

SECURITY = ("security-secret", "security-injection", "security-xss", "security-crypto")


def flags(issues: DataFrame) -> DataFrame:
    """Per file of any issue: is_circular, is_orphan, is_god_module, has_security_issue; one aggregation."""
    hit = issues.select("type", F.explode("files").alias("id"))
    any_of = lambda *types: F.bool_or(F.col("type").isin(*types))
    return hit.groupBy("id").agg(any_of("circular-dependency").alias("is_circular"), any_of("orphan-module").alias("is_orphan"), any_of("god-module").alias("is_god_module"), any_of(*SECURITY).alias("has_security_issue"))


def wide_nodes(nodes: DataFrame, edges: DataFrame, issues: DataFrame, spots: DataFrame | None = None, membership: DataFrame | None = None, comps: DataFrame | None = None, flows: DataFrame | None = None) -> DataFrame:
    """Nodes with degrees, flags, hotspot figures, group, component and data flows."""
    out = with_degrees(nodes, edges).join(flags(issues), "id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_circular", "is_orphan", "is_god_module", "has_security_issue")})
    if spots is not None:
        out = out.join(spots, "id", "left").withColumn("is_hotspot", F.coalesce("is_hotspot", F.lit(False)))
    if membership is not None:
        out = out.join(membership.withColumnRenamed("group_id", "parent"), "id", "left")
    if comps is not None:
        last = comps.groupBy(F.col("file_path").alias("_p")).agg(F.max_by(F.struct("name", "props", "hooks", "children", "is_default_export"), "ord").alias("component"))
        out = out.join(last, F.col("file_path") == F.col("_p"), "left").drop("_p")
    if flows is not None:
        by_file = flows.groupBy(F.col("file_path").alias("_p")).agg(F.collect_list(F.struct("component_name", "type", "name", "detail")).alias("data_flow"))
        out = out.join(by_file, F.col("file_path") == F.col("_p"), "left").drop("_p")
    return out


def wide_edges(nodes: DataFrame, edges: DataFrame, cycle_rows: DataFrame | None = None, temporal: DataFrame | None = None) -> DataFrame:
    """Edges between nodes with is_circular (both ends in one strong component) and the temporal pairs."""
    ids = nodes.select("id")
    known = edges.join(ids, edges.source == ids.id, "left_semi").join(ids, edges.target == ids.id, "left_semi").select("source", "target", "type")
    if cycle_rows is not None:
        home = cycle_rows.select("component", F.explode("members").alias("id"))
        a, b = home.select(F.col("id").alias("source"), F.col("component").alias("ca")), home.select(F.col("id").alias("target"), F.col("component").alias("cb"))
        known = known.join(a, "source", "left").join(b, "target", "left").select("source", "target", "type", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("is_circular"))
    else:
        known = known.withColumn("is_circular", F.lit(False))
    if temporal is not None:
        pairs = temporal.join(ids, temporal.file_a == ids.id, "left_semi").join(ids, temporal.file_b == ids.id, "left_semi")
        known = known.unionByName(pairs.select(F.col("file_a").alias("source"), F.col("file_b").alias("target"), F.lit("temporal").alias("type"), F.lit(False).alias("is_circular")))
    return known


def biome(module_type: Column, circular: Column) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for kv in dims.BIOME_OF.items() for x in kv]), module_type)
    return F.when(circular, "volcanic").otherwise(F.coalesce(found, F.lit("plains")))


def importance(with_metrics: bool = True) -> Column:
    god = F.when(F.col("is_god_module"), 25).otherwise(0)
    if with_metrics:
        return F.col("page_rank") * 40 + F.col("betweenness") * 15 + god + F.when(F.col("module_type").isin("entry-point", "page", "layout"), 10).otherwise(0)
    return (F.col("fan_in") + F.col("fan_out")) * 3 + F.log2(F.col("loc") + 1) * 2 + god


def size_category(with_metrics: bool = True) -> Column:
    degree = F.col("fan_in") + F.col("fan_out")
    rank = F.col("page_rank") if with_metrics else F.lit(0.0)
    return F.when(F.col("is_god_module") | (rank > 0.6) | (F.col("loc") > 200) | (degree > 8), "large").when((rank > 0.25) | (F.col("loc") > 50) | (degree > 3), "medium").otherwise("small")


def threats(wide: DataFrame, issues: DataFrame) -> DataFrame:
    """(id, type, severity, message): the issues of each file and those its flags imply but no issue states."""
    stated = issues.select(F.explode("files").alias("id"), "type", "severity", "message").join(wide.select("id"), "id", "left_semi")
    score = F.coalesce("hotspot_score", F.lit(0.0))
    implied = F.array_compact(
        F.array(
            F.when(F.col("is_hotspot"), F.struct(F.lit("hotspot").alias("type"), F.when(score >= 0.75, "error").otherwise("warning").alias("severity"), F.concat(F.lit("Hotspot (score: "), fixed(score), F.lit(")")).alias("message"))),
            F.when(F.col("is_orphan"), F.struct(F.lit("orphan-module").alias("type"), F.lit("info").alias("severity"), F.lit("Orphaned module — no imports or exports").alias("message"))),
            F.when(F.col("is_circular"), F.struct(F.lit("circular-dependency").alias("type"), F.lit("error").alias("severity"), F.lit("Part of circular dependency cycle").alias("message"))),
            F.when(F.col("is_god_module"), F.struct(F.lit("god-module").alias("type"), F.lit("warning").alias("severity"), F.lit("God module — too many dependencies or too large").alias("message"))),
        )
    )
    more = wide.select("id", F.explode(implied).alias("t")).select("id", "t.*").join(stated.select("id", "type").distinct(), ["id", "type"], "left_anti")
    return stated.unionByName(more.select("id", "type", "severity", "message"))


def conditions(wide: DataFrame, found: DataFrame) -> DataFrame:
    """(id, condition): burning, ruined, damaged or healthy, by the worst threat."""
    worst = found.groupBy("id").agg(F.bool_or(F.col("severity") == "error").alias("e"), F.bool_or(F.col("type") == "orphan-module").alias("o"), F.bool_or(F.col("severity") == "warning").alias("w"))
    return wide.select("id").join(worst, "id", "left").select("id", F.when(F.col("e"), "burning").when(F.col("o"), "ruined").when(F.col("w"), "damaged").otherwise("healthy").alias("condition"))


def locations(wide: DataFrame, issues: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """One row per node with importance, size, tiles, biome and condition."""
    base = wide if metrics is None else wide.join(metrics, "id", "left").fillna({"page_rank": 0.0, "betweenness": 0.0, "community": 0, "layer": 0, "is_articulation": False})
    size = size_category(metrics is not None)
    tiles = F.element_at(F.create_map(*[F.lit(x) for kv in dims.TILES.items() for x in kv]), size)
    named = base.withColumns({"importance": importance(metrics is not None), "size_category": size, "tile_size": tiles, "biome": biome(F.col("module_type"), F.col("is_circular"))})
    return named.join(conditions(wide, threats(wide, issues)), "id")


def diff_state(previous: DataFrame, current: DataFrame, least: float = 0.6, bound: int = 100) -> DataFrame:
    """(path, previous_path, status) of retained, renamed, added and removed paths.

    One full join on the path; what is left over on both sides is matched, if it
    is few enough on both, by equal file name and likeness of directories.  The
    greedy choice in path order is kept exactly by taking, round by round, the
    first current path of each contested previous one.
    """
    prev = previous.select(posix(F.col("path")).alias("path")).distinct().withColumn("p", F.lit(1))
    curr = current.select(posix(F.col("path")).alias("path")).distinct().withColumn("c", F.lit(1))
    both = prev.join(curr, "path", "full")
    kept = both.where("p = 1 and c = 1").select("path", F.col("path").alias("previous_path"), F.lit("retained").alias("status"))
    gone, new = both.where("c is null").select("path"), both.where("p is null").select("path")
    pairs = rename_pairs(gone, new, least)
    n_gone, n_new = gone.limit(bound + 1).count(), new.limit(bound + 1).count()
    chosen = []
    if 0 < n_gone <= bound and n_new <= bound:  # at most bound x bound pairs
        taken: set[str] = set()
        options: dict[str, list[tuple[float, str]]] = {}
        for r in pairs.collect():
            options.setdefault(r.path, []).append((-r.score, r.previous_path))
        for path in sorted(options):
            best = next((p for _, p in sorted(options[path]) if p not in taken), None)
            if best:
                taken.add(best)
                chosen.append((path, best, "renamed"))
    renamed = previous.sparkSession.createDataFrame(chosen, "path string, previous_path string, status string")
    none = F.lit(None).cast("string")
    added = new.join(renamed.select("path"), "path", "left_anti").select("path", none.alias("previous_path"), F.lit("added").alias("status"))
    lost = gone.join(renamed.select(F.col("previous_path").alias("path")), "path", "left_anti").select(none.alias("path"), F.col("path").alias("previous_path"), F.lit("removed").alias("status"))
    return kept.unionByName(renamed).unionByName(added).unionByName(lost)


def rename_pairs(gone: DataFrame, new: DataFrame, least: float = 0.6) -> DataFrame:
    """(path, previous_path, score) of paths with one file name and alike directories."""
    parts = lambda c: F.filter(F.split(directory(c), "/"), lambda x: x != "")
    a = new.select("path", basename(F.col("path")).alias("name"), parts(F.col("path")).alias("da"))
    b = gone.select(F.col("path").alias("previous_path"), basename(F.col("path")).alias("name"), parts(F.col("path")).alias("db"))
    alike = F.when((F.size("da") == 0) & (F.size("db") == 0), F.lit(0.0)).otherwise(jaccard(F.col("da"), F.col("db")))
    return a.join(b, "name").withColumn("score", F.lit(0.5) + 0.5 * alike).where(F.col("score") >= least).select("path", "previous_path", "score")


def health(issues: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: score and tier (0 to 4) from the severities and the number of nodes."""
    count = lambda s: F.count_if(F.col("severity") == s)
    i = issues.agg((count("error") * 10 + count("warning") * 3 + count("info")).alias("penalty"))
    n = nodes.agg(F.count("*").alias("n"))
    score = F.greatest(F.lit(0), round_half_up(100 - F.col("penalty") / F.greatest(F.lit(1), F.col("n") * 5) * 100))
    tier = F.when(F.col("score") >= 80, 4).when(F.col("score") >= 60, 3).when(F.col("score") >= 40, 2).when(F.col("score") >= 20, 1).otherwise(0)
    return i.crossJoin(n).select(score.cast("long").alias("score")).withColumn("tier", tier)


def verdicts(wide: DataFrame) -> DataFrame:
    """(id, verdict): the first of the reasons to look at a file."""
    busy, often = F.col("normalized_complexity") >= 0.5, F.col("change_frequency") >= 0.5
    rule = (
        F.when(busy & often, "refactor-first")
        .when(busy, "complex-but-stable")
        .when(often, "simple-but-busy")
        .when(F.col("fan_in") >= 8, "blast-radius")
        .when(F.col("is_god_module"), "oversized")
        .when(F.col("is_orphan"), "unused")
        .otherwise("fine")
    )
    return wide.select("id", rule.alias("verdict"))


def threat_log(found: DataFrame, severities: tuple[str, ...] = ("error", "warning", "info")) -> DataFrame:
    """Threats of the chosen severities, errors first."""
    rank = F.array_position(F.array(*map(F.lit, ("error", "warning", "info"))), F.col("severity"))
    return found.where(F.col("severity").isin(*severities)).withColumn("rank", rank.cast("int")).orderBy("rank", "id", "type", "message")


def search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose label or path holds the query, in any case."""
    q = query.lower()
    return nodes.where(F.lower("label").contains(q) | F.lower("file_path").contains(q))


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    """(id, direction) one step from a node."""
    out = edges.where(F.col("source") == node).select(F.col("target").alias("id"), F.lit("out").alias("direction"))
    into = edges.where(F.col("target") == node).select(F.col("source").alias("id"), F.lit("in").alias("direction"))
    return out.union(into).distinct()


def view(wide: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a view: all, component, dataflow or issues."""
    if name == "component":
        shown = edges.where("type = 'renders'")
        ends = shown.select(F.explode(F.array("source", "target")).alias("_e")).distinct()
        kinds = wide.where(F.col("module_type").isin("component", "page", "layout"))
        return kinds.unionByName(wide.join(ends, wide.id == F.col("_e"), "left_semi")).dropDuplicates(["id"]), shown
    if name == "dataflow":
        return wide.where("data_flow is not null"), edges.where("type = 'data-flow'")
    if name == "issues":
        return wide.where("is_circular or is_orphan or is_god_module or is_hotspot or has_security_issue"), edges.where("is_circular")
    return wide, edges


def type_chips(nodes: DataFrame, k: int = 8) -> DataFrame:
    """The k commonest module types; the limit is the report's."""
    return nodes.groupBy("module_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "module_type").limit(k)


def lens(wide: DataFrame, name: str) -> DataFrame:
    """(id, value) from 0 to 1 for colouring: dependencies, complexity, hotspots or threats."""
    value = {"dependencies": F.col("fan_in") + F.col("fan_out"), "complexity": F.coalesce("complexity", F.lit(0)), "hotspots": F.coalesce("hotspot_score", F.lit(0.0)), "threats": F.col("is_circular").cast("int") + F.col("is_god_module").cast("int") + F.col("has_security_issue").cast("int")}[name]
    base = wide.select("id", value.cast("double").alias("v"))
    top = base.agg(F.greatest(F.max("v"), F.lit(1e-9)).alias("top"))
    return base.crossJoin(F.broadcast(top)).select("id", (F.col("v") / F.col("top")).alias("value"))


#: A hotspot score from which a place is shown though it is no hotspot, and how faint the others are.
FAINT_SCORE, FAINT = 0.1, 0.35
LENSES = ("kingdom", "dependencies", "complexity", "hotspots", "threats")


def map_lens(wide: DataFrame, name: str, threats: DataFrame | None = None) -> DataFrame:
    """(id, value, alpha) of each place under a lens of the map; value from 0 to 1 for colouring, null for the lens's neutral colour.

    kingdom: a place's own colours, so no values.  dependencies: both degrees over the sum of their greatest values.  complexity
    and hotspots: over the greatest value; places that are neither hotspots nor near it are neutral and faint.  threats (id,
    severity): 1 with an error, 0.5 with a warning, 0 with others alone; places without any are neutral and faint.
    """
    one = F.lit(1.0)
    if name == "kingdom":
        return wide.select("id", F.lit(None).cast("double").alias("value"), one.alias("alpha"))
    if name == "threats":
        rank = F.when(F.col("severity") == "error", 1.0).when(F.col("severity") == "warning", 0.5).otherwise(0.0)
        worst = threats.groupBy("id").agg(F.max(rank).alias("value"))
        return wide.select("id").join(worst, "id", "left").select("id", "value", F.when(F.col("value").isNull(), FAINT).otherwise(one).alias("alpha"))
    most = {"dependencies": F.max("fan_in") + F.max("fan_out"), "complexity": F.max("complexity"), "hotspots": F.max("hotspot_score")}[name]
    own = {"dependencies": F.col("fan_in") + F.col("fan_out"), "complexity": F.col("complexity"), "hotspots": F.col("hotspot_score")}[name]
    value = F.when(F.col("most") > 0, F.coalesce(own, F.lit(0)) / F.col("most")).otherwise(0.0)
    joined = wide.crossJoin(F.broadcast(wide.agg(most.cast("double").alias("most"))))  # one row
    if name != "hotspots":
        return joined.select("id", value.alias("value"), one.alias("alpha"))
    shown = F.coalesce(F.col("is_hotspot"), F.lit(False)) | (F.coalesce("hotspot_score", F.lit(0.0)) >= FAINT_SCORE)
    return joined.select("id", F.when(shown, value).alias("value"), F.when(shown, one).otherwise(FAINT).alias("alpha"))


def flag_violations(paths: DataFrame, issues: DataFrame) -> DataFrame:
    """paths with is_violation: whether a layering issue names their ends in this order."""
    bad = issues.where((F.col("type") == "layering-violation") & (F.size("files") >= 2)).select(F.get("files", 0).alias("source"), F.get("files", 1).alias("target"), F.lit(True).alias("is_violation")).distinct()
    return paths.join(bad, ["source", "target"], "left").withColumn("is_violation", F.coalesce("is_violation", F.lit(False)))


def lens_paths(paths: DataFrame, wide: DataFrame, name: str) -> DataFrame:
    """The paths that a lens shows: of hotspots those with a hotspot at an end, of threats circular, temporal and violating ones, else all."""
    if name == "hotspots":
        hot = wide.where("is_hotspot").select(F.col("id").alias("source"))
        either = paths.join(hot, "source", "left_semi").unionByName(paths.join(hot.withColumnRenamed("source", "target"), "target", "left_semi").join(hot, "source", "left_anti"))
        return either.select(*paths.columns)
    return paths.where("is_circular or type = 'temporal' or is_violation") if name == "threats" else paths


def routes(places: DataFrame, edges: DataFrame) -> DataFrame:
    """L-shaped paths between locations (id, grid_x, grid_y, tile_size, importance, community): across first, then along.

    `n_points` is the number of `points` without making them, for who wants no more than a path's length.
    """
    centre = lambda axis: (F.col(axis) + F.floor(F.col("tile_size") / 2)).cast("int")
    p = places.select("id", centre("grid_x").alias("x"), centre("grid_y").alias("y"), "importance", "community")
    a = p.select(*[F.col(c).alias(f"a_{c}") for c in p.columns])
    b = p.select(*[F.col(c).alias(f"b_{c}") for c in p.columns])
    joined = edges.join(a, F.col("source") == F.col("a_id")).join(b, F.col("target") == F.col("b_id"))
    walk = lambda lo, hi: F.slice(F.sequence(lo, hi), 1, F.abs(hi - lo))
    across = F.transform(walk(F.col("a_x"), F.col("b_x")), lambda x: F.struct(x.alias("x"), F.col("a_y").alias("y")))
    along = F.transform(walk(F.col("a_y"), F.col("b_y")), lambda y: F.struct(F.col("b_x").alias("x"), y.alias("y")))
    points = F.concat(across, along, F.array(F.struct(F.col("b_x").alias("x"), F.col("b_y").alias("y"))))
    n_points = F.abs(F.col("a_x") - F.col("b_x")) + F.abs(F.col("a_y") - F.col("b_y")) + 1
    return joined.select("source", "target", points.alias("points"), n_points.alias("n_points"), ((F.col("a_importance") + F.col("b_importance")) / 2).alias("importance"), (F.col("a_community") != F.col("b_community")).alias("is_cross_region"))


#: Anchors that are sent to every task; there is one for each biome.
MOST_ANCHORS = 1000


def zones(tiles: DataFrame, anchors: DataFrame) -> DataFrame:
    """(x, y, biome) of each tile: the anchor (biome, ax, ay, weight) of most influence; anchors are one per biome, so few."""
    few = anchors.limit(MOST_ANCHORS + 1).collect()
    if len(few) > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors")
    anchors = anchors.sparkSession.createDataFrame(few, anchors.schema)
    pull = F.col("weight") / (1 + F.pow(F.col("x") - F.col("ax"), 2) + F.pow(F.col("y") - F.col("ay"), 2))
    return tiles.crossJoin(F.broadcast(anchors)).groupBy("x", "y").agg(F.max_by("biome", F.struct(pull.alias("p"), "biome")).alias("biome"))


def hit_test(rects: DataFrame, x: float, y: float) -> DataFrame:
    """Of the rectangles (id, x, y, w, h, ord) that hold a point, the last."""
    inside = rects.where((F.col("x") <= x) & (x < F.col("x") + F.col("w")) & (F.col("y") <= y) & (y < F.col("y") + F.col("h")))
    return inside.orderBy(F.col("ord").desc()).limit(1)


def community_totals(places: DataFrame) -> DataFrame:
    return places.groupBy("community").agg(F.count("*").alias("members"), F.sum("importance").alias("importance"))


def community_links(places: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, n): edges between two communities, whichever way."""
    c = places.select("id", "community")
    s, t = c.withColumnsRenamed({"id": "source", "community": "cs"}), c.withColumnsRenamed({"id": "target", "community": "ct"})
    return edges.join(s, "source").join(t, "target").where("cs <> ct").groupBy(F.least("cs", "ct").alias("a"), F.greatest("cs", "ct").alias("b")).agg(F.count("*").alias("n"))


def dominant_biome(places: DataFrame) -> DataFrame:
    """(community, biome): the commonest, the first seen of equals."""
    per = places.groupBy("community", "biome").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return per.groupBy("community").agg(F.max_by("biome", F.struct("n", -F.col("first"))).alias("biome"))


def quiet_edges(edges: DataFrame, most: int = 100) -> DataFrame:
    """Of many edges only those with an end of more than median degree; of few all."""
    from .graph import undirected_degree, upper_median

    degree = undirected_degree(edges)
    middle = upper_median(degree, "degree", 0)
    n = edges.agg(F.count("*").alias("n"))
    d = degree.select("id", "degree")
    a, b = d.withColumnsRenamed({"id": "source", "degree": "da"}), d.withColumnsRenamed({"id": "target", "degree": "db"})
    return edges.join(a, "source").join(b, "target").crossJoin(F.broadcast(middle.crossJoin(n))).where(f"n <= {most} or da > median or db > median").select(*edges.columns)


def ranked(places: DataFrame) -> DataFrame:
    """Places by layer and importance, greatest first, and their rank within each biome."""
    return places.withColumn("rank", F.row_number().over(W.partitionBy("biome").orderBy(F.col("importance").desc(), "ord")))
