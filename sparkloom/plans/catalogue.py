"""The registered queries over the driver's tables, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.functions import dims, rules, text
from sparkloom.operators import drilldown, enrich, extract, graph, graph_metrics, history, layout, security
from sparkloom.plans import project_queries
from sparkloom.plans.roles import COMMITS_SQL, PARTS_SQL, TRADE_SQL, commits, parts, successions, successions_sql, table, trade
from sparkloom.sources import project
from sparkloom.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _values(rows) -> str:
    q = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


GRAPH = f"nodes AS MATERIALIZED ({PARTS_SQL}), edges AS MATERIALIZED ({successions_sql()})"
DEGREES = "deg AS MATERIALIZED (SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT target AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT source, 0, 1 FROM edges) GROUP BY id)"
FULL = "full_nodes AS MATERIALIZED (SELECT n.*, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out FROM nodes n LEFT JOIN deg USING (id))"
MEDIAN = "med AS (SELECT coalesce(list_sort(list(loc))[CAST(floor(count(*) / 2) AS INT) + 1], 100) AS median FROM nodes WHERE loc > 0)"
LIMITS = f"limits(language, gf, gl, hi, ho) AS (VALUES {_values([(k, *v) for k, v in dims.THRESHOLDS.items()])})"
_D = dims.THRESHOLDS["default"]
JUDGED = f"""judged AS MATERIALIZED (SELECT f.*, coalesce(l.gl, {_D[1]}) AS gl, coalesce(l.hi, {_D[2]}) AS hi, coalesce(l.ho, {_D[3]}) AS ho,
  CASE WHEN module_type IN ('controller', 'handler') THEN CAST(ceil(coalesce(l.gf, {_D[0]}) * 1.5) AS BIGINT) ELSE coalesce(l.gf, {_D[0]}) END AS lim, greatest(median * 3, coalesce(l.gl, {_D[1]})) AS most
  FROM full_nodes f LEFT JOIN (SELECT * FROM limits WHERE language <> 'default') l USING (language), med WHERE module_type <> 'test')"""
CHAIN = f"{GRAPH}, {DEGREES}, {FULL}, {MEDIAN}, {LIMITS}, {JUDGED}"
LAYER_ROWS = f"layers(module_type, layer) AS (VALUES {_values(dims.LAYER_OF.items())}), ranks(layer, rank) AS (VALUES {_values(dims.LAYER_ORDER.items())})"


# ---- structure ----


@query(f"WITH edges AS ({successions_sql()}), {DEGREES} SELECT * FROM deg")
def degree_fan_in_out(spark, sf):
    return graph.degrees(successions(spark, sf))


@query(f"WITH {GRAPH}, {DEGREES}, {FULL} SELECT id, fan_in, fan_out FROM full_nodes WHERE module_type <> 'test' ORDER BY fan_in + fan_out DESC, ord LIMIT 10")
def coupling_top10(spark, sf):
    return graph.top_coupled(parts(spark, sf), successions(spark, sf))


@query(f"WITH nodes AS ({PARTS_SQL}), {MEDIAN} SELECT CAST(median AS BIGINT) AS median FROM med")
def upper_median_loc(spark, sf):
    return graph.upper_median(parts(spark, sf), "loc", 100).select(F.col("median").cast("long").alias("median"))


@query(
    f"""WITH {CHAIN} SELECT id, 'God module — ' || array_to_string(list_filter([
    CASE WHEN module_type NOT IN ('entry-point', 'config') AND fan_out > lim THEN 'fan-out ' || fan_out || ' (threshold ' || lim || ')' END,
    CASE WHEN loc > most THEN loc || ' LOC (threshold ' || most || ')' END], lambda x: x IS NOT NULL), ' AND ') || ': ' || id AS message
    FROM judged WHERE (module_type NOT IN ('entry-point', 'config') AND fan_out > lim) OR loc > most"""
)
def god_modules(spark, sf):
    return graph.god_modules(parts(spark, sf), successions(spark, sf)).select(F.get("files", 0).alias("id"), "message")


@query(f"WITH {CHAIN} SELECT id, 'High coupling (fan-in: ' || fan_in || ', fan-out: ' || fan_out || '): ' || id AS message FROM judged WHERE fan_in > hi AND fan_out > ho")
def high_coupling(spark, sf):
    return graph.high_coupling(parts(spark, sf), successions(spark, sf)).select(F.get("files", 0).alias("id"), "message")


@query(f"SELECT 'o' || o_orderkey AS id, o_orderpriority AS module_type FROM orders WHERE o_orderpriority NOT IN {dims.STANDALONE} AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphans(spark, sf):
    """Orders as modules and their lines as imports of parts: all parts have lines, but not all orders."""
    key = F.concat(F.lit("o"), "o_orderkey")
    nodes = table(spark, sf, "orders").select(key.alias("id"), F.concat(F.lit("orders/"), key).alias("file_path"), F.col("o_orderpriority").alias("module_type"))
    edges = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))
    return graph.orphans(nodes, edges).select("id", "module_type")


@query(
    f"""WITH {GRAPH}, {LAYER_ROWS}, ln AS (SELECT id, layer, rank FROM nodes JOIN layers USING (module_type) JOIN ranks USING (layer))
    SELECT source, target, a.layer AS source_layer, b.layer AS target_layer FROM edges JOIN ln a ON source = a.id JOIN ln b ON target = b.id WHERE a.rank < b.rank"""
)
def layer_violations(spark, sf):
    return graph.layer_violations(parts(spark, sf), successions(spark, sf))


@query(
    f"""WITH nodes AS ({PARTS_SQL}), {LAYER_ROWS} SELECT CASE WHEN bool_or(regexp_matches('/' || lower(directory) || '/', '/ports/|/adapters/|/domain/')) THEN 'hexagonal'
    WHEN bool_or(module_type IN ('model', 'entity')) AND bool_or(module_type IN ('view', 'component', 'page')) AND bool_or(module_type IN ('controller', 'handler')) THEN 'mvc'
    WHEN count(DISTINCT CASE WHEN layer <> 'infrastructure' THEN layer END) >= 3 THEN 'layered' WHEN count(DISTINCT CASE WHEN layer <> 'infrastructure' THEN layer END) >= 1 THEN 'modular' ELSE 'unknown' END AS pattern
    FROM nodes LEFT JOIN layers USING (module_type)"""
)
def architecture_pattern(spark, sf):
    return graph.architecture_pattern(parts(spark, sf))


GROUPED = "grp AS MATERIALIZED (SELECT id, 'auto:' || directory || '|' || module_type AS group_id FROM nodes WHERE (directory, module_type) IN (SELECT (directory, module_type) FROM nodes GROUP BY directory, module_type HAVING count(*) >= 3))"


@query(f"WITH nodes AS MATERIALIZED ({PARTS_SQL}), {GROUPED} SELECT group_id, count(*) AS member_count, CAST(sum(loc) AS BIGINT) AS total_loc, arg_min(directory, ord) AS directory, array_to_string(list_sort(list(DISTINCT module_type)), ',') AS module_types FROM nodes JOIN grp USING (id) GROUP BY group_id")
def auto_groups(spark, sf):
    nodes = parts(spark, sf)
    return graph.group_info(nodes, graph.auto_groups(nodes)).withColumn("module_types", F.array_join("module_types", ","))


@query(f"WITH {GRAPH}, {GROUPED}, e AS (SELECT coalesce(a.group_id, source) AS source, coalesce(b.group_id, target) AS target, type FROM edges LEFT JOIN grp a ON source = a.id LEFT JOIN grp b ON target = b.id) SELECT source, target, type, count(*) AS weight FROM e WHERE source <> target GROUP BY ALL")
def group_edges(spark, sf):
    nodes = parts(spark, sf)
    return graph.group_edges(successions(spark, sf), graph.auto_groups(nodes))


GROUPS = {"first": ["src/d1*"], "fives": ["d5/**", "d25/**"]}


@query(f"WITH nodes AS ({PARTS_SQL}) SELECT id, CASE WHEN regexp_matches(file_path, 'src/d1[^/]*') THEN 'group:first' ELSE 'group:fives' END AS group_id FROM nodes WHERE regexp_matches(file_path, 'src/d1[^/]*|d5/.*|d25/.*')")
def pattern_groups(spark, sf):
    return graph.group_by_patterns(parts(spark, sf), GROUPS)


def _pages(spark, sf):
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1), "/$", "")
    return table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), path.alias("file_path"), F.regexp_extract(path, "([^/]*)$", 1).alias("label"))


PAGES = "pg AS MATERIALIZED (SELECT CAST(page_id AS VARCHAR) AS id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/$', '') AS file_path FROM pages), base AS MATERIALIZED (SELECT id, file_path, regexp_extract(file_path, '([^/]*)$', 1) AS label, CASE WHEN file_path LIKE '%/%' THEN string_split(regexp_extract(file_path, '^(.*)/[^/]*$', 1), '/') ELSE [] END AS dirs FROM pg)"


@query(
    f"""WITH {PAGES}, clash AS (SELECT label, count(*) AS n, max(len(dirs)) AS deepest FROM base GROUP BY label HAVING count(*) > 1 AND max(len(dirs)) > 0),
    deep AS (SELECT b.*, n, deepest, unnest(generate_series(1, deepest)) AS depth FROM base b JOIN clash USING (label)),
    named AS (SELECT label, depth, n, CASE WHEN least(depth, len(dirs)) > 0 THEN array_to_string(dirs[greatest(len(dirs) - depth + 1, 1):], '/') || '/' || label ELSE label END AS name FROM deep),
    fit AS (SELECT label, min(depth) AS d FROM (SELECT label, depth FROM named GROUP BY label, depth HAVING count(DISTINCT name) = max(n)) GROUP BY label)
    SELECT id, CASE WHEN least(coalesce(d, deepest, 0), len(dirs)) > 0 THEN array_to_string(dirs[greatest(len(dirs) - coalesce(d, deepest) + 1, 1):], '/') || '/' || label ELSE label END AS label
    FROM base LEFT JOIN clash USING (label) LEFT JOIN fit USING (label)"""
)
def label_disambiguation(spark, sf):
    return graph.label_nodes(_pages(spark, sf))


@query(f"WITH {CHAIN}, {LAYER_ROWS}, {DEGREES.replace('deg AS', 'deg2 AS')}, iss AS (SELECT 'warning' AS severity FROM judged WHERE (module_type NOT IN ('entry-point', 'config') AND fan_out > lim) OR loc > most UNION ALL SELECT 'warning' FROM judged WHERE fan_in > hi AND fan_out > ho) SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM iss")
def severity_counts(spark, sf):
    n, e = parts(spark, sf), successions(spark, sf)
    return graph.severity_counts(graph.god_modules(n, e).unionByName(graph.high_coupling(n, e)))


# ---- history ----


@query(f"WITH c AS ({COMMITS_SQL}), k AS (SELECT path, count(*) AS changes FROM c GROUP BY path) SELECT path, changes, round(changes / (SELECT max(changes) FROM k), 6) AS frequency FROM k")
def change_frequency(spark, sf):
    return history.change_frequency(commits(spark, sf)).withColumn("frequency", F.round("frequency", 6))


CO = f"c AS (SELECT DISTINCT commit_id, path FROM ({COMMITS_SQL})), k AS (SELECT path, count(*) AS n FROM c GROUP BY path), co AS (SELECT a.path AS file_a, b.path AS file_b, count(*) AS co_changes FROM c a JOIN c b ON a.commit_id = b.commit_id AND a.path < b.path GROUP BY ALL), conf AS MATERIALIZED (SELECT file_a, file_b, co_changes, co_changes / greatest(ka.n, kb.n) AS confidence FROM co JOIN k ka ON file_a = ka.path JOIN k kb ON file_b = kb.path)"


@query(f"WITH {CO} SELECT file_a, file_b, co_changes, round(confidence, 6) AS confidence FROM conf")
def co_change(spark, sf):
    return history.co_changes(commits(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query("WITH c AS (SELECT DISTINCT l_orderkey AS commit_id, l_suppkey AS path FROM lineitem), k AS (SELECT path, count(*) AS n FROM c GROUP BY path), co AS (SELECT a.path AS file_a, b.path AS file_b, count(*) AS co_changes FROM c a JOIN c b ON a.commit_id = b.commit_id AND a.path < b.path GROUP BY ALL HAVING count(*) >= 3) SELECT file_a, file_b, co_changes, round(co_changes / greatest(ka.n, kb.n), 6) AS confidence FROM co JOIN k ka ON file_a = ka.path JOIN k kb ON file_b = kb.path")
def co_change_large(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_suppkey").alias("path"))
    return history.co_changes(li, 3).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {CO} SELECT file_a, file_b, co_changes, round(confidence, 6) AS confidence FROM conf WHERE co_changes >= 3 AND confidence >= 0.36 AND NOT (file_a = 'click' AND file_b = 'view')")
def temporal_coupling(spark, sf):
    nodes = table(spark, sf, "events").select(F.col("event_type").alias("id")).distinct()
    edges = spark.createDataFrame([("view", "click")], "source string, target string")
    return history.temporal_coupling(history.co_changes(commits(spark, sf), 3), nodes, edges, 3, 0.36).withColumn("confidence", F.round("confidence", 6))


@query("WITH p AS (SELECT user_id AS path, event_type AS author, count(*) AS commits FROM events GROUP BY ALL), t AS (SELECT *, sum(commits) OVER (PARTITION BY path) AS total FROM p) SELECT path, count(*) FILTER (commits >= 0.1 * total) AS bus_factor, CAST(sum(commits) AS BIGINT) AS commits, (list(author ORDER BY commits DESC, author))[1] AS top_author FROM t GROUP BY path")
def bus_factor(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("author"))
    return history.bus_factor(e)


@query("WITH l AS (SELECT o_custkey AS path, max(o_orderdate) AS last_change FROM orders GROUP BY o_custkey), d AS (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2001-08-01') - epoch_us(last_change)) / 86400000000) AS INT) AS stale_days FROM l) SELECT *, CASE WHEN stale_days >= 360 THEN 'abandoned' WHEN stale_days >= 180 THEN 'dusty' ELSE 'active' END AS stale_level FROM d")
def staleness(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderdate").alias("ts"))
    return history.staleness(o, F.lit("2001-08-01").cast("timestamp"))


_DOC_BRANCHES = text.branches_sql("text")


@query(f"SELECT doc_id, {_DOC_BRANCHES} AS branches FROM documents")
def branch_complexity(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.branches(F.col("text"), F.lit("c")).alias("branches"))


@query(f"WITH b AS (SELECT source AS id, CAST(sum({_DOC_BRANCHES}) AS BIGINT) AS complexity, count(*) AS changes FROM documents GROUP BY source), t AS (SELECT *, complexity / greatest((SELECT max(complexity) FROM b), 1) AS nc, changes / (SELECT max(changes) FROM b) AS cf FROM b) SELECT id, complexity, round(nc, 6) AS normalized_complexity, round(cf, 6) AS change_frequency, changes, round(nc * cf, 6) AS hotspot_score, nc * cf >= 0.5 AS is_hotspot FROM t")
def hotspots(spark, sf):
    docs = table(spark, sf, "documents")
    per = docs.groupBy(F.col("source").alias("path")).agg(F.sum(text.branches(F.col("text"), F.lit("c"))).alias("branches"))
    spots = history.hotspots(docs.select(F.col("source").alias("id")).distinct(), per, history.change_frequency(docs.select(F.col("source").alias("path"))))
    return spots.withColumns({c: F.round(c, 6) for c in ("normalized_complexity", "change_frequency", "hotspot_score")})


@query("WITH l AS (SELECT o_custkey AS path, max(o_orderdate) AS last_change FROM orders GROUP BY o_custkey), d AS (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2001-08-01') - epoch_us(last_change)) / 86400000000) AS INT) AS n FROM l) SELECT 'info' AS severity, 'Stale code (' || CASE WHEN n >= 360 THEN 'abandoned' ELSE 'dusty' END || ', ' || n || ' days): ' || path AS message FROM d WHERE n >= 180")
def stale_issues(spark, sf):
    return history.stale_issues(staleness(spark, sf).withColumn("path", F.col("path").cast("string"))).select("severity", "message")


@query(f"WITH {CO} SELECT CASE WHEN confidence >= 0.8 THEN 'warning' ELSE 'info' END AS severity, file_a || '|' || file_b AS pair FROM conf WHERE co_changes >= 3")
def temporal_issues(spark, sf):
    return history.temporal_issues(history.co_changes(commits(spark, sf), 3)).select("severity", F.array_join("files", "|").alias("pair"))


@query("WITH p AS (SELECT o_orderkey AS path, CAST(o_custkey AS VARCHAR) AS author FROM orders) SELECT 'warning' AS severity, 'Bus factor 1 — only ' || author || ' contributes to: ' || path AS message FROM p")
def bus_factor_issues(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").cast("string").alias("author"))
    return history.bus_factor_issues(history.bus_factor(o)).select("severity", "message")


@query("SELECT user_id, event_id, count(CASE WHEN event_type = 'signup' THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS header FROM events")
def carried_headers(spark, sf):
    """A header holds for the rows after it: here the number of signups so far of each user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    e = table(spark, sf, "events").withColumn("k", F.when(F.col("event_type") == "signup", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))))
    return e.select("user_id", "event_id", F.coalesce(F.last("k", ignorenulls=True).over(w), F.lit(0)).cast("long").alias("header"))


@query("SELECT commit_id, path FROM (SELECT last_value(CASE WHEN event_type = 'signup' THEN CAST(event_id AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS commit_id, event_type, event_type || '/' || event_id AS path FROM events) WHERE event_type <> 'signup' AND commit_id IS NOT NULL")
def carried_commits(spark, sf):
    """A user's events as the lines of a log: a sign-up is a header, the others are paths below it."""
    line = F.when(F.col("event_type") == "signup", F.concat(F.lit("commit "), "event_id")).otherwise(F.concat("event_type", F.lit("/"), "event_id"))
    lines = table(spark, sf, "events").select(F.col("user_id").alias("file"), "ts", "event_id", line.alias("value"))
    return project.carry_headers(lines, ("ts", "event_id"))


@query(f"WITH {GRAPH}, {DEGREES}, {FULL} SELECT id, fan_in, fan_out FROM full_nodes")
def degrees_of_all(spark, sf):
    """Nodes without edges have degrees of 0."""
    return graph.with_degrees(parts(spark, sf), successions(spark, sf)).select("id", "fan_in", "fan_out")


@query("SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, event_id) AS label, min(event_id) AS ord FROM events GROUP BY user_id")
def node_upserts(spark, sf):
    """Each event writes its user's node: the last label stays, at the place of the first."""
    return graph.upsert_nodes(table(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("label"), F.col("event_id").alias("ord")))


@query("SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')) AS escaped FROM pages")
def escaped_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.escape_markup(F.col("html")).cast("binary")).alias("escaped"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g'), '^_+|_+$', '', 'g') AS identifier FROM pages")
def identifiers(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.identifier(F.col("url")).alias("identifier"))


_KEPT = "list_concat(['src', 'x' || p_partkey, 'd' || (p_partkey % 7)][1 : CAST(3 - p_partkey % 4 AS INT)], ['index.ts'])"


@query(f"SELECT p_partkey, array_to_string({_KEPT}, '/') AS path, CASE WHEN len({_KEPT}) > 1 THEN ({_KEPT})[-2] ELSE 'index' END AS label FROM part")
def module_paths(spark, sf):
    """Paths with dots, empty and parent segments and back slashes; an index file has its directory's name."""
    k = F.col("p_partkey")
    raw = F.concat(F.lit("src\\x"), k, F.lit("/./d"), k % 7, F.lit("//"), F.repeat(F.lit("../"), (k % 4).cast("int")), F.lit("index.ts"))
    path = text.normalise(text.posix(raw))
    return table(spark, sf, "part").select("p_partkey", path.alias("path")).withColumn("label", text.module_name(F.col("path")))


@query(f"WITH s AS ({SQL['hotspots']}) SELECT CASE WHEN hotspot_score >= 0.75 THEN 'error' ELSE 'warning' END AS severity, id FROM s WHERE is_hotspot")
def hotspot_issues(spark, sf):
    return history.hotspot_issues(hotspots(spark, sf)).select("severity", F.get("files", 0).alias("id"))


@query(f"WITH {GRAPH}, {DEGREES}, {FULL} SELECT id, CAST(fan_in + fan_out AS DOUBLE) / (SELECT max(fan_in) + max(fan_out) FROM full_nodes) AS value, CAST(1 AS DOUBLE) AS alpha FROM full_nodes")
def map_lens_dependencies(spark, sf):
    return enrich.map_lens(graph.with_degrees(parts(spark, sf), successions(spark, sf)), "dependencies")


@query(
    f"""WITH {GRAPH}, {LAYER_ROWS}, ln AS (SELECT id, rank FROM nodes JOIN layers USING (module_type) JOIN ranks USING (layer)),
    bad AS (SELECT DISTINCT source, target FROM edges JOIN ln a ON source = a.id JOIN ln b ON target = b.id WHERE a.rank < b.rank)
    SELECT source, target FROM edges SEMI JOIN bad USING (source, target)"""
)
def violation_paths(spark, sf):
    """Paths that the lens of threats shows, where no edge is circular or temporal: those that violate the layers."""
    nodes, edges = parts(spark, sf), successions(spark, sf)
    flagged = enrich.flag_violations(edges.withColumn("is_circular", F.lit(False)), graph.layer_issues(nodes, edges))
    return enrich.lens_paths(flagged, nodes, "threats").select("source", "target")


# ---- text ----


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS loc FROM documents")
def lines_of_code(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.loc(F.col("text")).cast("long").alias("loc"))


_S = rules.SECURITY_RULES[0].pattern.replace("'", "''")
_TL, _TF = rules.TYPE_LINE.replace("'", "''"), rules.TYPE_FIELD.replace("'", "''")
_SECRETS = rf"ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE strlen(text) <= 100000), hit AS (SELECT *, regexp_extract(trim(value), '(\w+)\s*[:=]\s*[\x22\x27]', 1) AS name FROM ln WHERE regexp_matches(value, '{_S}') AND NOT regexp_matches(value, '{_TL}') AND NOT regexp_matches(value, '{_TF}'))"


def _sources(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(None).cast("string").alias("language"), F.lit("util").alias("module_type"), "text")


@query(rf"WITH {_SECRETS} SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line AS INT) AS line, 'secret' AS rule, 'error' AS severity, CASE WHEN name <> '' THEN name || ' = [redacted]' ELSE '[hardcoded secret]' END AS match FROM hit")
def secret_findings(spark, sf):
    return security.findings(_sources(spark, sf), {"secret"}).select("path", F.col("line").cast("int").alias("line"), "rule", "severity", "match")


@query(rf"WITH {_SECRETS} SELECT CAST(doc_id AS VARCHAR) AS path, 'security-secret' AS type, 'error' AS severity, count(*) AS total FROM hit GROUP BY doc_id")
def security_report(spark, sf):
    found = security.findings(_sources(spark, sf), {"secret"})
    return found.groupBy("path", F.col("kind").alias("type"), "severity").agg(F.count("*").alias("total"))


_URL_PATH = "regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1)"


@query(f"SELECT page_id, {rules.first_match_sql(_URL_PATH, rules.PATH_RULES, 'unknown')} AS module_type FROM pages")
def classify_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", rules.classify_path(F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1)).alias("module_type"))


@query("SELECT p_partkey, " + rules.first_match_sql("path", rules.PATH_RULES, "unknown") + " AS module_type FROM (SELECT p_partkey, '/src/' || (['controllers', 'services', 'models', 'utils', 'components', 'hooks', 'pages', 'api', 'tests', 'x'])[p_partkey % 10 + 1] || '/' || replace(p_name, ' ', '_') || (['.ts', '.py', '.go', '.rs', '.java', '.rb', '.php', '.cs', '.tsx', '.vue'])[CAST(floor(p_partkey / 10) AS BIGINT) % 10 + 1] AS path FROM part)")
def classify_part_paths(spark, sf):
    k = F.col("p_partkey")
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n % 10).cast("int") + 1)
    path = F.concat(F.lit("/src/"), pick("controllers services models utils components hooks pages api tests x".split(), k), F.lit("/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), pick(".ts .py .go .rs .java .rb .php .cs .tsx .vue".split(), F.floor(k / 10)))
    return table(spark, sf, "part").select("p_partkey", rules.classify_path(path).alias("module_type"))


_HEAD = "array_to_string(list_slice(string_split(html, chr(10)), 1, 150), chr(10))"


@query(f"SELECT page_id, {rules.first_match_sql(_HEAD, rules.CONTENT_RULES, 'unknown')} AS module_type FROM pages")
def classify_content(spark, sf):
    return table(spark, sf, "pages").select("page_id", rules.classify_content(F.col("html")).alias("module_type"))


@query(rf"""WITH h AS (SELECT url AS source, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, unnest(list_distinct(regexp_extract_all(html, '(?i)\bhref\s*=\s*["''''""]([^"''''""#?]+)', 1))) AS href FROM pages) SELECT DISTINCT source, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href ELSE host || '/' || regexp_replace(href, '^/+', '') END AS target FROM h""".replace("''''\"\"", "''"))
def link_edges(spark, sf):
    return extract.link_edges(table(spark, sf, "pages"))


@query(f"WITH nodes AS ({PARTS_SQL}), p AS (SELECT loc, string_split(file_path, '/') AS ps FROM nodes), l AS (SELECT loc, ps, unnest(range(len(ps))) AS depth FROM p) SELECT array_to_string(ps[1 : depth + 1], '/') AS path, array_to_string(ps[1 : depth], '/') AS parent, CAST(depth AS INT) AS depth, depth = len(ps) - 1 AS is_file, count(*) AS files, CAST(sum(loc) AS BIGINT) AS loc FROM l GROUP BY ALL")
def subtree_sums(spark, sf):
    return drilldown.subtrees(parts(spark, sf))


# ---- graph algorithms ----


def _rank_sql(rounds: int) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT id, 1.0 / (SELECT count(*) FROM nodes) AS rank FROM nodes)"]
    for k in range(rounds):
        steps.append(
            f"r{k + 1} AS MATERIALIZED (SELECT n.id, 0.15 / (SELECT count(*) FROM nodes) + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{k} WHERE id NOT IN (SELECT source FROM edges)) / (SELECT count(*) FROM nodes) + 0.85 * coalesce(sum(r.rank / d.o), 0) AS rank FROM nodes n LEFT JOIN edges e ON e.target = n.id LEFT JOIN r{k} r ON r.id = e.source LEFT JOIN outs d ON d.source = e.source GROUP BY n.id)"
        )
    changes = " UNION ALL ".join(f"SELECT {k + 1} AS k, (SELECT sum(abs(a.rank - b.rank)) FROM r{k + 1} a JOIN r{k} b USING (id)) AS change" for k in range(rounds))
    every = " UNION ALL ".join(f"SELECT {k + 1} AS k, id, rank FROM r{k + 1}" for k in range(rounds))
    return f"WITH {TRADE_SQL}, outs AS (SELECT source, count(*) AS o FROM edges GROUP BY source), {', '.join(steps)}, last AS (SELECT min(k) AS k FROM ({changes}) WHERE change < 1e-6 OR k = {rounds}) SELECT id, round(rank / max(rank) OVER (), 6) AS rank FROM ({every}) JOIN last USING (k)"


@query(_rank_sql(30))
def pagerank(spark, sf):
    """The operator's own bound and tolerance; the SQL is unrolled to thirty rounds and takes the first after which ranks change too little."""
    nodes, edges = trade(spark, sf)
    return graph_metrics.pagerank(nodes, edges).withColumn("rank", F.round("rank", 6))


def _next_supplier(spark, sf):
    """A graph of one edge per supplier: to the supplier that most often comes next in an order."""
    li = table(spark, sf, "lineitem")
    nxt = F.lead("l_suppkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    pairs = li.select("l_suppkey", nxt.alias("n")).where("n is not null and n <> l_suppkey").groupBy("l_suppkey", "n").agg(F.count("*").alias("k"))
    top = pairs.groupBy("l_suppkey").agg(F.min_by("n", F.struct(-F.col("k"), F.col("n"))).alias("n"))
    return top.select(F.format_string("s%05d", "l_suppkey").alias("source"), F.format_string("s%05d", "n").alias("target"))


NEXT = "edges AS MATERIALIZED (SELECT printf('s%05d', l_suppkey) AS source, printf('s%05d', n) AS target FROM (SELECT l_suppkey, n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, n) AS rn FROM (SELECT l_suppkey, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n IS NOT NULL AND n <> l_suppkey GROUP BY l_suppkey, n) WHERE rn = 1)"


@query(f"WITH RECURSIVE {NEXT}, walk(a, b) AS (SELECT source, target FROM edges UNION SELECT a, target FROM walk JOIN edges ON b = source), both_ways AS (SELECT w.a, w.b FROM walk w JOIN walk v ON w.a = v.b AND w.b = v.a WHERE w.a <> w.b) SELECT a AS id, greatest(a, max(b)) AS component FROM both_ways GROUP BY a")
def strong_components(spark, sf):
    return graph_metrics.strong_components(_next_supplier(spark, sf))


@query(f"WITH RECURSIVE {NEXT}, walk(id, distance) AS (SELECT 's00001', 0 UNION ALL SELECT target, distance + 1 FROM walk JOIN edges ON id = source WHERE distance < 200) SELECT id, CAST(min(distance) AS INT) AS distance FROM walk GROUP BY id")
def reachability(spark, sf):
    return graph_metrics.reachable(_next_supplier(spark, sf), "s00001")


@query(SQL["strong_components"])
def strong_components_distributed(spark, sf):
    """The loop of joins that graphs of any size take."""
    return graph_metrics.strong_components(_next_supplier(spark, sf), small=0)


@query(SQL["reachability"])
def reachability_distributed(spark, sf):
    return graph_metrics.reachable(_next_supplier(spark, sf), "s00001", small=0)


_TREE = "edges(source, target) AS (SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


def _tree(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    a = n.select(F.concat(F.lit("r"), "n_regionkey").alias("source"), F.concat(F.lit("n"), "n_nationkey").alias("target"))
    return a.unionByName(c.select(F.concat(F.lit("n"), "c_nationkey").alias("source"), F.concat(F.lit("c"), "c_custkey").alias("target")))


@query(f"WITH RECURSIVE {_TREE}, ids AS (SELECT source AS id FROM edges UNION SELECT target FROM edges), walk(id, d) AS (SELECT id, 0 FROM ids UNION ALL SELECT source, d + 1 FROM walk JOIN edges ON target = id) SELECT id, CAST(max(d) AS INT) AS layer FROM walk GROUP BY id")
def dependency_layers(spark, sf):
    edges = _tree(spark, sf)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return graph_metrics.dependency_layers(nodes, edges)


@query(f"WITH RECURSIVE {NEXT}, ids AS (SELECT source AS id FROM edges UNION SELECT target FROM edges), reach(a, b) AS (SELECT source, target FROM edges UNION SELECT a, target FROM reach JOIN edges ON b = source), ring AS (SELECT a AS id FROM reach WHERE a = b), walk(id, x, d) AS (SELECT id, id, 0 FROM ids UNION ALL SELECT id, target, d + 1 FROM walk JOIN edges ON x = source WHERE x NOT IN (SELECT id FROM ring)) SELECT id, CAST(max(d) + 1 AS INT) AS layer FROM walk GROUP BY id")
def dependency_layers_cyclic(spark, sf):
    """Every path of this graph ends in a cycle; a cycle counts as one step, so its members share layer 1."""
    edges = _next_supplier(spark, sf)
    nodes = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    return graph_metrics.dependency_layers(nodes, edges).select("id", "layer")


@query(f"WITH {TRADE_SQL}, u AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), w AS (WITH RECURSIVE walk(a, b) AS (SELECT id, id FROM nodes UNION SELECT a, target FROM walk JOIN u ON b = source) SELECT a AS id, min(b) AS component FROM walk GROUP BY a) SELECT * FROM w")
def weak_components(spark, sf):
    return graph_metrics.components(*trade(spark, sf))


def _between_sql(levels: int) -> str:
    """Numbers of shortest paths, level by level, and of those through each node."""
    steps = ["l0 AS (SELECT id AS s, id AS t, 0 AS d, CAST(1 AS DOUBLE) AS paths FROM nodes)"]
    for k in range(1, levels + 1):
        before = " UNION ALL ".join(f"SELECT s, t FROM l{j}" for j in range(k))
        steps.append(f"l{k} AS MATERIALIZED (SELECT s, target AS t, {k} AS d, sum(paths) AS paths FROM l{k - 1} JOIN edges ON t = source WHERE (s, target) NOT IN ({before}) GROUP BY s, target)")
    every = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(levels + 1))
    through = "SELECT a.t AS id, sum(a.paths * b.paths / c.paths) AS b FROM far a JOIN far b ON a.t = b.s JOIN far c ON c.s = a.s AND c.t = b.t AND c.d = a.d + b.d WHERE a.d > 0 AND b.d > 0 GROUP BY a.t"
    return f"WITH {TRADE_SQL}, {', '.join(steps)}, far AS MATERIALIZED ({every}), through AS ({through}) SELECT id, round(coalesce(b, 0) / (SELECT max(b) FROM through), 6) AS betweenness FROM nodes LEFT JOIN through USING (id)"


@query(_between_sql(12))
def betweenness(spark, sf):
    return graph_metrics.betweenness(*trade(spark, sf)).withColumn("betweenness", F.round("betweenness", 6))


def _visits_sql(graph: str, rounds: int, seeds: str | None = None) -> str:
    """Labels as one list that is changed node by node in id order, so many rounds over all nodes.

    seeds: SQL of (id, community), with which labels start and whose ties keep the label there is.
    """
    best = "list_sort(list_transform(list_distinct(vs), lambda x: {'n': -len(list_filter(vs, lambda y: y = x)), 'o': " + ("x <> labels[i]" if seeds else "false") + ", 'x': x}))[1].x"
    start = "i - 1"
    if seeds:
        votes = "SELECT source AS id, community, count(*) AS k FROM u JOIN seed ON seed.id = target GROUP BY ALL"
        start = f"coalesce((SELECT community FROM seed WHERE seed.id = ids.id), (SELECT arg_min(community, (-k, community)) FROM ({votes}) v WHERE v.id = ids.id), (SELECT max(community) FROM seed) + i)"
    return f"""WITH RECURSIVE {graph}, u AS MATERIALIZED (SELECT source, target FROM edges WHERE source <> target UNION SELECT target, source FROM edges WHERE source <> target), {f"seed AS MATERIALIZED ({seeds})," if seeds else ""}
 ids AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS i FROM nodes), first AS MATERIALIZED (SELECT id, i, CAST({start} AS BIGINT) AS label FROM ids),
 near AS MATERIALIZED (SELECT a.i, list(b.i) AS others FROM ids a JOIN u ON a.id = source JOIN ids b ON b.id = target GROUP BY a.i),
 visits AS MATERIALIZED (SELECT row_number() OVER (ORDER BY r, i) AS k, i, others FROM near, range({rounds}) t(r)),
 walk(k, labels) AS (SELECT 1, list(label ORDER BY i) FROM first UNION ALL SELECT k + 1, list_concat(labels[1 : i - 1], [{best}], labels[i + 1 :]) FROM (SELECT k, labels, i, list_transform(others, lambda o: labels[o]) AS vs FROM walk JOIN visits USING (k))),
 last AS (SELECT labels FROM walk ORDER BY k DESC LIMIT 1)
SELECT id, CAST(dense_rank() OVER (ORDER BY labels[i]) - 1 AS INT) AS community FROM ids, last"""


@query(_visits_sql(TRADE_SQL, 20))
def communities(spark, sf):
    return graph_metrics.communities(*trade(spark, sf))


def _with_ends(edges):
    return edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct(), edges


NEXT_GRAPH = f"{NEXT}, nodes AS MATERIALIZED (SELECT source AS id FROM edges UNION SELECT target FROM edges)"


@query(_visits_sql(NEXT_GRAPH, 20))
def communities_of_suppliers(spark, sf):
    return graph_metrics.communities(*_with_ends(_next_supplier(spark, sf)))


@query(_visits_sql(NEXT_GRAPH, 10, "SELECT printf('s%05d', s_suppkey) AS id, s_nationkey AS community FROM supplier WHERE s_suppkey % 3 <> 0"))
def seeded_communities(spark, sf):
    """Suppliers begin in their nation's community, every third one in what its neighbours have."""
    seeds = table(spark, sf, "supplier").where("s_suppkey % 3 <> 0").select(F.format_string("s%05d", "s_suppkey").alias("id"), F.col("s_nationkey").cast("int").alias("community"))
    return graph_metrics.communities(*_with_ends(_next_supplier(spark, sf)), seeds)


def _places(spark, sf):
    """Regions, nations and chains of seven suppliers that hang on a nation by one end, or by both; neighbouring nations are linked, by fives."""
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    nation, supplier = (lambda c: F.format_string("n%02d", c)), (lambda c: F.format_string("s%05d", c))
    links = [
        n.select(nation(F.col("n_nationkey")).alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target")),
        n.where("n_nationkey % 5 <> 0").select(nation(F.col("n_nationkey")), nation(F.col("n_nationkey") - 1)),
        s.where("s_suppkey % 7 <> 0").select(supplier(F.col("s_suppkey")), supplier(F.col("s_suppkey") - 1)),
        s.where("s_suppkey % 7 = 0 or (s_suppkey % 7 = 6 and floor(s_suppkey / 7) % 2 = 0)").select(supplier(F.col("s_suppkey")), nation(F.col("s_nationkey"))),
    ]
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


PLACES = """edges AS MATERIALIZED (SELECT printf('n%02d', n_nationkey) AS source, 'r' || n_regionkey AS target FROM nation
 UNION ALL SELECT printf('n%02d', n_nationkey), printf('n%02d', n_nationkey - 1) FROM nation WHERE n_nationkey % 5 <> 0
 UNION ALL SELECT printf('s%05d', s_suppkey), printf('s%05d', s_suppkey - 1) FROM supplier WHERE s_suppkey % 7 <> 0
 UNION ALL SELECT printf('s%05d', s_suppkey), printf('n%02d', s_nationkey) FROM supplier WHERE s_suppkey % 7 = 0 OR (s_suppkey % 7 = 6 AND (s_suppkey // 7) % 2 = 0))"""


@query(
    f"""WITH RECURSIVE {PLACES}, u AS MATERIALIZED (SELECT source, target FROM edges UNION SELECT target, source FROM edges), start AS (SELECT source AS x, min(target) AS v FROM u GROUP BY source),
    reach(x, v) AS (SELECT x, v FROM start UNION SELECT x, target FROM reach JOIN u ON source = v WHERE target <> x)
    SELECT DISTINCT source AS id FROM u WHERE NOT EXISTS (SELECT 1 FROM reach WHERE x = source AND v = target)"""
)
def articulation_points(spark, sf):
    """A graph of many cycles and bridges; the SQL takes each node out and looks which of its neighbours cannot be reached any more."""
    nodes, edges = _with_ends(_places(spark, sf))
    return graph_metrics.articulation_points(nodes, edges)


@query(f"WITH RECURSIVE {NEXT}, walk(a, b) AS (SELECT source, target FROM edges UNION SELECT a, target FROM walk JOIN edges ON b = source), home AS (SELECT w.a AS id, greatest(w.a, max(w.b)) AS component FROM walk w JOIN walk v ON w.a = v.b AND w.b = v.a WHERE w.a <> w.b GROUP BY w.a) SELECT 'error' AS severity, 'Circular dependency: ' || array_to_string(list_sort(list(id)), ' → ') AS message FROM home GROUP BY component")
def cycle_issues(spark, sf):
    return graph_metrics.cycle_issues(_next_supplier(spark, sf)).select("severity", "message")


# ---- enrichment ----


def _wide(spark, sf):
    n, e = parts(spark, sf), successions(spark, sf)
    issues = graph.god_modules(n, e).unionByName(graph.high_coupling(n, e)).unionByName(graph.orphan_issues(n, e))
    return enrich.wide_nodes(n, e, issues), issues


_ISSUES = f"{GRAPH}, {DEGREES}, {FULL}, {MEDIAN}, {LIMITS}, {JUDGED}, god AS MATERIALIZED (SELECT id FROM judged WHERE (module_type NOT IN ('entry-point', 'config') AND fan_out > lim) OR loc > most), high AS (SELECT id FROM judged WHERE fan_in > hi AND fan_out > ho), orp AS MATERIALIZED (SELECT id FROM full_nodes WHERE fan_in = 0 AND fan_out = 0 AND module_type NOT IN {dims.STANDALONE})"
_BIOMES = f"biomes(module_type, biome) AS (VALUES {_values(dims.BIOME_OF.items())})"


@query(
    f"""WITH {_ISSUES}, {_BIOMES} SELECT id, round((fan_in + fan_out) * 3 + log2(loc + 1) * 2 + CASE WHEN id IN (SELECT id FROM god) THEN 25 ELSE 0 END, 6) AS importance,
    CASE WHEN id IN (SELECT id FROM god) OR loc > 200 OR fan_in + fan_out > 8 THEN 'large' WHEN loc > 50 OR fan_in + fan_out > 3 THEN 'medium' ELSE 'small' END AS size_category, coalesce(biome, 'plains') AS biome,
    CASE WHEN id IN (SELECT id FROM orp) THEN 'ruined' WHEN id IN (SELECT id FROM god) OR id IN (SELECT id FROM high) THEN 'damaged' ELSE 'healthy' END AS condition FROM full_nodes LEFT JOIN biomes USING (module_type)"""
)
def importance_size(spark, sf):
    wide, issues = _wide(spark, sf)
    wide = wide.withColumns({"is_hotspot": F.lit(False), "hotspot_score": F.lit(0.0)})
    return enrich.locations(wide, issues).select("id", F.round("importance", 6).alias("importance"), "size_category", "biome", "condition")


@query(f"WITH {_ISSUES}, p AS (SELECT (SELECT count(*) FROM god) * 3 + (SELECT count(*) FROM high) * 3 + (SELECT count(*) FROM orp) AS penalty), s AS (SELECT CAST(greatest(0, floor(100 - penalty / greatest(1, (SELECT count(*) FROM nodes) * 5) * 100 + 0.5)) AS BIGINT) AS score FROM p) SELECT score, CASE WHEN score >= 80 THEN 4 WHEN score >= 60 THEN 3 WHEN score >= 40 THEN 2 WHEN score >= 20 THEN 1 ELSE 0 END AS tier FROM s")
def health_score(spark, sf):
    _, issues = _wide(spark, sf)
    return enrich.health(issues, parts(spark, sf))


@query(f"WITH {_ISSUES}, t AS (SELECT id, 'god-module' AS type, 'warning' AS severity FROM god UNION ALL SELECT id, 'high-coupling', 'warning' FROM high UNION ALL SELECT id, 'orphan-module', 'info' FROM orp) SELECT id, type, severity, CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS rank FROM t")
def threat_log(spark, sf):
    wide, issues = _wide(spark, sf)
    wide = wide.withColumns({"is_hotspot": F.lit(False), "hotspot_score": F.lit(0.0)})
    return enrich.threat_log(enrich.threats(wide, issues)).select("id", "type", "severity", "rank")


@query(f"WITH {_ISSUES} SELECT id, CASE WHEN fan_in >= 8 THEN 'blast-radius' WHEN id IN (SELECT id FROM god) THEN 'oversized' WHEN id IN (SELECT id FROM orp) THEN 'unused' ELSE 'fine' END AS verdict FROM full_nodes")
def verdicts(spark, sf):
    wide, _ = _wide(spark, sf)
    return enrich.verdicts(wide.withColumns({"normalized_complexity": F.lit(0.0), "change_frequency": F.lit(0.0)}))


@query(
    f"""WITH {_ISSUES}, churn AS (SELECT 'p' || l_partkey AS id, count(*) / max(count(*)) OVER () AS often FROM lineitem GROUP BY l_partkey),
    m AS (SELECT f.*, loc / (SELECT max(loc) FROM nodes) AS busy, coalesce(often, 0) AS often FROM full_nodes f LEFT JOIN churn USING (id))
    SELECT id, CASE WHEN busy >= 0.5 AND often >= 0.5 THEN 'refactor-first' WHEN busy >= 0.5 THEN 'complex-but-stable' WHEN often >= 0.5 THEN 'simple-but-busy' WHEN fan_in >= 8 THEN 'blast-radius' WHEN id IN (SELECT id FROM god) THEN 'oversized' WHEN id IN (SELECT id FROM orp) THEN 'unused' ELSE 'fine' END AS verdict FROM m"""
)
def verdicts_measured(spark, sf):
    """Lines of code over the greatest stand for complexity, a part's order lines for its changes."""
    wide, _ = _wide(spark, sf)
    changes = history.change_frequency(table(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("path")))
    top = parts(spark, sf).agg(F.max("loc").alias("top"))
    rows = wide.drop("change_frequency", "normalized_complexity").join(changes.select(F.col("path").alias("id"), F.col("frequency").alias("often")), "id", "left").crossJoin(F.broadcast(top))
    return enrich.verdicts(rows.withColumns({"normalized_complexity": F.col("loc") / F.col("top"), "change_frequency": F.coalesce("often", F.lit(0.0))}))


@query(
    f"""WITH {_ISSUES}, m AS (SELECT f.*, loc / (SELECT max(loc) FROM nodes) AS pr, (ord % 100) / 100 AS bt FROM full_nodes f)
    SELECT id, round(pr * 40 + bt * 15 + CASE WHEN id IN (SELECT id FROM god) THEN 25 ELSE 0 END + CASE WHEN module_type IN ('entry-point', 'page', 'layout') THEN 10 ELSE 0 END, 6) AS importance,
    CASE WHEN id IN (SELECT id FROM god) OR pr > 0.6 OR loc > 200 OR fan_in + fan_out > 8 THEN 'large' WHEN pr > 0.25 OR loc > 50 OR fan_in + fan_out > 3 THEN 'medium' ELSE 'small' END AS size_category FROM m"""
)
def importance_with_metrics(spark, sf):
    """The formula for graphs whose metrics are known; here they come from a part's size and number."""
    wide, issues = _wide(spark, sf)
    n = parts(spark, sf)
    metrics = n.crossJoin(F.broadcast(n.agg(F.max("loc").alias("top")))).select("id", (F.col("loc") / F.col("top")).alias("page_rank"), (F.col("ord") % 100 / 100).alias("betweenness"), F.lit(0).alias("community"), F.lit(0).alias("layer"), F.lit(False).alias("is_articulation"))
    wide = wide.withColumns({"is_hotspot": F.lit(False), "hotspot_score": F.lit(0.0)})
    return enrich.locations(wide, issues, metrics).select("id", F.round("importance", 6).alias("importance"), "size_category")


def _state(spark, sf, first: bool):
    o = table(spark, sf, "orders")
    cut = F.lit("1998-01-01").cast("timestamp")
    some = o.where(F.col("o_orderdate") < cut if first else F.col("o_orderdate") >= cut)
    return some.select(F.concat(F.lit("c/"), F.col("o_custkey").cast("string")).alias("path")).distinct()


@query("WITH p AS (SELECT DISTINCT 'c/' || o_custkey AS path FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), c AS (SELECT DISTINCT 'c/' || o_custkey AS path FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01') SELECT c.path AS path, p.path AS previous_path, CASE WHEN p.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'removed' ELSE 'retained' END AS status FROM p FULL JOIN c ON p.path = c.path")
def state_diff(spark, sf):
    return enrich.diff_state(_state(spark, sf, True), _state(spark, sf, False))


@query(
    r"""WITH p AS (SELECT DISTINCT page_id % 2 AS side, regexp_replace(regexp_extract(url, '^[a-z]+://(.*?)(?:[?#].*)?$', 1), '/$', '') AS path FROM pages),
    s AS (SELECT side, path, regexp_extract(path, '([^/]*)$', 1) AS name, list_distinct(list_filter(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), lambda x: x <> '')) AS dirs FROM p)
    SELECT a.path AS path, b.path AS previous_path, round(0.5 + 0.5 * len(list_intersect(a.dirs, b.dirs)) / len(list_distinct(list_concat(a.dirs, b.dirs))), 6) AS score FROM s a JOIN s b ON a.name = b.name AND a.side = 1 AND b.side = 0
    WHERE 0.5 + 0.5 * len(list_intersect(a.dirs, b.dirs)) / len(list_distinct(list_concat(a.dirs, b.dirs))) >= 0.6"""
)
def rename_match(spark, sf):
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://(.*?)(?:[?#].*)?$", 1), "/$", "")
    p = table(spark, sf, "pages").select((F.col("page_id") % 2).alias("side"), path.alias("path")).distinct()
    return enrich.rename_pairs(p.where("side = 0"), p.where("side = 1")).withColumn("score", F.round("score", 6))


@query(f"WITH {GRAPH} SELECT id FROM nodes WHERE lower(label) LIKE '%p19%' OR lower(file_path) LIKE '%p19%'")
def search(spark, sf):
    return enrich.search(parts(spark, sf), "P19").select("id")


@query(f"WITH {GRAPH} SELECT DISTINCT target AS id, 'out' AS direction FROM edges WHERE source = 'p7' UNION SELECT DISTINCT source, 'in' FROM edges WHERE target = 'p7'")
def neighborhood(spark, sf):
    return enrich.neighbourhood(successions(spark, sf), "p7")


@query(f"WITH {_ISSUES}, help(type, title, suggestion) AS (VALUES {_values([(k, v[0], v[2]) for k, v in dims.ISSUE_HELP.items()])}), t AS (SELECT 'god-module' AS type FROM god UNION ALL SELECT 'high-coupling' FROM high UNION ALL SELECT 'orphan-module' FROM orp) SELECT type, title, suggestion, count(*) AS n FROM t JOIN help USING (type) GROUP BY ALL")
def issue_help(spark, sf):
    _, issues = _wide(spark, sf)
    return graph.with_help(issues).groupBy("type", "title", "suggestion").agg(F.count("*").alias("n"))


@query(f"WITH {GRAPH}, pl AS (SELECT id, ord % 4 AS c FROM nodes) SELECT least(a.c, b.c) AS a, greatest(a.c, b.c) AS b, count(*) AS n FROM edges JOIN pl a ON source = a.id JOIN pl b ON target = b.id WHERE a.c <> b.c GROUP BY ALL")
def community_links(spark, sf):
    places = parts(spark, sf).select("id", (F.col("ord") % 4).alias("community"))
    return enrich.community_links(places, successions(spark, sf))


@query(f"WITH nodes AS ({PARTS_SQL}), {_BIOMES}, pl AS (SELECT ord, ord % 7 AS community, biome FROM nodes JOIN biomes USING (module_type)) SELECT community, arg_max(biome, n * 1000000 - first) AS biome FROM (SELECT community, biome, count(*) AS n, min(ord) AS first FROM pl GROUP BY ALL) GROUP BY community")
def dominant_biome(spark, sf):
    places = parts(spark, sf).select("id", "ord", (F.col("ord") % 7).alias("community"), enrich.biome(F.col("module_type"), F.lit(False)).alias("biome"))
    return enrich.dominant_biome(places)


@query(f"WITH {GRAPH}, {DEGREES}, d AS (SELECT id, fan_in + fan_out AS degree FROM deg), m AS (SELECT list_sort(list(degree))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM d) SELECT source, target FROM edges JOIN d a ON source = a.id JOIN d b ON target = b.id, m WHERE (SELECT count(*) FROM edges) <= 100 OR a.degree > median OR b.degree > median")
def quiet_edges(spark, sf):
    return enrich.quiet_edges(successions(spark, sf)).select("source", "target")


@query(f"WITH nodes AS ({PARTS_SQL}) SELECT module_type, count(*) AS n FROM nodes GROUP BY module_type ORDER BY n DESC, module_type LIMIT 8")
def type_chips(spark, sf):
    return enrich.type_chips(parts(spark, sf))


@query(f"WITH {GRAPH}, {DEGREES}, {FULL} SELECT id, round((fan_in + fan_out) / (SELECT max(fan_in + fan_out) FROM full_nodes), 6) AS value FROM full_nodes")
def dependency_lens(spark, sf):
    wide = graph.with_degrees(parts(spark, sf), successions(spark, sf))
    return enrich.lens(wide, "dependencies").withColumn("value", F.round("value", 6))


@query(
    f"""WITH {GRAPH}, pl AS (SELECT id, CAST(ord % 60 AS INT) + 1 AS x, CAST(floor(ord / 60) AS INT) + 1 AS y, ord % 4 AS c FROM nodes)
    SELECT source, target, CAST(abs(a.x - b.x) + abs(a.y - b.y) + 1 AS INT) AS n_points, a.c <> b.c AS is_cross_region FROM edges JOIN pl a ON source = a.id JOIN pl b ON target = b.id"""
)
def manhattan_paths(spark, sf):
    n = parts(spark, sf)
    places = n.select("id", (F.col("ord") % 60).cast("int").alias("grid_x"), F.floor(F.col("ord") / 60).cast("int").alias("grid_y"), F.lit(2).alias("tile_size"), F.lit(1.0).alias("importance"), (F.col("ord") % 4).alias("community"))
    return enrich.routes(places, successions(spark, sf)).select("source", "target", "n_points", "is_cross_region")


@query(f"WITH nodes AS ({PARTS_SQL}) SELECT directory, CAST(sum(greatest(loc, 1)) AS DOUBLE) AS value, round(sum(greatest(loc, 1)) / (SELECT sum(greatest(loc, 1)) FROM nodes) * 960000, 3) AS area FROM nodes GROUP BY directory")
def treemap_directories(spark, sf):
    """Each directory's rectangle has its share of the area."""
    boxes = layout.treemap(parts(spark, sf)).where("directory is null")
    return boxes.select(F.col("id").alias("directory"), "value", F.round(F.col("w") * F.col("h"), 3).alias("area"))


@query(f"WITH nodes AS ({PARTS_SQL}) SELECT id, directory, round(sqrt(greatest(loc, 1)), 6) AS r FROM nodes")
def packed_circles(spark, sf):
    return layout.pack_circles(parts(spark, sf)).select("id", "directory", F.round("r", 6).alias("r"))


# ---- windows ----


def _events(spark, sf):
    return table(spark, sf, "events")


@query("SELECT CAST(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS TIMESTAMP) AS start, CAST(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') + INTERVAL '1 day' AS TIMESTAMP) AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf):
    return windows.counts(_events(spark, sf), "1 day").withColumn("total", F.round("total", 4))


@query("WITH w AS (SELECT event_type, value, ts, unnest([time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '6 hours']) AS start FROM events) SELECT CAST(start AS TIMESTAMP) AS start, CAST(start + INTERVAL '12 hours' AS TIMESTAMP) AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL")
def sliding_counts(spark, sf):
    return windows.counts(_events(spark, sf), "12 hours", "6 hours").withColumn("total", F.round("total", 4))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark, sf):
    return windows.sessions(_events(spark, sf))


@query("SELECT user_id, event_type, min(ts) AS first_seen FROM events GROUP BY ALL")
def first_seen(spark, sf):
    return windows.first_seen(_events(spark, sf))


@query("SELECT event_id, count(*) AS n FROM (SELECT DISTINCT event_id FROM events) GROUP BY event_id")
def dedup_events(spark, sf):
    return windows.without_repeats(_events(spark, sf)).groupBy("event_id").agg(F.count("*").alias("n"))


QUERIES.update(project_queries.QUERIES)
SQL.update(project_queries.SQL)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
