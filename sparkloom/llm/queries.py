"""The registered queries of this subpackage and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html_text, licences, lines, media, ngram_join, quality, resample, reshard, secrets, suffix_dedup, vectors
from .shared import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classify(table(spark, sf_dir, "documents"))


def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard.reshard(table(spark, sf_dir, "documents"), reshard.by_source())


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.compress(table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ALL = (op1_quality, op2_html_extraction, op3_suffix_dedup, op4_decontamination, op5_ngram_join, op6_resharding, op7_media_columns, op8_secret_scan, op9_bpe, op10_licence_scan, op11_line_dedup, op12_vector_codes, op13_resampling)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def _spans_sql(pattern: str, kind: int, test: str) -> str:
    """DuckDB: list of (start, kind, end) of the matches m of a pattern in column t that pass a test."""
    q = pattern.replace("'", "''")
    start = "CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT)"
    return f"(SELECT coalesce(list({{'s': {start}, 'k': {kind}, 'e': {start} + length(m[i])}}), []) FROM (SELECT m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT regexp_extract_all(t, '{q}') AS m, regexp_split_to_array(t, '{q}') AS p)) WHERE {test})"


_WORDS = secrets.KINDS
_LISTED = "array_to_string(list_transform(list_sort({0}), lambda x: (" + str(list(_WORDS)) + ")[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
_BOUND = "(?<![A-Za-z0-9_])"
SECRET_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 b AS MATERIALIZED (SELECT doc_id, t, list_concat({_spans_sql(secrets.ASSIGN, 0, "length(regexp_replace(m[i], '" + secrets.ASSIGN_HEAD.replace("'", "''") + "', '')) >= 8")}, {_spans_sql(secrets.ACCESS, 1, "length(m[i]) >= 16")}, {_spans_sql(secrets.HEX, 2, "true")}) AS base FROM d),
 w AS (SELECT doc_id, unnest(list_concat({_spans_sql("[A-Za-z0-9+/=]+", 3, "length(m[i]) = 40 AND NOT contains(m[i], '=')")}, {_spans_sql("(?i)" + secrets.IDENT.replace(_BOUND, chr(92) + "b"), 4, "true")}, {_spans_sql(secrets.ENDPOINT.replace(_BOUND, chr(92) + "b"), 5, "true")})) AS x FROM b WHERE len(base) > 0),
 s AS (SELECT doc_id, unnest(base) AS y FROM b),
 l AS (SELECT w.doc_id, list(DISTINCT x) AS linked FROM w JOIN s ON w.doc_id = s.doc_id AND abs(x.s - y.s) <= {secrets.SCOPE} AND (x.e <= y.s OR y.e <= x.s) AND ((x.k = 3 AND y.k = 1) OR (x.k = 4 AND y.k IN (0, 2)) OR x.k = 5) GROUP BY w.doc_id)
SELECT doc_id, len(list_filter(base, lambda x: x.k = 0)) AS n_assign, len(list_filter(base, lambda x: x.k = 1)) AS n_access, len(list_filter(base, lambda x: x.k = 2)) AS n_hex, sha256({_LISTED.format("base")}) AS base_sha256, {_LISTED.format("list_concat(base, coalesce(linked, []))")} AS spans
FROM b LEFT JOIN l USING (doc_id)"""

def _rows_sql(rows: list[tuple]) -> str:
    q = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows)


def _phrase_at(phrase: str) -> str:
    """DuckDB: numbers of the words of ws at which a phrase stands."""
    parts = phrase.split()
    return f"list_transform(list_filter(range(1, len(ws) + 1), lambda i: ws[i:i + {len(parts) - 1}] = {parts}), lambda i: i - 1)"


LICENCE_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
 b AS MATERIALIZED (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS line, {", ".join(f"{_phrase_at(p)} AS at{n}" for n, p in enumerate(licences.BASE))} FROM d),
 posting(word, template, position) AS (VALUES {_rows_sql(licences.postings())}),
 need(template, label, phrase) AS (VALUES {_rows_sql([(n, label, k) for n, (label, _, ks) in enumerate(licences.TEMPLATES) for k in ks])}),
 w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d),
 holders AS MATERIALIZED (SELECT word, count(DISTINCT doc_id) AS k FROM w WHERE word IN (SELECT word FROM posting) GROUP BY word),
 chosen AS (SELECT word, template, position, coalesce(k, 0) AS k, row_number() OVER (PARTITION BY template ORDER BY coalesce(k, 0), position) AS place FROM posting LEFT JOIN holders USING (word)),
 idx AS MATERIALIZED (SELECT word, template, position, k, count(*) OVER (PARTITION BY template) AS total FROM chosen WHERE place <= {licences.RARE}),
 hit AS (SELECT doc_id, template, word, total, unnest([floor((i - position) / {licences.SLACK}), floor((i - position) / {licences.SLACK}) + 1]) AS band FROM w JOIN idx USING (word)),
 placed AS (SELECT doc_id, template, max(share) AS share FROM (SELECT doc_id, template, band, count(DISTINCT word) / max(total) AS share FROM hit GROUP BY ALL) WHERE share >= {licences.SUPPORT} GROUP BY ALL),
 good AS (SELECT doc_id, share, max(label) AS label FROM placed JOIN need USING (template) JOIN b USING (doc_id) GROUP BY doc_id, template, share HAVING bool_and(contains(line, ' ' || phrase || ' '))),
 per AS (SELECT doc_id, list(DISTINCT label) AS found, round(max(share), 6) AS score FROM good GROUP BY doc_id),
 r AS (SELECT doc_id, ws, list_concat({", ".join(f"at{n}" for n in range(len(licences.BASE)))}) AS starts, list_filter([{", ".join(f"CASE WHEN len(at{n}) > 0 THEN '{label}' END" for n, label in enumerate(licences.BASE.values()))}], lambda x: x IS NOT NULL) AS based FROM b)
SELECT doc_id, len(ws) AS n_words, len(starts) AS n_base, list_min(starts) AS first_word, list_max(starts) AS last_word, array_to_string(list_sort(based), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(based, coalesce(found, [])))), ',') AS labels, coalesce(score, CASE WHEN len(based) > 0 THEN 0.5 ELSE 0.0 END) AS score FROM r LEFT JOIN per USING (doc_id)"""

LINE_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
 l AS MATERIALIZED (SELECT r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{lines.CAPITALS}', '{lines.CAPITALS.lower()}') AS k FROM (SELECT r, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d)),
 f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= {lines.THRESHOLD}),
 x AS (SELECT r, count(f.k) AS gone, string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY i) AS kept FROM l LEFT JOIN f USING (k) GROUP BY r)
SELECT doc_id, len(ls) AS n_lines, gone AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN x USING (r)"""

_SIZE = f"(len(v) // {vectors.PARTS})"
#: One round of assigning parts p to entries of a codebook c, and the next codebook.
_NEAREST = "SELECT r, p, min_by(e, (away, e)) AS e, min(away) AS away FROM (SELECT r, p, e, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) AS BIGINT) AS away FROM part JOIN {0} USING (p)) GROUP BY r, p"
_NEXT = "SELECT p, e, coalesce(z, y) AS y FROM {0} LEFT JOIN (SELECT p, e, list(z ORDER BY i) AS z FROM (SELECT p, e, i, CAST((sum(xi) - ((sum(xi) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS z FROM (SELECT p, e, unnest(x) AS xi, generate_subscripts(x, 1) AS i FROM part JOIN {1} USING (r, p)) GROUP BY p, e, i) GROUP BY p, e) USING (p, e)"
VECTOR_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({vectors.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 part AS MATERIALIZED (SELECT r, p, v[p * {_SIZE} + 1 : (p + 1) * {_SIZE}] AS x FROM kept, range({vectors.PARTS}) AS t(p)),
 c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS y FROM part WHERE r <= {vectors.ENTRIES}),
 {" ".join(f"a{n} AS MATERIALIZED ({_NEAREST.format(f'c{n}')}), c{n + 1} AS MATERIALIZED ({_NEXT.format(f'c{n}', f'a{n}')})," for n in range(vectors.ROUNDS))}
 last AS ({_NEAREST.format(f"c{vectors.ROUNDS}")}),
 codes AS MATERIALIZED (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(away) AS BIGINT) AS error FROM last GROUP BY r),
 books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{vectors.ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN codes USING (r), books"""

_GRAMS = "SELECT {1} unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM (SELECT {1} regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM {0})"
RESAMPLE_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
 df AS MATERIALIZED ({_GRAMS.format("d", "r,")}),
 bf AS MATERIALIZED ({_GRAMS.format("benchmark", "")}),
 crc AS MATERIALIZED (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS n)),
 gram AS MATERIALIZED (SELECT g, hex(encode(g)) AS h FROM (SELECT g FROM df UNION SELECT g FROM bf)),
 step(g, h, i, c) AS (SELECT g, h, 0, 4294967295 FROM gram UNION ALL SELECT g, h, i + 1, xor(c >> 8, v) FROM step JOIN crc ON n = xor(c & 255, CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT)) WHERE 2 * i < length(h)),
 bucket AS MATERIALIZED (SELECT g, xor(c, 4294967295) % {resample.BUCKETS} AS b FROM step WHERE 2 * i = length(h)),
 s AS (SELECT b, count(*) AS s FROM df JOIN bucket USING (g) GROUP BY b),
 t AS (SELECT b, count(*) AS t FROM bf JOIN bucket USING (g) GROUP BY b),
 gain AS MATERIALIZED (SELECT b, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * ((SELECT count(*) FROM df) + {resample.BUCKETS}) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * ((SELECT count(*) FROM bf) + {resample.BUCKETS}) AS DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN t USING (b)),
 w AS (SELECT r, count(*) AS k, CAST(sum(gain) AS BIGINT) AS total FROM df JOIN bucket USING (g) JOIN gain USING (b) GROUP BY r),
 x AS MATERIALIZED (SELECT doc_id, coalesce(k, 0) AS n_features, CASE WHEN k > 0 THEN CAST((total - ((total % k) + k) % k) // k AS BIGINT) ELSE 0 END AS weight, CAST('0x' || sha256('{resample.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h FROM d LEFT JOIN w USING (r)),
 y AS MATERIALIZED (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score, CASE WHEN n_features > 0 THEN (n_features + 1) // 2 ELSE 0 END AS words FROM x),
 z AS (SELECT doc_id, n_features, weight, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place, {resample.PERCENT} * count(*) OVER () // 100 AS most FROM y WHERE words >= {resample.LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM z UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM y WHERE words < {resample.LEAST_WORDS}"""

#: Hashes of the windows of 1, 2, 4 ... 128 and 200 bytes from each place on, each from two of the one before.
_DOUBLED = ", ".join(f"w{n} AS (SELECT r, i, n, hash(h, lead(h, {step}) OVER (PARTITION BY r ORDER BY i)) AS h FROM w{n // 2 if n < 200 else 128})" for n, step in [*((2 << k, 1 << k) for k in range(7)), (200, 72)])
SUFFIX_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(encode(text), ''::BLOB) AS b FROM documents),
 c AS (SELECT r, octet_length(b) AS n, regexp_extract_all(hex(b), '..') AS cs FROM d WHERE octet_length(b) >= 200),
 w1 AS (SELECT r, n, unnest(range(0, n)) AS i, hash(unnest(cs)) AS h FROM c), {_DOUBLED},
 w AS MATERIALIZED (SELECT r, i, h FROM w200 WHERE i <= n - 200),
 rep AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
 g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM rep),
 k AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM g),
 spans AS MATERIALIZED (SELECT r, s, min(i) AS a, max(i) + 200 AS e FROM k GROUP BY r, s),
 cuts AS (SELECT r, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS f, a AS t FROM spans UNION ALL SELECT r, max(e), NULL FROM spans GROUP BY r),
 kept AS (SELECT r, string_agg(hex(b)[2 * f + 1 : 2 * coalesce(t, octet_length(b))], '' ORDER BY f) AS h FROM cuts JOIN d USING (r) GROUP BY r),
 m AS (SELECT r, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(h), b)) AS kept_sha256 FROM d LEFT JOIN m USING (r) LEFT JOIN kept USING (r)"""

SQL = {
    "op10_licence_scan": LICENCE_SQL,
    "op11_line_dedup": LINE_SQL,
    "op12_vector_codes": VECTOR_SQL,
    "op13_resampling": RESAMPLE_SQL,
    "op8_secret_scan": SECRET_SQL,
    "op3_suffix_dedup": SUFFIX_SQL,
    "op5_ngram_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
 n AS MATERIALIZED (SELECT doc_id, len(sh) AS n FROM s),
 t AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
 pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
 links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * k >= 90 * (p.n + q.n - k)),
 both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, min(b) AS component_id FROM n JOIN reach ON doc_id = a GROUP BY doc_id, n""",
}


def oracle_sql() -> dict[str, str]:
    """Where SQL expresses an operator and ends in reasonable time on the driver's tables."""
    return dict(SQL)
