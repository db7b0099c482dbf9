"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are found by pattern.  Spark returns matched strings but not their
places, so places come from splitting the text at the same pattern: the pieces
between the matches and the matches alternate, and running sums of their lengths
are the code point offsets.  Only texts that pass cheap substring tests are
matched at all.

Linking: strong parts are access identifiers, base secrets (assign, hex) and
service endpoints (URLs with a host).  Weak parts would be noise by themselves:
strings of 40 base64 letters (`key40`), identifiers given by a field name
(`ident`) and endpoints (`endpoint`).  Parts stand in scopes of SCOPE code
points.  A weak part is reported only if a complementary part stands within a
scope of it: key40 needs an access identifier; ident needs a secret; endpoint
needs an access identifier or secret.  The join is an equi-join on (row, bin of
SCOPE width) after putting each weak part in its own and the neighbouring bins,
with the distance as residual, so a row of the result costs a bounded number of
comparisons and a hot row spreads over its bins.

Edge cases: a null or empty text has no spans; equal rows get equal results;
null keys are a key; overlapping spans of different kinds are all kept;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, settle

#: Code points around a weak part in which its complement must begin.
SCOPE = 400
# The base kinds in the order of the contract.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
BASE = {"assign": 0, "access": 1, "hex": 2}
#: The weak kinds, after the base kinds.
KEY40 = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
IDENT = r"""(?<![A-Za-z0-9_])(?:user(?:name)?|client_id|account|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+_.-]{3,}"""
ENDPOINT = r"(?<![A-Za-z0-9_])(?:https?|ftp|jdbc|postgres|mysql|mongodb|redis|amqp|s3)(?::[a-z]+)?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?"
KINDS = ("assign", "access", "hex", "key40", "ident", "endpoint")
#: Matches handled together.
CHUNK = 100
SPAN = "array<struct<start:bigint,kind:int,end:bigint,text:string>>"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chunks(items: Column) -> Column:
    """Numbers of the chunks of CHUNK items."""
    last = ((F.size(items) - 1) / CHUNK).cast("int")
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _chunk(items: Column, number: Column) -> Column:
    return F.slice(items, number * CHUNK + 1, CHUNK)


def running(items: Column, made: str, step) -> Column:
    """What `step` makes of each item and the number that it passes on, starting from 0.

    step(at, item) -> (at of the next item, what is made); made: its type.  An
    array cannot grow in place, so the results are gathered by chunks: the work is
    the items' number times CHUNK, not its square.
    """

    def add(state, item):
        at, out = step(state["at"], item)
        return F.struct(at.alias("at"), F.concat(state["out"], F.array(out)).alias("out"))

    def whole(xs):
        def chunk(state, number):
            part = F.aggregate(_chunk(xs, number), F.struct(state["at"].alias("at"), F.array().cast(f"array<{made}>").alias("out")), add)
            return _let(part, lambda p: F.struct(p["at"].alias("at"), F.concat(state["out"], F.array(p["out"])).alias("out")))

        empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<array<{made}>>").alias("out"))
        return F.aggregate(_chunks(xs), empty, chunk, lambda state: F.flatten(state["out"]))

    return _let(items, whole)


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches, with code point offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    steps = F.zip_with(found, pieces, lambda m, p: F.struct(m.alias("m"), F.coalesce(F.length(p), F.lit(0)).cast("bigint").alias("gap")))

    def place(at, step):
        start = at + step["gap"]
        end = start + F.length(step["m"])
        return end, F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), step["m"].alias("text"))

    return running(F.filter(steps, lambda s: s["m"].isNotNull()), SPAN[6:-1], place)


def base_spans(text: Column, low: Column) -> Column:
    """Spans of the base kinds by start, then kind; `low` is the text in small letters."""
    none = F.array().cast(SPAN)
    keyed = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    assign = F.filter(spans_of(text, ASSIGN, 0), lambda s: F.length(F.regexp_replace(s["text"], ASSIGN_HEAD, "")) >= 8)
    access = F.filter(spans_of(text, ACCESS, 1), lambda s: F.length(s["text"]) >= 16)
    return F.array_sort(F.concat(F.when(keyed, assign).otherwise(none), F.when(text.contains("AKIA"), access).otherwise(none), F.when(text.rlike(HEX), spans_of(text, HEX, 2)).otherwise(none)))


def weak_spans(text: Column, low: Column) -> Column:
    """Spans of the weak kinds; the endpoints are also complements."""
    none = F.array().cast(SPAN)
    return F.concat(
        F.when(text.rlike("[A-Za-z0-9+/]{40}"), spans_of(text, KEY40, 3)).otherwise(none),
        F.when(low.contains("user") | low.contains("client_id") | low.contains("account") | low.contains("login"), spans_of(text, "(?i)" + IDENT, 4)).otherwise(none),
        F.when(text.contains("://"), spans_of(text, ENDPOINT, 5)).otherwise(none),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def link(parts: DataFrame) -> DataFrame:
    """From (key, digest, base, weak) per row to (key, digest, linked): weak spans with a complement in scope.

    Rows that are equal in key and digest are one row here.
    """
    row = ["key", "digest"]
    some = parts.where((F.size("weak") > 0) & (F.size("base") > 0)).select(*row, "base", "weak").dropDuplicates(row)
    strong = some.select(*row, F.explode("base").alias("s")).select(*row, "s.*").drop("text").withColumn("bin", F.floor(F.col("start") / SCOPE))
    weak = some.select(*row, F.explode("weak").alias("s")).select(*row, "s.*").drop("text")
    bins = F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: d + F.floor(F.col("start") / SCOPE)))
    weak = weak.withColumn("bin", bins)
    w, s = weak.alias("w"), strong.alias("s")
    near = F.col("w.key").eqNullSafe(F.col("s.key")) & (F.col("w.digest") == F.col("s.digest")) & (F.col("w.bin") == F.col("s.bin")) & (F.abs(F.col("w.start") - F.col("s.start")) <= SCOPE)
    apart = (F.col("w.end") <= F.col("s.start")) | (F.col("s.end") <= F.col("w.start"))
    fits = ((F.col("w.kind") == 3) & (F.col("s.kind") == 1)) | ((F.col("w.kind") == 4) & F.col("s.kind").isin(0, 2)) | (F.col("w.kind") == 5)
    kept = w.join(s, near & apart & fits, "left_semi").drop("bin").distinct()
    return kept.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))


SHORT = "array<struct<start:bigint,kind:int,end:bigint>>"


def _found(df: DataFrame, key: str, text: str) -> DataFrame:
    """row (all columns of df), key, t, base, weak and, where a link is possible, a digest of the text."""
    found = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = found.withColumn("base", base_spans(F.col("t"), F.lower("t"))).withColumn("weak", weak_spans(F.col("t"), F.lower("t")))
    return found.withColumn("digest", F.when((F.size("weak") > 0) & (F.size("base") > 0), F.sha2("t", 256)))


def _plain() -> Column:
    return F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).cast(SHORT)


def _spanned(found: DataFrame, parts: DataFrame) -> DataFrame:
    """found with base and spans, from the parts (key, digest, base, weak)."""
    linked = link(parts).withColumnsRenamed({"key": "_key", "digest": "_digest"})
    # Nearly all rows have no digest and find no partner; AQE splits a heavy key of the left side.
    joined = found.join(linked, F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest")), "left")
    out = joined.withColumn("spans", F.array_sort(F.concat(_plain(), F.coalesce(F.col("linked"), F.array().cast(SHORT)))))
    return out.withColumn("base", _plain()).drop("weak", "digest", "_key", "_digest", "linked")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base (array of spans) and spans (base and linked ones by start, then kind)."""
    found = settle(_found(df, key, text).select("key", "base", "weak", "digest"), df.count(), wide=True)
    return _spanned(found, found).withColumnsRenamed({"key": "doc_id"})


def _with_spans(df: DataFrame, key: str, text: str) -> DataFrame:
    """row, base and spans of all rows.  Only texts that may hold a link are shuffled; the others pass by, at the price of matching twice."""
    found = _found(df, key, text).drop("t")
    some = found.where("digest is not null")
    rest = found.where("digest is null").withColumn("base", _plain()).select("row", "base", F.col("base").alias("spans"))
    return rest.unionByName(_spanned(some, some.select("key", "digest", "base", "weak")).select("row", "base", "spans"))


def with_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of df and the columns `base` and `spans`, with underscores behind them where df has such columns."""
    return _with_spans(df, key, text).select("row.*", F.col("base").alias(fresh(df, "base")), F.col("spans").alias(fresh(df, "spans")))


def redacted(df: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """df with the secrets masked in its texts, and the new number of code points in the column `length` where a text changed."""
    old, spans = F.col("row").getField(text), F.col("spans")
    new = {text: redact(old, spans)}
    found = _with_spans(df, key, text).withColumn("text", new[text])
    cols = {text: F.col("text")} | ({} if length is None else {length: F.when(F.size("spans") > 0, F.length("text").cast(df.schema[length].dataType)).otherwise(F.col("row").getField(length))})
    return found.select(*[cols.get(c, F.col("row").getField(c)).alias(c) for c in df.columns])


def report(found: DataFrame) -> DataFrame:
    """The digest columns of `scan`."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with each run of overlapping spans (sorted by start) replaced by the mask.

    A cut into a string walks through it from the front, so the text is cut into
    chunks of gaps first and those into gaps.
    """

    def gap(at, s):
        return F.greatest(at, s["end"]), F.struct(at.alias("from"), s["start"].alias("to"))

    def cut(t, start, end):
        return F.substr(t, (start + 1).cast("int"), (end - start).cast("int"))

    def joined(gaps):
        def part(number):
            def inside(some):
                first, last = F.element_at(some, 1)["from"], F.array_max(F.transform(some, lambda g: F.greatest(g["from"], g["to"])))
                return _let(F.struct(cut(text, first, last).alias("t"), first.alias("at")), lambda c: F.array_join(F.transform(some, lambda g: F.when(g["to"] >= g["from"], F.concat(cut(c["t"], g["from"] - c["at"], g["to"] - c["at"]), F.lit(mask))).otherwise(F.lit(""))), ""))

            return _let(_chunk(gaps, number), inside)

        return F.array_join(F.transform(_chunks(gaps), part), "")

    rest = cut(text, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(_let(running(spans, "struct<from:bigint,to:bigint>", gap), joined), rest))
