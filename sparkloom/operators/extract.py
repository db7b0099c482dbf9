"""From sources to nodes, import edges, components and data flows.

Specifiers come out of the text by pattern; each becomes a few ranked candidate
keys, and one equi-join of candidates with the files decides: the lowest rank
that exists wins.  All languages share that one join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import rules
from sparkloom.functions.patterns import GO_BLOCK, GO_LINE, IMPORTS
from sparkloom.functions.text import directory, language_of, loc, module_name, normalise

#: Extensions tried in turn for a script import.
SCRIPT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def nodes_of(files: DataFrame) -> DataFrame:
    """Nodes from (path, text, ord): type by path, else by content."""
    by_path = rules.classify_path(F.col("path"))
    kind = F.when(by_path == "unknown", rules.classify_content(F.col("text"))).otherwise(by_path)
    return files.select(F.col("path").alias("id"), F.col("path").alias("file_path"), module_name(F.col("path")).alias("label"), kind.alias("module_type"), loc(F.col("text")).alias("loc"), directory(F.col("path")).alias("directory"), language_of(F.col("path")).alias("language"), "ord")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _tagged(specifiers: Column, kind: str) -> Column:
    return F.transform(specifiers, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("spec")))


def specifiers(language: str, text: Column) -> Column:
    """Array of (kind, spec) of the imports in a source."""
    found = IMPORTS.get(language)
    if found is None:
        return F.array().cast("array<struct<kind:string,spec:string>>")
    parts = [_tagged(_all(text, p), kind) for kind, p in found]
    if language == "go":
        blocks = F.array_join(_all(text, GO_BLOCK), "\n")
        parts.append(_tagged(_all(blocks, GO_LINE), "go"))
    return F.array_distinct(F.concat(*parts))


@dataclass
class Aliases:
    """Path aliases of a script project: (prefix, targets) in order, and the base for bare specifiers."""

    prefixes: list[tuple[str, list[str]]]
    base: str | None = None


def _prefixes(parts: Column, separator: str) -> Column:
    """From the whole down to one part, joined."""
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def _script_keys(path: Column) -> Column:
    """(key, place) of a script: each base that a specifier can come to and that finds it, with its place in the order of trying.

    A base is tried as it is, with each extension, with that of its source for one of JavaScript, and as a folder.
    """
    less = lambda tail, put="": F.concat(F.left(path, F.length(path) - len(tail)), F.lit(put))
    tails = [(e, "") for e in SCRIPT_EXTENSIONS] + [(".ts", ".js"), (".tsx", ".js"), (".tsx", ".jsx")] + [("/index" + e, "") for e in SCRIPT_EXTENSIONS]
    keys = [F.struct(path.alias("key"), F.lit(0).alias("place"))]
    keys += [F.when(path.endswith(tail), F.struct(less(tail, put).alias("key"), F.lit(n).alias("place"))) for n, (tail, put) in enumerate(tails, 1)]
    return F.array_compact(F.array(*keys))


def candidates(kind: Column, spec: Column, path: Column, aliases: Aliases, go_module: str | None) -> Column:
    """Keys of a specifier, best first; nulls are no keys.  Those of a script are bases, which `keys_of` has for each file."""
    here = directory(path)
    bases = []
    relative = spec.startswith(".")
    bases.append(F.when(relative, normalise(F.concat(here, F.lit("/"), spec))))
    for prefix, targets in aliases.prefixes:
        rest = F.when(spec.startswith(prefix), F.substring(spec, len(prefix) + 1, 1 << 30)).when(spec == prefix[:-1], "")
        bases += [F.when(~relative, F.concat(F.lit(t), rest)) for t in targets]
    if aliases.base:
        root = "" if aliases.base == "." else aliases.base.rstrip("/") + "/"
        bases.append(F.when(~relative, F.concat(F.lit(root), spec)))
    bases.append(F.when(~relative, spec))
    script = F.array_compact(F.array(*bases))
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    package = F.split(here, "/")
    up = F.slice(package, 1, F.greatest(F.size(package) - (dots - 1), F.lit(0)))
    inner = F.array_join(F.array_compact(F.concat(F.filter(up, lambda p: p != ""), F.filter(F.split(F.regexp_replace(spec, r"^\.+", ""), r"\."), lambda p: p != ""))), ".")
    python = F.when(dots > 0, F.array(inner)).otherwise(_prefixes(F.split(spec, r"\."), "."))
    rust_up = directory(here)
    slashed = F.replace(spec, F.lit("::"), F.lit("/"))
    at = lambda folder, tail: F.concat(folder, F.lit("/"), slashed, F.lit(tail))
    crate = F.split(spec, "::")
    out = (
        F.when(kind == "script", script)
        .when(kind == "python", python)
        .when(kind == "crate", F.slice(_prefixes(crate, "::"), 1, F.greatest(F.size(crate) - 1, F.lit(0))))
        .when(kind == "mod", F.array(at(here, ".rs"), at(here, "/mod.rs")))
        .when(kind == "super", F.array(at(rust_up, ".rs"), at(rust_up, "/mod.rs")))
        .when(kind == "include", F.array(spec, normalise(F.concat(here, F.lit("/"), spec))))
        .when(kind == "ruby_relative", F.array(normalise(F.concat(here, F.lit("/"), spec, F.lit(".rb"))), F.concat(here, F.lit("/"), spec)))
    )
    if go_module is not None:
        inside = (spec == go_module) | spec.startswith(go_module + "/")
        out = out.when(kind == "go", F.array(F.when(inside, F.regexp_replace(F.substring(spec, len(go_module) + 1, 1 << 30), "^/", ""))))
    else:
        out = out.when(kind == "go", F.array().cast("array<string>"))
    return out.otherwise(F.array(F.regexp_replace(spec, r"\.$", "")))  # a wildcard names its package


#: Kinds of which a key means one file, the last (of Go the first) in order; of the others all files of a key count.
ONE_FILE = ("python", "go", "java", "crate", "php", "ruby")


def keys_of(files: DataFrame) -> DataFrame:
    """(kind, key, target, place) under which each file can be found; for most kinds one file per key, for scripts the least place is meant.

    All keys of a file come from one look at it, whatever its language.
    """
    p, text = F.col("path"), F.col("text")
    key = lambda kind, key, place=F.lit(0): F.struct(F.lit(kind).alias("kind"), key.alias("key"), place.alias("place"))
    some = lambda *keys: F.array_compact(F.array(*keys))
    named = lambda tail: F.regexp_replace(F.regexp_extract(p, "([^/]*)$", 1), tail, "")
    module = F.replace(F.regexp_replace(p, r"\.py$", ""), F.lit("/"), F.lit("."))
    package = F.regexp_extract(text, r"(?m)^package\s+([\w.]+)", 1)
    crate = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "^src/", "crate/"), r"\.rs$", ""), "/mod$", "")
    space = F.regexp_extract(text, r"namespace\s+([\w.]+)", 1)
    php = F.regexp_extract(text, r"(?m)^namespace\s+([\w\\]+)", 1)
    bare = F.regexp_replace(p, r"\.rb$", "")
    short = bare.startswith("lib/") | bare.startswith("app/")
    language = F.col("language")
    keys = (
        F.when(language.isin("javascript", "typescript"), F.transform(_script_keys(p), lambda k: key("script", k["key"], k["place"])))
        .when(language == "python", some(key("python", F.regexp_replace(module, r"\.__init__$", ""))))
        .when(language == "go", some(key("go", directory(p))))
        .when(language.isin("java", "kotlin"), some(*[F.when(package != "", key("java", k)) for k in (F.concat(package, F.lit("."), named(r"\.(java|kt|kts)$")), package)]))
        .when(language == "rust", some(key("mod", p), key("super", p), key("crate", F.replace(crate, F.lit("/"), F.lit("::")))))
        .when(language == "csharp", some(F.when(space != "", key("csharp", space))))
        .when(language == "php", some(key("include", p), *[F.when(php != "", key("php", k)) for k in (F.concat(php, F.lit("\\"), named(r"\.php$")), php)]))
        .when(language == "ruby", some(key("ruby_relative", p), key("ruby", bare), F.when(short, key("ruby", F.substring(bare, 5, 1 << 30)))))
    )
    # The outer form: of the inner one the optimiser makes a filter, which computes all keys once more.
    rows = files.select(p, text, "ord", language_of(p).alias("language")).select(p, "ord", F.explode_outer(keys).alias("k")).where("k is not null").select("k.*", p, "ord")
    kind = F.col("kind")
    each = F.when(~kind.isin(*ONE_FILE), p).alias("each")
    target = F.when(kind == "go", F.min_by("path", "ord")).when(kind.isin(*ONE_FILE), F.max_by("path", "ord")).otherwise(F.min("path"))
    return rows.groupBy("kind", "key", each).agg(target.alias("target"), F.min("place").alias("place")).select("kind", "key", "target", "place")


#: Parsers added by users: language to (extensions, function of the text Column giving (kind, spec) pairs).
PARSERS: dict[str, tuple[tuple[str, ...], Callable[[Column], Column]]] = {}


def register_parser(language: str, extensions: tuple[str, ...], specifiers_of: Callable[[Column], Column]) -> None:
    """Adds a language; its specifiers name keys of kind "script" (paths), or of any kind that `keys_of` knows."""
    PARSERS[language] = (extensions, specifiers_of)


def import_edges(files: DataFrame, aliases: Aliases | None = None, go_module: str | None = None) -> DataFrame:
    """(source, target, type): resolved imports between files (path, text, ord), each once.

    Script and Python and Go files may import themselves; others may not.
    """
    language = language_of(F.col("path"))
    text = F.col("text")
    found = F.when(language.isin("javascript", "typescript"), specifiers("javascript", text))
    for name in ("python", "go", "rust", "csharp", "php", "ruby"):
        found = found.when(language == name, specifiers(name, text))
    found = found.when(language.isin("java", "kotlin"), specifiers("java", text))
    for extensions, of in PARSERS.values():
        hit = F.lit(False)
        for e in extensions:
            hit = hit | F.lower(F.col("path")).endswith(e)
        found = F.when(hit, of(text)).otherwise(found)
    # The outer forms: of the inner ones the optimiser makes filters, which compute specifiers and keys once more.
    wanted = files.select(F.col("path").alias("source"), F.posexplode_outer(found).alias("nth", "s")).where("s is not null").select("source", "nth", "s.kind", "s.spec")
    keyed = wanted.withColumn("keys", candidates(F.col("kind"), F.col("spec"), F.col("source"), aliases or Aliases([]), go_module))
    tried = keyed.select("source", "nth", "kind", F.posexplode_outer("keys").alias("rank", "key")).where("key is not null")
    # Generated rows are estimated as if there were one for each file: never broadcast by that.
    hits = tried.hint("merge").join(keys_of(files), ["kind", "key"])
    # A namespace alone has many files, and only one candidate: there all hits stay, elsewhere that of the least rank.
    each = F.when(F.col("kind") == "csharp", F.col("target")).alias("each")
    best = hits.groupBy("source", "nth", "kind", each).agg(F.min_by("target", F.struct("rank", "place")).alias("target"))
    edges = best.where("source <> target or kind in ('script', 'python', 'go')")
    return edges.select("source", "target").distinct().withColumn("type", F.lit("import"))


HREF = r"""(?i)\bhref\s*=\s*["']([^"'#?]+)"""


def link_edges(pages: DataFrame, key: str = "url", source: str = "html") -> DataFrame:
    """(source, target) links of pages, targets on the page's host, each once."""
    host = F.regexp_extract(F.col(key), "^[a-z]+://([^/?#]+)", 1)
    links = pages.select(F.col(key).alias("source"), host.alias("host"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(source), F.lit(HREF), F.lit(1)))).alias("href"))
    target = F.when(F.col("href").rlike("^[a-z]+:"), F.col("href")).otherwise(F.concat("host", F.lit("/"), F.regexp_replace("href", "^/+", "")))
    return links.select("source", target.alias("target")).distinct()


# Components.  Tokens and the brackets and tags among them give the depth of every place in a source.  A declaration
# is what begins with a keyword at depth 0, up to the next one; what is nested in it is its own, as are its calls and tags.
_STRINGS = r"""(?s:"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`)"""
_COMMENTS = rf"({_STRINGS})|//[^\n]*|/\*[\s\S]*?\*/"
_NAME = r"[\w$]+(?:\.[\w$]+)*"
#: Strings; tags that open, close or end themselves; calls with their bracket; names with type arguments; names; marks.
TOKEN = rf"{_STRINGS}|<>|</[\w.]*\s*>|<[A-Za-z][\w.]*(?=[\s/>])(?!\s+extends\b)|/>|=>|{_NAME}\s*(?:<(?:[^<>()]++|<[^<>()]*>)*+>\s*)?\(|(?:[\w$]+\.)*[A-Z][\w$]*<[^<>(){{}};=/]*>(?=\s*[=,;)\]|&{{>:])|{_NAME}|[{{}}()\[\];=,:?>]"
_DECLARE = ("function", "const", "let", "var", "class", "interface", "type", "enum")
_MODIFY = ("export", "default", "async", "declare", "abstract")
#: After these a keyword goes on with what has begun.
_GOES_ON = (*_MODIFY, "=", "(", ",", ":", "=>", "?", "as", "typeof", "return")


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, _COMMENTS, "$1")


def declarations(sources: DataFrame) -> DataFrame:
    """(path, nth, name, kind, body) of the declarations at the top of each source (path, text), in order; kind is the keyword, `var` for further names of one."""
    from pyspark.sql import Window as W

    clean = sources.select("path", without_comments(F.col("text")).alias("text"))
    pairs = F.arrays_zip(F.split("text", TOKEN, -1).alias("gap"), F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("token"))
    rows = clean.select("path", F.posexplode(pairs).alias("at", "t")).select("path", "at", F.coalesce("t.gap", F.lit("")).alias("gap"), F.coalesce("t.token", F.lit("")).alias("token"))
    token = F.col("token")
    opens = token.rlike(r"(?:^[\w$][^\"'`]*\($)|^[{(\[]$|^<[A-Za-z>]")
    closes = token.isin(")", "}", "]", "/>") | token.startswith("</")
    by = W.partitionBy("path").orderBy("at")
    before = F.coalesce(F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = rows.select("path", "at", "gap", "token", before.alias("depth"), F.coalesce(F.lag("token").over(by), F.lit("")).alias("prev"), F.lead("token").over(by).alias("next"), F.lead("token", 2).over(by).alias("second"))
    top = F.col("depth") == 0
    last = F.last(F.when(top & token.isin(*_DECLARE), token), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    begins = top & (token.isin(*_DECLARE, "export", "import") | ((token == "async") & (F.col("next") == "function"))) & ~F.col("prev").isin(*_GOES_ON)
    further = top & (token == ",") & last.isin("const", "let", "var") & F.col("second").isin("=", ":")
    parted = placed.withColumn("begins", begins | further).withColumn("nth", F.sum(F.col("begins").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    named = ~token.isin(*_DECLARE, *_MODIFY, "import", ",")
    found = parted.groupBy("path", "nth").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat("gap", "token").alias("s")))), lambda x: x["s"]), "").alias("body"),
        F.regexp_extract(F.min_by(F.when(named, token), F.when(named, F.col("at"))), r"^([\w$]+)", 1).alias("name"),
        F.coalesce(F.min_by(F.when(token.isin(*_DECLARE), token), F.when(token.isin(*_DECLARE), F.col("at"))), F.lit("var")).alias("kind"),
    )
    return found.where("nth > 0").select("path", "nth", "name", "kind", "body")


#: Data sources: (type, name or empty for the callee itself, callee).
SOURCES = [
    ("context", "", "useContext"),
    ("local-state", "useState", "useState"),
    ("local-state", "useReducer", "useReducer"),
    ("store", "redux", "useSelector|useAppSelector"),
    ("store", "redux-dispatch", "useDispatch|useAppDispatch"),
    ("store", "", r"use\w+Store"),
    ("api", "fetch", r"fetch|axios\.get|axios\.post"),
    ("api", "", "useQuery|useSWR|useMutation"),
]


def _declarations(files: DataFrame) -> DataFrame:
    """Functions and variables with a capital name, with their source."""
    some = files.where(F.lower("path").rlike(r"\.[tj]sx$"))
    found = declarations(some).where(F.col("kind").isin("function", "const", "let", "var") & F.col("name").rlike("^[A-Z]"))
    return found.join(some.select("path", without_comments(F.col("text")).alias("text"), "ord"), "path")


def components(files: DataFrame) -> DataFrame:
    """(name, file_path, props, hooks, children, is_default_export, ord); props are (name, type, is_required)."""
    tokens = F.regexp_extract_all("body", F.lit(TOKEN), F.lit(0))
    found = _declarations(files).withColumn("tokens", tokens).where(F.exists("tokens", lambda t: t.rlike("^<[A-Za-z>]")))
    one = lambda pattern: F.array_distinct(F.transform(F.filter("tokens", lambda t: t.rlike(pattern)), lambda t: F.regexp_extract(t, pattern, 1)))
    hooks, children = one(r"^(use[A-Z][\w$.]*)[^\"'`]*\($"), one(r"^<([A-Z][\w.]*)$")
    shape = F.expr(r"regexp_extract(text, concat('(?s)(?:interface|type)\\s+', name, 'Props\\b[^{]*\\{(.*?)\\}'), 1)")
    fields = _all(shape, r"(?:^|[;,\n{])\s*(?:readonly\s+)?(\w+\??\s*:\s*[^;,\n]+)")
    props = F.transform(fields, lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("name"), F.trim(F.regexp_extract(x, r":\s*(.*)$", 1)).alias("type"), (~x.rlike(r"^\w+\?")).alias("is_required")))
    first = F.row_number().over(_by_path())
    exported = F.col("text").rlike(r"\bexport\s+default\b|\bexport\s*\{[^}]*\bas\s+default\b")
    return found.select("name", F.col("path").alias("file_path"), props.alias("props"), hooks.alias("hooks"), children.alias("children"), (exported & (first == 1)).alias("is_default_export"), "ord")


def _by_path():
    from pyspark.sql import Window as W

    return W.partitionBy("path").orderBy("nth")


def _use_of(kind: str, name: str) -> Callable[[Column], Column]:
    """What a call (its callee and first argument) says about its source."""

    def of(call: Column) -> Column:
        argument = F.regexp_replace(F.regexp_extract(call, r"\(([^(),]*)", 1), r"^\s+|\s+$", "")
        called = argument if kind == "context" else F.lit(name) if name else F.regexp_extract(call, r"^([\w.]+)", 1)
        detail = F.concat(F.substring(F.regexp_replace(call, r"\s+", " "), 1, 59), F.lit(")"))
        return F.struct(F.lit(kind).alias("type"), called.alias("name"), detail.alias("detail"))

    return of


def data_flows(files: DataFrame) -> DataFrame:
    """(component_name, file_path, type, name, detail): one row per use of a data source."""
    calls = []
    for kind, name, callee in SOURCES:
        found = _all(F.col("body"), rf"(?<![\w.])((?:{callee})\s*(?:<(?:[^<>()]++|<[^<>()]*>)*+>)?\([^(),]*)", 1)
        calls.append(F.transform(found, _use_of(kind, name)))
    given = F.regexp_extract("body", r"^[^(]*\(\s*(\{[^}]*\}|\w+\s*:\s*\w*Props)", 1)
    calls.append(F.when(given != "", F.array(F.struct(F.lit("props").alias("type"), F.lit("props").alias("name"), F.substring(given, 1, 60).alias("detail")))).otherwise(F.array().cast("array<struct<type:string,name:string,detail:string>>")))
    return _declarations(files).select(F.col("name").alias("component_name"), F.col("path").alias("file_path"), F.explode(F.concat(*calls)).alias("s")).select("component_name", "file_path", "s.*")


def render_edges(comps: DataFrame) -> DataFrame:
    """(source, target, type): a file renders the file of the first component of a child's name."""
    first = comps.groupBy("name").agg(F.min_by("file_path", "ord").alias("target"))
    uses = comps.select(F.col("file_path").alias("source"), F.explode("children").alias("name"))
    return uses.join(first, "name").where("source <> target").select("source", "target").distinct().withColumn("type", F.lit("renders"))
