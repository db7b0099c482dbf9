"""Scalar functions on paths, sources and numbers, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import LANGUAGE_OF
from .rules import BRANCHES, STRIPS, java


def loc(text: Column) -> Column:
    """Lines with something other than blanks (Unicode blanks too)."""
    return F.coalesce(F.size(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"(?U)[^\s\x{FEFF}]"))), F.lit(0))


def directory(path: Column) -> Column:
    """What stands before the last slash; empty at the root."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def module_name(path: Column) -> Column:
    """The stem; of an index file its directory's name."""
    parent = basename(directory(path))
    return F.when((stem(path) == "index") & (parent != ""), parent).otherwise(stem(path))


def language_of(path: Column) -> Column:
    """Language by extension; null where there is none."""
    ext = F.lower(F.regexp_extract(basename(path), r"(\.[^.]*)$", 1))
    items = [F.lit(x) for kv in LANGUAGE_OF.items() for x in kv]
    return F.element_at(F.create_map(*items), ext)


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalise(path: Column) -> Column:
    """The path without empty and dot segments; `..` takes its parent away and stops at the root."""

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part.isin("", "."), kept).when(part == "..", up).otherwise(F.concat(kept, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def glob_to_regex(glob: str) -> str:
    """`**` is any depth, `*` any name part; the pattern is searched for anywhere in the path."""
    out = []
    for part in re.split(r"(\*\*|\*)", glob.replace("\\", "/")):
        out.append({"**": ".*", "*": "[^/]*"}.get(part) or re.sub(r"[.+^${}()|\[\]]", lambda m: "\\" + m[0], part))
    return "".join(out)


def branches(text: Column, language: Column) -> Column:
    """Number of branch points once comments and literals are stripped."""
    bare = text
    for pattern, _, put in STRIPS:
        bare = F.regexp_replace(bare, pattern, put)
    total = lambda family: sum((F.regexp_count(bare, F.lit(java(p))) for p in BRANCHES[family][1:]), F.regexp_count(bare, F.lit(java(BRANCHES[family][0]))))
    counted = F.when(language == "python", total("python")).when(language == "ruby", total("ruby")).otherwise(total("c"))
    return F.coalesce(counted, F.lit(0)).cast("long")


def branches_sql(text: str, family: str = "c") -> str:
    """`branches` of one family, for DuckDB."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    for _, re2, put in STRIPS:
        text = f"regexp_replace({text}, {q(re2)}, {q(put)}, 'g')"
    return "CAST(coalesce(" + " + ".join(f"len(regexp_extract_all({text}, {q(p)}))" for p in BRANCHES[family]) + ", 0) AS BIGINT)"


def shorten(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def redact(line: Column) -> Column:
    """The name a secret is given to, without its value."""
    name = F.regexp_extract(F.trim(line), r"""(\w+)\s*[:=]\s*["']""", 1)
    return F.when(name != "", F.concat(name, F.lit(" = [redacted]"))).otherwise("[hardcoded secret]")


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def fixed(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", x)


def identifier(text: Column) -> Column:
    """Letters, digits and underscores only, without underscores at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]", "_"), "^_+|_+$", "")


def escape_markup(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def embed_json(column: Column) -> Column:
    """JSON that can stand inside a script element."""
    return F.replace(F.to_json(column), F.lit("</"), F.lit("<\\/"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
