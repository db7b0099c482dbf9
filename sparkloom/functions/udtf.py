"""Imports of a source as a table function, for SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sparkloom.functions.patterns import GO_BLOCK, GO_LINE, IMPORTS


def specifiers(text: str | None, language: str | None) -> Iterator[tuple[str, str]]:
    """(kind, spec) of the imports in a source, each once, in the order of the patterns."""
    found: dict[tuple[str, str], None] = {}
    for kind, pattern in IMPORTS.get(language or "", ()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            found[kind, m[1]] = None
    if language == "go":
        for block in re.findall(GO_BLOCK, text or ""):
            for spec in re.findall(GO_LINE, block):
                found["go", spec] = None
    yield from found


@udtf(returnType="nth int, kind string, spec string")
class ImportEdges:
    """`import_edges(text, language)`: a row for each import, to be used with a lateral join."""

    def eval(self, text: str, language: str) -> Iterator[tuple[int, str, str]]:
        for nth, (kind, spec) in enumerate(specifiers(text, language)):
            yield nth, kind, spec


def register(spark: SparkSession) -> None:
    """Makes `import_edges` known to the session's SQL."""
    spark.udtf.register("import_edges", ImportEdges)
