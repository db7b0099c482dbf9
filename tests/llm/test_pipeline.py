"""The pipeline stage by stage on a small table."""

import ast
import re

from pyspark.sql import functions as F
from test_joins import plain_classes
from test_scans import plain_redaction, plain_spans
from test_text import brute_tiles
from test_text import plain_words as plain_tokens
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import bpe, decontaminate, ngram_join, quality, secrets


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns
        gone = {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()}
        if n == 0:
            assert gone == {r.doc_id for r in quality.classify(before).where("not keep").collect()}
        elif n == 1:
            assert gone == {r.doc_id for r in ngram_join.classify(before, width=5, percent=80).where("doc_id <> component_id").collect()}
        elif n == 2:
            assert gone == {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
        else:
            assert not gone
            texts = {r.doc_id: r.text for r in before.collect()}
            found = {r.doc_id: r.spans for r in secrets.scan(before).collect()}
            for r in after.collect():
                assert r.n_chars == len(r.text) and (r.text == texts[r.doc_id]) == (not found[r.doc_id])
                assert all(texts[r.doc_id][s.start : s.end] not in r.text for s in found[r.doc_id])
        before = after
    tokens = corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()
    assert len(tokens) == before.count() and all(len(r.ids) == r.n_tokens for r in tokens)
    assert corpus_pipeline.run(spark, sf).count() == len(tokens)


def plain_near(docs):
    """The row of the least id of each class, by comparing sets of five words."""
    keyed = [(r.doc_id, r.text) for r in docs]
    return {i for i, n, least in map(ast.literal_eval, plain_classes(keyed, 5, 80)) if n == 0 or i == least}


def plain_leaks(docs, items):
    """Documents that hold an item, by trying every pair that shares five words in a row."""
    gone = set()
    for item in items:
        words = plain_tokens(item)
        k = min(decontaminate.SEED, len(words))
        seeds = {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}
        for r in docs:
            other = plain_tokens(r.text)
            line = f" {' '.join(other)} "
            if words and any(f" {s} " in line for s in seeds) and brute_tiles(words, other, k) >= decontaminate.COVERAGE * len(words):
                gone.add(r.doc_id)
    return gone


WEAK = [
    (3, r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"),
    (4, r"""(?i)(?<![A-Za-z0-9_])(?:user(?:name)?|client_id|account|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+_.-]{3,}"""),
    (5, r"(?<![A-Za-z0-9_])(?:https?|ftp|jdbc|postgres|mysql|mongodb|redis|amqp|s3)(?::[a-z]+)?://[A-Za-z0-9.-]+(?::[0-9]{1,5})?"),
]


def plain_all_spans(text):
    """Base spans, and weak ones that a complement begins near to."""
    base = plain_spans(text)
    out = list(base)
    for kind, pattern in WEAK:
        for m in re.finditer(pattern, text):
            fits = [s for s in base if (kind == 3 and s[1] == 1) or (kind == 4 and s[1] in (0, 2)) or kind == 5]
            if any(abs(m.start() - a) <= 400 and (m.end() <= a or b <= m.start()) for a, _, b in fits):
                out.append((m.start(), kind, m.end()))
    return [(a, b) for a, _, b in out]


def test_stages_equal_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = stages[0](spark, docs, sf).cache()
    near = stages[1](spark, docs, sf).cache()
    assert sorted(r.doc_id for r in near.collect()) == sorted(plain_near(docs.collect()))
    clean = stages[2](spark, near, sf).cache()
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in near.collect()} - {r.doc_id for r in clean.collect()} == plain_leaks(near.collect(), items)
    masked = stages[3](spark, clean, sf).cache()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert {r.doc_id: r.text for r in masked.collect()} == {i: plain_redaction(t, plain_all_spans(t)) for i, t in texts.items()}
    library = Tokenizer.from_file(bpe.default_path())
    got = {r.doc_id: list(r.ids) for r in stages[4](spark, masked, sf).collect()}
    assert got == {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in masked.collect()}


def test_stages_on_awkward_tables(spark, edge):
    """Null and repeated ids, null and empty texts, repeated rows, no rows, and columns with the operators' names."""
    sf = "/root/testdata/sf0.001"
    more = {c: F.lit("x") for c in ("_c", "_key", "_row", "base", "weak", "digest", "spans", "row", "key", "label", "token", "lang")}
    docs = edge.withColumns(more).withColumn("n_chars", F.length("text").cast("long"))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), sf)
        assert empty.count() == 0
        out = stage(spark, docs, sf)
        assert n == 4 or out.columns == docs.columns == empty.columns
        rows = out.collect()
        if n == 0:
            assert all(r.text and r.text.strip() for r in rows)
        elif n == 1:
            assert sum(r.text == "same words here again" for r in rows) == 1 and sum(r.text is None or not r.text.strip() for r in rows) == 3
        else:
            assert len(rows) == docs.count()
