"""Extraction, tokens, leaks and quality."""

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import bpe, decontaminate, html_text, quality


def test_page_text():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=/a>A</a></nav>
    <div id="cookie-notice">We use cookies, a lot.</div><div class="content"><h2>Head</h2><p>First  part,
    with <b>bold</b>face &amp; more. It goes on, as articles do.<p>Second &lt;part&gt;: x < y, and so on; long enough to be prose.</div>
    <div class="sidebar"><p>Side text, with marks.</p></div><form><label>Mail</label><input></form>
    <section id="comments"><p>I say, well done. Really, well done, indeed.</p></section><footer>&copy; us</footer><script>var a="</p>";</script></body></html>"""
    assert html_text.main_text(page) == "Head First part, with boldface & more. It goes on, as articles do. Second <part>: x < y, and so on; long enough to be prose."
    for nothing in (None, "", "<html><body></body></html>", "<!-- x -->", "<script>x</script>", "   "):
        assert html_text.main_text(nothing) == ""
    assert html_text.main_text("plain text & more") == "plain text & more"


PROSE = "<p>A sentence with words, marks, and more; it goes on as prose does, for a while.</p>"


def test_names_inside_an_article_only_weigh():
    page = f"<html><body><article><h1>Title</h1>{PROSE * 4}<div class='related-work'>{PROSE}</div><p class='legal'>Some lawful sentence, with marks, as long as others are; it stays.</p><div class='related'><a>More</a></div></article></body></html>"
    text = html_text.main_text(page)
    assert text.count("A sentence") == 5 and text.endswith("it stays.")


def test_a_menu_that_does_not_say_so():
    page = f"<html><body><div class='content'><h1>Title</h1>{PROSE * 6}<ul><li><a href=/>Share this</a></li><li><a href=/>Home</a></li><li><a href=/>About</a></li></ul></div></body></html>"
    text = html_text.main_text(page)
    assert text.startswith("Title A sentence") and text.endswith("for a while.")
    assert html_text.main_text(f"<article>{PROSE * 6}<ul><li><a href=/>A source</a></li></ul></article>").endswith("A source")


@pytest.mark.parametrize("broken", ["<div>" * 20_000, "<a " * 20_000, "<span>" * 20_000 + "<p>" * 2000, "</b>" * 20_000, "<!--" * 5000, "<script </script " * 5000, "<a '" * 5000, '<a "x<b ' * 5000, "<div><b>" * 10_000 + "</i></div>" * 10_000])
def test_broken_pages_take_time_in_proportion(broken):
    import time

    began = time.process_time()
    html_text.main_text(f"<article>{PROSE}</article>{broken}")
    assert time.process_time() - began < 2
    assert html_text.main_text(f"{'<div>' * 5000}{PROSE}{'</div>' * 5000}").startswith("A sentence")


def test_pages_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = html_text.extract(df).collect()
    sources = {r.page_id: r.html for r in df.collect()}
    assert len(rows) == len(sources)
    for r in rows:
        body = sources[r.page_id].split("<article>")[1].split("</article>")[0]
        plain = " ".join(html_text.html.unescape(html_text.re.sub(r"<[^>]+>", " ", html_text.re.sub(r"</?b>", "", body))).split())
        assert r.text == plain and r.n_chars == len(plain)
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_bpe_equals_the_library(spark, documents, edge, library):
    df = documents.select("doc_id", "text").unionByName(edge.select("doc_id", "text"))
    got = bpe.encode_table(df).collect()
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append(str((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())))
    assert sorted(str(tuple(r)) for r in got) == sorted(want)
    assert bpe.encode_table(edge.limit(0)).count() == 0


def test_bpe_on_random_texts(library):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    vocabulary = bpe.vocabulary(bpe.read_file(bpe.default_path()))
    pieces = st.lists(st.sampled_from(["the", " ", "\n", "  ", "ing", "é", "漢", "🎉", "1", "'s", "<|endoftext|>", ".", "Ab", "\t", "aaaa", "zq"]), max_size=30).map("".join)

    @settings(max_examples=300, deadline=None)
    @given(st.one_of(pieces, st.text(max_size=30)))
    def check(text):
        ids = np.frombuffer(vocabulary.encode(text), "<u4")
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert vocabulary.decode(ids).tobytes().decode() == text

    check()


def brute_tiles(item, text, least):
    """Greedy tiling by trying every pair of places, longest first."""
    item, text, total = list(item), list(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] is not None and item[i + k] == text[j + k]:
                    k += 1
                best = max(best, (k, -i, -j))
        if best[0] < least:
            return total
        k, i, j = best[0], -best[1], -best[2]
        item[i : i + k], text[j : j + k] = [None] * k, [-1] * k
        total += k


def test_tiles_cover_as_much_as_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item = rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64)
        text = rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64)
        got = decontaminate.tiles(item, text, 2)
        assert sum(t[2] for t in got) == brute_tiles(item.tolist(), text.tolist(), 2)


def plain_words(text):
    return [w for w in re.split(r"[^0-9a-z\x80-\U0010FFFF]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def test_leaks_equal_brute_force(spark):
    """All pairs of texts and items, tiled by trying every pair of places; items of every length, many with one beginning."""
    import random

    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(25)]
    stock = "which of the following is"
    items = [" ".join(rnd.choices(vocabulary, k=n)) for n in (1, 2, 3, 4, 5, 6, 9, 14, 20, 30)] + [f"{stock} " + " ".join(rnd.choices(vocabulary, k=rnd.randrange(12))) for _ in range(25)] + [None, "", "!?"]
    texts = [None, "", "..."]
    for _ in range(60):
        parts = []
        for item in rnd.sample(items[:-3], 3):
            w = item.split()
            a = rnd.randrange(len(w))
            parts += [*w[a:], *rnd.choices(vocabulary, k=rnd.randrange(4)), *(w[:a] if rnd.random() < 0.7 else [])]
        texts.append(rnd.choice([" ", ", ", "\n"]).join(parts).title() if rnd.random() < 0.2 else " ".join(parts))
    want = []
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            words = plain_words(item)
            if words and brute_tiles(words, plain_words(text), min(decontaminate.SEED, len(words))) >= decontaminate.COVERAGE * len(words):
                want.append((d, i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in enumerate(texts)], "doc_id long, text string, item_id string, k string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == sorted(want) and len(want) > 30
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_items_of_one_beginning_cost_little():
    import time

    items = decontaminate.Items(list(range(2000)), [f"which of the following is the q{i} a{i} b{i} c{i} d{i}" for i in range(2000)])
    part = pa.RecordBatch.from_pydict({"t": pa.array([" ".join(["which of the following is the word"] * 2000 + [f"x{i}" for i in range(100_000)])])})
    began = time.process_time()
    assert decontaminate.leaks(part, 0, items) == [] and time.process_time() - began < 3


def test_reordered_and_clean_passages(spark):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "two words"), (3, None), (None, "a b c d e f g")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x y " + " ".join(words[20:]) + " ... z, " + " ".join(words[:20]).upper()), (2, " ".join(words[:25])), (3, None), (4, "says Two, WORDS only"), (5, "a b c d e f g"), (5, "a b c d e f g")],
        "doc_id long, text string",
    )
    rows = sorted((r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in decontaminate.contaminated(docs, bench).collect() if r.doc_id != 5)
    assert rows == [(1, 1, 1.0, 2), (4, 2, 1.0, 1)]
    assert [r.doc_id for r in decontaminate.clean(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def plain_stats(text):
    """The eight statistics of a text, word by word."""
    words = re.findall(rb"[^ \t-\r]+", (text or "").encode())
    n = max(len(words), 1)
    lines = [x for x in re.split(rb"[\n\r]+", (text or "").encode()) if x]
    windows = [words[min(k, max(len(words) - 3000, 0)) :][:3000] for k in range(0, len(words), 3000)]
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    small = lambda w: sum(97 <= b < 123 or b >= 128 for b in w)
    caps = lambda w: sum(65 <= b < 91 for b in w)
    return [
        sum(any(chr(b) in "#$%&*|{}<>~^\\=_@`" for b in w) for w in words) / n,
        sum(caps(w) >= 2 and small(w) == 0 for w in words) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        np.mean([len(set(w)) / len(w) for w in windows]) if windows else 0,
        1 - len(set(lines)) / max(len(lines), 1),
        sum(b in b".!?" for w in words for b in w) / n,
        sum(small(w) + caps(w) for w in words) / max(sum(map(len, words)), 1),
        1 - len(set(triples)) / max(len(triples), 1),
    ]


def test_quality_statistics_equal_plain_ones(documents):
    texts = [r.text for r in documents.limit(60).collect()] + ["a a a b", "AB CD x!", "one\none\ntwo", "x" * 500, "#a $b c", "é漢 é漢 é漢"]
    got = quality.Slice(pa.array(texts)).stats[:8].T
    for row, text in zip(got, texts, strict=True):
        assert np.allclose(row, plain_stats(text)), text


def test_expectation_maximisation_equals_a_plain_one():
    """Row by row instead of by pattern."""
    rng = np.random.default_rng(4)
    truth = rng.random(400) < 0.7
    votes = np.where(rng.random((400, len(quality.NAMES))) < 0.5, 0, np.where(rng.random((400, len(quality.NAMES))) < 0.85, truth[:, None] + 1, 2 - truth[:, None]))
    codes = (votes * 3 ** np.arange(len(quality.NAMES))).sum(1)
    patterns, counts = np.unique(codes, return_counts=True)
    got, share, accuracy = quality.estimate(patterns, counts.astype(float))
    p = [0.05 if 1 in v else 0.95 for v in votes.tolist()]
    for _ in range(quality.ROUNDS):
        acc = []
        for k in range(len(quality.NAMES)):
            right = sum(x if v[k] == 2 else 1 - x for x, v in zip(p, votes.tolist(), strict=True) if v[k])
            acc.append(min(max((right + 2) / (sum(v[k] > 0 for v in votes.tolist()) + 3), 0.55), 0.98))
        before = sum(p) / len(p)
        p = [1 / (1 + np.exp(-sum((1 if x == 2 else -1) * np.log(a / (1 - a)) for x, a in zip(v, acc, strict=True) if x))) for v in votes.tolist()]
    assert np.allclose(got[np.searchsorted(patterns, codes)], p) and np.allclose(accuracy, acc) and abs(share - before) < 1e-9
    assert ((np.array(p) > 0.5) == truth).mean() > 0.95


def test_the_scorer_equals_a_dense_one(monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 12)
    rng = np.random.default_rng(6)
    x, y = rng.random((30, 12)) * (rng.random((30, 12)) < 0.4), rng.random(30)
    row, bucket = np.nonzero(x)
    weights, bias = quality.train(row, bucket, x[row, bucket], y)
    w, b, seen, seen_b = np.zeros(12), 0.0, np.full(12, 1e-8), 1e-8
    for _ in range(quality.STEPS):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        slope = x.T @ error / 30 + 1e-6 * w
        seen += slope**2
        w -= 0.5 * slope / np.sqrt(seen)
        seen_b += error.mean() ** 2
        b -= 0.5 * error.mean() / np.sqrt(seen_b)
    assert np.allclose(weights, w, atol=1e-4) and abs(bias - b) < 1e-6


def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs).join(labels, "doc_id").select("quality", "keep").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [not r.keep for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) >= 0.9 * len(bad)


def test_quality_edges(edge):
    rows = quality.classify(edge).collect()
    assert len(rows) == edge.count()
    assert all(not r.keep for r in rows if r.score == 0)
    kept = quality.keep(edge)
    assert kept.columns == edge.columns and kept.where("text is null or trim(text) = ''").count() == 0
    assert quality.classify(edge.limit(0)).count() == 0
