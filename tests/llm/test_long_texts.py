"""Texts longer than the given tables have in numbers: what is found in a short one is found in a long one."""

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import html_text, quality


def salad(words, length):
    rng = np.random.default_rng(length)
    return " ".join(f"w{i}" for i in rng.integers(0, words, length))


@pytest.mark.parametrize("words", [60, 750])
def test_poor_texts_are_poor_at_any_length(words):
    texts = [salad(words, n) for n in (2900, 3000, 3001, 3100, 9000, 20_000)]
    votes = quality.digits(quality.Slice(pa.array([None, *texts, "", salad(10_000, 4000)])).votes())
    assert votes[:, quality.NAMES.index("poor")].tolist() == [0, 1, 1, 1, 1, 1, 1, 0, 0]


def test_variety_is_the_mean_over_windows_of_the_whole_text():
    texts = [salad(500, n) for n in (1, 50, 3000, 3001, 6500)]

    def plain(t):
        w = t.split()
        starts = [min(k, max(len(w) - quality.WINDOW, 0)) for k in range(0, len(w), quality.WINDOW)]
        return np.mean([len(set(w[k : k + quality.WINDOW])) / len(w[k : k + quality.WINDOW]) for k in starts])

    assert np.allclose(quality.Slice(pa.array(texts)).stats[3], [plain(t) for t in texts])


PROSE = "<p>A sentence with words, marks, and more; it goes on as prose does.</p>"


@pytest.mark.parametrize("n", [3, 1000])
@pytest.mark.parametrize(
    "before, after, kept",
    [
        ("<article><h1>The title</h1><div>A lead</div><div>", "</div></article>", "The title A lead"),
        ("<main><h1>The title</h1><article><div>", "</div></article></main>", "The title"),
        ("<div><div><h2>The title</h2><p>A lead, it leads.</p></div><div><div>", "</div></div></div>", "The title A lead, it leads."),
        ("<div><h1>The title</h1><div>A lead without an element of its own, as it is.</div><div>", "</div></div>", "The title A lead without an element of its own, as it is."),
    ],
)
def test_heads_of_long_pages_stay(n, before, after, kept):
    page = f"<html><body><nav><a>Menu</a></nav>{before}{PROSE * n}{after}<footer>us</footer></body></html>"
    text = html_text.main_text(page)
    assert text.startswith(f"{kept} A sentence") and text.count("A sentence") == n and text.endswith("as prose does.")


@pytest.mark.parametrize("beside", ["<div><a>One link</a> <a>another link, of many words</a></div>", "<article><h3>Other story</h3><p>Its teaser, it teases.</p></article>"])
def test_links_and_other_articles_beside_long_pages_go(beside):
    alone = html_text.main_text(f"<article>{PROSE * 1000}</article>")
    assert html_text.main_text(f"<html><body><article>{PROSE * 1000}</article>{beside}</body></html>") == alone
