"""Byte-level BPE by backtracking over longest matches, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives, for each place of a word,
the longest token that starts there.  The encoder goes from left to right with
it; two neighbours are accepted only if the pair table says that merging in rank
order could have left them side by side; otherwise it goes on to the next
shorter prefix token, or back by one token and marks the place as unreachable.
Each place is given up at most once, so the work is linear in the word, and the
ids are those of rank-order merging.

Texts are cut into words as the byte-level scheme does it; a text without two
blanks in a row is cut at single blanks first, whose pieces do not depend on
what stands beside them and are kept in a bounded cache.

Edge cases: a null text is an empty one and has no tokens; the vocabulary's
special tokens in a text become their single ids; repeated rows give equal rows;
columns other than key and text are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts
from .textbatch import HELD, give_back, slices

#: Entries of the two halves of the cache of encoded pieces, in each Python worker.
CACHE = 300_000
#: How the byte-level scheme cuts a text into words; a fixed value of the vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary (the bytes of its file) with its matcher, pair table and offset table."""

    def __init__(self, data: bytes):
        import ahocorasick
        import regex

        spec = json.loads(data)
        letters = byte_letters()
        ids: dict[str, int] = spec["model"]["vocab"]
        tokens = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.words = regex.compile(WORDS)
        self.double = regex.compile(r"\s\s")
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = max([*tokens, *self.special.values()]) + 1
        whole = [tokens.get(i, b"") for i in range(size)]
        for text, i in self.special.items():
            whole[i] = text.encode()
        self.length = np.array([len(t) for t in whole], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.blob = np.frombuffer(b"".join(whole), np.uint8)
        self.sizes = self.length.tolist()
        self.rank = [0] * size  # merge order; single bytes come first
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            pair, made = (ids[left], ids[right]), ids[left + right]
            self.merged[pair], self.parts[made], self.rank[made] = made, pair, r + 1
        by_bytes = {t: i for i, t in tokens.items()}
        self.shorter = [next((by_bytes[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_bytes), -1) for t in whole]
        self.matcher = ahocorasick.Automaton()
        for i, t in tokens.items():
            self.matcher.add_word(t.decode("latin-1"), (len(t) - 1, i))
        self.matcher.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.young = _Pieces(self.encode_piece, CACHE // 2)
        self.known = _Pieces(self.encode_single, CACHE)

    def compatible(self, left: int, right: int) -> bool:
        """Whether rank-order merging can end with `left` directly before `right`.

        Undoes, latest merge first, the merges that made the two tokens' facing
        edges: the pair is impossible if at any time the two edge tokens merge
        into something earlier than the merge that is being undone.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is not None:
            return known
        rank, parts, merged = self.rank, self.parts, self.merged
        # A merge on the right side at the same rank as one across it comes later, hence the half step.
        bound = float("inf")
        while True:
            across = merged.get((left, right))
            if across is not None and rank[across] < bound:
                good = False
                break
            if rank[left] == 0 and rank[right] == 0:
                good = True
                break
            if rank[left] > rank[right]:
                bound, left = rank[left], parts[left][1]
            else:
                bound, right = rank[right] + 0.5, parts[right][0]
        if len(self.pairs) > 4 * CACHE:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def encode_word(self, word: bytes) -> list[int]:
        n = len(word)
        longest = [0] * n
        for end, (back, i) in self.matcher.iter(word.decode("latin-1")):
            longest[end - back] = i  # matches of one start come shortest first
        open_ = [True] * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        sizes, shorter, compatible = self.sizes, self.shorter, self.compatible
        while True:
            end = at + sizes[token]
            if open_[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                open_[at] = False
                token = out.pop()
                at -= sizes[token]

    def encode_single(self, word: str) -> bytes:
        ids = self.encode_word(word.encode())
        return pack(f"<{len(ids)}I", *ids)

    def encode_piece(self, text: str) -> bytes:
        """Ids of a text without special tokens, as little-endian 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.words.findall(text)))

    def encode_part(self, text: str) -> bytes:
        if self.double.search(text):
            return self.encode_piece(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        head = self.young[first] if first else b""
        return head + b"".join(map(self.young.__getitem__, [p if p[:1] == "\n" else f" {p}" for p in rest]))

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return self.encode_part(text) if text else b""
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self.encode_part(text[at : m.start()]) if m.start() > at else b"", self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self.encode_part(text[at:]) if at < len(text) else b""])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the ids: a gather over the offset table."""
        n = self.length[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return np.empty(0, np.uint8)
        return self.blob[np.repeat(self.offset[ids] - ends + n, n) + np.arange(ends[-1])]


class _Pieces(dict):
    """A cache that fills itself; the older half goes when the younger is full."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(data: bytes) -> Vocabulary:
    """The vocabulary of a file's bytes, once per Python worker."""
    name = hashlib.sha256(data).hexdigest()
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Vocabulary(data)
    HELD["bpe"] = _LOADED.clear
    return _LOADED[name]


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


SCHEMA = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_table(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per row: key, number of tokens, digests of the ids and of the decoded text, and the ids themselves if asked for."""
    # The driver reads the file, a few MB whatever the data; executors need not have it.
    sent = df.sparkSession.sparkContext.broadcast(read_file(path or default_path()))
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(sent.value)
        for batch in batches:
            for part in slices(batch, "t", owner="bpe"):
                coded = [vocab.encode(t or "") for t in part.column(1).to_pylist()]
                ids = np.frombuffer(b"".join(coded), "<u4")
                ends = np.cumsum([len(c) // 4 for c in coded])
                data = vocab.decode(ids)
                at = np.concatenate([[0], np.cumsum(vocab.length[ids])]).astype(np.int64)
                bounds = at[np.concatenate([[0], ends])].tolist()
                decoded = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                out = [part.column(0), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in coded]), pa.array([hashlib.sha256(d if _valid(d) else d.decode("utf-8", "replace").encode()).hexdigest() for d in decoded])]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in schema.split(", ")])
            give_back()

    return texts(df).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, schema)


def _valid(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True
