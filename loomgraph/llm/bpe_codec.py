"""BPE encoding and decoding with batched numpy merge rounds.

The vocabulary file (a JSON of the tokenizers library, kind word BPE) is a parameter. Words that a task has not met
yet are put into one flat array of symbols. The rank of every neighbouring pair is looked up by binary search over the
sorted pair keys. Each round takes the lowest rank of each word, merges its occurrences from left to right in all words
at once, and looks up the pairs with a new symbol; words without a mergeable pair leave the array. All occurrences of a word's lowest pair may be merged
in one round because the loader checks that a merge never makes a pair of lower rank than its own; if a vocabulary
breaks that rule, one occurrence is merged a round.

Results equal `encode(text, add_special_tokens=False)` and `decode(ids, skip_special_tokens=False)` of the library:
texts are cut at the strings of added tokens, put into NFC, lower-cased character by character, split by the pattern
below, and written as UTF-8 bytes. White space is dropped. Decoding joins the tokens' strings by one space, as a
file without a decoder asks for. Null counts as the empty text: no tokens, and the empty string decoded.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as X

#: The white space of the file's pattern, and its word pattern for given letter and number classes.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"


def _unicode_class(kind: str) -> str:
    """The code points whose category in Python's Unicode tables begins with kind, as ranges of a pattern."""
    has = np.fromiter((unicodedata.category(chr(c))[0] == kind for c in range(0x110000)), bool, 0x110000)
    edge = np.flatnonzero(np.diff(has.astype(np.int8), prepend=0, append=0))
    return "".join(rf"\U{a:08x}-\U{b - 1:08x}" for a, b in zip(edge[::2], edge[1::2], strict=True))


#: The fast pattern takes the newer Unicode tables of the regex module; a text with characters that only those know goes
#: through the pattern of Python's own tables, which are as old as the library's.
WORD = regex.compile(PATTERN.format(L=r"\p{L}", N=r"\p{N}", S=SPACE))


@functools.cache
def _settled() -> regex.Pattern:
    return regex.compile(PATTERN.format(L=_unicode_class("L"), N=_unicode_class("N"), S=SPACE))


@functools.cache
def _newer() -> frozenset[str]:
    known = regex.compile(r"[\p{L}\p{N}]")
    return frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn" and known.match(c))
#: Words kept with their ids by a task; beyond it the table starts anew, which costs time only.
CACHED_WORDS = 150_000


def byte_names() -> list[str]:
    """The printable character that stands for each byte: itself if it is visible Latin-1, else the next free one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


class WordBpe:
    """A vocabulary, and the merge rounds over it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.names = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for name, i in [*vocab.items(), *self.added.items()]:
            self.names[i] = name
        self.inner = np.array([vocab.get(c, -1) for c in byte_names()], np.int64)
        self.last = np.array([vocab.get(c + self.end, -1) for c in byte_names()], np.int64)
        self.base = np.int64(len(self.names))
        left, right, made = np.empty((3, len(model["merges"])), np.int64)
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left[i], right[i], made[i] = vocab[a], vocab[b], vocab[a + b]
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made
        newest = np.full(len(self.names), -1)
        np.maximum.at(newest, made, np.arange(len(made)))
        self.whole_rounds = bool((np.maximum(newest[left], newest[right]) < np.arange(len(made))).all())
        self.cache: dict[str, list[int]] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a large number."""
        key = a * self.base + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], np.iinfo(np.int64).max)

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word by merge rounds over one flat array of all words' symbols."""
        raw = [w.encode("utf-8") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.last[data[ends]]
        word = np.repeat(np.arange(len(words)), size)
        out: list[list[int]] = [[] for _ in words]
        none = np.iinfo(np.int64).max
        rank = np.full(len(symbols), none)
        at = np.flatnonzero(word[:-1] == word[1:])
        rank[at] = self.ranks(symbols[at], symbols[at + 1])
        while len(symbols):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(word)))
            best = np.repeat(low, counts)
            done = best == none
            if done.any():
                over = np.flatnonzero(low == none)
                for f in over.tolist():
                    lo = int(first[f])
                    out[int(word[lo])] = symbols[lo : lo + int(counts[f])].tolist()
                keep = ~done
                symbols, word, rank, best = symbols[keep], word[keep], rank[keep], best[keep]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == best)
            if self.whole_rounds:  # of touching occurrences (a a a) the first, third, ... are merged
                new = np.ones(len(hit), bool)
                new[1:] = (np.diff(hit) != 1)
                run = np.flatnonzero(new)[np.cumsum(new) - 1]
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            else:
                hit = hit[np.diff(word[hit], prepend=-1) != 0]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            merged = hit - np.arange(len(hit))  # a symbol goes behind each hit: so far the places have moved
            at = np.concatenate([merged - 1, merged])  # only pairs with a new symbol have new ranks
            at = at[(at >= 0) & (at < len(symbols) - 1)]
            within = word[at] == word[at + 1]
            rank[merged] = none  # for the last symbol of a word
            at = at[within]
            rank[at] = self.ranks(symbols[at], symbols[at + 1])
        return out

    def words(self, text: str) -> list[str]:
        """Words of a stretch of text without added tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if not _newer().isdisjoint(text):
                return _settled().findall(text.lower())
        return WORD.findall(text.lower())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as uint32 arrays."""
        split: list[list[list[str] | int]] = []
        for t in texts:
            if self.split is None or not any(a in t for a in self.added):
                split.append([self.words(t)])
            else:
                split.append([self.added[x] if x in self.added else self.words(x) for x in self.split.split(t)])
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        fresh = set().union(*(x for parts in split for x in parts if isinstance(x, list))).difference(self.cache) if split else set()
        if fresh:
            new = list(fresh)
            self.cache.update(zip(new, self.merge(new), strict=True))
        look = self.cache.__getitem__
        out = []
        for parts in split:
            ids: list[int] = []
            for x in parts:
                if isinstance(x, int):
                    ids.append(x)
                else:
                    ids.extend(chain.from_iterable(map(look, x)))
            out.append(np.array(ids, np.uint32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.names.__getitem__, ids.tolist()))


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The vocabulary at path, read once a worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _codec(path: str, keep: bool, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for part in X.pieces(batches, "text", 2 << 20):
            texts = [t or "" for t in part.column("text").to_pylist()]
            rows: list[list] = [[], [], [], [], []]
            for ids in bpe.encode(texts):
                text = bpe.decode(ids)
                data = ids.astype("<u4").tobytes()
                for out, x in zip(rows, (len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), data if keep else None, text if decoded else None), strict=True):
                    out.append(x)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
            arrays = [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)][: 3 + keep + (keep and decoded)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *arrays], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 1 + len(arrays)])

    return run


def bpe_codec(docs: DataFrame, path: str, keep: bool = True, decoded: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for every row of docs (doc_id, text).

    ids are little-endian unsigned 32-bit integers; keep=False leaves the last two columns out,
    decoded=False the last one. Repeated rows give
    repeated results, a null doc_id stays null, further columns are ignored, an empty table gives no rows.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep + ", decoded string" * (keep and decoded)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_codec(path, keep, decoded), schema)
