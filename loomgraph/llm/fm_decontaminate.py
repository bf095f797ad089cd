"""Benchmark decontamination with an FM-index per training shard.

A shard is a stretch of documents of one task. Its text is the sequence of its words over the alphabet of the benchmark:
a word of no phrase is a break, and stretches between breaks that are shorter than the shortest phrase cannot hold one
and are left out. Over that sequence the shard builds a suffix array, the Burrows-Wheeler transform in a wavelet matrix,
and suffix positions sampled by text position. All phrases go through backward search at once, one word a step; their
occurrences are located by walking to the next sampled position; covered words are merged into removal spans.

A phrase (window) is `window` consecutive words of an item; an item of fewer words, but not none, is one phrase.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from . import shared
from . import textnp as X

U64 = np.uint64
SAMPLE = 16
SHARD_SYMBOLS = 2_000_000
SHARD_BYTES = 16 << 20


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.packbits(np.concatenate([bits, np.zeros(-n % 64 + 64, bool)]), bitorder="little").view("<u8")
        self.words = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int64)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((U64(1) << (i & 63).astype(U64)) - U64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(U64)) & U64(1) == 1


class Wavelet:
    """A wavelet matrix over symbols 0 .. 2**levels - 1."""

    def __init__(self, seq: np.ndarray, levels: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for b in range(levels - 1, -1, -1):
            bit = (seq >> b) & 1 == 1
            zeros = int(len(seq) - bit.sum())
            self.levels.append((b, Bits(bit), zeros))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i, for arrays of both."""
        lo, hi = np.zeros_like(i), i
        for b, bits, zeros in self.levels:
            one = (c >> b) & 1 == 1
            a, z = bits.rank(lo), bits.rank(hi)
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + z, hi - z)
        return hi - lo

    def get(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before it."""
        c, lo = np.zeros_like(i), np.zeros_like(i)
        for b, bits, zeros in self.levels:
            one = bits.get(i)
            a, z = bits.rank(lo), bits.rank(i)
            lo, i = np.where(one, zeros + a, lo - a), np.where(one, zeros + z, i - z)
            c |= one.astype(c.dtype) << b
        return c, i - lo


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order of an integer sequence by prefix doubling; a suffix that ends comes first."""
    n = len(seq)
    _, rank = np.unique(seq, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    k = 1
    while True:
        key = rank * (n + 2)
        key[: max(n - k, 0)] += rank[k:]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(n, np.int64)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if n == 0 or rank[order[-1]] == n:
            return order
        k *= 2


class FmIndex:
    """Counts and positions of phrases in an integer sequence (symbols from 1; 0 ends it)."""

    def __init__(self, seq: np.ndarray, symbols: int) -> None:
        text = np.append(seq, 0).astype(np.int64)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n = len(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))]).astype(np.int64)
        self.wavelet = Wavelet(bwt, max(1, int(symbols).bit_length()))
        sampled = sa % SAMPLE == 0
        self.sampled, self.at = Bits(sampled), sa[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row ranges [lo, hi) of phrases of one length, by backward search; empty where there is none."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.first[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.first[c] + self.wavelet.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, walking back to sampled positions."""
        out, live, rows = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.copy()
        steps = 0
        while len(live):
            hit = self.sampled.get(rows)
            out[live[hit]] = self.at[self.sampled.rank(rows[hit])] + steps
            live, rows = live[~hit], rows[~hit]
            c, before = self.wavelet.get(rows)
            rows = self.first[c] + before
            steps += 1
        return out


class Phrases:
    """The benchmark: its vocabulary by word hash, and its distinct windows by length with the items that have them.

    Windows are kept as places in the sequence of the benchmark's words, and their items as one sorted array with
    offsets: some 40 bytes a word, whatever the benchmark repeats.
    """

    def __init__(self, ids: list, texts: list[str], window: int) -> None:
        buf, off = X.text_buffer(pa.array(texts, pa.string()))
        buf = X.lower_ascii(buf)
        starts, ends, at = X.word_spans(buf, off, X.ALNUM)
        hashes = X.span_hashes(buf, starts, ends)
        self.vocab, word = np.unique(hashes, return_inverse=True)
        self.word = word.astype(np.int64) + 2  # 0 ends the sequence, 1 is a break
        names: dict[str, int] = {}
        item = np.array([names.setdefault(str(i), len(names)) for i in ids], np.int64)
        self.items = list(names)
        words = np.diff(at)
        length = np.minimum(words, window)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(length[length > 0]).tolist():
            rows = np.flatnonzero(length == k)
            count = words[rows] - k + 1
            place, owner = X.ranges(at[:-1][rows], count), np.repeat(item[rows], count)
            key = np.zeros(len(place), np.int64)
            for j in range(k):  # names of growing prefixes: equal names, equal windows
                key = np.unique(key * (len(self.vocab) + 2) + self.word[place + j], return_inverse=True)[1].astype(np.int64)
            order = np.lexsort((owner, key))
            key, owner, place = key[order], owner[order], place[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            key, owner, place = key[new], owner[new], place[new]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            self.windows[k] = place[first], owner, np.append(first, len(key))
        self.least = min(self.windows, default=0)
        bits = max(12, int(len(self.vocab)).bit_length() + 5)
        self.tables, left, shift = [], np.arange(len(self.vocab)), 64 - bits
        while len(left):  # open slots by some bits of the hash; words that meet in one go to the next table
            slot = ((self.vocab[left] << U64(7 * len(self.tables) % 40)) >> U64(shift)).astype(np.int64)
            table = np.full(1 << bits, -1, np.int32)
            table[slot[::-1]] = left[::-1]
            self.tables.append((U64(7 * len(self.tables) % 40), U64(shift), table))
            left = left[table[slot] != left]

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's symbol, 1 for words of no phrase."""
        out = np.ones(len(hashes), np.int64)
        for over, shift, table in self.tables:
            at = table[((hashes << over) >> shift).astype(np.int64)]
            hit = np.flatnonzero(at >= 0)
            hit = hit[self.vocab[at[hit]] == hashes[hit]]
            out[hit] = at[hit] + 2
        return out


def stretches(symbols: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of at least `least` benchmark words inside each document."""
    known = symbols > 1
    first = known.copy()
    first[1:] &= ~known[:-1]
    last = known.copy()
    last[:-1] &= ~known[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(symbols))]
    first[edge], last[edge - 1] = known[edge], known[edge - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    keep = e - s >= least
    return s[keep], (e - s)[keep]


class Shard:
    """Documents of one index, until it is built."""

    def __init__(self, most_phrases: int = 1 << 20) -> None:
        self.most_phrases = most_phrases
        self.parts: list[pa.RecordBatch] = []
        self.counts, self.seq, self.doc, self.nth, self.begin, self.end = [], [], [], [], [], []
        self.docs = self.symbols = self.bytes = 0

    def add(self, part: pa.RecordBatch, phrases: Phrases) -> None:
        buf, off = X.text_buffer(part.column("text"))
        buf = X.lower_ascii(buf)
        starts, ends, at = X.word_spans(buf, off, X.ALNUM)
        self.parts.append(part)
        self.counts.append(np.diff(at))
        if phrases.least:
            sym = phrases.symbols(X.span_hashes(buf, starts, ends))
            s, n = stretches(sym, at, phrases.least)
            pick = X.ranges(s, n)
            doc = np.searchsorted(at, pick, side="right") - 1
            gaps = np.cumsum(n) + np.arange(len(n))
            seq = np.ones(len(pick) + len(n), np.int64)
            real = np.ones(len(seq), bool)
            real[gaps] = False
            seq[real] = sym[pick]
            for out, x in ((self.doc, doc + self.docs), (self.nth, pick - at[doc]), (self.begin, starts[pick] - off[doc]), (self.end, ends[pick] - off[doc])):
                full = np.full(len(seq), -1, np.int64)
                full[real] = x
                out.append(full)
            self.seq.append(seq)
            self.symbols += len(seq)
        self.docs += len(part)
        self.bytes += int(off[-1])

    def hits(self, phrases: Phrases) -> tuple[list[list[dict]], list[list[str]]]:
        """Each document's maximal runs of hit words (numbers and byte ranges), and the items that occur in it."""
        runs: list[list[dict]] = [[] for _ in range(self.docs)]
        items: list[list[str]] = [[] for _ in range(self.docs)]
        if not self.symbols:
            return runs, items
        seq, doc, nth, begin, end = (np.concatenate(x) for x in (self.seq, self.doc, self.nth, self.begin, self.end))
        index = FmIndex(seq, len(phrases.vocab) + 1)
        cover = np.zeros(len(seq) + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for k, (places, owners, at_owner) in phrases.windows.items():
            for base in range(0, len(places), self.most_phrases):
                lo, hi = index.search(phrases.word[places[base : base + self.most_phrases, None] + np.arange(k)])
                some = np.flatnonzero(hi > lo)
                times = (hi - lo)[some]
                at = index.locate(X.ranges(lo[some], times))
                np.add.at(cover, at, 1)
                np.add.at(cover, at + k, -1)
                met = np.unique(np.stack([np.repeat(base + some, times), doc[at]], 1), axis=0)
                n = at_owner[met[:, 0] + 1] - at_owner[met[:, 0]]
                pairs.append(np.unique(np.stack([np.repeat(met[:, 1], n), owners[X.ranges(at_owner[met[:, 0]], n)]], 1), axis=0))
        for d, i in np.unique(np.concatenate(pairs), axis=0).tolist():
            items[d].append(phrases.items[i])
        hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (doc[hit[1:]] != doc[hit[:-1]])
        first, last = hit[new], hit[np.append(new[1:], True)[: len(hit)]]
        for d, *x in zip(*(y.tolist() for y in (doc[first], nth[first], nth[last] + 1, begin[first], end[last])), strict=True):
            runs[d].append(dict(zip(("first", "last", "begin", "end"), x, strict=True)))
        return runs, items


def merged(runs: list[dict]) -> list[dict]:
    """Runs of hit words that touch or overlap as one."""
    out: list[dict] = []
    for x in sorted(runs, key=lambda x: (x["first"], -x["last"])):
        if out and x["first"] <= out[-1]["last"]:
            if x["last"] > out[-1]["last"]:
                out[-1] |= {"last": x["last"], "end": x["end"]}
        else:
            out.append(dict(x))
    return out


def without(text: str | None, spans: list[dict]) -> str | None:
    """A text with byte spans cut out."""
    if not spans:
        return text
    data, kept, last = text.encode(), [], 0
    for x in spans:
        kept.append(data[last : x["begin"]])
        last = x["end"]
    return b"".join([*kept, data[last:]]).decode()


RUNS = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "begin", "end")]))
SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _shards(phrases, close):
    """Batches through shards: close(shard, its phrases) makes the rows of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for part in X.pieces(batches, "text", 4 << 20):
            shard.add(part, phrases.value)
            if shard.symbols >= SHARD_SYMBOLS or shard.bytes >= SHARD_BYTES:
                yield close(shard, phrases.value)
                shard = Shard()
        if shard.docs:
            yield close(shard, phrases.value)

    return run


def _column(shard: Shard, name: str) -> pa.Array:
    return pa.concat_arrays([x.column(name) for x in shard.parts])


def _collect(shard: Shard, phrases: Phrases) -> pa.RecordBatch:
    """Rows as given, with this part's runs and items added to those of earlier parts."""
    runs, items = shard.hits(phrases)
    runs = [a + b for a, b in zip(_column(shard, "runs").to_pylist(), runs, strict=True)]
    items = [a + b for a, b in zip(_column(shard, "items").to_pylist(), items, strict=True)]
    names = shard.parts[0].schema.names
    own = {"runs": pa.array(runs, RUNS), "items": pa.array(items, pa.list_(pa.string()))}
    return pa.RecordBatch.from_arrays([own[c] if c in own else _column(shard, c) for c in names], names=names)


def _decide(cut_out: bool):
    def close(shard: Shard, phrases: Phrases) -> pa.RecordBatch:
        runs, items = shard.hits(phrases)
        carried = [c for c in shard.parts[0].schema.names if c == "carried"]
        if "runs" in shard.parts[0].schema.names:
            runs = [merged(a + b) for a, b in zip(_column(shard, "runs").to_pylist(), runs, strict=True)]
            items = [[*{*a, *b}] for a, b in zip(_column(shard, "items").to_pylist(), items, strict=True)]
        counts = np.concatenate(shard.counts)
        n_hit = np.array([sum(x["last"] - x["first"] for x in r) for r in runs], np.int64)
        names = [",".join(sorted(x)) for x in items]
        out = {
            "doc_id": _column(shard, "doc_id"), "n_words": pa.array(counts), "n_hit": pa.array(n_hit), "n_items": pa.array([len(x) for x in items], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in names]), "contaminated": pa.array((n_hit > 0) & (20 * n_hit >= counts)),
            "spans": pa.array([[{"begin": x["begin"], "end": x["end"]} for x in r] for r in runs], SPANS),
        }
        if cut_out:
            texts = _column(shard, "text")
            some = [i for i, r in enumerate(runs) if r]
            if some:
                texts = texts.to_pylist()
                for i in some:
                    texts[i] = without(texts[i], runs[i])
            out["kept"] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_pydict(out | {c: _column(shard, c) for c in carried})

    return close


def benchmark_parts(rows: DataFrame, most_bytes: int) -> int:
    """How many parts of about most_bytes of text there are; at least one."""
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return max(1, -(-size // most_bytes))


def fm_decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, most_bytes: int = 16 << 20, carry: tuple[str, ...] = (), cut: bool = False) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans[, kept, carried]) for every row of docs.

    spans are byte ranges [begin, end) of the UTF-8 text whose words are hit. Nulls and empty texts have no words and
    are clean; benchmark rows with null text or id are ignored, texts of one item_id are one item, no benchmark hits
    nothing; repeated rows of docs give repeated results. The benchmark is sent to all tasks in parts of about most_bytes
    of text, so what is sent at once is bounded (some 100 bytes a word); documents go through all parts, and their runs
    of hit words are united. With `cut` kept is the text without the spans. `carry` names columns of docs that come
    back in a struct (see shared.restored); other columns are ignored.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    parts = benchmark_parts(rows, most_bytes)
    state = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *shared.carried(carry))
    if parts > 1:
        rows = shared.cut(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))))
        state = state.withColumn("runs", F.array().cast("array<struct<first: long, last: long, begin: long, end: long>>")).withColumn("items", F.array().cast("array<string>"))
    for i in range(parts):
        got = (rows.where(F.col("part") == i) if parts > 1 else rows).select("item_id", "text").toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        phrases = spark.sparkContext.broadcast(Phrases(got.column("item_id").to_pylist(), got.column("text").to_pylist(), window))
        if i + 1 < parts:
            state = shared.cut(state.mapInArrow(_shards(phrases, _collect), state.schema))
    own = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<begin: long, end: long>>" + ", kept string" * cut
    return state.mapInArrow(_shards(phrases, _decide(cut)), shared.schema(own, docs, carry))
