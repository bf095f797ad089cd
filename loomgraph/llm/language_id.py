"""Language identification: script ranges, per-word scores, and Viterbi with a switching penalty.

Learning counts, for each label, whole words and their first and last three bytes by hash, and words by script. A word
scores each language with its log posterior: of the whole word if it was seen often enough, else of its two ends.
Languages in which the word's script does not occur are no candidates for it. Viterbi finds the cheapest labelling of a document's words,
where each change of language costs `penalty`; runs of one label are spans of that language. The document's language is
the one with most letters.

Only text and label of learning rows are used, at most about `most_rows` of them (a share drawn by hash of doc_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as X
from .shared import carried, schema

U64 = np.uint64
WORD_BUCKETS, END_BUCKETS = 1 << 17, 1 << 15
#: First code points of scripts; a script reaches to the next one's start.
SCRIPTS = [("latin", 0x0), ("greek", 0x370), ("cyrillic", 0x400), ("armenian", 0x530), ("hebrew", 0x590), ("arabic", 0x600), ("syriac and others", 0x700), ("devanagari", 0x900), ("bengali", 0x980), ("gurmukhi", 0xA00), ("gujarati", 0xA80), ("oriya", 0xB00), ("tamil", 0xB80), ("telugu", 0xC00), ("kannada", 0xC80), ("malayalam", 0xD00), ("sinhala", 0xD80), ("thai", 0xE00), ("lao", 0xE80), ("tibetan", 0xF00), ("myanmar", 0x1000), ("georgian", 0x10A0), ("hangul jamo", 0x1100), ("ethiopic and others", 0x1200), ("latin additional", 0x1E00), ("greek extended", 0x1F00), ("symbols", 0x2000), ("kana", 0x3040), ("bopomofo and others", 0x3100), ("han", 0x3400), ("yi and others", 0xA000), ("hangul", 0xAC00), ("private and forms", 0xD7B0), ("supplementary", 0x10000), ("han supplementary", 0x20000)]
_SCRIPT_STARTS = np.array([s for _, s in SCRIPTS])
#: The score of a language that a word's script rules out, unless every language is.
RULED_OUT = -1e9
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z and the capitals of Latin-1 in lower case."""
    buf, off = X.text_buffer(texts)
    buf = X.lower_ascii(buf)
    capital = (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)
    buf[1:][capital] += 0x20
    return buf, off


def first_code_points(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    a, b, c, d = (buf[np.minimum(starts + k, len(buf) - 1)].astype(np.int64) for k in range(4))
    two, three, four = (a & 0x1F) << 6 | b & 0x3F, (a & 0xF) << 12 | (b & 0x3F) << 6 | c & 0x3F, (a & 0x7) << 18 | (b & 0x3F) << 12 | (c & 0x3F) << 6 | d & 0x3F
    return np.select([a < 0x80, a < 0xE0, a < 0xF0], [a, two, three], four)


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word, its beginning and its end, and its script."""
    whole = X.span_hashes(buf, starts, ends) & U64(WORD_BUCKETS - 1)
    head = X.span_hashes(buf, starts, np.minimum(ends, starts + 3)) & U64(END_BUCKETS - 1)
    tail = X.span_hashes(buf, np.maximum(starts, ends - 3), ends) & U64(END_BUCKETS - 1)
    script = np.searchsorted(_SCRIPT_STARTS, first_code_points(buf, starts), side="right") - 1
    return whole.astype(np.int64), head.astype(np.int64), tail.astype(np.int64), script


def _count(labels: list[str]):
    """(text, lang) -> (feature, lang index, n) of a task; features are numbered whole, head, tail, script."""
    sizes = np.cumsum([0, WORD_BUCKETS, END_BUCKETS, END_BUCKETS, len(SCRIPTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(labels)
        at_label = {x: i for i, x in enumerate(labels)}
        keys, total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in X.pieces(batches, "text"):
            buf, off = lowered(part.column("text"))
            starts, ends, at = X.word_spans(buf, off, LETTER)
            lang = np.repeat(np.array([at_label[x] for x in part.column("lang").to_pylist()], np.int64), np.diff(at))
            met = [np.unique((base + f) * k + lang, return_counts=True) for base, f in zip(sizes, features(buf, starts, ends), strict=False)]
            keys, at = np.unique(np.concatenate([keys, *(x for x, _ in met)]), return_inverse=True)
            total = np.bincount(at, np.concatenate([total, *(n for _, n in met)]), len(keys)).astype(np.int64)
        for i in range(0, len(keys), 100_000):
            x = keys[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x // k), pa.array((x % k).astype(np.int32)), pa.array(total[i : i + 100_000])], names=["feature", "lang", "n"])

    return run


class Model:
    """Log posteriors by word bucket and by the buckets of its ends, and languages by script."""

    def __init__(self, labels: list[str], feature: np.ndarray, lang: np.ndarray, n: np.ndarray) -> None:
        self.labels = labels
        k = max(len(labels), 1)
        sizes = np.cumsum([0, WORD_BUCKETS, END_BUCKETS, END_BUCKETS, len(SCRIPTS)])
        counts = np.zeros((int(sizes[-1]), k))
        counts[feature, lang] = n
        tables = [counts[a:b] for a, b in zip(sizes[:-1], sizes[1:], strict=True)]

        def posterior(c: np.ndarray) -> np.ndarray:
            p = np.log((c + 0.5) / (c.sum(0) + 0.5 * len(c)))
            p -= np.logaddexp.reduce(p, 1, keepdims=True)
            return np.maximum(p, -6).astype(np.float32)

        self.whole, self.head, self.tail = (posterior(t) for t in tables[:3])
        self.seen = tables[0].sum(1) >= 3
        script = tables[3]
        share = script / np.maximum(script.sum(0), 1)
        allowed = share >= 1e-4
        allowed[~allowed.any(1)] = True
        self.barred = ~allowed

    def scores(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's scores by language, the words whose script rules languages out, and those languages."""
        whole = (X.span_hashes(buf, starts, ends) & U64(WORD_BUCKETS - 1)).astype(np.int32)
        out = self.whole[whole]
        rare = np.flatnonzero(~self.seen[whole])
        del whole
        _, head, tail, _ = features(buf, starts[rare], ends[rare])
        out[rare] = (self.head[head] + self.tail[tail]) / 2
        odd = np.flatnonzero(buf[starts] >= 0x80)
        script = np.zeros(len(starts), np.int8)
        script[odd] = np.searchsorted(_SCRIPT_STARTS, first_code_points(buf, starts[odd]), side="right") - 1
        narrowed = np.flatnonzero(self.barred.any(1)[script])
        return out, narrowed, self.barred[script[narrowed]]


def long_viterbi(scores: np.ndarray, penalty: float, block: int) -> np.ndarray:
    """The best label of each word of one long document, whose blocks of words take one step at a time together.

    First each block's best change from every label to every label, then the values at the blocks' beginnings one by
    one, then the labels inside the blocks for every label at their ends, of which the ends of the whole choose.
    """
    n, k = scores.shape
    blocks = n // block
    inner = scores[: blocks * block].reshape(blocks, block, k).astype(np.float64)
    change = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(blocks, 0)
    for t in range(block):
        change = np.maximum(change, change.max(2, keepdims=True) - penalty) + inner[:, t, None, :]
    value = np.zeros((blocks + 1, k))
    for b in range(blocks):
        value[b + 1] = (value[b][:, None] + change[b]).max(0)
        value[b + 1] -= value[b + 1].max()
    out = np.empty(n, np.int64)
    last = value[blocks]
    if n > blocks * block:
        rest = np.concatenate([last[None], scores[blocks * block :]])  # a first step that holds the values so far
        labels = viterbi(rest, np.array([0, len(rest)]), penalty)
        out[blocks * block :], end = labels[1:], int(labels[0])
    else:
        end = int(last.argmax())
    now, back = value[:-1].copy(), np.empty((blocks, block, k), np.uint16)
    same = np.arange(k)
    for t in range(block):
        best = now.argmax(1)
        top = now.max(1, keepdims=True) - penalty
        back[:, t] = np.where(now >= top, same, best[:, None])
        now = np.maximum(now, top) + inner[:, t]
    ends = np.tile(same, (blocks, 1))
    label = np.empty((blocks, block, k), np.uint16)
    for t in range(block - 1, -1, -1):
        label[:, t] = ends
        ends = np.take_along_axis(back[:, t], ends, 1)
    for b in range(blocks - 1, -1, -1):
        out[b * block : (b + 1) * block] = label[b, :, end]
        end = int(ends[b, end])
    return out


def viterbi(scores: np.ndarray, at: np.ndarray, penalty: float, block: int = 2048) -> np.ndarray:
    """The best label of each word; documents are words at[i] .. at[i + 1]. All documents take one step at a time; those
    over 4 blocks take a step in all their blocks at once."""
    long = np.flatnonzero(np.diff(at) > 4 * block)
    if len(long):
        out = np.empty(len(scores), np.uint8 if scores.shape[1] <= 256 else np.uint16)
        for i in long:
            out[at[i] : at[i + 1]] = long_viterbi(scores[at[i] : at[i + 1]], penalty, block)
        rest = np.diff(at)
        rest[long] = 0
        pick = X.ranges(at[:-1], rest)
        out[pick] = viterbi(scores[pick], np.concatenate([[0], np.cumsum(rest)]), penalty, block)
        return out
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    first, n = at[:-1][order], n[order]
    longest = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(1, longest + 1), side="right")
    kind = np.uint8 if scores.shape[1] <= 256 else np.uint16
    back = np.empty(scores.shape, kind)
    value = np.zeros((len(n), scores.shape[1]), np.float32)
    same = np.arange(scores.shape[1], dtype=kind)
    for t in range(longest):
        m = active[t]
        v, w = value[:m], first[:m] + t
        best = v.argmax(1)
        top = v[np.arange(m), best] - penalty
        stay = v >= top[:, None]
        back[w] = np.where(stay, same, best[:, None].astype(kind))
        value[:m] = np.where(stay, v, top[:, None]) + scores[w]
    label = np.empty(len(scores), kind)
    now = value.argmax(1)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        w = first[:m] + t
        label[w] = now[:m]
        now[:m] = back[w, now[:m]]
    return label


def _predict(model, penalty: float, with_spans: bool, extra: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        k = len(m.labels)
        for part in X.pieces(batches, "text", 6 << 20):
            texts = part.column("text")
            buf, off = lowered(texts)
            starts, ends, at = X.word_spans(buf, off, LETTER)
            docs, words = len(off) - 1, np.diff(at)
            letters = np.zeros(docs, bool)
            plain = np.maximum.reduceat(np.append((buf[starts] <= 0x7A), False), np.minimum(at[:-1], len(starts))) if docs else letters
            letters[words > 0] = plain[words > 0]
            for i in np.flatnonzero(~letters & (words > 0)).tolist():
                letters[i] = any(c.isalpha() for c in texts[i].as_py())
            if k:
                scores, narrowed, barred = m.scores(buf, starts, ends)
                if len(narrowed):
                    open_ = scores[narrowed]
                    scores[narrowed] = np.where(barred, RULED_OUT, open_)
                    label = viterbi(scores, at, penalty)
                    scores[narrowed] = np.where(barred, open_ - 12, open_)  # one word of another script is no proof
                else:
                    label = viterbi(scores, at, penalty)
                doc = np.repeat(np.arange(docs), words)
                letter = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int32)])  # characters, not bytes
                mass = np.bincount(doc * k + label.astype(np.int64), letter[ends] - letter[starts], docs * k).reshape(docs, k)
                best = mass.argmax(1)
                share = mass[np.arange(docs), best] / np.maximum(mass.sum(1), 1)
                sums = np.stack([np.bincount(doc, scores[:, j], docs) for j in range(k)], 1) / np.maximum(words / 20, 1)[:, None]
                sums -= sums.max(1, keepdims=True)
                p = np.exp(sums)
                score = share * (p[np.arange(docs), best] / p.sum(1))
                names = np.array(m.labels, object)[best]
            else:
                score, names = np.zeros(docs), np.full(docs, "und", object)
            names[~letters], score[~letters] = "und", 0
            out = [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))]
            if with_spans:
                spans: list[list[dict]] = [[] for _ in range(docs)]
                if k and len(label):
                    new = np.ones(len(label), bool)
                    new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                    last = np.append(new[1:], True)
                    for d, b, e, x in zip(doc[new].tolist(), (starts[new] - off[doc[new]]).tolist(), (ends[last] - off[doc[last]]).tolist(), label[new].tolist(), strict=True):
                        if letters[d]:
                            spans[d].append({"begin": b, "end": e, "lang": m.labels[x]})
                out.append(pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
            names = ["doc_id", "held_out", "lang_pred", "score", "spans"][: len(out)]
            yield pa.RecordBatch.from_arrays([*out, *(part.column(c) for c in extra)], names=[*names, *extra])

    return run


def held_out(column: str, folds: int, fold: int):
    """Whether crc32 of the number as text leaves that remainder; a null is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == fold, F.lit(False))


def language_id(docs: DataFrame, penalty: float = 4.0, most_rows: int = 20_000, spans: bool = True, learn_from: DataFrame | None = None, carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score[, spans, text, carried]) for every row of docs (doc_id, text, lang to learn).

    Learns from rows of `learn_from` (default: docs) with non-null text and lang that are not held out. lang_pred is
    `und`, score 0, where text is null or has no letter, or nothing could be learnt. spans are byte ranges with their
    language. Ties go to the label that comes first in order of code points. Repeated rows get equal results.
    `carry` names columns of docs that come back in a struct (see shared.restored), with_text the text itself. A label
    takes some 0.8 MB in the model, which is sent to all tasks: the operator is for hundreds of languages, not more.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string").alias("text")
    rows = (docs if learn_from is None else learn_from).select("doc_id", text, F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null").where(~held_out("doc_id", 4, 2))
    found = rows.groupBy("lang").count().orderBy("lang").collect()
    labels, total = [r.lang for r in found], sum(r["count"] for r in found)
    share = min(1.0, most_rows / max(total, 1))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))) if share < 1 else rows
    counts = drawn.select("text", "lang").mapInArrow(_count(labels), "feature long, lang int, n long").groupBy("feature", "lang").agg(F.sum("n").alias("n")).toArrow()  # at most a row a bucket and label
    model = spark.sparkContext.broadcast(Model(labels, *(counts.column(x).to_numpy() for x in ("feature", "lang", "n"))))
    own = "doc_id long, held_out boolean, lang_pred string, score double" + ", spans array<struct<begin: long, end: long, lang: string>>" * spans + ", text string" * with_text
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 4, 2).alias("held_out"), text, *carried(carry))
    return given.mapInArrow(_predict(model, penalty, spans, ("text",) * with_text + ("carried",) * bool(carry)), schema(own, docs, carry))
