"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of `passage` words. Each passage has a row of surface features: shares of character
classes, word shapes, repeats inside the passage and the document, and hashed words. A tanh layer encodes it, gated
attention (tanh times sigmoid) weighs the passages of a document, and a logistic layer scores the weighted sum. The
weights are learnt from document labels alone, by Adam on the driver over a bounded sample of labelled rows. A drawn row
is learnt from with all its passages: the bound on passages leaves out rows, never a part of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as X
from .language_id import held_out

U64 = np.uint64
HASHED = 24
_CLASSES = np.zeros((256, 8), np.float32)
_CLASSES[0x61:0x7B, 0] = 1
_CLASSES[0x41:0x5B, 1] = 1
_CLASSES[0x30:0x3A, 2] = 1
_CLASSES[[*b".,;:?'\"-()"], 3] = 1
_CLASSES[[*b"!#$%&*+/<=>@\\^_`{|}~[]"], 4] = 1
_CLASSES[0x80:, 5] = 1
_CLASSES[[*b" \t\r\x0b\x0c"], 6] = 1
_CLASSES[0x0A, 7] = 1
WIDTH = 8 + 9 + HASHED


def passages(texts: pa.Array, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and their offsets by document; a text without words is one passage of zeros."""
    buf, off = X.text_buffer(texts)
    starts, ends, at = X.word_spans(buf, off, X.NOT_SPACE)
    words = np.diff(at)
    per_doc = np.maximum(-(-words // passage), 1)
    bag = np.concatenate([[0], np.cumsum(per_doc)])
    out = np.zeros((int(bag[-1]), WIDTH), np.float32)
    if not len(starts):
        return out, bag
    doc = np.repeat(np.arange(len(words)), words)
    nth = np.arange(len(starts)) - at[doc]
    p = bag[doc] + nth // passage
    first = np.flatnonzero(np.diff(p, prepend=-1))
    full = p[first]
    count = np.diff(np.append(first, len(p))).astype(np.float32)
    last = np.append(first[1:], len(p)) - 1
    lo, hi = starts[first], ends[last]
    size = (hi - lo).astype(np.float32)
    for k in range(8):
        sums = np.concatenate([[0], np.cumsum(_CLASSES[:, k][buf[: int(off[-1])]], dtype=np.float64)])
        out[full, k] = (sums[hi] - sums[lo]) / size
    mean = lambda x: np.add.reduceat(x.astype(np.float32), first) / count
    length = (ends - starts).astype(np.float32)
    out[full, 8] = mean(length) / 10
    out[full, 9] = mean(_CLASSES[buf[ends - 1], 4])
    out[full, 10] = mean(_CLASSES[buf[ends - 1], 3])
    out[full, 11] = mean(length > 20)
    h = X.span_hashes(X.lower_ascii(buf), starts, ends)
    with np.errstate(over="ignore"):
        own = X.mix64(h ^ (p.astype(U64) * X.GOLDEN))
        four = h.copy()
        for k in (1, 2, 3):
            four[:-k] += h[k:] * U64(2 * k + 1) * X.MIX_A
        four = X.mix64(four ^ (doc.astype(U64) * X.MIX_B))

    def again(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x)
        s = x[order]
        same = np.zeros(len(x), bool)
        equal = s[1:] == s[:-1]
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
        return same

    out[full, 12] = mean(again(own))
    out[full, 13] = mean(again(four))
    out[full, 14] = np.log1p(count) / 5
    bucket = (h >> U64(8)).astype(np.int64) % HASHED
    sign = np.where(h & U64(1) == 1, 1.0, -1.0)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out[full, 15] = mean(same)
    out[full, 16] = mean(length == 1)
    out[:, 17:] = np.bincount(p * HASHED + bucket, sign, len(out) * HASHED).reshape(-1, HASHED) / np.sqrt(np.maximum(np.bincount(p, minlength=len(out)), 1))[:, None]
    return out, bag


class GatedAttention:
    """The network, its gradient and its training."""

    def __init__(self, width: int, hidden: int = 24, gate: int = 12, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float64)
        self.w = {"mean": np.zeros(width), "scale": np.ones(width), "W": draw(width, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "a": draw(gate, 1)[:, 0], "c": draw(hidden, 1)[:, 0], "c0": np.zeros(1)}

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        x = (x - w["mean"]) / w["scale"]
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        first, of = bag[:-1], np.repeat(np.arange(len(bag) - 1), np.diff(bag))
        e = np.exp(e - np.maximum.reduceat(e, first)[of])
        a = e / np.add.reduceat(e, first)[of]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["c0"], -30, 30)))
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "of": of}

    def gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, s = self.w, self.forward(x, bag)
        h, t, g, a, of = s["h"], s["t"], s["g"], s["a"], s["of"]
        do = (s["p"] - y) / len(y)
        dz = do[:, None] * w["c"]
        da = (dz[of] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, bag[:-1])[of])
        dt, dg = de[:, None] * g * w["a"] * (1 - t * t), de[:, None] * t * w["a"] * g * (1 - g)
        dh = a[:, None] * dz[of] + dt @ w["V"].T + dg @ w["U"].T
        dx = dh * (1 - h * h)
        return {"W": s["x"].T @ dx, "b": dx.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": s["z"].T @ do, "c0": np.array([do.sum()])}

    def batch_gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, i: np.ndarray, room: int = 32_768) -> dict[str, np.ndarray]:
        """The gradient over documents i, summed over groups of about `room` passages: long documents take no more memory."""
        n = np.diff(bag)[i]
        group = (np.cumsum(n) - 1) // room
        total: dict[str, np.ndarray] = {}
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            found = self.gradient(x[X.ranges(bag[i[own]], n[own])], np.concatenate([[0], np.cumsum(n[own])]), y[i[own]])
            for k, d in found.items():
                total[k] = total.get(k, 0) + d * (len(own) / len(i))
        return total

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> None:
        self.w["mean"], self.w["scale"] = x.mean(0), x.std(0) + 1e-3
        r = np.random.default_rng(seed)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items() if k not in ("mean", "scale")}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for lo in range(0, len(y), batch):
                step += 1
                for k, d in self.batch_gradient(x, bag, y, order[lo : lo + batch]).items():
                    d = d + decay * self.w[k]
                    m[k][0] = 0.9 * m[k][0] + 0.1 * d
                    m[k][1] = 0.999 * m[k][1] + 0.001 * d * d
                    self.w[k] -= rate * (1 - epoch / epochs) * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.999**step)) + 1e-8)


def _count(passage: int):
    """Documents -> (doc_id, n passages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.pieces(batches, "text"):
            buf, off = X.text_buffer(part.column("text"))
            words = np.diff(X.word_spans(buf, off, X.NOT_SPACE)[2])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.maximum(-(-words // passage), 1).astype(np.int64))], names=["doc_id", "n"])

    return run


def _encode(passage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.pieces(batches, "text"):
            x, bag = passages(part.column("text"), passage)
            rows = [x[bag[i] : bag[i + 1]].tobytes() for i in range(len(bag) - 1)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(rows, pa.binary())], names=["doc_id", "y", "x"])

    return run


def _score(model, passage: int, threshold: float, with_weights: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in X.pieces(batches, "text", 8 << 20):
            x, bag = passages(part.column("text"), passage)
            s = model.value.forward(x, bag) if len(bag) > 1 else {"p": np.zeros(0), "a": np.zeros(0)}
            p = s["p"]
            out = [part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            if with_weights:
                out.append(pa.ListArray.from_arrays(pa.array(bag.astype(np.int32)), pa.array(s["a"])))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "held_out", "score", "predicted", "attention"][: len(out)])

    return run


def quality_mil(docs: DataFrame, labels: DataFrame, passage: int = 64, most_rows: int = 6000, sample_passages: int = 262_144, threshold: float = 0.3, attention: bool = True) -> DataFrame:
    """(doc_id, held_out, score, predicted[, attention]) for every row of docs (doc_id, text; more are ignored).

    Learns from labels (doc_id, quality 0 or 1) of rows that are not held out, at most about most_rows of them, drawn by
    hash of doc_id, and of those, in the order of their hashes, as many as have sample_passages passages together (one that
    has more by itself is passed over), each with all its passages; of labels for one doc_id the smallest counts, nulls do not. Null and empty texts are one empty
    passage and get a score as well. Without labels of both kinds every score is the share of label 1, or 0.5.
    attention holds the weight of each passage.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string").alias("text")
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out("doc_id", 5, 0)).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.min("quality").cast("double").alias("y"))
    total = known.count()
    share = min(1.0, most_rows / max(total, 1))
    place = F.pmod(F.xxhash64(F.lit(3), "label_id"), F.lit(1 << 20))
    drawn = known.where(place < int(share * (1 << 20))) if share < 1 else known
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    # at most about most_rows rows of 16 bytes: the bound that allows the broadcasts and what the driver gets here
    sizes = source.join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id")).select("doc_id", "text").mapInArrow(_count(passage), "doc_id long, n long").groupBy(F.col("doc_id").alias("label_id")).agg(F.sum("n").alias("n"))
    sizes = sizes.select("label_id", "n", place.alias("place")).toArrow().sort_by([("place", "ascending"), ("label_id", "ascending")])
    n = sizes.column("n").to_numpy()
    fits = n <= sample_passages
    whole = fits & (np.cumsum(np.where(fits, n, 0)) <= sample_passages)
    if not whole.all():
        ids = sizes.column("label_id").to_numpy()[whole].tolist()
        drawn = drawn.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "label_id long")), "label_id")
    bags = source.join(F.broadcast(drawn), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y").mapInArrow(_encode(passage), "doc_id long, y double, x binary").toArrow().sort_by("doc_id")
    y = bags.column("y").to_numpy()
    x = np.frombuffer(b"".join(bags.column("x").to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)
    bag = np.concatenate([[0], np.cumsum([len(b) // (4 * WIDTH) for b in bags.column("x").to_pylist()])]).astype(np.int64)
    model = GatedAttention(WIDTH)
    if len(set(y.tolist())) == 2:
        model.fit(x, bag, y)
    else:
        model.w["c"][:] = 0
        model.w["c0"][:] = 30 * (2 * y[0] - 1) if len(y) else 0
    sent = spark.sparkContext.broadcast(model)
    schema = "doc_id long, held_out boolean, score double, predicted int" + ", attention array<double>" * attention
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 5, 0).alias("held_out"), text).mapInArrow(_score(sent, passage, threshold, attention), schema)
