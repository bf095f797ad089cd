"""N-gram Jaccard join with signature trees.

Two documents link when the Jaccard similarity of their word-shingle sets is at least num/den (0.8). All links are
found, none is estimated:

1. One scan hashes every document's shingle set; documents with equal sets form a class, and only one member of a
   class goes on.
2. Prefix filter: two sets that link share c shingles (or their whole overlap, if that is less) among the first
   |x| - ceil(0.8 |x|) + c of each, in any common order of shingles; c grows with the smaller set, from 1 to `SHARED`.
   The order is from rare to frequent, by a sketch of 2**22 counters over all documents (its size is fixed, so it can be
   sent to all tasks), then by hash. Counters that shingles share change only the work, not the links. A map task sends
   its (shingle, class, size, place) rows sorted and packed, one row per reducer.
3. Classes that share so many of these and whose sizes and places in the order allow a link form candidate clusters
   (connected components). One shared shingle is not enough: how many pairs have one by chance grows with the square of
   the documents, and such pairs would join most of a large table to one cluster.
4. In each cluster a signature tree is built: members sorted so that like ones are neighbours, leaf bitmaps of hashed
   shingles, inner nodes with OR-combined bitmaps and size ranges. A dual traversal drops node pairs whose maximum
   possible overlap is too small or whose members are all connected already; surviving pairs of members are verified
   on their whole sets.
5. A cluster of more than `block` members or `block_shingles` shingles is no single task. First its members with one
   smallest shingle meet in blocks, each with the first of them all; what these stars connect is known. Then the cluster
   is dealt out as pairs of blocks of about `block` members that were laid out by the groups known so far, without the
   pairs whose members are in one group already: a large group of copies costs its stars, not its pairs. Every two
   members that are not connected yet still meet in one task.

Shingles are compared as 64-bit hashes of whole word sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnp as X
from .components import components
from .shared import cut, few, width

U64 = np.uint64
_LANES = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3)]
BATCH = 1_000_000
#: Cells of the sketch that ranks shingles by how often they occur, and the blocks in which tasks' sketches are added up.
CELLS, BLOCKS = 1 << 22, 64
#: In a group of up to so many classes that share a shingle all pairs are tested by size and place, and counted.
PAIRED = 32
#: Shingles that the prefixes of two large sets have in common if they link; each lengthens a prefix by one.
SHARED = 8
#: Rows of 16 bytes that may be sent to all tasks instead of shuffling the texts; beyond it the texts are shuffled.
MOST_SENT = 1_000_000


def shingle_sets(texts: pa.Array, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and their n + 1 offsets."""
    buf, off = X.text_buffer(texts)
    buf = X.lower_ascii(buf)
    starts, ends, at = X.word_spans(buf, off, X.NOT_SPACE)
    w = X.span_hashes(buf, starts, ends)
    count = np.diff(at)
    with np.errstate(over="ignore"):
        whole = np.maximum(count - words + 1, 0)
        first = X.ranges(at[:-1], whole)
        acc = np.zeros(len(first), U64)
        for k in range(words):
            acc += w[first + k] * _LANES[k % 8] ** U64(1 + k // 8)
        few = np.flatnonzero((count > 0) & (count < words))
        short = np.zeros(len(few), U64)
        for k in range(words - 1):
            has = count[few] > k
            short[has] += w[at[few[has]] + k] * _LANES[k % 8] ** U64(1 + k // 8)
        short = X.mix64(short + count[few].astype(U64) * X.GOLDEN)
        acc = X.mix64(acc)
    size = whole.copy()
    size[few] = 1
    ends_ = np.cumsum(size)
    out = np.zeros(int(ends_[-1]) if len(ends_) else 0, U64)
    lo = ends_ - size
    is_short = np.zeros(len(out), bool)
    is_short[lo[few]] = True
    out[is_short] = short
    out[~is_short] = acc
    for i in np.flatnonzero(size > 1):
        out[lo[i] : ends_[i]].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[lo[size > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], np.concatenate([[0], kept[ends_]]).astype(np.int64) if len(ends_) else np.zeros(1, np.int64)


def _class_ids(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """An int64 that names each set; 0 for the empty one."""
    n = np.diff(off)
    full = n > 0
    out = np.zeros(len(n), U64)
    if full.any():
        with np.errstate(over="ignore"):
            out[full] = X.mix64(np.add.reduceat(X.mix64(sets * _LANES[1]), off[:-1][full]) ^ X.mix64(np.bitwise_xor.reduceat(X.mix64(sets * _LANES[2]), off[:-1][full]) + n[full].astype(U64)))
    return out.view(np.int64)


def _scan(words: int):
    """Documents -> (doc_id, n, cls, low) rows, low the smallest shingle, and (block, counts) rows of a task's sketch of
    shingle counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(CELLS, np.uint32), np.zeros(0, np.int64)
        for part in X.pieces(batches, "text", 8 << 20):
            sets, off = shingle_sets(part.column("text"), words)
            n, cls = np.diff(off), _class_ids(sets, off)
            low = np.append(sets, U64(0))[off[:-1]].view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(cls), pa.array(low), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=["doc_id", "n", "cls", "low", "block", "counts"])
            rows, seen = _fresh(cls, n, seen)
            sketch += np.bincount(_cells(sets[X.ranges(off[rows], n[rows])]), minlength=CELLS).astype(np.uint32)
        blocks = [(i, x) for i, x in enumerate(np.split(sketch, BLOCKS)) if x.any()]
        none = pa.nulls(len(blocks), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([i for i, _ in blocks], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for _, x in blocks], pa.binary())], names=["doc_id", "n", "cls", "low", "block", "counts"])

    return run


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _fresh(cls: np.ndarray, n: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first member of each class that the task has not met, and the classes it has met now."""
    _, first = np.unique(cls, return_index=True)
    first = np.sort(first)
    first = first[(n[first] > 0) & ~np.isin(cls[first], seen)]
    return first, np.union1d(seen, cls[first])


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, counts) rows of tasks -> one row a block, with the logarithms of the sums as bytes."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[i] = total.get(i, 0) + np.frombuffer(zlib.decompress(x), np.uint32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(np.log2(x + 1) * 6, 255).astype(np.uint8).tobytes() for x in total.values()], pa.binary())], names=["block", "levels"])


def _prefixes(words: int, num: int, den: int, levels, parts: int):
    """Documents -> (part, tokens, classes, sizes): each set's prefix, packed by range of the shingle's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        seen = np.zeros(0, np.int64)
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            t, c, n, place = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(t)
            t, c, n, place = t[order], c[order], n[order], place[order]
            part = ((t >> U64(32)) * U64(parts)) >> U64(32)
            cut_at = np.flatnonzero(np.diff(part, prepend=U64(parts)))
            ends = np.append(cut_at[1:], len(t))
            rows = [[int(part[a]) for a in cut_at], *([x[a:b].tobytes() for a, b in zip(cut_at, ends, strict=True)] for x in (t, c, n, place))]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["part", "tokens", "classes", "sizes", "places"])

        for piece in X.pieces(batches, "text", 8 << 20):
            sets, off = shingle_sets(piece.column("text"), words)
            n, cls = np.diff(off), _class_ids(sets, off)
            rows, seen = _fresh(cls, n, seen)
            if not len(rows):
                continue
            size = n[rows]
            k = np.minimum(size - (num * size + den - 1) // den + _shared(size), size)
            rank = (levels.value[_cells(sets)].astype(U64) << U64(56)) | (sets & U64((1 << 56) - 1))
            lo = off[rows]
            at = np.concatenate([a + _lowest(rank[a : a + m], j) for a, m, j in zip(lo.tolist(), size.tolist(), k.tolist(), strict=True)])
            place = np.minimum(np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k), 65535).astype(np.uint16)
            held.append((sets[at], np.repeat(cls[rows], k), np.repeat(size, k).astype(np.int32), place))
            total += int(k.sum())
            if total >= BATCH:
                yield from flush()
                held, total = [], 0
        if total:
            yield from flush()

    return run


def _shared(n: np.ndarray) -> np.ndarray:
    """Shingles that the prefix of a set of size n has in common with that of each larger set it links with."""
    return np.minimum(1 + n // 32, SHARED)


def _lowest(rank: np.ndarray, k: int) -> np.ndarray:
    at = np.argpartition(rank, k - 1)[:k]
    return at[np.argsort(rank[at])]


def _candidates(num: int, den: int):
    """Packed prefixes of a part -> (a, b, n, need): pairs of classes that share n shingles of it and may link if all parts
    together find `need`.

    If a shingle is one of the first c that sets of sizes n <= m share, at places i and j of their order, then
    min(n - i, m - j) + c - 1 bounds the overlap. In larger groups an entry is joined with the next smaller one whose
    place lets it be the smaller side of a link, which connects no less; such a pair needs no other shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, c, n, p = [], [], [], []
        for b in batches:
            for k, out, kind in ((1, t, U64), (2, c, np.int64), (3, n, np.int32), (4, p, np.uint16)):
                out += [np.frombuffer(x.as_buffer(), kind) for x in b.column(k)]
        if not t:
            return
        t, c, n, p = np.concatenate(t), np.concatenate(c), np.concatenate(n), np.concatenate(p)
        order = np.argsort(t, kind="stable")
        s = t[order]
        same = s[1:] == s[:-1]
        shared = np.zeros(len(s), bool)
        shared[1:] |= same
        shared[:-1] |= same
        pick = order[shared]
        t, c, n, p = t[pick], c[pick], n[pick].astype(np.int64), p[pick].astype(np.int64)
        smaller = (num + den) * (n - p + _shared(n) - 1) >= 2 * num * n  # may be the smaller side
        order = np.lexsort((c, ~smaller, n, t))
        fresh = np.ones(len(order), bool)  # a class that several tasks have met counts once
        fresh[1:] = (t[order[1:]] != t[order[:-1]]) | (c[order[1:]] != c[order[:-1]])
        order = order[fresh]
        t, c, n, p, smaller = t[order], c[order], n[order], p[order], smaller[order]
        if not len(t):
            return
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        group = np.cumsum(new) - 1
        count = np.bincount(group)[group]
        found = []
        small = np.flatnonzero(count <= PAIRED)
        for d in range(1, PAIRED):
            i = small[small + d < len(t)]
            i = i[group[i] == group[i + d]]
            if not len(i):
                break
            j = i + d
            bound = np.minimum(n[i] - p[i], n[j] - p[j])
            ok = ((num + den) * (bound + _shared(n[i]) - 1) >= num * (n[i] + n[j])) & (num * n[j] <= den * n[i])
            i, j = i[ok], j[ok]
            least = -(-num * (n[i] + n[j]) // (num + den))
            found.append(np.stack([c[i], c[j], np.ones(len(i), np.int64), np.minimum(least, _shared(n[i]))], 1))
        large = np.flatnonzero(count > PAIRED)
        if len(large):
            last = np.maximum.accumulate(np.where(smaller, np.arange(len(t)), -1))
            before = np.concatenate([[-1], last[:-1]])[large]
            ok = (before >= 0) & (group[before] == group[large]) & (num * n[large] <= den * n[before])
            sure = np.full(int(ok.sum()), SHARED, np.int64)
            found.append(np.stack([c[before[ok]], c[large[ok]], sure, sure], 1))
        if not found:
            return
        edges = np.concatenate(found)
        edges[:, :2].sort(1)
        edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
        new = np.ones(len(edges), bool)
        new[1:] = (edges[1:, :2] != edges[:-1, :2]).any(1)
        first = np.flatnonzero(new)
        if not len(first):
            return
        a, b, shared, need = *edges[first, :2].T, np.add.reduceat(edges[:, 2], first), np.maximum.reduceat(edges[:, 3], first)
        for i in range(0, len(first), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in (a, b, shared, need)], names=["a", "b", "n", "need"])

    return run


class Sets:
    """Union-find over the members of one cluster, by labels that numpy can compare."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True

    def labels(self) -> np.ndarray:
        up = np.asarray(self.up)
        while not np.array_equal(up, nxt := up[up]):
            up = nxt
        return up


class SignatureTree:
    """Levels of nodes over members sorted by their smallest shingles; level 0 are the members themselves."""

    FAN = 8

    def __init__(self, sets: list[np.ndarray]) -> None:
        n = np.array([len(s) for s in sets], np.int64)
        bits = 256
        while bits < 2 * n.max() and bits < 1 << 15:
            bits *= 2
        sig = np.zeros((len(sets), bits // 64), U64)
        for i, s in enumerate(sets):
            at = (s >> U64(17)) & U64(bits - 1)
            np.bitwise_or.at(sig[i], (at >> U64(6)).astype(np.int64), U64(1) << (at & U64(63)))
        spare = n - np.bitwise_count(sig).sum(1).astype(np.int64)
        self.sig, self.low, self.high, self.spare = [sig], [n], [n], [spare]
        while len(self.sig[-1]) > 1:
            at = np.arange(0, len(self.sig[-1]), self.FAN)
            self.sig.append(np.bitwise_or.reduceat(self.sig[-1], at, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], at))
            self.high.append(np.maximum.reduceat(self.high[-1], at))
            self.spare.append(np.maximum.reduceat(self.spare[-1], at))

    def uniform(self, labels: np.ndarray) -> list[np.ndarray]:
        """Each node's label where all its members have the same one, else -1."""
        out = [labels]
        while len(out[-1]) > 1:
            at = np.arange(0, len(out[-1]), self.FAN)
            lo, hi = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(lo == hi, lo, -1))
        return out


def overlap_of(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def tree_links(sets: list[np.ndarray], num: int = 4, den: int = 5) -> list[tuple[int, int]]:
    """A spanning forest of the links between these sets (indices), by dual traversal of their signature tree."""
    m = len(sets)
    if m < 2:
        return []
    order = sorted(range(m), key=lambda i: (sets[i][: 3].tobytes(), len(sets[i])))
    sets = [sets[i] for i in order]
    size = np.array([len(s) for s in sets], np.int64)
    groups, links = Sets(m), []
    linked = lambda i, j: (num + den) * overlap_of(sets[i], sets[j]) >= num * int(size[i] + size[j])

    def test(i: int, j: int) -> bool:
        if groups.find(i) != groups.find(j) and linked(i, j):
            groups.join(i, j)
            links.append((order[i], order[j]))
            return True
        return False

    for i in range(m - 1):  # like members are neighbours: most groups of near copies are connected by these alone
        test(i, i + 1)
    tree = SignatureTree(sets)
    same = tree.uniform(groups.labels())
    stack = [(len(tree.sig) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    room = max(256, (8 << 20) // (8 * tree.sig[0].shape[1]))
    while stack:
        level, a, b = stack.pop()
        if len(a) > room:
            stack += [(level, a[i : i + room], b[i : i + room]) for i in range(0, len(a), room)]
            continue
        ok = ~((same[level][a] == same[level][b]) & (same[level][a] >= 0))
        low, high = tree.low[level], tree.high[level]
        ok &= (den * high[a] >= num * low[b]) & (den * high[b] >= num * low[a])
        a, b = a[ok], b[ok]
        most = np.bitwise_count(tree.sig[level][a] & tree.sig[level][b]).sum(1).astype(np.int64) + np.minimum(tree.spare[level][a], tree.spare[level][b])
        most = np.minimum(most, np.minimum(high[a], high[b]))
        ok = (num + den) * most >= num * (low[a] + low[b])
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if level == 0:
            found = False
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                found |= test(i, j)
            if found:
                same = tree.uniform(groups.labels())
            continue
        below, f = len(tree.sig[level - 1]), tree.FAN
        ca = (a[:, None] * f + np.arange(f)[None, :]).repeat(f, 1).ravel()
        cb = np.tile(b[:, None] * f + np.arange(f)[None, :], (1, f)).ravel()
        ok = (ca < below) & (cb < below) & (ca <= cb if level > 1 else ca < cb)
        ca, cb = ca[ok], cb[ok]
        stack.append((level - 1, ca, cb))
    return links


def _cluster_links(words: int, num: int, den: int):
    """Rows (task, doc_id, text) sorted by task -> (a, b) links of a spanning forest of each task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1 and (found := tree_links(sets, num, den)):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], names=["a", "b"])

        for part in X.pieces(batches, "text", 4 << 20):
            flat, off = shingle_sets(part.column("text"), words)
            tasks, docs = part.column("task").to_pylist(), part.column("doc_id").to_pylist()
            for i, task in enumerate(tasks):
                if task != key:
                    yield from close()
                    key, ids, sets = task, [], []
                ids.append(docs[i])
                sets.append(flat[off[i] : off[i + 1]].copy())
        yield from close()

    return run


def ngram_jaccard_join(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, block_shingles: int = 4_000_000, block: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text; more columns are ignored).

    Documents link when |x & y| / |x | y| >= num / den over sets of `words`-word shingles; component_id is the smallest
    doc_id reachable by links. Null and empty texts have no shingles and link with nothing. Repeated rows of one
    doc_id are returned as often as given. A row with null doc_id is returned alone, its component_id null.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = cut(source.mapInArrow(_scan(words), "doc_id long, n long, cls long, low long, block int, counts binary"))
    per_doc = scanned.where("block is null").select("doc_id", "n", "cls", "low")
    level = np.zeros((BLOCKS, CELLS // BLOCKS), np.uint8)
    for r in scanned.where("block is not null").select("block", "counts").repartition(BLOCKS, "block").mapInArrow(_add_sketches, "block int, levels binary").collect():
        level[r.block] = np.frombuffer(r.levels, np.uint8)
    levels = spark.sparkContext.broadcast(level.ravel())  # CELLS bytes
    shingles = per_doc.agg(F.sum("n")).first()[0] or 0
    parts = width(spark, 5 * shingles, 256 << 20)  # a fifth of each set goes out, some 25 bytes a shingle
    files = few(spark, 16 * shingles)
    packed = source.mapInArrow(_prefixes(words, num, den, levels, parts), "part int, tokens binary, classes binary, sizes binary, places binary")
    pairs = packed.repartition(parts, "part").mapInArrow(_candidates(num, den), "a long, b long, n long, need long")
    edges = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("need").alias("need")).where("n >= need")
    clusters = components(edges, files=files)
    classes = per_doc.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("low").alias("low"))
    members = cut(classes.join(clusters.withColumnRenamed("node", "cls"), "cls").select("rep", "n", "low", "root").coalesce(files))
    first = source.where("doc_id is not null")

    def links_of(tasks: DataFrame, sent: bool = False) -> DataFrame:
        """Links of the members that meet in tasks (rep, task); tasks are sent to the texts if these are to need no shuffle."""
        texts = first.join(F.broadcast(tasks) if sent else tasks.hint("shuffle_hash"), F.col("doc_id") == F.col("rep")).select("task", "doc_id", "text")
        return texts.repartition(parts, "task").sortWithinPartitions("task", "doc_id").mapInArrow(_cluster_links(words, num, den), "a long, b long")

    sizes = members.groupBy("root").agg(_block_count(block, block_shingles).alias("blocks"))
    placed = members.join(sizes, "root")
    small = placed.where("blocks = 1").select("rep", F.xxhash64(F.lit(0), "root").alias("task"))
    large = cut(placed.where("blocks > 1").coalesce(files))
    if large.isEmpty():
        links = links_of(small)
    else:
        links = cut(links_of(small.unionByName(_stars(large, block, block_shingles))).repartition(files))  # coalesced, the texts would meet in so few tasks
        again = cut(_pairs(large, links, block, block_shingles, files).coalesce(files))
        links = links.unionByName(links_of(again, again.limit(MOST_SENT + 1).count() <= MOST_SENT))
    roots = components(links, files=files)
    by_class = classes.select("cls", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("root", "rep").alias("found"))
    out = per_doc.join(by_class, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("found")).otherwise(F.col("doc_id"))).alias("component_id"))


def _block_count(block: int, block_shingles: int):
    return F.greatest(F.ceil(F.sum("n") / block_shingles), F.ceil(F.count("*") / block)).cast("int")


def _stars(large: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """(rep, task): members of a cluster with one smallest shingle, in blocks, and the first of them in each block."""
    groups = large.groupBy("root", "low").agg(_block_count(block, block_shingles).alias("own_blocks"), F.min("rep").alias("centre"), F.count("*").alias("members")).where("members > 1")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))  # a hot group is joined in so many parts
    dealt = large.withColumn("salt", F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(16)).cast("int")).join(salted, ["root", "low", "salt"])
    task = lambda n: F.xxhash64(F.lit(1), "root", "low", n)
    rest = dealt.where("rep != centre").select("rep", task(F.pmod(F.xxhash64(F.lit(4), "rep"), F.col("own_blocks")).cast("int")).alias("task"))
    centres = groups.withColumn("nth", F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1))).select(F.col("centre").alias("rep"), task(F.col("nth")).alias("task"))
    return rest.unionByName(centres)


def _pairs(large: DataFrame, links: DataFrame, block: int, block_shingles: int, files: int) -> DataFrame:
    """(rep, task): pairs of blocks of a cluster's members, without those inside one group of the links known.

    A block is of one group, or of the many small groups of a cluster; a cluster that is one group needs none.
    """
    known = components(links, files=files)
    held = cut(large.select("root", "rep", "n").join(known.select(F.col("node").alias("rep"), F.col("root").alias("grp")), "rep", "left").withColumn("grp", F.coalesce("grp", "rep")).coalesce(files))
    groups = held.groupBy("root", "grp").agg(_block_count(block, block_shingles).alias("own_blocks"), F.count("*").alias("members"), F.sum("n").alias("n"))
    several = groups.groupBy("root").agg(F.count("*").alias("n_groups"), F.sum(F.when(F.col("own_blocks") == 1, F.col("members"))).alias("loose"), F.sum(F.when(F.col("own_blocks") == 1, F.col("n"))).alias("loose_n")).where("n_groups > 1")
    several = several.select("root", F.greatest(F.lit(1), F.ceil(F.coalesce("loose", F.lit(0)) / block), F.ceil(F.coalesce("loose_n", F.lit(0)) / block_shingles)).cast("int").alias("loose_blocks"))
    groups = cut(groups.join(several, "root").select("root", "grp", "own_blocks", "loose_blocks").coalesce(files))
    nth = F.when(F.col("own_blocks") == 1, F.pmod(F.xxhash64(F.lit(5), "grp"), F.col("loose_blocks"))).otherwise(F.pmod(F.xxhash64(F.lit(6), "rep"), F.col("own_blocks"))).cast("int")
    loose = F.lit(None).cast("long")
    placed = held.join(groups, ["root", "grp"]).select("root", "rep", F.when(F.col("own_blocks") > 1, F.col("grp")).otherwise(loose).alias("grp"), nth.alias("nth"))
    own = groups.where("own_blocks > 1").select("root", "grp", F.explode(F.sequence(F.lit(0), F.col("own_blocks") - 1)).alias("nth"))
    mixed = groups.select("root", "loose_blocks").distinct().select("root", loose.alias("grp"), F.explode(F.sequence(F.lit(0), F.col("loose_blocks") - 1)).alias("nth"))
    blocks = own.unionByName(mixed).withColumn("block", F.xxhash64("grp", "nth"))
    placed = placed.withColumn("block", F.xxhash64("grp", "nth"))
    a, b = blocks.select("root", F.col("grp").alias("ga"), F.col("block").alias("a")), blocks.select("root", F.col("grp").alias("gb"), F.col("block").alias("b"))
    tasks = a.join(b, "root").where("a <= b and (ga is null or gb is null or ga != gb)").select("root", "a", "b", F.xxhash64(F.lit(2), "root", "a", "b").alias("task"))
    ends = tasks.select("root", F.col("a").alias("block"), "task").unionByName(tasks.where("a != b").select("root", F.col("b").alias("block"), "task"))
    return placed.join(ends, ["root", "block"]).select("rep", "task")
