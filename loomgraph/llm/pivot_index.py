"""Embedding near-dedup with a pivot-permutation index.

Pivots are vectors drawn from a bounded sample. Each vector is described by its nearest pivots in order. It is entered
in the inverted lists of its first `lists` pivots; two entries of a list are candidates if the vectors share at least
`shared` of their first `prefix` pivots; candidates are verified by cosine in double precision. A pair is counted in
the list of the smallest pivot that both are entered under, so it is counted once.

Each dimension has a sample of its own. One with at most `pivots` classes gets a single pivot, so that all its vectors are
in one list and every pair of a label is verified.

Vectors that are equal bit by bit and have one label form a class that is indexed once. A long list is cut into blocks
of `block` entries, and every two blocks meet in a task of their own, so no task holds more than two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, width

#: Parts in which the entries of a list meet the list's number of blocks.
SALTS = 16


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Indices of the `prefix` nearest pivots of unit vectors x, nearest first."""
    out = np.empty((len(x), min(prefix, len(pivots))), np.int16)
    for lo in range(0, len(x), 1024):
        far = -(x[lo : lo + 1024] @ pivots.T)
        at = np.argpartition(far, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
        out[lo : lo + 1024] = np.take_along_axis(at, np.argsort(np.take_along_axis(far, at, 1), axis=1, kind="stable"), 1)
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def _describe(pivots, prefix: int, lists: int):
    """(cls, label, dim, embedding) -> one row for each list that a vector enters, with its permutation prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                p = pivots.value.get(int(dim))
                rows = b.filter(pa.array(dims == dim))
                x = _vectors(rows.column("embedding")).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                near = nearest_pivots(x, p, prefix)
                enter = near[:, :lists]
                at = np.repeat(np.arange(len(x)), enter.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("cls").take(pa.array(at)), rows.column("label").take(pa.array(at)), rows.column("dim").take(pa.array(at)), pa.array(enter.ravel().astype(np.int32)), rows.column("copies").take(pa.array(at)), pa.array([near[i].tobytes() for i in at], pa.binary()), rows.column("embedding").take(pa.array(at))],
                    names=["cls", "label", "dim", "pivot", "copies", "near", "embedding"],
                )

    return run


def pair_counts(x: np.ndarray, near: np.ndarray, copies: np.ndarray, side: np.ndarray, pivot: int, lists: int, shared: int, limit: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each vector, weighed by copies, and a spanning forest of them. side: 0 and 1 for two blocks whose
    pairs across are wanted, 2 for all pairs of one block."""
    n = len(x)
    shared = min(shared, near.shape[1])  # a dimension can have fewer pivots
    known, place = np.unique(near, return_inverse=True)  # only pivots that occur here
    place = place.reshape(near.shape)
    member = np.zeros((n, len(known)), np.float32)
    np.put_along_axis(member, place, 1, axis=1)
    entered = np.zeros((n, len(known)), np.float32)
    np.put_along_axis(entered, place[:, :lists], 1, axis=1)
    smaller = entered[:, : int(np.searchsorted(known, pivot))]
    links, forest, group = np.zeros(n, np.int64), [], np.arange(n)
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side != 2).all() else (np.arange(n),) * 2
    for lo in range(0, len(left), 512):
        a = left[lo : lo + 512]
        ok = (member[a] @ member[right].T) >= shared
        ok &= (smaller[a] @ smaller[right].T) == 0  # else the pair is counted in a smaller pivot's list
        if left is right:
            ok &= a[:, None] != right[None, :]
        ok &= x[a] @ x[right].T >= limit
        links[a] += ok @ copies[right]
        if left is not right:
            links[right] += ok.T @ copies[a]
        for i in np.flatnonzero(ok.any(1)).tolist():
            to = right[ok[i]]
            for name, at in zip(*np.unique(group[to], return_index=True), strict=True):
                if name != group[a[i]]:
                    forest.append((int(a[i]), int(to[at])))
                    group[group == name] = group[a[i]]
    return links, forest


def _list_links(lists: int, shared: int, limit: float):
    """Entries sorted by task -> (cls, n) links and (cls, other) edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            x = _vectors(t.column("embedding").combine_chunks() if isinstance(t.column("embedding"), pa.ChunkedArray) else t.column("embedding")).astype(np.float64)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            near = np.frombuffer(b"".join(t.column("near").to_pylist()), np.int16).reshape(len(x), -1)
            cls = t.column("cls").to_numpy()
            links, forest = pair_counts(x, near, t.column("copies").to_numpy(), t.column("side").to_numpy(), t.column("pivot")[0].as_py(), lists, shared, limit)
            some = np.flatnonzero(links)
            n = len(some) + len(forest)
            if n:
                edges = np.array(forest, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([cls[some], cls[edges[:, 0]]])), pa.array(np.concatenate([links[some], np.zeros(len(edges), np.int64)])), pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(cls[edges[:, 1]])])], names=["cls", "n", "other"]
                )

        for b in batches:
            tasks = b.column("task").to_numpy()
            starts = np.flatnonzero(np.diff(tasks, prepend=tasks[:1] - 1)) if len(tasks) else []
            for lo, hi in zip(starts, [*starts[1:], len(tasks)], strict=True):
                if key is not None and tasks[lo] != key:
                    yield from close()
                    held = []
                key = tasks[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from close()

    return run


def pivot_count(classes: int, least: int, most: int) -> int:
    """Pivots for so many distinct vectors: their square root, so that the lists' lengths grow with the root as well."""
    return min(max(least, math.isqrt(classes)), most)


def embedding_near_dedup(vectors: DataFrame, limit: float = 0.98, pivots: int = 128, most_pivots: int = 4096, prefix: int = 16, lists: int = 4, shared: int = 8, sample: int = 16_384, block: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label; more are ignored).

    Only rows of one non-null label and one dimension are compared. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing. n_links counts other rows with cosine >= limit that the index finds;
    component_id is the smallest vec_id reachable; kept says whether it is the row's own. Rows given twice are copies
    of each other and link; different vectors under one vec_id are vectors of their own. A row with null vec_id links with
    nothing. A dimension has from `pivots` to `most_pivots` pivots, by the square root of its distinct vectors; `sample`
    bounds the vectors that they are drawn from. Every row is indexed.
    """
    spark = vectors.sparkSession
    parts = width(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    is_usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & (norm > 0) & (norm < float("inf")), F.lit(False))
    usable = rows.where(is_usable).withColumn("key", F.sha2(F.concat_ws("|", "label", F.col("embedding").cast("string")), 256))
    # numbers of classes are drawn once and kept: a lost task reads them again, it doesn't draw them anew
    classes = cut(usable.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("cls", F.monotonically_increasing_id()))
    one = classes.select("cls", "label", F.size("embedding").alias("dim"), "copies", "embedding")
    by_dim: dict[int, np.ndarray] = {}
    for dim, total in sorted((r.dim, r["count"]) for r in one.groupBy("dim").count().collect()):
        wanted = pivot_count(total, pivots, most_pivots)
        drawn = max(sample * 384 // max(dim, 384), wanted + 1)  # of wide vectors fewer
        pool = one.where(F.col("dim") == dim).orderBy(F.xxhash64("embedding"), "embedding").limit(drawn).select("embedding").toArrow().combine_chunks()
        x = _vectors(pool.column("embedding").chunk(0)).copy()
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        chosen = [0]  # farthest first: each pivot is the vector least like those before it
        most = x @ x[0]
        while len(chosen) < (wanted if len(x) > wanted else 1):
            chosen.append(int(most.argmin()))
            most = np.maximum(most, x @ x[chosen[-1]])
        by_dim[dim] = x[chosen]
    sent = spark.sparkContext.broadcast(by_dim)
    entries = one.mapInArrow(_describe(sent, prefix, lists), "cls long, label string, dim int, pivot int, copies long, near binary, embedding array<double>")
    entries = cut(entries.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")))
    list_key = ["label", "dim", "pivot"]
    place = entries.groupBy(*list_key).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    place = place.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a hot list is joined in so many parts
    dealt = entries.join(place, [*list_key, "salt"]).withColumn("own", F.pmod(F.xxhash64(F.lit(5), "cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.xxhash64(*list_key, F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    dealt = dealt.select(task.alias("task"), side.cast("int").alias("side"), "cls", "pivot", "copies", "near", "embedding")
    found = cut(dealt.repartition(parts, "task").sortWithinPartitions("task", "cls").mapInArrow(_list_links(lists, shared, limit), "cls long, n long, other long"))
    links = found.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = components(found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    named = classes.join(links, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "cls").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    solved = named.join(least, "root").select("key", "n_links", "component_id")
    linked = usable.select("vec_id", "key").join(solved, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where(~is_usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
