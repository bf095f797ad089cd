"""Connected components of an edge table by alternating large and small stars; nothing is gathered on the driver.

Rounds end as soon as at most `SMALL` edges are left: so few fit a single task of a few megabytes, which saves the
shuffles of the last rounds. A larger table goes through further rounds, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

SMALL = 100_000


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of at most SMALL edges -> (node, root), by hooking to the smaller root and halving paths."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if len(b)]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        if np.array_equal(new, root):
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", files: int | None = None) -> DataFrame:
    """(node, root) for every node of an edge between two different nodes; root is the smallest node reachable.

    Nulls, loops and repeated edges are ignored. An empty table gives no rows. Each round joins every edge with
    the smallest neighbour of its end, a map-side combined aggregate, so a node with very many edges costs one
    skew-splittable join, never a list of its neighbours. A round is kept in `files` partitions at most.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    kept = lambda df: cut(df.coalesce(files) if files else df)
    e = kept(e)
    while True:  # ends: a round that changes nothing follows after some log of the longest path
        if e.limit(SMALL + 1).count() <= SMALL:
            return e.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).coalesce(1).mapInArrow(_solve, "node long, root long")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        nxt = kept(small)
        if nxt.exceptAll(e).isEmpty() and e.exceptAll(nxt).isEmpty():
            break
        e = nxt
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
