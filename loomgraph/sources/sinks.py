"""Upserts, deletes and reports over tables of nodes, edges and points. Each returns the new table; write() stores it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], first_wins: tuple[str, ...] = ()) -> DataFrame:
    """Old rows with new rows of equal keys laid over them; null in new keeps the old value, as in first_wins columns.

    One full join on the keys, of the new rows after they have been reduced to one a key (the last by all columns).
    """
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in new.columns if c not in keys] or [F.lit(1)])
    one = new.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    rest = [c for c in old.columns if c not in keys]
    right = one.select(*keys, *[F.col(c).alias(f"new_{c}") if c in one.columns else F.lit(None).alias(f"new_{c}") for c in rest])
    joined = old.join(right, keys, "full")
    return joined.select(*keys, *[(F.coalesce(c, f"new_{c}") if c in first_wins else F.coalesce(f"new_{c}", c)).alias(c) for c in rest]).select(*old.columns)


def add_counts(old: DataFrame, new: DataFrame, keys: list[str], count: str = "count") -> DataFrame:
    """Counted edges: old (keys, count) plus one for each new row (keys)."""
    more = new.select(*keys, F.lit(1).cast("long").alias(count))
    return old.select(*keys, F.col(count).cast("long").alias(count)).unionByName(more).groupBy(*keys).agg(F.sum(count).alias(count))


def merge_properties(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (keys, props map): entries of new rows replace those of equal name."""
    keep = F.map_filter("props", lambda k, v: ~F.array_contains(F.map_keys("more"), k))
    joined = old.join(new.select(*keys, F.col("props").alias("more")), keys, "full")
    both = F.when(F.col("more").isNull(), F.col("props")).when(F.col("props").isNull(), F.col("more")).otherwise(F.map_concat(keep, "more"))
    return joined.select(*keys, both.alias("props"))


def existing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def delete_files(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of the given files (file) and the edges at them."""
    gone = nodes.join(paths.select("file"), "file", "left_semi").select("id")
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti").select(nodes.columns), left.select(edges.columns)


def prune_orphans(nodes: DataFrame, edges: DataFrame, label: str, rel_type: str) -> DataFrame:
    """Nodes without those of a label that no edge of a type leads to."""
    used = edges.where(F.col("rel_type") == rel_type).select(F.col("dst").alias("id"))
    orphans = nodes.where(F.col("label") == label).join(used, "id", "left_anti").select("id")
    return nodes.join(orphans, "id", "left_anti").select(nodes.columns)


def replace_scope(old: DataFrame, new: DataFrame, scope: list[str]) -> DataFrame:
    """Old rows of other scopes (such as a project) and the new rows: delete all of a scope, then write it."""
    return old.join(new.select(*scope).distinct(), scope, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def checked_vectors(points: DataFrame, dimension: int) -> DataFrame:
    """Points; a vector of another dimension stops the job with an error."""
    wrong = F.raise_error(F.format_string("vector of %d numbers; the collection has %d", F.size("vector"), F.lit(dimension)))
    return points.withColumn("vector", F.when(F.size("vector") == dimension, F.col("vector")).otherwise(wrong))


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", by: list[str] | None = None) -> None:
    """Write a table or a report (parquet, json, csv, orc) below path, by folders of `by`; other folders stay as they are
    when mode is `replace`."""
    w = df.write.format(kind).mode("overwrite" if mode == "replace" else mode)
    if kind == "csv":
        w = w.option("header", "true")
    if mode == "replace":
        w = w.option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(*by) if by else w).save(path)
