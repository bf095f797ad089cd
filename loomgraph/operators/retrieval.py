"""Retrieval as one plan: vector seeds, keyword hits, BM25, their neighbourhood in the graph, and one weighted score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, score, search


def tokens(*columns: str):
    """Lower-case words of some text columns together."""
    return F.regexp_extract_all(F.lower(F.concat_ws(" ", *columns)), F.lit("[a-z0-9_]+"), F.lit(0))


def fulltext(nodes: DataFrame, query: str, columns: list[str], limit: int = 20) -> DataFrame:
    """(id, score, rank): nodes (id, columns) by BM25 of a query's words; where no word is found, nodes that contain one of
    them as a part, all with score 0. Ties go by id."""
    words = [w for w in query.lower().split() if w]
    found = search.bm25(nodes.select("id", tokens(*columns).alias("tokens")), words)
    if found.isEmpty():
        found = nodes.where(search.any_contains([F.col(c) for c in columns], words)).select("id", F.lit(0.0).alias("score"))
    top = found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(limit)  # a page of results
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def retrieve(nodes: DataFrame, edges: DataFrame, points: DataFrame | None, vector: list[float] | None, words: list[str], weights: dict[str, float], k: int = 10, seeds: int = 20, depth: int = 2, expand: int = 50, columns: tuple[str, ...] = ("name", "qualified_name", "comment")) -> DataFrame:
    """(id, signals..., score) of the k best candidates.

    1. The `seeds` nearest points (id, vector), and the first `seeds` nodes that contain a word.
    2. BM25 over all nodes; a hit is a candidate of its own.
    3. The ten best seeds, by vector score, then keyword hits, are expanded through the graph; the `expand` nearest new
       nodes count by their distance.
    4. Semantic and keyword signals are scaled over the candidates; all are weighed into one score, ties by id.
    """
    keyword = nodes.where(search.any_contains([F.col(c) for c in columns], words)).select("id").orderBy("id").limit(seeds).withColumn("keyword", F.lit(1.0))
    ranked = keyword.select("id", F.lit(0.0).alias("s"))
    sources = [keyword, search.bm25(nodes.select("id", tokens(*columns).alias("tokens")), words).select("id", F.round("score", 6).alias("bm25"))]
    if points is not None and vector is not None:
        semantic = search.knn(points, vector, seeds).select(F.col("id").cast("string").alias("id"), F.col("score").alias("semantic"))
        sources.append(semantic)
        ranked = ranked.unionByName(semantic.select("id", F.col("semantic").alias("s")).where("s > 0"))
    start = ranked.groupBy("id").agg(F.max("s").alias("s")).orderBy(F.desc("s"), "id").limit(10).select("id")
    near = graph.bfs(edges, start, depth, "both").where("depth > 0").orderBy("depth", "id").limit(expand)
    sources.append(near.select("id", graph.hop_proximity(F.col("depth")).alias("graph")))
    names = ["semantic", "keyword", "graph", "bm25"]
    full = [s.select("id", *[(F.col(n) if n in s.columns else F.lit(None)).cast("double").alias(n) for n in names]) for s in sources]
    union = full[0]
    for s in full[1:]:
        union = union.unionByName(s)
    merged = union.groupBy("id").agg(*[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names])
    scaled = score.min_max(merged, ["semantic", "keyword"])
    own = {"freshness": F.lit(0.3), "confidence": F.lit(0.0), "usage": F.lit(0.0)}
    scaled = scaled.withColumns({n: c for n, c in own.items()})
    return scaled.withColumn("score", score.weighted(weights)).orderBy(F.desc("score"), "id").limit(k)
