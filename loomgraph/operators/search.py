"""Search: substring and token predicates, BM25, exact vector top-k, and merging of collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def any_contains(columns: list[Column], terms: list[str], ignore_case: bool = True) -> Column:
    """Whether one of the columns contains one of the terms; nulls count as empty."""
    texts = [F.coalesce(c, F.lit("")) for c in columns]
    texts = [F.lower(t) for t in texts] if ignore_case else texts
    terms = [t.strip().lower() if ignore_case else t for t in terms if t.strip()]
    out = F.lit(False)
    for t in texts:
        for term in terms:
            out = out | F.contains(t, F.lit(term))
    return out


def or_terms(query: str) -> list[str]:
    """Terms of a query separated by |."""
    return [t.strip() for t in query.split("|") if t.strip()]


def bm25(docs: DataFrame, query: list[str], k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(id, score): Okapi BM25 of docs (id, tokens array) for query tokens, divided by the highest score; above 0 only.

    A token in more than half of the documents would have a negative weight; it gets `floor` times the mean weight of
    all tokens instead. Only rows with a query token are joined; statistics are two aggregates over the whole table.
    """
    terms = docs.select("id", F.explode("tokens").alias("token"))
    stats = docs.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean_length"))
    weight = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    df = terms.distinct().groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats)).withColumn("idf", weight)
    mean = df.agg(F.avg("idf").alias("mean_idf"))
    asked = df.where(F.col("token").isin(query)).crossJoin(F.broadcast(mean)).select("token", "n", "mean_length", F.when(F.col("idf") < 0, floor * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    times = docs.sparkSession.createDataFrame([(t, query.count(t)) for t in sorted(set(query))], "token string, asked int")
    tf = docs.select("id", F.size("tokens").alias("length"), F.explode(F.filter("tokens", lambda t: t.isin(query))).alias("token")).groupBy("id", "length", "token").agg(F.count("*").alias("tf"))
    part = F.col("asked") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    scores = tf.join(F.broadcast(asked.join(times, "token")), "token").groupBy("id").agg(F.sum(part).alias("raw")).where("raw > 0")
    top = scores.agg(F.max("raw").alias("top"))
    return scores.crossJoin(F.broadcast(top)).select("id", (F.col("raw") / F.col("top")).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def knn(points: DataFrame, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """(id, score, ...) of the k points (id, vector, ...) most like a query vector; a filter comes first, ties go by id.

    Points of another dimension are left out. One pass and a bounded heap per task (TakeOrderedAndProject).
    """
    rows = points if where is None else points.where(where)
    rows = rows.where(F.size("vector") == len(query))
    vector = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", F.round(cosine(F.col("vector"), vector), 6)).where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def knn_join(queries: DataFrame, points: DataFrame, k: int, block: int = 1000, most_queries: int = 100_000) -> DataFrame:
    """(query_id, id, score, rank) of the k points most like each query (query_id, vector); exact.

    Queries are a stated set against all rows: each task takes them in blocks against every batch of its points, in a
    numpy product, and keeps the best k of each query from batch to batch, so what is shuffled is k rows per query and
    task. The queries are sent to all tasks, so their number is checked: over most_queries this raises a ValueError,
    and the caller deals them out in parts.
    """
    import numpy as np
    import pandas as pd

    spark = points.sparkSession
    if queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"over {most_queries} queries at once")
    asked = queries.orderBy("query_id").toPandas()
    if asked.empty:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int")
    ids = asked["query_id"].to_numpy()
    matrix = np.array(asked["vector"].tolist(), np.float64)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    sent = spark.sparkContext.broadcast((ids, matrix))

    def run(batches):
        ids, matrix = sent.value
        kept: list[tuple] = [()] * -(-len(ids) // block)  # of each block of queries: ids and scores, the best first
        parts = (pdf.iloc[i : i + block] for pdf in batches for i in range(0, len(pdf), block))
        for pdf in parts:  # block x block scores at a time, whatever the size of a batch
            x = np.array(pdf["vector"].tolist(), np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            own = pdf["id"].to_numpy()
            order = np.argsort(own, kind="stable")
            x, own = x[order], own[order]
            for i in range(len(kept)):
                score = np.round(matrix[i * block : (i + 1) * block] @ x.T, 6)
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                near, score = own[best], np.take_along_axis(score, best, 1)
                if kept[i]:
                    near, score = np.hstack([kept[i][0], near]), np.hstack([kept[i][1], score])
                    best = np.lexsort((near, -score), axis=1)[:, :k]
                    near, score = np.take_along_axis(near, best, 1), np.take_along_axis(score, best, 1)
                kept[i] = near, score
        for i, (near, score) in enumerate(x for x in kept if x):
            rows = np.repeat(np.arange(len(near)), near.shape[1])
            yield pd.DataFrame({"query_id": ids[i * block : (i + 1) * block][rows], "id": near.ravel(), "score": score.ravel()})

    found = points.select("id", "vector").mapInPandas(run, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge_collections(points: DataFrame, query: list[float], per_collection: int, k: int) -> DataFrame:
    """(id, score): top points of each collection (id, vector, collection), the best score of each id, then the top k."""
    rows = points.where(F.size("vector") == len(query))
    scored = rows.select("id", "collection", F.round(cosine(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])), 6).alias("score"))
    w = Window.partitionBy("collection").orderBy(F.desc("score"), "id")
    best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_collection)
    return best.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hash_vector(tokens: Column, size: int = 1024) -> Column:
    """Token counts by sha1 bucket, in unit length; size is a power of two up to 4096."""
    bucket = F.transform(tokens, lambda t: F.conv(F.substring(F.sha1(t), -3, 3), 16, 10).cast("int") % size)
    counts = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(bucket, lambda b: b == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(norm == 0, counts).otherwise(F.transform(counts, lambda v: v / norm))


def hash_buckets(texts: DataFrame, size: int = 1024) -> DataFrame:
    """(id, bucket, value): the sparse form of hash_vector, for long texts (id, text)."""
    tokens = texts.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[A-Za-z0-9_:.]+"), F.lit(0))).alias("token"))
    counts = tokens.groupBy("id", "token").agg(F.count("*").alias("c"))
    counts = counts.withColumn("bucket", (F.conv(F.substring(F.sha1("token"), -3, 3), 16, 10).cast("int") % size)).groupBy("id", "bucket").agg(F.sum("c").alias("c"))
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    return counts.join(norms, "id").select("id", "bucket", F.round(F.col("c") / F.col("norm"), 6).alias("value"))


def mean_pool(chunks: DataFrame) -> DataFrame:
    """(id, vector): the mean of chunk vectors (id, vector), by place."""
    long = chunks.select("id", F.posexplode("vector").alias("place", "value"))
    means = long.groupBy("id", "place").agg(F.avg(F.col("value").cast("double")).alias("value"))
    return means.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("vector"))
