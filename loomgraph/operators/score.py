"""Ranking math: normalised signals, weight profiles, hybrid scores, reranking, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNALS = ["semantic", "keyword", "graph", "freshness", "confidence", "usage"]
#: Weights by query intent, in the order of SIGNALS
PROFILES = {
    "default": [0.35, 0.20, 0.20, 0.10, 0.10, 0.05],
    "semantic": [0.50, 0.15, 0.10, 0.05, 0.15, 0.05],
    "structural": [0.20, 0.10, 0.50, 0.05, 0.10, 0.05],
    "temporal": [0.20, 0.15, 0.10, 0.45, 0.05, 0.05],
}


def profile(intent: str, override: dict[str, float] | None = None, bm25: float = 0.0) -> dict[str, float]:
    """Weights of an intent, overridden, with their sum at 1."""
    w = dict(zip(SIGNALS, PROFILES.get(intent, PROFILES["default"]), strict=True)) | ({"bm25": bm25} if bm25 else {}) | (override or {})
    total = sum(w.values()) or 1.0
    return {k: v / total for k, v in w.items()}


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0 .. 1 over the whole table; 0 everywhere if all values are equal. One aggregate of one row."""
    bounds = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(bounds))
    for c in columns:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        out = out.withColumn(c, F.when(hi == lo, 0.0).otherwise(F.round((F.col(c) - lo) / (hi - lo), 6)))
    return out.drop(*[f"{n}_{c}" for c in columns for n in ("lo", "hi")])


def bounded(value: Column, lo: float, hi: float) -> Column:
    """A value of a known range as 0 .. 1; null and NaN become 0."""
    v = F.nanvl(F.coalesce(value.cast("double"), F.lit(lo)), F.lit(lo))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo))), 6)


def freshness(age_seconds: Column, half_life_days: float = 30.0, dirty: Column | None = None) -> Column:
    """Halves with each half life; 1 where dirty, 0.3 where the age is unknown."""
    value = F.round(F.exp(-F.log(F.lit(2.0)) * F.greatest(age_seconds, F.lit(0.0)) / (half_life_days * 86400)), 6)
    value = F.coalesce(value, F.lit(0.3))
    return value if dirty is None else F.when(dirty, 1.0).otherwise(value)


def weighted(weights: dict[str, float]) -> Column:
    """The weighted sum of the signal columns; a missing signal counts 0."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.lit(w) * F.coalesce(F.col(name), F.lit(0.0))
    return F.round(total, 6)


def inject(candidates: DataFrame, signals: DataFrame, names: list[str], key: str = "id") -> DataFrame:
    """Candidates with signals laid over them: where the right side has a value, it counts."""
    right = signals.select(key, *[F.col(n).alias(f"new_{n}") for n in names])
    out = candidates.join(right, key, "left")
    for n in names:
        out = out.withColumn(n, F.coalesce(f"new_{n}", n) if n in candidates.columns else F.col(f"new_{n}"))
    return out.drop(*[f"new_{n}" for n in names])


def hybrid(sources: list[DataFrame], weights: dict[str, float], k: int) -> DataFrame:
    """(id, signals..., score): candidates of all sources (id and any signals), the highest of each signal, top k."""
    names = list(weights)
    full = [s.select("id", *[(F.col(n) if n in s.columns else F.lit(None)).cast("double").alias(n) for n in names]) for s in sources]
    union = full[0]
    for s in full[1:]:
        union = union.unionByName(s)
    merged = union.groupBy("id").agg(*[F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names])
    return merged.withColumn("score", weighted(weights)).orderBy(F.desc("score"), "id").limit(k)


def result_confidence(ranked: DataFrame, top: int = 5) -> DataFrame:
    """The mean of the highest scores, rounded to three places."""
    return ranked.orderBy(F.desc("score"), "id").limit(top).agg(F.round(F.avg("score"), 3).alias("confidence"), F.count("*").alias("n"))


def rerank(types: list[str], entity: float = 0.05, kind: float = 0.1, confidence: float = 0.3, penalty: float = 0.0002) -> Column:
    """A passage's score with bonuses for its mentions (array of id, type, confidence) and a penalty for its length."""
    ids = F.size(F.array_distinct(F.transform("mentions", lambda m: m["id"])))
    hits = F.size(F.filter("mentions", lambda m: m["type"].isin(types)))
    known = F.filter("mentions", lambda m: m["confidence"].isNotNull())
    mean = F.when(F.size(known) == 0, 0.0).otherwise(F.aggregate(known, F.lit(0.0), lambda s, m: s + m["confidence"]) / F.size(known))
    return F.round(F.col("score") + entity * ids + kind * hits + confidence * mean - penalty * F.length("text"), 6)


def function_confidence(naming: Column, type_: Column, usage: Column, body: Column, exported: Column, short: Column, generic: Column) -> Column:
    """Weighted signals; a bonus for exported, discounts for short and generic names."""
    base = 0.4 * naming + 0.2 * type_ + 0.3 * usage + 0.1 * body
    base = base + F.when(exported, 0.03).otherwise(0.0)
    base = base * F.when(short, 0.75).otherwise(1.0) * F.when(generic, 0.85).otherwise(1.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base)), 4)


def resolved_intent() -> Column:
    """The intent of the first signal that is strong enough: usage, type, name, body."""
    return F.when(F.col("usage") >= 0.5, F.col("usage_intent")).when(F.col("type") >= 0.65, F.col("type_intent")).when(F.col("naming") >= 0.6, F.col("naming_intent")).when(F.col("body") >= 0.5, F.col("body_intent")).otherwise("unknown")


def vote(sites: DataFrame) -> DataFrame:
    """(callee, pattern, n, sites, ratio): the commonest pattern of each callee's sites (callee, pattern); ties by name."""
    counts = sites.groupBy("callee", "pattern").agg(F.count("*").alias("n"))
    best = counts.groupBy("callee").agg(F.sum("n").alias("sites"), F.min(F.struct((-F.col("n")).alias("k"), F.col("pattern").alias("pattern"))).alias("best"))
    n = -F.col("best.k")
    return best.select("callee", F.col("best.pattern").alias("pattern"), n.alias("n"), "sites", F.round(n / F.col("sites") * F.when(F.col("sites") == 1, 0.7).otherwise(1.0), 4).alias("ratio"))
