"""Documents: paragraphs, entities and mentions, relation expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_name
from ..session import cut


def paragraphs(docs: DataFrame, most: int = 1200, least: int = 150) -> DataFrame:
    """(id, para, chunk, text, short): texts cut at blank lines, long paragraphs into pieces of `most` characters."""
    blocks = docs.select("id", F.posexplode(F.filter(F.transform(F.split("text", r"\n\s*\n+"), lambda p: F.trim(p)), lambda p: p != "")).alias("para", "block"))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("block") / most).cast("int") - 1, F.lit(0)))
    pieces = blocks.select("id", "para", "block", F.posexplode(starts).alias("chunk", "n")).select("id", "para", "chunk", F.trim(F.substring(F.col("block"), F.col("n") * most + 1, F.lit(most))).alias("text"))
    return pieces.where("text != ''").withColumn("short", F.length("text") < least)


def merge_entities(mentions: DataFrame) -> DataFrame:
    """(key, type, name, name_norm, confidence, n): entities of mentions (pos, name, type, confidence) by type and
    normalised name; the longest spelling counts, the first of equals."""
    rows = mentions.withColumn("name", F.trim("name")).where("name is not null and name != ''").withColumn("type", F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("UNKNOWN")))
    rows = rows.withColumn("name_norm", entity_name(F.col("name"))).where("name_norm != ''")
    best = F.max(F.struct(F.length("name").alias("l"), (-F.col("pos")).alias("p"), F.col("name").alias("name")))
    merged = rows.groupBy("type", "name_norm").agg(best.alias("best"), F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    return merged.select(F.concat_ws("::", "type", "name_norm").alias("key"), "type", F.col("best.name").alias("name"), "name_norm", "confidence", "n")


def link_relations(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """(source_key, target_key, type): relation ends by normalised name, to the entity that came first; else UNKNOWN."""
    rows = mentions.withColumn("type", F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("UNKNOWN"))).withColumn("norm", entity_name(F.col("name"))).where("norm != ''")
    first = rows.groupBy("norm").agg(F.min(F.struct("pos", F.concat_ws("::", "type", "norm").alias("key"))).alias("f")).select("norm", F.col("f.key").alias("key"))
    r = relations.select(entity_name(F.col("source")).alias("s"), entity_name(F.col("target")).alias("t"), F.coalesce(F.nullif(F.trim("relation"), F.lit("")), F.lit("RELATED")).alias("type")).where("s != '' and t != ''")
    r = r.join(first.select(F.col("norm").alias("s"), F.col("key").alias("sk")), "s", "left").join(first.select(F.col("norm").alias("t"), F.col("key").alias("tk")), "t", "left")
    return r.select(F.coalesce("sk", F.concat(F.lit("UNKNOWN::"), F.col("s"))).alias("source_key"), F.coalesce("tk", F.concat(F.lit("UNKNOWN::"), F.col("t"))).alias("target_key"), "type")


def primary_mention(mentions: DataFrame) -> DataFrame:
    """One mention of each entity (entity, start_char, confidence, ...): the surest, of equals the first."""
    order = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.coalesce("start_char", F.lit(10**9)).alias("s"), *mentions.columns)
    return mentions.groupBy("entity").agg(F.min(order).alias("m")).select(*[F.col(f"m.{c}").alias(c) for c in mentions.columns])


def expandable(passages: DataFrame, least_score: float | None, least_times: int) -> DataFrame:
    """(entity, n): entities of passages (score, entities array) worth expanding; none if no score reaches least_score."""
    counts = passages.select("score", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n")).where(F.col("n") >= least_times)
    if least_score is None:
        return counts
    top = passages.agg(F.max("score").alias("top")).where((F.col("top") >= least_score) | F.col("top").isNull())
    return counts.crossJoin(F.broadcast(top.select(F.lit(1).alias("one")))).drop("one")


def expand_relations(relations: DataFrame, seeds: DataFrame, depth: int, budget: int, types: list[str] | None = None) -> DataFrame:
    """(source, relation, target, hop) of undirected relations (source, relation, target[, source_type, target_type])
    around seeds (id): frontier by frontier, each relation once in the orientation met first, `budget` in all."""
    rows = relations if not types else relations.where(F.col("source_type").isin(types) | F.col("target_type").isin(types))
    both = rows.select("source", "relation", "target").unionByName(rows.select(F.col("target").alias("source"), "relation", F.col("source").alias("target"))).distinct()
    frontier = cut(seeds.select("id").distinct())
    seen, left, found = frontier, budget, []
    for hop in range(1, depth + 1):
        step = both.join(frontier, both["source"] == frontier["id"], "left_semi")
        for f in found:
            step = step.join(f, ["source", "relation", "target"], "left_anti")
        step = cut(step.withColumn("hop", F.lit(hop)))
        n = step.count()
        if n > left:  # only then are rows put in order
            step, n = cut(step.orderBy("source", "relation", "target").limit(left)), left
        if not n:
            break
        found.append(step)
        left -= n
        frontier = cut(step.select(F.col("target").alias("id")).distinct().join(seen, "id", "left_anti"))
        if left <= 0 or frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return reduce(DataFrame.unionByName, found) if found else both.withColumn("hop", F.lit(0)).limit(0)
