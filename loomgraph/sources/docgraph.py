"""The document graph and its passages as tables: upserts of one batch, lookups, projects with repositories, reset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug
from .sinks import upsert


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities (id, name, type, name_norm): the first name stays, type and normalised name are the new ones."""
    return upsert(old, new, ["id"], first_wins=("name",))


def has_entity(mentions: DataFrame) -> DataFrame:
    """(source_id, paragraph_id, entity, confidence, start_char, surface, n): one edge for each passage and entity, with its
    primary mention: the surest, of equals the first."""
    order = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.coalesce("start_char", F.lit(10**9)).alias("s"), "confidence", "start_char", "surface")
    best = mentions.groupBy("source_id", "paragraph_id", "entity").agg(F.min(order).alias("m"), F.count("*").alias("n"))
    return best.select("source_id", "paragraph_id", "entity", "m.confidence", "m.start_char", "m.surface", "n")


def related(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges (source, target, type, source_id, paragraph_id) between known entities (id), each once a passage and type."""
    ids = entities.select("id")
    inside = relations.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return inside.select("source", "target", "type", "source_id", "paragraph_id").distinct()


def ingest(tables: dict[str, DataFrame], paragraphs: DataFrame, entities: DataFrame, mentions: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """The tables documents (id, name), paragraphs (source_id, paragraph_id, text, short, props), entities, has_entity and
    related after a batch. Entries of a paragraph's props are laid over those it had."""
    named = paragraphs.select(F.col("source_id").alias("id"), F.col("source_id").alias("name")).distinct()
    merged = upsert(tables["paragraphs"], paragraphs.select("source_id", "paragraph_id", "text", "short"), ["source_id", "paragraph_id"])
    more = paragraphs.select("source_id", "paragraph_id", F.col("props").alias("more"))
    old = F.coalesce(F.col("props"), F.create_map().cast("map<string,string>"))
    laid = F.when(F.col("more").isNull(), F.col("props")).otherwise(F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys("more"), k)), "more"))
    merged = merged.join(more, ["source_id", "paragraph_id"], "left").withColumn("props", laid).drop("more")
    found = upsert_entities(tables["entities"], entities)
    edges = upsert(tables["has_entity"], has_entity(mentions), ["source_id", "paragraph_id", "entity"])
    links = tables["related"].unionByName(related(relations, found)).distinct()
    return {"documents": upsert(tables["documents"], named, ["id"]), "paragraphs": merged, "entities": found, "has_entity": edges, "related": links}


def passage_points(paragraphs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Points (source_id, paragraph_id, vector, payload) of embedded paragraphs (source_id, paragraph_id, text, vector), their
    entities and primary mentions in the payload."""
    lists = has_entity(mentions).groupBy("source_id", "paragraph_id").agg(F.array_sort(F.collect_list(F.struct("entity", "confidence", "start_char", "surface"))).alias("entity_mentions"))
    rows = paragraphs.join(lists, ["source_id", "paragraph_id"], "left")
    entities = F.coalesce(F.transform("entity_mentions", lambda m: m["entity"]), F.array().cast("array<string>"))
    return rows.select("source_id", "paragraph_id", "vector", F.struct("text", entities.alias("entity_ids"), "entity_mentions").alias("payload"))


def paragraphs_by_key(paragraphs: DataFrame, keys: DataFrame) -> DataFrame:
    return paragraphs.join(keys.select("source_id", "paragraph_id").distinct(), ["source_id", "paragraph_id"], "left_semi")


def entities_by_id(entities: DataFrame, ids: DataFrame) -> DataFrame:
    return entities.join(ids.select("id").distinct(), "id", "left_semi")


def project_graph(projects: DataFrame, repositories: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projects (id, name, slug, created), repositories (name, project, created) and HAS_REPOSITORY edges (src, dst) after
    new rows (project, project_name, repository, at): names and slugs follow the new rows, the first times and a
    repository's first project stay."""
    p = new.groupBy(F.col("project").alias("id")).agg(F.max("project_name").alias("name"), F.min("at").alias("created")).withColumn("slug", slug(F.col("name")))
    r = new.groupBy(F.col("repository").alias("name")).agg(F.min_by("project", F.struct("at", "project")).alias("project"), F.min("at").alias("created"))
    edges = new.select(F.col("project").alias("src"), F.col("repository").alias("dst")).distinct()
    return upsert(projects, p.select("id", "name", "slug", "created"), ["id"], first_wins=("created",)), upsert(repositories, r, ["name"], first_wins=("project", "created")), edges


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a JSON file {"messages": [{...}, ...]}: the fall-back source where no table has them. Entries that are no
    objects go; a file of another shape has none."""
    raw = spark.read.text(path, wholetext=True)
    kind = "struct<id: string, name: string, sender: string, receiver: string, payload: string, file: string, line: int, confidence: double>"
    each = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.messages"), "array<string>")).alias("m")).where("m like '{%'")
    return each.select(F.from_json("m", kind).alias("m")).select("m.*")


def parse_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(path, signature, parsed): files (path, modified, length) with what the cache (path, signature, parsed) has for their
    signature of time and size; null where the file has to be parsed again."""
    rows = files.select("path", F.concat_ws(":", F.col("modified").cast("string"), F.col("length").cast("string")).alias("signature"))
    return rows.join(cache.select("path", "signature", "parsed"), ["path", "signature"], "left")


def reset(spark: SparkSession, paths: list[str]) -> None:
    """Delete all tables below the paths."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
