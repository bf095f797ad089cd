"""A corpus pipeline: language ID, near-duplicate removal, repeated-passage removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet into the shared
folder and reads it again for the next stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.bpe_codec import bpe_codec
from loomgraph.llm.fm_decontaminate import fm_decontaminate
from loomgraph.llm.language_id import language_id
from loomgraph.llm.ngram_jaccard_join import ngram_jaccard_join
from loomgraph.llm.shared import checkpoint_dir, quoted, restored
from loomgraph.llm.suffix_dedup import suffix_dedup


def _others(docs: DataFrame, *but: str) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in but)


def _as_given(found: DataFrame, docs: DataFrame, carry: tuple[str, ...], **own: Column) -> DataFrame:
    """The columns of docs again: those carried, and `own` ones."""
    columns = restored(carry) | own
    return found.select(*(columns[c].alias(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those whose words fit no learnt language (score under 0.3)."""
    carry = _others(docs, "text")
    found = language_id(docs, spans=False, carry=carry, with_text=True).where("lang_pred != 'und' and score >= 0.3")
    return _as_given(found, docs, carry, text=F.col("text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of the smallest doc_id, of each group linked by 5-word shingles at Jaccard 0.8.

    Rows count, not ids: a row given twice stays once, a row with null doc_id is a copy like any other and stays if no
    row of its group has an id, and different texts under one doc_id stay both. Rows are told apart by a 64-bit hash of
    all columns.
    """
    given = docs.select(F.struct(*(quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("carried"), quoted("doc_id").alias("doc_id"), quoted("text").alias("text"))
    fields = [F.col(f"carried.c{i}") for i in range(len(docs.columns))]
    keyed = given.withColumn("row", F.xxhash64(*fields, *(F.isnull(c) for c in fields)))  # the flags, as nulls alone leave a hash unchanged
    found = ngram_jaccard_join(keyed.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id", F.lit(None).cast("long").alias("id"))
    ids = keyed.select("row", F.lit(None).cast("long").alias("component_id"), F.col("doc_id").cast("long").alias("id"))
    rows = found.unionByName(ids).groupBy("row").agg(F.max("component_id").alias("component_id"), F.max("id").alias("id"))
    best = rows.groupBy("component_id").agg(F.min(F.struct(F.isnull("id").alias("no_id"), "id", "row")).alias("best")).select(F.col("best.row").alias("row"))
    kept = keyed.dropDuplicates(["row"]).join(best.hint("shuffle_hash"), "row", "left_semi")
    return kept.select(*(F.col(f"carried.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts byte strings of 200 that also start elsewhere; a document of which nothing is left goes."""
    carry = _others(docs, "text")
    kept = suffix_dedup(docs, carry=carry, as_text=True).where("n_removed = 0 or n_removed < n_bytes")
    return _as_given(kept, docs, carry, text=F.col("kept"), n_chars=F.length("kept").cast("long"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that benchmark phrases cover by a twentieth or more, and cuts phrases out of the others."""
    carry = _others(docs, "text")
    found = fm_decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=carry, cut=True).where("not contaminated")
    return _as_given(found, docs, carry, text=F.col("kept"), n_chars=F.length("kept").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of their decoded text."""
    return bpe_codec(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", encode),
]
#: Learnt scores, links and suffix arrays have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage wrote is deleted once the next one has read it."""
    checkpoint_dir(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"pipeline-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder.toString()}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(before), True)
        before = path
    return docs


QUERIES = {"pipeline": run}
ORACLES = {}
