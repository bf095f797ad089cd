"""The registered queries of the llm operators: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import bpe_codec
from .chat_format import chat_format
from .fm_decontaminate import fm_decontaminate
from .language_id import language_id
from .license_scan import license_scan
from .ngram_jaccard_join import ngram_jaccard_join
from .pivot_index import embedding_near_dedup
from .quality_mil import quality_mil
from .suffix_dedup import suffix_dedup
from .token_packing import token_packing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_packing(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), keep=False)


#: Schemas of the tools that conversations may call; calls of other tools are reported as unknown.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}}, "required": ["url"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
}


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(_table(spark, sf_dir, "conversations"), TOOLS)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"), spans=False)


def op6_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("spans")


def op7_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(_table(spark, sf_dir, "embeddings"))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=False)


def op10_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), attention=False)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"), matches=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_packing": op2_token_packing,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_language_id": op5_language_id,
    "op6_fm_decontaminate": op6_fm_decontaminate,
    "op7_pivot_index": op7_pivot_index,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_license_scan": op9_license_scan,
    "op10_quality_mil": op10_quality_mil,
}
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: DuckDB SQL of those that SQL can express on whole tables
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
 e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.root)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM r WHERE r.id = d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op6_fm_decontaminate": rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
 win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 13) AS k, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
 dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
 hit AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
 h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit) GROUP BY 1),
 it AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
 SELECT d.doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
 FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""",
    "op7_pivot_index": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
 r(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.root), c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
 SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, root AS component_id, root = vec_id AS kept FROM v JOIN c ON c.id = vec_id""",
}
