"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent))
HEADLINE = ["subgraph_khop", "subgraph_in", "shortest_path", "proximity_hops", "scc_components", "condensed_waves", "dead_nodes", "module_plan_counts", "workflow_impact", "shared_step_pairs", "cohesion_coupling", "contains_search", "bm25_scores", "knn_cosine_topk", "knn_join_topk", "multi_collection_merge", "minmax_signals", "hybrid_search", "rerank_passages", "entity_merge", "paragraph_split", "path_match", "hash_embedding", "message_extract", "upsert_nodes", "change_detect", "row_identity", "vote_dominant"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from loomgraph.plans.all import QUERIES

    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in QUERIES]
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    took = {}
    for name in names:
        began = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
