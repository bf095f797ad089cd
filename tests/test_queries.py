"""Registered queries against DuckDB on the same tables, and that the entry points hold together."""

import datetime
import decimal
import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from loomgraph.plans.all import ORACLES, QUERIES

#: a share of the registry that touches every operator module; RUN_ALL_QUERIES=1 runs all
CHOSEN = ["subgraph_khop", "subgraph_both", "subgraph_edges", "shortest_path", "topo_waves", "dead_nodes", "screen_paths_ranked", "execution_flows", "call_resolution", "include_closure", "nav_attribution", "workflow_impact", "cohesion_coupling", "contains_search", "bm25_scores", "knn_cosine_topk", "knn_join_topk", "hybrid_search", "entity_merge", "relation_expand", "paragraph_split", "url_normalise", "hash_embedding", "message_extract", "ipc_lookup", "upsert_nodes", "merge_properties", "delete_by_path", "change_detect", "rename_split", "table_regions", "header_detect", "vote_dominant", "workflow_naming", "windowed_counts"]
NAMES = sorted(ORACLES) if os.environ.get("RUN_ALL_QUERIES") else [n for n in CHOSEN if n in ORACLES]


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal | float | np.floating):
        return None if math.isnan(v) else round(float(v), 8)
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.sql(ORACLES[name])
    at = [found.columns.index(c) for c in columns]
    assert sorted(found.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
