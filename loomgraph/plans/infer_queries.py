"""Queries on what functions are for, on query understanding and result texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import infer
from ..operators import frontend, graph
from ..streaming import sync
from .adapters import Tables, with_views
from .registry import query

_VERBS = ["get", "load", "set", "save", "is", "validate", "calculate", "create", "delete", "parse", "handle", "add", "on", "zip"]
_INTENTS = ["retrieval", "io_read", "mutation", "io_write", "predicate", "validation", "computation", "factory", "deletion", "transformation", "side_effect", "mutation", "side_effect", "unknown"]
_CONF = [0.95, 0.90, 0.95, 0.90, 0.95, 0.95, 0.95, 0.95, 0.95, 0.88, 0.75, 0.85, 0.72, 0.0]
_SQL = "n AS (SELECT p_partkey, p_partkey % 14 + 1 AS v, upper(left(p_name, 1)) || split_part(p_name, ' ', 1)[2:] AS w FROM part)"


def _named(t: Tables) -> DataFrame:
    verb = F.element_at(F.array(*map(F.lit, _VERBS)), (F.col("p_partkey") % 14 + 1).cast("int"))
    word = F.initcap(F.split("p_name", " ")[0])
    return t.part.select("p_partkey", F.concat(verb, word).alias("name"), word.alias("word"))


@query(f"WITH {_SQL} SELECT p_partkey, {_INTENTS}[v] AS intent, {_CONF}[v]::DOUBLE AS confidence FROM n")
def naming_intent(t: Tables) -> DataFrame:
    return _named(t).select("p_partkey", infer.naming_signal(F.col("name")).alias("s")).select("p_partkey", "s.intent", "s.confidence")


@query(f"WITH {_SQL} SELECT p_partkey, CASE v WHEN 13 THEN 'on ' || lower(w) WHEN 14 THEN 'zip ' || lower(w) ELSE lower(w) END AS subject, CASE v WHEN 1 THEN 'Retrieves ' || lower(w) ELSE NULL END AS retrieves FROM n")
def subject_summary(t: Tables) -> DataFrame:
    rows = _named(t).withColumn("subject", infer.subject(F.col("name")))
    return rows.select("p_partkey", "subject", F.when(F.col("p_partkey") % 14 == 0, infer.summary(infer.naming_signal(F.col("name"))["intent"], F.col("subject"))).alias("retrieves"))


@query("SELECT p_partkey, p_partkey % 3 <> 0 AS generic FROM part")
def generic_names(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 3 == 0, "getUserProfile").when(F.col("p_partkey") % 3 == 1, "handleData").otherwise("process_the_result")
    return t.part.select("p_partkey", infer.is_generic(name).alias("generic"))


@query("SELECT p_partkey, ['side_effect', 'predicate', 'io_read', 'retrieval', NULL][p_partkey % 5 + 1] AS intent, [0.7, 0.8, 0.55, 0.45, NULL][p_partkey % 5 + 1]::DOUBLE AS confidence FROM part")
def return_types(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("void", "Promise<boolean>", "Promise<User>", "User", "any"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", infer.return_signal(kind).alias("s")).select("p_partkey", "s.intent", "s.confidence")


@query("SELECT p_partkey, ['side_effect', 'io_read', 'io_write', NULL][p_partkey % 4 + 1] AS intent FROM part")
def parameter_types(t: Tables) -> DataFrame:
    kinds = F.array(F.lit("x"), F.element_at(F.array(*map(F.lit, ("MouseEvent", "HttpRequest", "res", "y"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return t.part.select("p_partkey", infer.parameter_signal(kinds)["intent"].alias("intent"))


@query("SELECT p_partkey, ['io_read', 'io_write', 'validation', NULL][p_partkey % 4 + 1] AS intent, [0.5, 0.25, 0.75, NULL][p_partkey % 4 + 1]::DOUBLE AS confidence FROM part")
def body_signals(t: Tables) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, ("const x = fetch (u); axios", "db.save(x)", "throw new Error", "nothing"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", infer.body_signal(code).alias("s")).select("p_partkey", "s.intent", "s.confidence")


@query("SELECT p_partkey, ['condition', 'assignment', 'await', 'standalone'][p_partkey % 4 + 1] AS context, CASE p_partkey % 4 WHEN 1 THEN ['a', 'b'] ELSE []::VARCHAR[] END AS args FROM part")
def call_contexts(t: Tables) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, ("if (ready && load()) {}", "const v = await db.load(a, b)", "await load()", "load()"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", infer.call_context(F.lit("load"), code).alias("context"), infer.call_arguments(F.lit("load"), code).alias("args"))


@query("SELECT user_id AS function, event_type AS intent, round(least(1, max(c) + least(0.10::DOUBLE, 0.05::DOUBLE * (count(*) - 1))), 4)::DOUBLE AS confidence FROM (SELECT user_id, event_type, (event_id % 7)::DOUBLE / 10 AS c FROM events) GROUP BY 1, 2 HAVING round(least(1, max(c) + least(0.10::DOUBLE, 0.05::DOUBLE * (count(*) - 1))), 4) >= 0.5")
def frontend_intents(t: Tables) -> DataFrame:
    return infer.gathered_intents(t.events.select(F.col("user_id").alias("function"), F.col("event_type").alias("intent"), ((F.col("event_id") % 7) / 10.0).alias("confidence")))


@query("SELECT p_partkey, ['validateToken', 'p_' || p_partkey] AS entities, ['who', 'calls', 'validatetoken', 'p_' || p_partkey] AS keywords FROM part")
def query_understanding(t: Tables) -> DataFrame:
    text = F.concat(F.lit("who calls the validateToken of p_"), F.col("p_partkey").cast("string"))
    return t.part.select("p_partkey", infer.query_entities(text).alias("entities"), infer.query_keywords(text, ["the", "and", "for"]).alias("keywords"))


@query("SELECT p_partkey, round(CASE WHEN contains(p_name, 'ring') THEN 2 ELSE 0 END + 0.6 + 0.8 * CASE WHEN contains(p_name, 'red') THEN 1 ELSE 0 END + 0.5, 4)::DOUBLE AS score FROM part")
def task_scores(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", infer.task_score(F.col("p_name"), ["ring"], F.split("p_name", " ")[0], F.lit("red one"), F.lit("")).alias("score"))


@query("SELECT p_partkey, p_size % 4 = 0 OR p_retailprice >= 1000 AS entry_point, CASE WHEN p_size % 2 = 0 THEN 'Retrieved via keyword (0.50).' ELSE 'Retrieved as a related graph neighbor.' END || CASE p_size % 4 WHEN 0 THEN ' This is a direct seed node (entry point).' WHEN 1 THEN ' This is a 1-hop neighbor of a seed node.' WHEN 2 THEN ' This is a 2-hop neighbor discovered via graph expansion.' ELSE '' END || ' Located in ' || p_brand || '.' AS reason FROM part")
def result_packaging(t: Tables) -> DataFrame:
    hop, signal = F.col("p_size") % 4, F.when(F.col("p_size") % 2 == 0, 0.5).otherwise(0.1)
    entry = infer.is_entry_point(hop, F.lit(0.0), F.col("p_retailprice") >= 1000, F.lit(0.0), F.lit("method"))
    return t.part.select("p_partkey", entry.alias("entry_point"), infer.reason({"keyword": signal}, hop, F.col("p_brand")).alias("reason"))


@query("SELECT phrase, count(*) AS n FROM (SELECT split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) AS phrase FROM part) GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, phrase LIMIT 30")
def label_candidates(t: Tables) -> DataFrame:
    return infer.label_candidates(t.part.select(F.col("p_name").alias("text")))


_DOMAINS = ", ".join(f"CASE WHEN regexp_matches(u, '{'|'.join(infer.DOMAINS[d])}') THEN '{d}' END" for d in sorted(infer.DOMAINS))


@query(f"SELECT doc_id, list_filter([{_DOMAINS}], lambda x: x IS NOT NULL) AS domains FROM (SELECT doc_id, lower(coalesce(text, '')) AS u FROM documents)")
def domain_signals(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", infer.domain_signals(F.col("text")).alias("domains"))


_CODE = "CASE p_partkey % 4 WHEN 0 THEN '<Card x/> <Fragment>' WHEN 1 THEN 'navigation.push(\"Home\")' WHEN 2 THEN 'setOpen(true); setTimeout(f, 1)' ELSE 'if (x) load(1)' END"


@query("SELECT p_partkey AS src, e.target, e.rel_type, e.confidence::DOUBLE AS confidence FROM (SELECT p_partkey, unnest(CASE p_partkey % 4 WHEN 0 THEN [{'target': 'Card', 'rel_type': 'RENDER', 'confidence': 0.90}] WHEN 1 THEN [{'target': 'Home', 'rel_type': 'NAVIGATE', 'confidence': 0.88}, {'target': 'push', 'rel_type': 'CALLS', 'confidence': 0.55}] WHEN 2 THEN [{'target': 'setOpen', 'rel_type': 'STATE_UPDATE', 'confidence': 0.80}, {'target': 'setTimeout', 'rel_type': 'STATE_UPDATE', 'confidence': 0.80}, {'target': 'setTimeout', 'rel_type': 'SIDE_EFFECT', 'confidence': 0.75}, {'target': 'setOpen', 'rel_type': 'CALLS', 'confidence': 0.55}, {'target': 'setTimeout', 'rel_type': 'CALLS', 'confidence': 0.55}] ELSE [{'target': 'load', 'rel_type': 'CALLS', 'confidence': 0.55}] END) AS e FROM part)")
def frontend_edges(t: Tables) -> DataFrame:
    return frontend.found_edges(t.part.select(F.col("p_partkey").alias("id"), F.expr(_CODE).alias("code")))


@query("SELECT DISTINCT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def repo_file_edges(t: Tables) -> DataFrame:
    """New edges only: those of even orders are there already."""
    ident = lambda mark, c: F.concat(F.lit(mark), F.col(c).cast("string"))
    edges = t.lineitem.where("l_returnflag = 'R'").select(ident("o:", "l_orderkey").alias("src"), ident("p:", "l_partkey").alias("dst"), "l_orderkey").distinct()
    return edges.join(t.orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").select("src", "dst")


@query("SELECT s_suppkey, s_name, r_name AS community FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region ON r_regionkey = n_regionkey")
def community_enrichment(t: Tables) -> DataFrame:
    member = t.nation.where("n_nationkey % 2 = 0").join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("community"))
    return t.supplier.join(member, "s_nationkey", "left").select("s_suppkey", "s_name", "community")


@query("SELECT l_returnflag, count(*) AS calls, count(*) FILTER (l_quantity > 25) AS resolved, round(count(*) FILTER (l_quantity > 25)::DOUBLE / count(*), 6) AS ratio FROM lineitem GROUP BY 1")
def call_statistics(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("calls"), F.count_if(F.col("l_quantity") > 25).alias("resolved"), F.round(F.count_if(F.col("l_quantity") > 25) / F.count("*"), 6).alias("ratio"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0")
def resume_vectors(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    return sync.not_seen(e, e.where("id % 3 = 0")).select(F.col("id").alias("vec_id"), "label")


@query("SELECT user_id, arg_max(event_id, (value, event_id)) AS event_id, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id")
def best_message_per_key(t: Tables) -> DataFrame:
    best = t.events.where("value is not null").groupBy("user_id").agg(F.max(F.struct("value", "event_id")).alias("b"))
    return best.select("user_id", "b.event_id", "b.value")


@query(with_views(", near AS (SELECT 'n:' || n_nationkey AS id, 1 AS depth FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 1) UNION ALL SELECT 'r:' || n_regionkey, 2 FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey = 1)) SELECT id, depth FROM near", "geo"))
def connected_documents(t: Tables) -> DataFrame:
    seed = t.spark.createDataFrame([("c:1",)], "id string")
    return graph.bfs(t.geo(), seed, 3, "in").where("depth > 0")
