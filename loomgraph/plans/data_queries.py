"""Queries over rows, files, messages, names and tables that change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import infer
from ..functions import text as X
from ..operators import code, messages, score, search, sheets
from ..sources import files, sinks
from ..streaming import sync
from .adapters import Tables, with_views
from .registry import query


@query(with_views("SELECT src, rel_type, count(*) AS n FROM trade GROUP BY 1, 2 HAVING count(*) > 3", "trade"))
def edge_counts_by_type(t: Tables) -> DataFrame:
    return t.trade().groupBy("src", "rel_type").agg(F.count("*").alias("n")).where("n > 3")


@query(with_views("SELECT upper(rel_type) AS rel_type, count(*) AS n FROM trade GROUP BY 1", "trade"))
def relationship_types(t: Tables) -> DataFrame:
    return t.trade().groupBy(F.upper("rel_type").alias("rel_type")).agg(F.count("*").alias("n"))


@query(with_views("SELECT id, name, file FROM functions WHERE id IN ('p:5', 'p:17', 'p:123')", "functions"))
def nodes_by_ids(t: Tables) -> DataFrame:
    ids = t.spark.createDataFrame([("p:5",), ("p:17",), ("p:123",), ("p:5",), ("none",)], "id string")
    return t.functions().join(ids, "id", "left_semi").select("id", "name", "file").dropDuplicates(["id"])


@query(with_views("SELECT id, coalesce(nullif(trim(summary), ''), nullif(trim(comment), ''), nullif(trim(name), '')) AS content FROM functions", "functions"))
def node_content(t: Tables) -> DataFrame:
    return t.functions().select("id", X.content("auto", F.col("summary"), F.col("comment"), F.col("qualified_name"), F.col("name"), F.col("id")).alias("content"))


@query(with_views("SELECT id FROM functions WHERE coalesce(trim(summary), '') = '' AND kind IS DISTINCT FROM 'lambda' AND module LIKE 'Brand#1%'", "functions"))
def without_summary(t: Tables) -> DataFrame:
    f = t.functions()
    return f.where((F.coalesce(F.trim("summary"), F.lit("")) == "") & ~F.col("kind").eqNullSafe("lambda") & F.col("module").startswith("Brand#1")).select("id")


@query(with_views("SELECT id, module FROM functions WHERE regexp_full_match(module, 'Brand#.*3')", "functions"))
def pattern_match(t: Tables) -> DataFrame:
    return t.functions().where(F.col("module").rlike(X.wildcard_pattern("Brand#*3"))).select("id", "module")


@query(with_views("SELECT id FROM functions WHERE id NOT IN (SELECT dst FROM trade WHERE rel_type = 'CALLS' AND calls > 1)", "trade", "functions"))
def undocumented(t: Tables) -> DataFrame:
    return t.functions().join(t.trade().where("rel_type = 'CALLS' and calls > 1").select(F.col("dst").alias("id")), "id", "left_anti").select("id")


@query(with_views("SELECT workflow, step, function, domain FROM steps JOIN workflows USING (workflow) WHERE domain = 'auth'", "steps", "workflows"))
def workflow_steps(t: Tables) -> DataFrame:
    return t.steps().join(t.workflows().where("domain = 'auth'"), "workflow").orderBy("workflow", "step").select("workflow", "step", "function", "domain")


@query(with_views("SELECT module AS community, count(*) AS size, count(*) FILTER (kind = 'method') AS methods, count(DISTINCT file) AS files, min(name) AS first FROM functions GROUP BY 1 HAVING count(*) >= 60", "functions"))
def module_contents(t: Tables) -> DataFrame:
    f = t.functions().groupBy(F.col("module").alias("community")).agg(F.count("*").alias("size"), F.count_if(F.col("kind") == "method").alias("methods"), F.countDistinct("file").alias("files"), F.min("name").alias("first"))
    return f.where("size >= 60")


@query("SELECT l_orderkey AS src, l_partkey AS dst, count(*) + count(*) FILTER (l_orderkey % 2 = 0) AS count FROM lineitem GROUP BY 1, 2")
def upsert_counted_calls(t: Tables) -> DataFrame:
    calls = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    old = calls.groupBy("src", "dst").agg(F.count("*").alias("count"))
    return sinks.add_counts(old, calls.where("src % 2 = 0"), ["src", "dst"])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_name END AS name, c_mktsegment AS type, c_acctbal AS score FROM customer UNION ALL SELECT -1, 'new', NULL, NULL")
def upsert_nodes(t: Tables) -> DataFrame:
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.col("c_acctbal").alias("score"))
    new = old.where("id % 3 = 0").select("id", F.lit("changed").alias("name")).unionByName(t.spark.createDataFrame([(-1, "new")], "id long, name string"))
    return sinks.upsert(old, new, ["id"])


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'b=2;kind=x;size=' || p_size ELSE 'kind=' || p_type || ';size=' || p_size END AS props FROM part")
def merge_properties(t: Tables) -> DataFrame:
    old = t.part.select(F.col("p_partkey").alias("id"), F.create_map(F.lit("kind"), "p_type", F.lit("size"), F.col("p_size").cast("string")).alias("props"))
    new = t.part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("kind"), F.lit("x"), F.lit("b"), F.lit("2")).alias("props"))
    merged = sinks.merge_properties(old, new, ["id"])
    return merged.select("id", F.array_join(F.array_sort(F.transform(F.map_entries("props"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("props"))


@query(with_views(", gone AS (SELECT id FROM functions WHERE file LIKE '%economy.py') SELECT src, dst, rel_type, calls FROM trade WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)", "trade", "functions"))
def delete_by_path(t: Tables) -> DataFrame:
    f = t.functions()
    return sinks.delete_files(f, t.trade(), f.where("file like '%economy.py'").select("file").distinct())[1]


@query(with_views(", nodes AS (SELECT id, 'Function' AS label FROM functions UNION ALL SELECT 's:' || s_suppkey, 'UnknownFunction' FROM supplier UNION ALL SELECT 'x:' || s_suppkey, 'UnknownFunction' FROM supplier) SELECT id, label FROM nodes WHERE label <> 'UnknownFunction' OR id IN (SELECT dst FROM trade WHERE rel_type = 'POSSIBLE_CALLS')", "trade", "functions"))
def orphan_prune(t: Tables) -> DataFrame:
    s = t.supplier.select(F.col("s_suppkey").cast("string").alias("k"))
    nodes = t.functions().select("id", F.lit("Function").alias("label"))
    for mark in ("s:", "x:"):
        nodes = nodes.unionByName(s.select(F.concat(F.lit(mark), "k").alias("id"), F.lit("UnknownFunction").alias("label")))
    return sinks.prune_orphans(nodes, t.trade(), "UnknownFunction", "POSSIBLE_CALLS")


@query("SELECT o_orderkey AS id, o_orderpriority AS project, 'old' AS v FROM orders WHERE o_orderpriority <> '1-URGENT' UNION ALL SELECT o_orderkey, o_orderpriority, 'new' FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0")
def replace_scope(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("project"), F.lit("old").alias("v"))
    new = rows.where("project = '1-URGENT' and id % 2 = 0").withColumn("v", F.lit("new"))
    return sinks.replace_scope(rows, new, ["project"])


@query(with_views("SELECT src, dst FROM trade WHERE src LIKE 'p:%' AND dst IN (SELECT 's:' || s_suppkey FROM supplier WHERE s_acctbal > 0)", "trade"))
def existing_edge_ends(t: Tables) -> DataFrame:
    nodes = t.functions().select("id").unionByName(t.supplier.where("s_acctbal > 0").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id")))
    return sinks.existing_ends(t.trade().select("src", "dst"), nodes)


_OLD_NEW = "o AS (SELECT 'd' || doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 11 <> 0)"


@query(f"WITH {_OLD_NEW} SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.path = n.path WHERE o.h IS DISTINCT FROM n.h")
def change_detect(t: Tables) -> DataFrame:
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path")
    d = t.documents
    old = d.where("doc_id % 7 != 0").select(path, F.sha2("text", 256).alias("hash"))
    new = d.where("doc_id % 11 != 0").select(path, F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(F.sha2("text", 256)).alias("hash"))
    return files.detect_changes(old, new)


@query("SELECT DISTINCT path, change FROM (SELECT 'old' || page_id AS path, 'deleted' AS change FROM pages WHERE page_id % 4 IN (2, 3) UNION ALL SELECT 'new' || page_id, 'changed' FROM pages WHERE page_id % 4 = 3 UNION ALL SELECT 'old' || page_id, 'changed' FROM pages WHERE page_id % 4 < 2)")
def rename_split(t: Tables) -> DataFrame:
    i = F.col("page_id").cast("string")
    line = F.when(F.col("page_id") % 4 == 3, F.concat(F.lit("R090\told"), i, F.lit("\tnew"), i)).when(F.col("page_id") % 4 == 2, F.concat(F.lit("D\told"), i)).when(F.col("page_id") % 4 == 1, F.concat(F.lit("M\told"), i)).otherwise(F.concat(F.lit("A\told"), i))
    return files.changed_and_deleted(files.diff_entries(t.pages.select(line.alias("value"))))


@query(with_views("SELECT file AS path, 'python' AS parser, count(*) AS n FROM functions GROUP BY 1", "functions"))
def owned_files(t: Tables) -> DataFrame:
    f = t.functions().groupBy(F.col("file").alias("path")).agg(F.count("*").alias("n"))
    extra = t.spark.createDataFrame([("node_modules/x/a.py", 1), ("a.unknown", 1)], "path string, n long")
    return files.with_parser(f.unionByName(extra)).select("path", "parser", "n")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\bbegin\\b') OR regexp_matches(text, '(?i)\\bdeclare\\b') THEN 'plsql' ELSE 'sql' END AS dialect FROM documents")
def sql_dialect(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", files.sql_dialect(F.col("text")).alias("dialect"))


@query("SELECT n_name AS language, n_nationkey + 1 AS files, n_regionkey::BIGINT AS blank, 2::BIGINT AS comment, (n_nationkey * 10)::BIGINT AS code FROM nation")
def line_statistics(t: Tables) -> DataFrame:
    n = t.nation
    raw = n.select(F.to_json(F.map_from_arrays(F.array("n_name", F.lit("header")), F.array(*[F.struct((F.col("n_nationkey") + k).cast("long").alias("nFiles"), F.col("n_regionkey").cast("long").alias("blank"), F.lit(2).cast("long").alias("comment"), (F.col("n_nationkey") * 10).cast("long").alias("code")) for k in (1, 2)]))).alias("value"))
    return files.line_statistics(raw)


_LINES = "SELECT 'f/' || conv_id AS file, turn::INT AS line, CASE WHEN turn % 4 = 0 THEN 'class ' || role || ' {' ELSE 'bus.publish(\"topic' || (conv_id % 7) || '\", target' || (turn % 3) || ', payload); sendMessage(win, \"m' || turn || '\")' END AS text FROM conversations"


def _lines(t: Tables) -> DataFrame:
    c, turn = F.col("conv_id"), F.col("turn")
    body = F.concat(F.lit('bus.publish("topic'), (c % 7).cast("string"), F.lit('", target'), (turn % 3).cast("string"), F.lit(', payload); sendMessage(win, "m'), turn.cast("string"), F.lit('")'))
    return t.conversations.select(F.concat(F.lit("f/"), c.cast("string")).alias("file"), turn.cast("int").alias("line"), F.when(turn % 4 == 0, F.concat(F.lit("class "), "role", F.lit(" {"))).otherwise(body).alias("text"))


_FILLED = f"l AS ({_LINES}), filled AS (SELECT file, line, text, coalesce(last_value(nullif(regexp_extract(text, 'class (\\w+)', 1), '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS sender FROM l)"


@query(f"WITH {_FILLED} SELECT file, line, sender FROM filled")
def sender_ffill(t: Tables) -> DataFrame:
    return messages.fill_sender(_lines(t), r"class (\w+)").select("file", "line", "sender")


_MSG = f"{_FILLED}, c AS (SELECT file, line, sender, 'topic' || regexp_extract(text, 'topic([0-9]+)', 1) AS name, 'target' || (line % 3) AS receiver, 'target' || (line % 3) AS payload, 0.95::DOUBLE AS confidence FROM filled WHERE line % 4 <> 0 UNION ALL SELECT file, line, sender, 'm' || line, 'win', '\"m' || line || '\"', 0.75::DOUBLE FROM filled WHERE line % 4 <> 0), m AS (SELECT 'msg::' || left(sha1(concat_ws('||', 'proj', file, line::VARCHAR, s, receiver, name, payload)), 24) AS id, name, s AS sender, receiver, payload, confidence, file, line FROM (SELECT *, CASE WHEN sender = '' THEN split_part(file, '/', 2) ELSE sender END AS s FROM c))"


@query(f"WITH {_MSG} SELECT id, name, sender, receiver, payload, confidence, file, line FROM m")
def message_extract(t: Tables) -> DataFrame:
    return messages.extract_messages(messages.fill_sender(_lines(t), r"class (\w+)"), "proj")


@query(f"WITH {_MSG} SELECT receiver AS endpoint, count(*) AS n FROM m WHERE sender = 'user' AND receiver <> '' GROUP BY 1")
def ipc_lookup(t: Tables) -> DataFrame:
    return messages.between(messages.extract_messages(messages.fill_sender(_lines(t), r"class (\w+)"), "proj"), sender="user")


@query(with_views("SELECT sender, receiver, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM messages GROUP BY 1, 2", "messages"))
def message_counts(t: Tables) -> DataFrame:
    return t.messages().groupBy("sender", "receiver").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, sha1(l_orderkey || '|' || l_linenumber || '|' || coalesce(l_returnflag, '') || '|') AS row_hash FROM lineitem")
def row_identity(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", sheets.row_hash(F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag")).alias("row_hash"))


def _row(t: Tables) -> DataFrame:
    name = F.when(F.col("n_nationkey") % 6 == 0, "Grand TOTAL").when(F.col("n_nationkey") % 6 == 1, "summary").otherwise(F.col("n_name"))
    return t.nation.select("n_nationkey", F.create_map(F.lit("name"), name, F.lit("key"), F.col("n_nationkey").cast("string"), F.lit("blank"), F.lit(" ")).alias("values"))


@query("SELECT n_nationkey, n_nationkey % 6 < 2 AS is_footer, 'key: ' || n_nationkey || '. name: ' || CASE n_nationkey % 6 WHEN 0 THEN 'Grand TOTAL' WHEN 1 THEN 'summary' ELSE n_name END AS serialised FROM nation")
def footer_rows(t: Tables) -> DataFrame:
    return _row(t).select("n_nationkey", sheets.is_footer(F.col("values")).alias("is_footer"), sheets.serialised(F.col("values")).alias("serialised"))


@query("SELECT n_nationkey, CASE n_nationkey % 6 WHEN 0 THEN 'Grand TOTAL' WHEN 1 THEN 'summary' ELSE n_name END AS name, 'COUNTRY' AS type FROM nation")
def column_entities(t: Tables) -> DataFrame:
    return _row(t).select("n_nationkey", F.explode(sheets.column_entities(F.col("values"), {"name": "COUNTRY", "blank": "NONE"})).alias("e")).select("n_nationkey", "e.name", "e.type")


def _cells(t: Tables) -> DataFrame:
    """Nations as a table at (2, 1), regions as one at (40, 5), a lone cell between."""
    n = t.nation.select((F.col("n_nationkey") + 3).alias("r"), F.explode(F.create_map(F.lit(1), F.col("n_name"), F.lit(2), F.col("n_regionkey").cast("string"))).alias("c", "value"))
    r = t.region.select((F.col("r_regionkey") + 41).alias("r"), F.explode(F.create_map(F.lit(5), F.col("r_name"), F.lit(6), F.col("r_regionkey").cast("string"))).alias("c", "value"))
    more = t.spark.createDataFrame([(2, 1, "Nation"), (2, 2, "Region"), (40, 5, "Name"), (40, 6, "Key"), (33, 9, "lone"), (34, 1, " ")], "r int, c int, value string")
    return n.unionByName(r).unionByName(more).withColumn("sheet", F.lit("s1"))


@query("SELECT 's1' AS sheet, * FROM (SELECT 2 AS r0, 1 AS c0, 2 + count(*)::INT AS r1, 2 AS c1, 2 + 2 * count(*) AS cells FROM nation UNION ALL SELECT 40, 5, 40 + count(*)::INT, 6, 2 + 2 * count(*) FROM region UNION ALL SELECT 33, 9, 33, 9, 1)")
def table_regions(t: Tables) -> DataFrame:
    return sheets.table_regions(_cells(t))


@query("SELECT 's1' AS sheet, * FROM (SELECT 2 AS r0, 1 AS c0, 40 + (SELECT count(*) FROM region)::INT AS r1, 9 AS c1, 2 + 2 * count(*) + 2 + 2 * (SELECT count(*) FROM region) + 1 AS cells FROM nation)")
def table_regions_gap(t: Tables) -> DataFrame:
    return sheets.table_regions(_cells(t), gap=7)


@query("SELECT 's1' AS sheet, unnest([2, 3, 4]) AS r")
def header_detect(t: Tables) -> DataFrame:
    return sheets.header_rows(_cells(t).where("r < 30"))


@query("SELECT 's1' AS sheet, n_nationkey AS c, CASE WHEN row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) > 1 THEN 'h' || n_regionkey || '_' || row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) ELSE 'h' || n_regionkey END AS name FROM nation")
def unique_headers(t: Tables) -> DataFrame:
    return sheets.unique_headers(t.nation.select(F.lit("s1").alias("sheet"), F.col("n_nationkey").alias("c"), F.concat(F.lit(" h"), F.col("n_regionkey").cast("string")).alias("name")))


@query("SELECT 's1' AS sheet, n_nationkey AS r, 1 AS c, CASE WHEN n_nationkey < 4 THEN (SELECT n_name FROM nation WHERE n_nationkey = 0) ELSE n_name END AS value FROM nation")
def merged_cells(t: Tables) -> DataFrame:
    cells = t.nation.select(F.lit("s1").alias("sheet"), F.col("n_nationkey").alias("r"), F.lit(1).alias("c"), F.when(F.col("n_nationkey").between(1, 3), "").otherwise(F.col("n_name")).alias("value"))
    ranges = t.spark.createDataFrame([("s1", 0, 1, 3, 1)], "sheet string, r0 int, c0 int, r1 int, c1 int")
    return sheets.fill_merged(cells, ranges)


@query("SELECT callee, pattern, n, sites, round(n::DOUBLE / sites * CASE WHEN sites = 1 THEN 0.7::DOUBLE ELSE 1 END, 4) AS ratio FROM (SELECT callee, pattern, n, sum(n) OVER (PARTITION BY callee)::BIGINT AS sites, row_number() OVER (PARTITION BY callee ORDER BY n DESC, pattern) AS rn FROM (SELECT l_partkey AS callee, l_returnflag AS pattern, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE rn = 1")
def vote_dominant(t: Tables) -> DataFrame:
    return score.vote(t.lineitem.select(F.col("l_partkey").alias("callee"), F.col("l_returnflag").alias("pattern")))


@query("SELECT p_partkey, round(least(1, greatest(0, (0.4::DOUBLE * s + 0.2::DOUBLE * s / 2 + 0.3::DOUBLE * s + 0.1::DOUBLE + CASE WHEN p_size % 2 = 0 THEN 0.03::DOUBLE ELSE 0 END) * CASE WHEN length(p_name) < 9 THEN 0.75::DOUBLE ELSE 1 END * CASE WHEN p_type = 'ECONOMY' THEN 0.85::DOUBLE ELSE 1 END)), 4)::DOUBLE AS confidence FROM (SELECT *, (p_size % 10)::DOUBLE / 10.7::DOUBLE AS s FROM part)")
def function_confidence(t: Tables) -> DataFrame:
    s = (F.col("p_size") % 10).cast("double") / 10.7
    return t.part.select("p_partkey", score.function_confidence(s, s / 2, s, F.lit(1.0), F.col("p_size") % 2 == 0, F.length("p_name") < 9, F.col("p_type") == "ECONOMY").alias("confidence"))


@query("SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'Payment Flow' WHEN event_type = 'signup' THEN 'Registration Flow' ELSE upper(left(event_type, 1)) || event_type[2:] || ' Flow' END AS name, CASE WHEN event_type = 'purchase' THEN 'payment' WHEN event_type = 'signup' THEN 'auth' ELSE 'unknown' END AS domain, CASE WHEN event_type IN ('purchase', 'signup') THEN 0.75::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM events")
def workflow_naming(t: Tables) -> DataFrame:
    rule = X.workflow_rule(F.concat("event_type", F.lit(" page")))
    return t.events.select("event_id", rule.alias("w")).select("event_id", "w.name", "w.domain", "w.confidence")


@query("SELECT doc_id, regexp_replace(lower(trim(source)) || '_x', '[_/-]', ' ', 'g') AS name, regexp_replace(source || ' (' || doc_id || ')', '[^A-Za-z0-9_.-]+', '_', 'g') AS source_id FROM documents")
def entity_names(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.entity_name(F.concat(F.lit('"'), "source", F.lit('_x"'))).alias("name"), X.source_id(F.concat("source", F.lit(" ("), F.col("doc_id").cast("string"), F.lit(")"))).alias("source_id"))


@query("SELECT c_custkey, CASE WHEN upper(trim(c_mktsegment)) IN ('GET', 'POST') THEN upper(trim(c_mktsegment)) ELSE 'GET' END AS method FROM customer")
def http_methods(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", X.http_method(F.col("c_mktsegment")).alias("method"))


@query("SELECT p_partkey, list_filter(['get', lower(string_split(p_name, ' ')[1]), lower(string_split(p_name, ' ')[2]), 'by', 'id'], lambda x: length(x) > 1) AS tokens FROM part")
def name_tokens(t: Tables) -> DataFrame:
    w = F.split("p_name", " ")
    return t.part.select("p_partkey", X.name_tokens(F.concat(F.lit("get"), F.initcap(w[0]), F.lit("_"), w[1], F.lit("-byId"))).alias("tokens"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(t: Tables) -> DataFrame:
    """An extension: the reference has no windows over time."""
    return sync.windowed_counts(t.events, "ts", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN upper(c_name) ELSE c_name END AS name FROM customer")
def incremental_sync(t: Tables) -> DataFrame:
    """The streamed upsert in one batch: rows that arrive replace those of equal id."""
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    done = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return sinks.upsert(old, sync.not_seen(old.select("id", F.upper("name").alias("name")), done), ["id"])


_STOP = ["the", "and", "for", "with", "that", "this"]


@query(f"SELECT doc_id, list_sort(list_distinct(list_filter(string_split_regex(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_-]+', ' ', 'g')), ' +'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w)))) AS keywords FROM documents")
def keywords(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_sort(infer.query_keywords(F.col("text"), _STOP)).alias("keywords"))


@query("SELECT page_id, contains(url, '/en/') OR contains(url, '/de/') AS external FROM pages")
def path_markers(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.col("url").rlike("/(en|de)/").alias("external"))


@query(with_views("SELECT id, file FROM functions WHERE contains(file, 'Brand#1/') OR contains(file, 'Brand#2/')", "functions"))
def symbols_by_file(t: Tables) -> DataFrame:
    tokens = F.array(F.lit("Brand#1/"), F.lit("Brand#2/"))
    return t.functions().where(F.exists(tokens, lambda k: F.contains(F.col("file"), k))).select("id", "file")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_probe(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT DISTINCT source AS source_id FROM documents ORDER BY 1 LIMIT 10")
def list_source_ids(t: Tables) -> DataFrame:
    return t.documents.select(F.col("source").alias("source_id")).distinct().orderBy("source_id").limit(10)
