"""Queries over lookups, the document graph, retrieval in one plan, query understanding, detectors and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import infer
from ..functions import text as X
from ..operators import detectors, frontend, graph, impact, lookup, retrieval, score, sheets
from ..sources import docgraph
from .adapters import Tables, with_views
from .registry import query

_LABELLED = """labelled AS (SELECT 'Region' AS label, 'r:' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'Document', 'n:' || n_nationkey, n_name FROM nation
 UNION ALL SELECT 'Class', 'c:' || c_custkey, c_name FROM customer UNION ALL SELECT NULL, 's:' || s_suppkey, s_name FROM supplier)"""


def _labelled(t: Tables) -> DataFrame:
    """Nodes (label, id, name): regions, nations as documents, customers as classes, suppliers without a label."""
    def part(df: DataFrame, label: str | None, mark: str, key: str, name: str) -> DataFrame:
        return df.select(F.lit(label).cast("string").alias("label"), F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"))

    out = part(t.region, "Region", "r:", "r_regionkey", "r_name").unionByName(part(t.nation, "Document", "n:", "n_nationkey", "n_name"))
    return out.unionByName(part(t.customer, "Class", "c:", "c_custkey", "c_name")).unionByName(part(t.supplier, None, "s:", "s_suppkey", "s_name"))


@query(f"WITH {_LABELLED} SELECT label, id, name FROM labelled WHERE label IN ('Region', 'Class')")
def label_filter(t: Tables) -> DataFrame:
    return lookup.with_labels(_labelled(t), lookup.string_list("Region; Class"))


@query(with_views("SELECT id, name FROM functions WHERE starts_with(name, 'getNew') ORDER BY name, id LIMIT 50", "functions"))
def prefix_search(t: Tables) -> DataFrame:
    return lookup.by_prefix(t.functions().select("id", "name"), "getNew")


@query(with_views("SELECT id, name, kind FROM functions WHERE kind IN ('lambda', 'builtin')", "functions"))
def kind_filter(t: Tables) -> DataFrame:
    return lookup.of_kinds(t.functions().select("id", "name", "kind"), ["lambda", "builtin"])


def _classed(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    kind = lookup.node_class(F.col("label"), none, none, F.when(F.col("id").endswith("7"), F.col("name")), F.col("name"))
    return _labelled(t).withColumn("node_type", kind)


_CLASSED = f"{_LABELLED}, classed AS (SELECT *, CASE WHEN label = 'Document' THEN 'doc' WHEN label = 'Class' THEN 'code' WHEN id LIKE '%7' THEN 'doc' ELSE 'code' END AS node_type FROM labelled)"


@query(f"WITH {_CLASSED} SELECT id, node_type FROM classed")
def node_classes(t: Tables) -> DataFrame:
    return _classed(t).select("id", "node_type")


@query(f"WITH {_CLASSED} SELECT id, label, name, node_type, CASE WHEN node_type = 'doc' THEN length(name) END AS size FROM classed")
def expanded_search(t: Tables) -> DataFrame:
    return lookup.typed(_classed(t).withColumn("size", F.length("name").cast("long")), "doc", expand=True)


@query(with_views("SELECT m.id, count(f.id) AS n, md5(coalesce(string_agg(f.id || '=' || f.name, ',' ORDER BY f.id), '')) AS members FROM (SELECT DISTINCT p_brand AS id FROM part) m LEFT JOIN functions f ON f.module = m.id AND f.kind = 'lambda' WHERE length(m.id) = 8 GROUP BY m.id", "functions"))
def pending_summaries(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_brand").alias("id")).distinct().withColumn("status", F.when(F.length("id") == 8, "pending_summary").otherwise("done"))
    members = t.functions().where("kind = 'lambda'").select(F.col("module").alias("id"), F.col("id").alias("member"), "name")
    found = lookup.pending(nodes, members)
    return found.select("id", F.size("members").cast("long").alias("n"), F.md5(F.array_join(F.transform("members", lambda m: F.concat_ws("=", m["member"], m["name"])), ",")).alias("members"))


@query("SELECT doc_id, strpos(lower(text), lower(w)) - 1 AS start_char, strpos(lower(text), lower(w)) - 1 + length(w) AS end_char FROM (SELECT doc_id, text, split_part(text, ' ', 3) AS w FROM documents) WHERE w <> '' AND strpos(lower(text), lower(w)) > 0")
def span_find(t: Tables) -> DataFrame:
    name = F.coalesce(F.get(F.split("text", " "), F.lit(2)), F.lit(""))
    rows = t.documents.select("doc_id", X.find_span(F.col("text"), name).alias("s")).where("s is not null")
    return rows.select("doc_id", F.col("s.start").cast("long").alias("start_char"), F.col("s.end").cast("long").alias("end_char"))


@query("SELECT doc_id, (i - 1)::INT AS chunk, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, i, substr(text, (i - 1) * 512 + 1, 512) AS c FROM (SELECT doc_id, text, unnest(generate_series(1, greatest(1, ceil(length(text) / 512.0)::BIGINT))) AS i FROM documents))")
def text_chunks(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(X.text_chunks(F.col("text"), 512)).alias("chunk", "c"))
    return rows.select("doc_id", "chunk", F.length("c").cast("long").alias("n"), F.md5("c").alias("digest"))


_UUID = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('BRAND::' || lower(p_name)))"


@query(f"SELECT p_partkey, h[:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS id FROM (SELECT p_partkey, {_UUID} AS h FROM part)")
def entity_ids(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.entity_id(F.lit("BRAND"), F.concat(F.lit('"'), F.upper("p_name"), F.lit('"'))).alias("id"))


@query(with_views("SELECT workflow, 'wf::' || sha256(string_agg(function, '|' ORDER BY function))[:16] AS id FROM steps GROUP BY workflow", "steps"))
def workflow_ids(t: Tables) -> DataFrame:
    return t.steps().groupBy("workflow").agg(X.workflow_id(F.collect_list("function")).alias("id"))


_HINTS = "CASE " + " ".join(f"WHEN contains(lower(arg), '{k}') THEN '{v}'" for k, v in infer.TYPE_HINTS.items()) + " END"


@query(f"SELECT conv_id AS function, place, coalesce(arg_min(hint, (turn, arg)) FILTER (hint IS NOT NULL), '') AS hint FROM (SELECT *, {_HINTS} AS hint FROM (SELECT conv_id, turn, 0 AS place, role AS arg FROM conversations UNION ALL SELECT conv_id, turn, 1, split_part(text, ' ', 1) FROM conversations)) GROUP BY 1, 2")
def argument_types(t: Tables) -> DataFrame:
    sites = t.conversations.select(F.col("conv_id").alias("function"), F.col("turn").alias("caller"), F.array("role", F.split("text", " ")[0]).alias("args"))
    return infer.argument_types(sites)


_DOMAINS = ", ".join(f"CASE WHEN regexp_matches(u, '{'|'.join(infer.DOMAINS[d])}') THEN '{d}' END" for d in sorted(infer.DOMAINS))
_ACTIONS = ", ".join(f"CASE WHEN regexp_matches(text, '(?i){p}') THEN '{a}' END" for p, a in infer.ACTIONS)
_EXPAND = "CASE d " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in infer.EXPANSIONS.items()) + " END"


@query(f"""SELECT conv_id, turn, actions, trim(text) || coalesce(' ' || nullif(array_to_string(list_transform(domains, lambda d: {_EXPAND}), ' '), ''), '') || coalesce(' ' || nullif(array_to_string(actions, ' '), ''), '') AS embedded FROM (
 SELECT conv_id, turn, text, list_filter([{_DOMAINS}], lambda x: x IS NOT NULL) AS domains, list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(list_filter([{_ACTIONS}], lambda x: x IS NOT NULL), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END) AS actions FROM (SELECT *, lower(text) AS u FROM conversations))""")
def query_expansion(t: Tables) -> DataFrame:
    text = F.col("text")
    rows = t.conversations.select("conv_id", "turn", "text", infer.query_actions(text).alias("actions"), infer.domain_signals(text).alias("domains"))
    none = F.array().cast("array<string>")
    return rows.select("conv_id", "turn", "actions", infer.embedding_text(text, none, F.col("actions"), F.col("domains")).alias("embedded"))


@query("SELECT url AS path, page_id || ':' || length(html) AS signature, CASE WHEN length(html) % 2 = 0 THEN md5(html) END AS parsed FROM pages")
def parse_cache(t: Tables) -> DataFrame:
    size = F.length("html")
    files = t.pages.select(F.col("url").alias("path"), F.col("page_id").alias("modified"), size.alias("length"))
    stamp = F.col("page_id") + F.when(size % 2 == 0, 0).otherwise(-1)  # files of odd size have changed since
    cache = t.pages.select(F.col("url").alias("path"), F.concat_ws(":", stamp.cast("string"), size.cast("string")).alias("signature"), F.md5("html").alias("parsed"))
    return docgraph.parse_cache(files, cache)


@query("SELECT 'p' || o_orderpriority[1:1] AS id, o_orderpriority AS name, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS slug, CASE WHEN o_orderpriority[1:1] = '1' THEN -1 ELSE min(o_orderkey) END AS created, count(DISTINCT o_custkey) AS repositories FROM orders GROUP BY o_orderpriority")
def project_graph(t: Tables) -> DataFrame:
    new = t.orders.select(F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("project"), F.col("o_orderpriority").alias("project_name"), F.concat(F.lit("repo"), F.col("o_custkey").cast("string")).alias("repository"), F.col("o_orderkey").cast("long").alias("at"))
    old = t.spark.createDataFrame([("p1", "an old name", "old", -1)], "id string, name string, slug string, created long")
    repos = t.spark.createDataFrame([], "name string, project string, created long")
    projects, _, edges = docgraph.project_graph(old, repos, new)
    return projects.join(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("repositories")), "id")


_MENTIONS = ", m AS (SELECT id, source, words[i] AS name, lower(words[i]) AS entity, round(1.0::DOUBLE / (i + 1), 4) AS confidence, (i - 1)::INT AS pos FROM (SELECT id, source, words, unnest(generate_series(1, len(words))) AS i FROM passages))"


def _mentions(t: Tables) -> DataFrame:
    m = t.passages().select("id", "source", F.explode("mentions").alias("m"))
    return m.select(F.col("source").alias("source_id"), F.col("id").alias("paragraph_id"), F.col("m.id").alias("entity"), F.col("m.confidence").alias("confidence"), F.col("m.pos").alias("start_char"), F.col("m.name").alias("surface"))


@query(with_views(_MENTIONS + " SELECT source AS source_id, id AS paragraph_id, entity, max(confidence) AS confidence, arg_min(pos, (-confidence, pos)) AS start_char, arg_min(name, (-confidence, pos)) AS surface, count(*) AS n FROM m GROUP BY 1, 2, 3", "passages"))
def doc_graph_edges(t: Tables) -> DataFrame:
    return docgraph.has_entity(_mentions(t))


@query(with_views(_MENTIONS + ", old AS (SELECT entity AS id, 'Old ' || entity AS name FROM m GROUP BY entity HAVING count(*) > 20) SELECT e.entity AS id, coalesce(old.name, e.name) AS name, CASE WHEN length(e.entity) % 2 = 0 THEN 'PERSON' ELSE 'PLACE' END AS type, e.entity AS name_norm FROM (SELECT entity, min(name) AS name FROM m GROUP BY entity) e LEFT JOIN old ON old.id = e.entity", "passages"))
def entity_upsert(t: Tables) -> DataFrame:
    m = _mentions(t)
    kind = F.when(F.length("entity") % 2 == 0, "PERSON").otherwise("PLACE")
    new = m.groupBy("entity").agg(F.min("surface").alias("name")).select(F.col("entity").alias("id"), "name", kind.alias("type"), F.col("entity").alias("name_norm"))
    old = m.groupBy("entity").agg(F.count("*").alias("n")).where("n > 20").select(F.col("entity").alias("id"), F.concat(F.lit("Old "), "entity").alias("name"), F.lit("OLD").alias("type"), F.lit("old").alias("name_norm"))
    return docgraph.upsert_entities(old, new)


@query(with_views(_MENTIONS + ", l AS (SELECT id, count(DISTINCT entity) AS n, md5(string_agg(DISTINCT entity, ',' ORDER BY entity)) AS entities FROM m GROUP BY id) SELECT source AS source_id, id AS paragraph_id, md5(text) AS text, coalesce(n, 0) AS n, coalesce(entities, md5('')) AS entities FROM passages LEFT JOIN l USING (id)", "passages"))
def passage_points(t: Tables) -> DataFrame:
    rows = t.passages().select(F.col("source").alias("source_id"), F.col("id").alias("paragraph_id"), "text", F.array(F.lit(0.0)).alias("vector"))
    points = docgraph.passage_points(rows, _mentions(t))
    return points.select("source_id", "paragraph_id", F.md5("payload.text").alias("text"), F.size("payload.entity_ids").cast("long").alias("n"), F.md5(F.array_join("payload.entity_ids", ",")).alias("entities"))


@query("SELECT source AS source_id, doc_id AS paragraph_id, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def paragraphs_by_key(t: Tables) -> DataFrame:
    paragraphs = t.documents.select(F.col("source").alias("source_id"), F.col("doc_id").alias("paragraph_id"), "text")
    keys = t.documents.join(t.benchmark.select(F.col("item_id").alias("doc_id")), "doc_id").select(F.col("source").alias("source_id"), F.col("doc_id").alias("paragraph_id"))
    return docgraph.paragraphs_by_key(paragraphs, keys).select("source_id", "paragraph_id", F.md5("text").alias("digest"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents), k(name, type, n) AS (VALUES ('license', 'LEGAL', 1), ('the license', 'LEGAL', 2), ('all rights reserved', 'LEGAL', 3), ('email', 'CONTACT', 1)),
 g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM w, (SELECT DISTINCT n FROM k) WHERE len(w) >= n))
 SELECT doc_id AS id, name, type, (i - 1)::INT AS pos FROM g JOIN k ON g.n = k.n AND g = name""")
def dictionary_entities(t: Tables) -> DataFrame:
    patterns = t.spark.createDataFrame([("License", "LEGAL"), ("the License", "LEGAL"), ("All rights reserved", "LEGAL"), ("email", "CONTACT")], "pattern string, label string")
    return lookup.dictionary_entities(t.documents.select(F.col("doc_id").alias("id"), "text"), patterns)


_BM25 = """toks AS (SELECT id, regexp_extract_all(lower(concat_ws(' ', name, qualified_name, comment)), '[a-z0-9_]+') AS tokens FROM functions), st AS (SELECT count(*) AS n, avg(len(tokens)) AS ml FROM toks), w AS (SELECT id, unnest(tokens) AS token FROM toks),
 df AS (SELECT token, ln(any_value(n) - count(DISTINCT id) + 0.5::DOUBLE) - ln(count(DISTINCT id) + 0.5::DOUBLE) AS idf FROM w, st GROUP BY token), idf AS (SELECT token, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM df) ELSE idf END AS idf FROM df WHERE token IN ({words})),
 tf AS (SELECT id, token, count(*) AS tf FROM w WHERE token IN ({words}) GROUP BY 1, 2), sc AS (SELECT id, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(tokens) / ml))) AS raw FROM tf JOIN idf USING (token) JOIN toks USING (id), st GROUP BY id),
 bm AS (SELECT id, round(raw / (SELECT max(raw) FROM sc), 6) AS bm25 FROM sc WHERE raw > 0)"""


@query(with_views(", " + _BM25.format(words="'small', 'ring'") + " SELECT id, bm25 AS score, row_number() OVER (ORDER BY bm25 DESC, id)::INT AS rank FROM bm ORDER BY bm25 DESC, id LIMIT 20", "functions"))
def fulltext_search(t: Tables) -> DataFrame:
    return retrieval.fulltext(t.functions(), "small ring", ["name", "qualified_name", "comment"])


@query(with_views("SELECT id, 0.0::DOUBLE AS score, row_number() OVER (ORDER BY id)::INT AS rank FROM functions WHERE contains(lower(name), 'izm') OR contains(lower(coalesce(comment, '')), 'izm') ORDER BY id LIMIT 20", "functions"))
def fulltext_fallback(t: Tables) -> DataFrame:
    return retrieval.fulltext(t.functions(), "izm", ["name", "comment"])


_RETRIEVE = ", " + _BM25.format(words="'small', 'anvil'") + """, q AS (SELECT vector::DOUBLE[] AS v FROM points WHERE id = 7),
 sem AS (SELECT 'p:' || id AS id, round(list_cosine_similarity(vector::DOUBLE[], v), 6) AS s FROM points, q ORDER BY s DESC, 'p:' || id LIMIT 20),
 kw AS (SELECT id FROM functions WHERE contains(lower(name), 'small') OR contains(lower(qualified_name), 'small') OR contains(lower(coalesce(comment, '')), 'small') OR contains(lower(name), 'anvil') OR contains(lower(qualified_name), 'anvil') OR contains(lower(coalesce(comment, '')), 'anvil') ORDER BY id LIMIT 20),
 seeds AS (SELECT id FROM (SELECT id, max(s) AS s FROM (SELECT id, s FROM sem WHERE s > 0 UNION ALL SELECT id, 0.0 FROM kw) GROUP BY id) ORDER BY s DESC, id LIMIT 10),
 e AS (SELECT DISTINCT src, dst FROM calls UNION SELECT dst, src FROM calls), h1 AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM seeds) AND dst NOT IN (SELECT id FROM seeds)),
 h2 AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM h1) AND dst NOT IN (SELECT id FROM seeds) AND dst NOT IN (SELECT id FROM h1)),
 near AS (SELECT id, graph FROM (SELECT id, 1 AS depth, 0.8::DOUBLE AS graph FROM h1 UNION ALL SELECT id, 2, 0.6::DOUBLE FROM h2) ORDER BY depth, id LIMIT 50),
 c AS (SELECT id, max(semantic) AS semantic, max(keyword) AS keyword, max(graph) AS graph, max(bm25) AS bm25 FROM (SELECT id, s AS semantic, 0.0::DOUBLE AS keyword, 0.0::DOUBLE AS graph, 0.0::DOUBLE AS bm25 FROM sem UNION ALL SELECT id, 0, 1, 0, 0 FROM kw UNION ALL SELECT id, 0, 0, graph, 0 FROM near UNION ALL SELECT id, 0, 0, 0, bm25 FROM bm) GROUP BY id),
 n AS (SELECT id, round((semantic - min(semantic) OVER ()) / (max(semantic) OVER () - min(semantic) OVER ()), 6) AS semantic, round((keyword - min(keyword) OVER ()) / (max(keyword) OVER () - min(keyword) OVER ()), 6) AS keyword, graph, bm25 FROM c)
 SELECT id, semantic, keyword, graph, bm25, round((0.35::DOUBLE * semantic + 0.2::DOUBLE * keyword + 0.2::DOUBLE * graph + 0.1::DOUBLE * 0.3::DOUBLE + 0.15::DOUBLE * bm25) / 1.15::DOUBLE, 6) AS score FROM n ORDER BY score DESC, id LIMIT 10"""


@query(with_views(_RETRIEVE, "functions", "calls", "points"))
def hybrid_retrieval(t: Tables) -> DataFrame:
    """Vector, keyword, BM25 and graph parts over the whole tables; the best ten, as the tool has it."""
    points = t.points()
    vector = [float(x) for x in points.where("id = 7").first()["vector"]]
    named = points.select(F.concat(F.lit("p:"), F.col("id").cast("string")).alias("id"), "vector")
    found = retrieval.retrieve(t.functions(), t.calls(), named, vector, ["small", "anvil"], score.profile("default", bm25=0.15))
    return found.select("id", "semantic", "keyword", "graph", "bm25", "score")


@query("SELECT 's1' AS sheet, n_nationkey + 1 AS c, CASE WHEN n_regionkey < 2 THEN r_name || ' / ' || n_name ELSE n_name END AS name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 's1', 0, 'col_0'")
def joined_headers(t: Tables) -> DataFrame:
    """Nations as columns, their regions in a row above where they are the first two, and a column without a name."""
    c = (F.col("n_nationkey") + 1).alias("c")
    above = t.nation.where("n_regionkey < 2").join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.lit("s1").alias("sheet"), F.lit(1).alias("r"), c, F.concat(F.lit(" "), "r_name").alias("value"))
    names = t.nation.select(F.lit("s1").alias("sheet"), F.lit(2).alias("r"), c, F.col("n_name").alias("value"))
    body = t.spark.createDataFrame([("s1", 3, 0, "x"), ("s1", 1, 0, " ")], "sheet string, r int, c int, value string")
    headers = t.spark.createDataFrame([("s1", 1), ("s1", 2)], "sheet string, r int")
    return sheets.joined_headers(above.unionByName(names).unionByName(body), headers)


@query(with_views(", e AS (SELECT DISTINCT src, dst FROM trade WHERE rel_type = 'CALLS'), walk(id, depth) AS (SELECT 'o:5', 0 UNION SELECT dst, depth + 1 FROM walk JOIN e ON e.src = walk.id WHERE depth < 6) SELECT id, min(depth) AS depth FROM walk GROUP BY id", "trade", recursive=True))
def trace_flow_defaults(t: Tables) -> DataFrame:
    """The generic defaults, of which the graph has one."""
    edges = t.trade()
    have = [r.rel_type for r in edges.select("rel_type").distinct().collect()]
    return graph.bfs(edges, t.spark.createDataFrame([("o:5",)], "id string"), 6, rel_types=graph.flow_types("python", None, have))


@query(with_views(", seeds AS (SELECT id FROM functions WHERE contains(lower(name), 'newring') OR contains(lower(qualified_name), 'brand#11.') OR contains(lower(file), 'economy')), e AS (SELECT DISTINCT src, dst FROM calls WHERE src IN (SELECT id FROM functions WHERE size < 5)), live(id, depth) AS (SELECT id, 0 FROM seeds UNION SELECT dst, depth + 1 FROM live JOIN e ON e.src = live.id WHERE depth < 3) SELECT f.id, f.file, coalesce(i.n, 0) AS inbound FROM functions f LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) i ON i.dst = f.id WHERE f.id NOT IN (SELECT id FROM live)", "functions", "calls", recursive=True))
def dead_code_report(t: Tables) -> DataFrame:
    f = t.functions()
    small = f.where("size < 5").select(F.col("id").alias("src"))  # calls of small functions are the ones that are known
    seeds = impact.dead_code_seeds(f, names=["newRing"], qualified=["brand#11."], files=["economy"])
    return impact.dead_nodes(f.select("id", "file"), t.calls().join(small, "src", "left_semi").distinct(), seeds, 3)


_HITS = """, changed(id) AS (VALUES ('p:1'), ('p:2'), ('p:3')), back AS (SELECT id AS changed, id, 0 AS depth FROM changed UNION ALL SELECT DISTINCT dst, src, 1 FROM calls WHERE dst IN (SELECT id FROM changed) AND src <> dst),
 best AS (SELECT changed, workflow, min((depth, step)) AS b FROM (SELECT changed, id, min(depth) AS depth FROM back GROUP BY 1, 2) JOIN steps ON function = id GROUP BY 1, 2),
 hit AS (SELECT changed, workflow, b[1] AS depth, b[2] AS step, domain FROM best JOIN workflows USING (workflow)),
 sev AS (SELECT *, CASE WHEN domain IN ('payment', 'auth') THEN CASE WHEN depth = 0 AND step <= 2 THEN 'critical' WHEN depth = 0 THEN 'high' ELSE 'medium' END WHEN domain IN ('order', 'loyalty') THEN 'medium' ELSE 'low' END AS severity FROM hit)"""


def _impacts(t: Tables) -> tuple[DataFrame, DataFrame]:
    changed = t.spark.createDataFrame([("p:1",), ("p:2",), ("p:3",)], "id string")
    return impact.workflow_impact(t.steps(), t.workflows(), t.calls(), changed, 1), impact.cascades(t.steps(), changed)


@query(with_views(_HITS + " SELECT changed, workflow, depth, severity FROM (SELECT *, row_number() OVER (PARTITION BY changed ORDER BY depth, workflow) AS nth FROM sev WHERE depth > 0) WHERE nth <= 20", "steps", "workflows", "calls"))
def workflow_indirect(t: Tables) -> DataFrame:
    """The nearest twenty of each change, as the tool has it."""
    return impact.indirect(_impacts(t)[0]).select("changed", "workflow", "depth", "severity")


@query(with_views(_HITS + """, cas AS (SELECT function AS changed, count(DISTINCT workflow) AS n FROM steps WHERE function IN (SELECT id FROM changed) GROUP BY 1 HAVING count(DISTINCT workflow) > 1),
 d AS (SELECT changed, string_agg(workflow, ', ' ORDER BY workflow) FILTER (severity = 'critical') AS critical, min((workflow, step)) FILTER (severity = 'critical') AS first, string_agg(workflow, ', ' ORDER BY workflow) FILTER (severity = 'high') AS high, string_agg(workflow, ', ' ORDER BY workflow) AS names FROM sev WHERE depth = 0 GROUP BY changed),
 i AS (SELECT changed, string_agg('Also impacts ' || workflow || ' indirectly (depth=' || depth || ').', ' ' ORDER BY depth, workflow) AS near FROM (SELECT *, row_number() OVER (PARTITION BY changed ORDER BY depth, workflow) AS nth FROM sev WHERE depth > 0) WHERE nth <= 3 GROUP BY changed),
 r AS (SELECT changed, string_agg(DISTINCT domain, ' + ' ORDER BY domain) FILTER (domain IN ('payment', 'auth')) AS risky FROM sev GROUP BY changed)
 SELECT r.changed, concat_ws(' ', CASE WHEN critical IS NOT NULL THEN 'CRITICAL: Changes affect ' || critical || ' at step ' || (first[2] + 1) || CASE WHEN first[2] = 0 THEN ' (entrypoint)' ELSE '' END || '.' WHEN high IS NOT NULL THEN 'HIGH: Changes directly affect ' || high || '.' WHEN names IS NOT NULL THEN 'Changes directly affect: ' || names || '.' END, near,
 CASE WHEN n > 1 THEN 'Shared screen/component used across ' || (n - 1) || ' other workflow(s) — cascade risk HIGH.' END, CASE WHEN risky IS NOT NULL THEN 'Recommended: run e2e tests for ' || risky || ' flows before merge.' ELSE 'Recommended: run integration tests for affected workflows before merge.' END) AS text
 FROM r LEFT JOIN d USING (changed) LEFT JOIN i USING (changed) LEFT JOIN cas USING (changed)""", "steps", "workflows", "calls"))
def workflow_recommendation(t: Tables) -> DataFrame:
    return impact.recommendation(*_impacts(t))


@query("SELECT role AS language, count(*) AS n, min(confidence) AS confidence FROM (SELECT CASE WHEN turn % 2 = 0 THEN 'python' ELSE 'java' END AS role, 0.95::DOUBLE AS confidence FROM conversations) GROUP BY 1")
def message_detectors(t: Tables) -> DataFrame:
    """A sending call of two languages in each turn; tests hold all detectors against examples."""
    python = F.concat(F.lit('bus.publish("'), "role", F.lit('", worker)'))
    java = F.concat(F.lit('sendBroadcast("'), "role", F.lit('", null, worker);'))
    even = F.col("turn") % 2 == 0
    file = F.concat(F.lit("f/"), F.col("conv_id").cast("string"), F.when(even, ".py").otherwise(".java"))
    lines = t.conversations.select(file.alias("file"), F.col("turn").cast("int").alias("line"), F.when(even, python).otherwise(java).alias("text"), F.when(even, "python").otherwise("java").alias("language"))
    found = detectors.detect_messages(lines, "proj", ["python", "java"])
    return found.groupBy(F.when(F.col("file").endswith(".py"), "python").otherwise("java").alias("language")).agg(F.count("*").alias("n"), F.min("confidence").alias("confidence"))


_REACT = [(i, p, c) for f, i, p, c in frontend.SIGNALS if f == "react"]


@query("SELECT page_id AS function, s.intent AS intent, count(*) AS n, max(s.confidence)::DOUBLE AS confidence FROM (SELECT page_id, unnest([" + ", ".join("{{'intent': '{}', 'confidence': CASE WHEN regexp_matches(html, '{}') THEN {} END}}".format(i, p.replace("'", "''"), c) for i, p, c in _REACT) + "]) AS s FROM (SELECT page_id, replace(replace(html, '<div', '<Div'), '<a ', '<Link ') AS html FROM pages)) WHERE s.confidence IS NOT NULL GROUP BY 1, 2")
def framework_signals(t: Tables) -> DataFrame:
    code = F.replace(F.replace("html", F.lit("<div"), F.lit("<Div")), F.lit("<a "), F.lit("<Link "))  # tags as components
    found = frontend.framework_signals(t.pages.select(F.col("page_id").alias("id"), code.alias("code"), F.lit("react").alias("framework")))
    return found.groupBy("function", "intent").agg(F.count("*").alias("n"), F.max("confidence").cast("double").alias("confidence"))
