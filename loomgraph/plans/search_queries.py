"""Queries over text and vectors: search, ranking, matching, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import docs, match, score, search
from ..session import cut
from .adapters import Tables, with_views
from .registry import query


@query(with_views("SELECT id, name FROM functions WHERE contains(lower(coalesce(name, '')), 'ring') OR contains(lower(coalesce(qualified_name, '')), 'ring')", "functions"))
def contains_search(t: Tables) -> DataFrame:
    return t.functions().where(search.any_contains([F.col("name"), F.col("qualified_name")], ["RING"])).select("id", "name")


@query(with_views("SELECT id, comment FROM functions WHERE module <> 'Brand#1' AND (contains(coalesce(comment, ''), 'red') OR contains(coalesce(summary, ''), 'red') OR contains(coalesce(comment, ''), 'small') OR contains(coalesce(summary, ''), 'small'))", "functions"))
def token_or_search(t: Tables) -> DataFrame:
    f = t.functions()
    return f.where(F.col("module") != "Brand#1").where(search.any_contains([F.col("comment"), F.col("summary")], search.or_terms("red| small "), ignore_case=False)).select("id", "comment")


@query("SELECT doc_id, source FROM documents WHERE NOT (contains(text, 'the') OR contains(text, 'and')) AND contains(text, 'e')")
def none_of_tokens(t: Tables) -> DataFrame:
    tokens = F.array(F.lit("the"), F.lit("and"))
    return t.documents.where(~F.exists(tokens, lambda k: F.contains(F.col("text"), k)) & F.col("text").contains("e")).select("doc_id", "source")


_BM25 = """, toks AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS tokens FROM documents), st AS (SELECT count(*) AS n, avg(len(tokens)) AS ml FROM toks), w AS (SELECT id, unnest(tokens) AS token FROM toks),
 df AS (SELECT token, count(DISTINCT id) AS df, ln(any_value(n) - count(DISTINCT id) + 0.5::DOUBLE) - ln(count(DISTINCT id) + 0.5::DOUBLE) AS idf FROM w, st GROUP BY token), idf AS (SELECT token, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM df) ELSE idf END AS idf FROM df WHERE token IN ('license', 'version', 'the')),
 tf AS (SELECT id, token, count(*) AS tf FROM w WHERE token IN ('license', 'version', 'the') GROUP BY 1, 2), sc AS (SELECT id, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(tokens) / ml))) AS raw FROM tf JOIN idf USING (token) JOIN toks USING (id), st GROUP BY id)
 SELECT id, round(raw / (SELECT max(raw) FROM sc), 6) AS score FROM sc WHERE raw > 0"""


@query("WITH " + _BM25.lstrip(", "))
def bm25_scores(t: Tables) -> DataFrame:
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
    rows = t.documents.select(F.col("doc_id").alias("id"), tokens.alias("tokens"))
    return search.bm25(rows, ["license", "version", "the"]).select("id", F.round("score", 6).alias("score"))


_QUERY = "(SELECT vector::DOUBLE[] FROM points WHERE id = 7)"


def _vector(t: Tables, i: int) -> list[float]:
    return [float(x) for x in t.points().where(F.col("id") == i).first()["vector"]]


@query(with_views(f"SELECT id, round(list_cosine_similarity(vector::DOUBLE[], {_QUERY}), 6) AS score FROM points ORDER BY score DESC, id LIMIT 20", "points"))
def knn_cosine_topk(t: Tables) -> DataFrame:
    return search.knn(t.points(), _vector(t, 7), 20).select("id", "score")


@query(with_views(f"SELECT id, round(list_cosine_similarity(vector::DOUBLE[], {_QUERY}), 6) AS score FROM points WHERE collection IN ('c1', 'c2') ORDER BY score DESC, id LIMIT 10", "points"))
def knn_filtered(t: Tables) -> DataFrame:
    return search.knn(t.points(), _vector(t, 7), 10, F.col("collection").isin("c1", "c2")).select("id", "score")


@query(with_views(f"SELECT id, round(max(s), 6) AS score FROM (SELECT id, s FROM (SELECT id, collection, round(list_cosine_similarity(vector::DOUBLE[], {_QUERY}), 6) AS s, row_number() OVER (PARTITION BY collection ORDER BY round(list_cosine_similarity(vector::DOUBLE[], {_QUERY}), 6) DESC, id) AS rn FROM points) WHERE rn <= 5) GROUP BY id ORDER BY score DESC, id LIMIT 15", "points"))
def multi_collection_merge(t: Tables) -> DataFrame:
    return search.merge_collections(t.points(), _vector(t, 7), 5, 15)


@query(with_views("SELECT query_id, id, score, rank::INT AS rank FROM (SELECT q.id AS query_id, p.id, round(list_cosine_similarity(q.vector::DOUBLE[], p.vector::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.vector::DOUBLE[], p.vector::DOUBLE[]), 6) DESC, p.id) AS rank FROM points q, points p WHERE q.id % 50 = 0) WHERE rank <= 3", "points"))
def knn_join_topk(t: Tables) -> DataFrame:
    p = t.points()
    return search.knn_join(p.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), p, 3)


@query("SELECT o_orderkey AS id, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS price FROM orders")
def minmax_signals(t: Tables) -> DataFrame:
    return score.min_max(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), ["price"])


_SIG = ", sig AS (SELECT p_partkey AS id, (p_size % 7)::DOUBLE / 7 AS semantic, (p_size % 5)::DOUBLE / 5 AS keyword, (p_size % 3)::DOUBLE / 3 AS graph, 0.3::DOUBLE AS freshness, (p_size % 2)::DOUBLE AS confidence, 0::DOUBLE AS usage FROM part)"


def _signals(t: Tables) -> DataFrame:
    m = lambda k: (F.col("p_size") % k).cast("double") / k
    return t.part.select(F.col("p_partkey").alias("id"), m(7).alias("semantic"), m(5).alias("keyword"), m(3).alias("graph"), F.lit(0.3).alias("freshness"), (F.col("p_size") % 2).cast("double").alias("confidence"), F.lit(0.0).alias("usage"))


@query("WITH " + _SIG.lstrip(", ") + " SELECT id, round(0.2::DOUBLE * semantic + 0.1::DOUBLE * keyword + 0.5::DOUBLE * graph + 0.05::DOUBLE * freshness + 0.1::DOUBLE * confidence + 0.05::DOUBLE * usage, 6) AS score FROM sig")
def weighted_scores(t: Tables) -> DataFrame:
    return _signals(t).select("id", score.weighted(score.profile("structural")).alias("score"))


@query("WITH " + _SIG.lstrip(", ") + ", s AS (SELECT id, round(0.35::DOUBLE * semantic + 0.2::DOUBLE * k + 0.2::DOUBLE * graph + 0.1::DOUBLE * freshness + 0.1::DOUBLE * confidence, 6) AS score FROM (SELECT *, greatest(keyword, CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END) AS k FROM sig JOIN part ON p_partkey = id)) SELECT id, score FROM s ORDER BY score DESC, id LIMIT 10")
def hybrid_search(t: Tables) -> DataFrame:
    hits = t.part.where(search.any_contains([F.col("p_name")], ["ring"])).select(F.col("p_partkey").alias("id"), F.lit(1.0).alias("keyword"))
    return score.hybrid([_signals(t), hits], score.profile("default"), 10).select("id", "score")


@query("WITH " + _SIG.lstrip(", ") + ", s AS (SELECT id, round(0.5::DOUBLE * semantic + 0.15::DOUBLE * keyword + 0.1::DOUBLE * graph + 0.05::DOUBLE * freshness + 0.15::DOUBLE * confidence + 0.05::DOUBLE * usage, 6) AS score FROM sig) SELECT round(avg(score), 3) AS confidence, count(*) AS n FROM (SELECT score FROM s ORDER BY score DESC, id LIMIT 5)")
def result_confidence(t: Tables) -> DataFrame:
    return score.result_confidence(_signals(t).select("id", score.weighted(score.profile("semantic")).alias("score")))


@query("WITH " + _SIG.lstrip(", ") + " SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN 0.9::DOUBLE END, semantic) AS semantic FROM sig")
def inject_signals(t: Tables) -> DataFrame:
    sig = _signals(t).select("id", "semantic")
    return score.inject(sig, sig.where("id % 2 = 0").select("id", F.lit(0.9).alias("semantic")), ["semantic"])


@query("SELECT event_id, CASE WHEN value > 90 THEN 1.0::DOUBLE ELSE round(exp(-ln(2::DOUBLE) * (event_id * 3600)::DOUBLE / (30 * 86400)), 6) END AS freshness FROM events")
def freshness_decay(t: Tables) -> DataFrame:
    return t.events.select("event_id", score.freshness(F.col("event_id") * 3600.0, dirty=F.coalesce(F.col("value") > 90, F.lit(False))).alias("freshness"))


@query("SELECT c_custkey, round(greatest(0, least(1, c_acctbal / 25)), 6)::DOUBLE AS signal FROM customer")
def bounded_signal(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", score.bounded(F.col("c_acctbal"), 0, 25).alias("signal"))


_MENTIONS = ", m AS (SELECT id, words[i] AS name, lower(words[i]) AS entity, CASE WHEN len(words[i]) % 2 = 0 THEN 'PERSON' ELSE 'PLACE' END AS type, round(1.0::DOUBLE / (i + 1), 4) AS confidence, (i - 1)::INT AS pos FROM (SELECT id, words, unnest(generate_series(1, len(words))) AS i FROM passages))"


@query(with_views(_MENTIONS + ", a AS (SELECT id, count(DISTINCT entity) AS u, count(*) FILTER (type = 'PERSON') AS h, avg(confidence) AS c FROM m GROUP BY id) SELECT id, round(score + 0.05::DOUBLE * coalesce(u, 0) + 0.1::DOUBLE * coalesce(h, 0) + 0.3::DOUBLE * coalesce(c, 0) - 0.0002::DOUBLE * length(text), 6) AS score FROM passages LEFT JOIN a USING (id)", "passages"))
def rerank_passages(t: Tables) -> DataFrame:
    return t.passages().select("id", score.rerank(["PERSON"]).alias("score"))


@query(with_views(_MENTIONS + " SELECT entity, count(*) AS n FROM m GROUP BY entity HAVING count(*) >= 3", "passages"))
def entity_gate(t: Tables) -> DataFrame:
    rows = t.passages().select("score", F.transform("mentions", lambda m: m["id"]).alias("entities"))
    return docs.expandable(rows, 0.5, 3)


@query(with_views(_MENTIONS + " SELECT type || '::' || lower(name) AS key, type, arg_min(name, (-len(name), rowid)) AS name, max(confidence) AS confidence, count(*) AS n FROM (SELECT *, id * 100000000 + pos AS rowid FROM m) GROUP BY type, lower(name)", "passages"))
def entity_merge(t: Tables) -> DataFrame:
    m = t.passages().select("id", F.explode("mentions").alias("m")).select((F.col("id") * 100000000 + F.col("m.pos")).alias("pos"), "m.name", "m.type", "m.confidence")
    return docs.merge_entities(m).select("key", "type", "name", "confidence", "n")


@query(with_views(_MENTIONS + " SELECT entity, arg_min(id, (-confidence, pos, id)) AS passage, max(confidence) AS confidence FROM m GROUP BY entity", "passages"))
def primary_mention(t: Tables) -> DataFrame:
    m = t.passages().select("id", F.explode("mentions").alias("m")).select(F.col("m.id").alias("entity"), F.col("id").alias("passage"), F.col("m.confidence").alias("confidence"), F.col("m.pos").alias("start_char"))
    return docs.primary_mention(m.select("entity", "confidence", "start_char", "passage")).select("entity", "passage", "confidence")


_REL = _MENTIONS + ", rel AS (SELECT DISTINCT a.entity AS source, b.entity AS target FROM m a JOIN m b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.entity <> b.entity), sym AS (SELECT source, target FROM rel UNION SELECT target, source FROM rel), top AS (SELECT min(source) AS id FROM rel)"


@query(with_views(_REL + ", h1 AS (SELECT source, target FROM sym JOIN top ON source = id), f AS (SELECT target AS id FROM h1 EXCEPT SELECT id FROM top), h2 AS (SELECT source, target FROM sym JOIN f ON source = f.id EXCEPT SELECT source, target FROM h1) SELECT source, target, 1 AS hop FROM h1 UNION ALL SELECT source, target, 2 FROM h2", "passages"))
def relation_expand(t: Tables) -> DataFrame:
    ids = F.transform("mentions", lambda m: m["id"])
    pairs = F.zip_with(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), F.slice(ids, 2, F.size(ids)), lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    near = t.passages().select(F.explode(F.array_distinct(pairs)).alias("p")).select("p.source", "p.target").where("source != target")
    rel = cut(near.distinct()).select("source", F.lit("NEXT").alias("relation"), "target")
    seeds = rel.agg(F.min("source").alias("id"))
    return docs.expand_relations(rel, seeds, 2, 1_000_000).select("source", "target", "hop")


_PARA = "SELECT doc_id AS id, (p - 1)::INT AS para, (c - 1)::INT AS chunk, trim(substr(block, ((c - 1) * 300 + 1)::INT, 300), chr(10) || ' ') AS text FROM (SELECT doc_id, p, block, unnest(generate_series(1, greatest(1, ceil(length(block) / 300.0)::INT))) AS c FROM (SELECT doc_id, generate_subscripts(l, 1) AS p, unnest(l) AS block FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)))"


@query(f"SELECT id, para, chunk, length(text) AS n, md5(text) AS digest, length(text) < 150 AS short FROM ({_PARA}) WHERE text <> ''")
def paragraph_split(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("id"), F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return docs.paragraphs(rows, 300).select("id", "para", "chunk", F.length("text").cast("long").alias("n"), F.md5("text").alias("digest"), "short")


@query(with_views(", u AS (SELECT DISTINCT url FROM urls WHERE url <> '' AND url <> '/'), p AS (SELECT a.url AS call, b.url AS endpoint, string_split(ltrim(a.url, '/'), '/') AS x, string_split(ltrim(b.url, '/'), '/') AS y FROM u a, u b), s AS (SELECT call, endpoint, CASE WHEN call = endpoint THEN 1.0 WHEN len(x) <> len(y) THEN CASE WHEN x[:least(len(x), len(y))] = y[:least(len(x), len(y))] THEN 0.6 ELSE 0 END ELSE (SELECT CASE WHEN sum(h) = len(x) THEN 0.85 ELSE round(sum(h) * 0.7 / len(x), 2) END FROM (SELECT unnest(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN x[i] = y[i] OR left(x[i], 1) = ':' OR left(y[i], 1) = ':' THEN 1 ELSE 0 END)) AS h)) END AS score FROM p) SELECT call, endpoint, score::DOUBLE AS score FROM s WHERE score > 0", "urls"))
def path_match(t: Tables) -> DataFrame:
    u = t.urls().where("url != '' and url != '/'").select("url").distinct()
    pairs = u.select(F.col("url").alias("call")).join(u.select(F.col("url").alias("endpoint")), F.lit(True))
    return pairs.withColumn("score", X.path_match(F.col("call"), F.col("endpoint"))).where("score > 0")


@query("SELECT page_id, CASE WHEN p = '' OR p = '/' THEN NULL ELSE p END AS pattern FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+|[?#].*$', '', 'g'), '/+$', ''), '/[0-9]+', '/:id', 'g') AS p FROM pages)")
def url_normalise(t: Tables) -> DataFrame:
    raw = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+|#.*$", ""), "/[0-9]+", "/{id}")
    return t.pages.select("page_id", X.url_pattern(raw).alias("pattern"))


@query(with_views(", c AS (SELECT id AS call, url FROM urls WHERE id % 2 = 1 AND url <> ''), e AS (SELECT id AS endpoint, url AS path FROM urls WHERE id % 2 = 0 AND url <> ''), s AS (SELECT call, endpoint FROM c JOIN e ON url = path) SELECT call, min(endpoint) AS endpoint FROM s GROUP BY call", "urls"))
def api_match_best(t: Tables) -> DataFrame:
    u = t.urls().where("url != ''")
    side = lambda odd, path: u.where(f"id % 2 = {odd}").select("id", F.col("url").alias(path), F.lit("GET").alias("method"), F.lit("getPage").alias("name"), F.lit("src/pages.ts").alias("file"))
    return match.best_matches(side(1, "url"), side(0, "path"), 0.9).select("call", "endpoint")


_NAMES = "n AS (SELECT DISTINCT name, ['get', lower(regexp_extract(name, '^get([A-Z][a-z]+)', 1)), lower(regexp_extract(name, '([A-Z][a-z]+)$', 1))] AS t FROM functions), w AS (SELECT * FROM (SELECT DISTINCT name, unnest(t) AS word FROM n) WHERE word NOT IN ('get', 'new'))"


@query(with_views(f", {_NAMES}, p AS (SELECT DISTINCT a.name AS a, b.name AS b FROM w a JOIN w b USING (word) WHERE a.name < b.name) SELECT p.a, p.b, len(list_intersect(x.t, y.t))::DOUBLE / len(list_distinct(x.t || y.t)) AS similarity FROM p JOIN n x ON x.name = p.a JOIN n y ON y.name = p.b", "functions"))
def token_jaccard(t: Tables) -> DataFrame:
    """Pairs of names of all functions that share a token besides their verb."""
    return match.similar_names(t.functions().select("name"))


@query("SELECT turn, role, v, CASE WHEN v = 'id' THEN 1.0::DOUBLE WHEN v = 'userid' THEN 0.4::DOUBLE WHEN v = 'slug' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END AS score FROM (SELECT DISTINCT turn, role FROM conversations), (SELECT unnest(['id', 'userid', 'slug', 'fixed']) AS v)")
def pathvar_compat(t: Tables) -> DataFrame:
    rows = t.conversations.select("turn", "role").distinct().withColumn("v", F.explode(F.array(*map(F.lit, ("id", "userid", "slug", "fixed")))))
    other = F.when(F.col("v") == "fixed", "/users/fixed").otherwise(F.concat(F.lit("/users/:"), F.col("v")))
    return rows.select("turn", "role", "v", X.path_variables(F.lit("/users/:id"), other).alias("score"))


@query("SELECT conv_id, turn, CASE WHEN contains(l, 'interface') OR contains(l, 'calls') OR contains(l, 'imports') OR contains(l, 'extends') THEN 'structural' WHEN contains(l, 'fresh') OR contains(l, 'stale') OR contains(l, 'dirty') OR contains(l, 'today') THEN 'temporal' WHEN contains(l, 'like') OR contains(l, 'explain') OR contains(l, 'describe') OR contains(l, 'concept') THEN 'semantic' ELSE 'default' END AS intent FROM (SELECT conv_id, turn, lower(text) AS l FROM conversations)")
def intent_classify(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", X.query_intent(F.col("text")).alias("intent"))


_HASH = "SELECT doc_id AS id, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS value FROM (SELECT doc_id, (('0x' || right(sha1(token), 3))::INT % 1024)::INT AS bucket, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_:.]+')) AS token FROM documents) GROUP BY 1, 2)"


@query(_HASH)
def hash_embedding(t: Tables) -> DataFrame:
    return search.hash_buckets(t.documents.select(F.col("doc_id").alias("id"), "text"))


@query("SELECT id, list(round(v, 6) ORDER BY place) AS vector FROM (SELECT label AS id, place, avg(v) AS v FROM (SELECT label, generate_subscripts(embedding, 1) AS place, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY 1, 2) GROUP BY id")
def chunk_mean_pool(t: Tables) -> DataFrame:
    rows = t.embeddings.select(F.col("label").alias("id"), F.col("embedding").alias("vector"))
    return search.mean_pool(rows).select("id", F.transform("vector", lambda v: F.round(v, 6)).alias("vector"))
