"""What grows with the square of a group, or of a table, in operators that need not: results, and rows on the way."""

import random
import threading

from pyspark.sql import functions as F

from loomgraph.functions import infer
from loomgraph.operators import code, dag, docs, graph, impact, lookup, match, search
from loomgraph.plans import adapters, search_queries


def within(spark, seconds, job):
    """What job() returns; its Spark jobs are cancelled after so many seconds, which makes it fail."""
    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return job()
    finally:
        timer.cancel()


def test_equal_calls_and_endpoints_are_scored_once(spark, monkeypatch):
    calls = spark.createDataFrame([(i, f"/en/{'x' if i % 2 else ':id'}", "GET", None if i % 5 == 0 else "getPage", "a.ts") for i in range(200)], "id long, url string, method string, name string, file string")
    ends = spark.createDataFrame([(1000 + i, f"/en/{'y' if i % 2 else ':id'}", "GET", "getPage", "b.ts") for i in range(200)], "id long, path string, method string, name string, file string")
    seen, real = [], match.score_pairs
    monkeypatch.setattr(match, "score_pairs", lambda pairs: seen.append(pairs.count()) or real(pairs))
    got = {r.call: (r.endpoint, r.confidence) for r in match.best_matches(calls, ends, 0.5).collect()}
    assert seen[0] <= 8  # 4 kinds of calls, 2 of endpoints; it was one row for each call and endpoint
    one = {r.call: (r.endpoint, r.confidence) for r in real(match.candidates(calls.where("id in (0, 2)"), ends).join(calls.selectExpr("id as call", "url", "method as call_method", "name as function", "file as call_file"), "call").join(ends.selectExpr("id as endpoint", "path", "method", "name as handler", "file as endpoint_file"), "endpoint")).where("endpoint = 1000").collect()}
    assert got.keys() >= set(range(0, 200, 2)) and all(got[i] == one[0 if i % 5 == 0 else 2] for i in range(0, 200, 2))


def brute_callee(rows, functions):
    """The callee of the rows of one call, by their candidates one by one."""
    cand = [(r, f) for r in rows for f in functions if r[1] is not None and f[1] == r[1]]
    same = [(r, f) for r, f in cand if r[2] is not None and r[2] == f[2]]
    cand = same or cand
    typed = [f[0] for r, f in cand if r[4] is not None and f[3] is not None and f[3].endswith(r[4])]
    scoped = [f[0] for r, f in cand if r[3] is not None and r[3] == f[3]]
    return cand[0][1][0] if len(cand) == 1 else typed[0] if len(typed) == 1 else scoped[0] if len(scoped) == 1 else None


def test_call_resolution_against_brute_force(spark):
    rng = random.Random(3)
    pick = lambda *values: rng.choice(values)
    functions = [(f"f{i}", pick(*"abcdefgh", None), pick(0, 1, 2, None), pick("m.A", "m.B", "n.A", "n.C", None)) for i in range(24)]
    calls = [(rng.randrange(300), pick(*"abcdefghi", None), pick(0, 1, 2, None), pick("m.A", "m.B", "n.A", "n.C", None), pick("A", "m.B", "C", "", None, None)) for _ in range(400)]
    got = code.resolve_calls(spark.createDataFrame(calls, "call int, name string, arity int, scope string, field_type string"), spark.createDataFrame(functions, "id string, name string, arity int, scope string"))
    want = {c: brute_callee([r for r in calls if r[0] == c], functions) for c in {r[0] for r in calls}}
    assert {r.call: r.callee for r in got.collect()} == {c: f for c, f in want.items() if f is not None}
    assert len(set(want.values())) > 8


def test_calls_of_a_common_name_meet_counts(spark):
    n = 60_000
    functions = spark.range(n).select(F.concat(F.lit("f"), "id").alias("id"), F.lit("get").alias("name"), F.lit(0).alias("arity"), F.concat(F.lit("m"), "id").alias("scope"))
    calls = spark.range(n).select(F.col("id").alias("call"), F.lit("get").alias("name"), F.lit(0).alias("arity"), F.concat(F.lit("m"), "id").alias("scope"), F.lit(None).cast("string").alias("field_type"))
    got = within(spark, 90, lambda: code.resolve_calls(calls, functions).where("callee = concat('f', call)").count())
    assert got == n


def test_nodes_with_edges_both_ways_are_drawn_together(spark, monkeypatch):
    """Chains of pairs that hang on each other: every pair was a round of its own."""
    rng, names = random.Random(5), [f"n{i:02d}" for i in range(90)]
    rng.shuffle(names)
    edges = [(a, b) for i in range(0, 90, 3) for a, b in ((names[i], names[i + 1]), (names[i + 1], names[i]), (names[i + 1], names[i + 2]), (names[i + 2], names[i + 1]))]
    edges += [(names[i], names[i + 3]) for i in range(0, 87, 3)]  # one way along the chain
    edges += [(names[8], names[0]), ("loop", "loop"), ("in", names[0])]  # the first three groups are a cycle; a loop; a leaf
    df, colours, real = spark.createDataFrame(edges, "src string, dst string"), [], dag._smallest
    monkeypatch.setattr(dag, "_smallest", lambda live: colours.append(1) or real(live))
    got = {r.id: (r.scc, r.size, r.is_cycle) for r in dag.scc(df, small=40).collect()}
    groups = [names[:9], *(names[i : i + 3] for i in range(9, 90, 3))]
    want = {n: (min(g), len(g), True) for g in groups for n in g} | {"loop": ("loop", 1, True), "in": ("in", 1, False)}
    assert got == want and len(colours) < 5
    assert {(r.id, r.wave) for r in dag.condensed_waves(df).collect()} >= {(names[0], 1), ("in", 0), (names[9], 2), (names[12], 3)}


def test_shared_steps_from_two_on(spark):
    rng = random.Random(7)
    flows = {f"w{i}": {f"f{rng.randrange(40)}" for _ in range(rng.choice((1, 2, 4, 8, 20)))} for i in range(60)}
    steps = spark.createDataFrame([(w, f) for w, fs in flows.items() for f in fs for _ in range(2)] + [("w1", None), (None, "f1")], "workflow string, function string")
    for least in (1, 2, 3):
        want = {(a, b, len(flows[a] & flows[b])) for a in flows for b in flows if a < b and len(flows[a] & flows[b]) >= least}
        assert {tuple(r) for r in impact.shared_steps(steps, least, wide=6).collect()} == want
    # one step that all workflows have: 40,000 x 40,000 / 2 rows for pairs that share it alone
    n = 40_000
    common = spark.range(n).select(F.concat(F.lit("w"), "id").alias("workflow"), F.explode(F.array(F.lit("all"), F.concat(F.lit("f"), (F.col("id") / 2).cast("long").cast("string")))).alias("function"))
    assert within(spark, 60, lambda: impact.shared_steps(common, 2).count()) == n // 2


def test_domains_are_searched_as_plain_text(spark):
    texts = ["", None, "PAYMENT of ORDERS", "giỏ HÀNG đăng nhập", "nothing", "x500y", *(t for ts in infer.DOMAINS.values() for t in ts)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", infer.domain_signals(F.col("text")).alias("d"))
    assert "rlike" not in df._jdf.queryExecution().executedPlan().toString().lower()
    for r in df.collect():
        assert r.d == [d for d in sorted(infer.DOMAINS) if any(t in (r.text or "").lower() for t in infer.DOMAINS[d])]


def test_phrases_are_sent_to_the_texts(spark):
    df = spark.createDataFrame([(1, "All rights Reserved. The license"), (2, None)], "id long, text string")
    known = spark.createDataFrame([("license", "L"), ("the License", "L"), ("all rights reserved", "R")], "pattern string, label string")
    sent, dealt = lookup.dictionary_entities(df, known), lookup.dictionary_entities(df, known, most_sent=2)
    want = {(1, "license", "L", 4), (1, "the license", "L", 3), (1, "all rights reserved", "R", 0)}
    assert {tuple(r) for r in sent.collect()} == {tuple(r) for r in dealt.collect()} == want
    probe = sent.withColumn("x", F.lit(1))
    assert probe._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 3


def test_a_small_frontier_is_sent_to_the_edges(spark, monkeypatch):
    edges = spark.createDataFrame([(f"n{i}", f"n{j}", t) for i in range(60) for j in (i * 2, i * 2 + 1, i) for t in ("a", "b")], "src string, dst string, rel_type string")
    seeds, dealt, real = spark.createDataFrame([("n1",), ("n7",)], "id string"), [], graph.laid_out
    monkeypatch.setattr(graph, "laid_out", lambda *a: dealt.append(1) or real(*a))
    got = {way: {tuple(r) for r in graph.bfs(edges, seeds, 3, way).collect()} for way in ("out", "in", "both")}
    assert not dealt
    monkeypatch.setattr(graph, "SENT", 1)  # a wide frontier: the edges are dealt out once
    assert got == {way: {tuple(r) for r in graph.bfs(edges, seeds, 3, way).collect()} for way in got} and len(dealt) == 3
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(125)], "id string")
    want = {(r.id, r.inbound) for r in impact.dead_nodes(nodes, edges, seeds, 2).collect()}
    assert want == {(r.id, r.inbound) for r in impact.dead_nodes(nodes, edges, seeds, 2, edges.select("src", "dst").distinct()).collect()}
    assert ("n0", 4) in want and ("n124", 0) in want and not {"n1", "n7", "n14"} & {i for i, _ in want}


def test_neighbouring_mentions_need_no_join(spark, tmp_path, monkeypatch):
    texts = ["Ann met Bob. Cid saw Ann, Bob", "lower only", None, "Ann", "Bob Bob Eve"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    plans, real = [], docs.expand_relations
    monkeypatch.setattr(docs, "expand_relations", lambda rel, *a: plans.append(rel._jdf.queryExecution().optimizedPlan().toString()) or real(rel, *a))
    got = {tuple(r) for r in search_queries.relation_expand(adapters.Tables(spark, str(tmp_path))).collect()}
    assert got == {("ann", "bob", 1), ("ann", "cid", 1), ("bob", "ann", 2), ("bob", "cid", 2), ("bob", "eve", 2), ("cid", "ann", 2), ("cid", "bob", 2)}
    assert "Join" not in plans[0]
    rel = spark.createDataFrame([("a", "R", f"b{i}") for i in range(9)], "source string, relation string, target string")
    some = real(rel, spark.createDataFrame([("a",)], "id string"), 3, 4).collect()
    assert [(r.target, r.hop) for r in sorted(some)] == [(f"b{i}", 1) for i in range(4)]


def test_nearest_points_by_small_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-3, 4)) or 1.0 for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").coalesce(1)
    queries = df.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    one, small = ({tuple(r) for r in search.knn_join(queries, df, 5, block=b).collect()} for b in (1000, 7))
    assert one == small and len(one) == 100
