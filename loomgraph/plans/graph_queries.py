"""Queries over graphs: traversal, ordering, joins along edges, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import code, dag, graph, impact
from .adapters import Tables, with_views
from .registry import query


def _seed(t: Tables, *ids: str) -> DataFrame:
    return t.spark.createDataFrame([(i,) for i in ids], "id string")


_WALK = """, e AS (SELECT DISTINCT src, dst FROM trade), walk(id, depth) AS (SELECT '{seed}', 0 UNION SELECT {to}, depth + 1 FROM walk JOIN {edges} e ON e.{frm} = walk.id WHERE depth < {d})"""
_BOTH = "(SELECT src, dst FROM e UNION SELECT dst, src FROM e)"


@query(with_views(_WALK.format(seed="o:1", to="dst", frm="src", edges="e", d=3) + " SELECT id, min(depth) AS depth FROM walk GROUP BY id", "trade", recursive=True))
def subgraph_khop(t: Tables) -> DataFrame:
    return graph.bfs(t.links(), _seed(t, "o:1"), 3)


@query(with_views(_WALK.format(seed="s:1", to="src", frm="dst", edges="e", d=2) + " SELECT id, min(depth) AS depth FROM walk GROUP BY id", "trade", recursive=True))
def subgraph_in(t: Tables) -> DataFrame:
    return graph.bfs(t.links(), _seed(t, "s:1"), 2, "upstream")


@query(with_views(_WALK.format(seed="o:1", to="dst", frm="src", edges=_BOTH, d=2) + " SELECT id, min(depth) AS depth FROM walk GROUP BY id", "trade", recursive=True))
def subgraph_both(t: Tables) -> DataFrame:
    return graph.bfs(t.links(), _seed(t, "o:1"), 2, "both")


@query(with_views(_WALK.format(seed="o:1", to="dst", frm="src", edges="e", d=2) + " SELECT src, dst, rel_type, calls FROM trade WHERE src IN (SELECT id FROM walk WHERE depth < 2)", "trade", recursive=True))
def subgraph_edges(t: Tables) -> DataFrame:
    return graph.subgraph_edges(t.trade(), graph.bfs(t.links(), _seed(t, "o:1"), 2), 2)


_TYPED = """, e AS (SELECT DISTINCT src, dst FROM trade WHERE rel_type IN ('CALLS', 'CALLS_FUNCTION_POINTER')), walk(id, depth) AS (SELECT 'o:3', 0 UNION SELECT dst, depth + 1 FROM walk JOIN e ON e.src = walk.id WHERE depth < 6) SELECT id, min(depth) AS depth FROM walk GROUP BY id"""


@query(with_views(_TYPED, "trade", recursive=True))
def trace_flow_types(t: Tables) -> DataFrame:
    return graph.bfs(t.links(), _seed(t, "o:3"), 6, rel_types=["CALLS", "CALLS_FUNCTION_POINTER"])


_BETWEEN = """, e AS (SELECT DISTINCT src, dst FROM calls), walk AS (SELECT src AS source, dst AS target, [src, dst] AS path, 1 AS length FROM e JOIN functions ON id = src WHERE module = 'Brand#1' AND src <> dst
  UNION ALL SELECT source, dst, list_append(path, dst), length + 1 FROM walk JOIN e ON e.src = target WHERE length < 2 AND NOT list_contains(path, dst)),
  best AS (SELECT source, target, arg_min(path, (length, path)) AS path, min(length)::INT AS length FROM walk WHERE target IN (SELECT id FROM functions WHERE module = 'Brand#2') GROUP BY source, target)"""


def _between(t: Tables) -> DataFrame:
    f = t.functions()
    return graph.paths_between_sets(t.calls(), f.where("module = 'Brand#1'").select("id"), f.where("module = 'Brand#2'").select("id"), 2)


@query(with_views(_BETWEEN + " SELECT source, target, array_to_string(path, '>') AS path, length FROM best", "functions", "calls", recursive=True))
def module_paths(t: Tables) -> DataFrame:
    return _between(t).select("source", "target", F.array_join("path", ">").alias("path"), "length")


@query(with_views(_BETWEEN + " SELECT source, target, array_to_string(path, '>') AS path, length FROM best ORDER BY length, source, target LIMIT 20", "functions", "calls", recursive=True))
def trace_between_modules(t: Tables) -> DataFrame:
    """The 20 shortest, as the tool's limit has it."""
    f = t.functions()
    side = lambda token: f.where(F.contains(F.col("file"), F.lit(token))).select("id")
    found = graph.paths_between_sets(t.calls(), side("Brand#1/"), side("Brand#2/"), 2, 20)
    return found.select("source", "target", F.array_join("path", ">").alias("path"), "length")


@query(with_views(", e AS (SELECT DISTINCT src, dst FROM trade), two AS (SELECT b.dst AS target, min([a.src, a.dst, b.dst]) AS path FROM e a JOIN e b ON b.src = a.dst WHERE a.src = 'o:1' GROUP BY 1) SELECT 'o:1' AS source, target, array_to_string(path, '>') AS path, 2 AS length FROM two", "trade"))
def shortest_path(t: Tables) -> DataFrame:
    pairs = t.supplier.select(F.lit("o:1").alias("source"), F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("target"))
    return graph.shortest_paths(t.trade(), pairs).select("source", "target", F.array_join("path", ">").alias("path"), "length")


@query(with_views(_WALK.format(seed="p:1", to="dst", frm="src", edges=_BOTH, d=2) + " SELECT id, min(depth) AS depth, round(1 - 0.2 * min(depth), 1)::DOUBLE AS proximity FROM walk GROUP BY id", "trade", recursive=True))
def proximity_hops(t: Tables) -> DataFrame:
    near = graph.bfs(t.links(), _seed(t, "p:1"), 2, "both")
    return near.withColumn("proximity", graph.hop_proximity(F.col("depth")))


_CLOSURE = """, e AS (SELECT DISTINCT src, dst FROM needs), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), reach(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM reach JOIN e ON e.src = b),
 comp AS (SELECT n.id, least(n.id, coalesce(m.low, n.id)) AS scc FROM n LEFT JOIN (SELECT r.a, min(r.b) AS low FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a GROUP BY r.a) m ON m.a = n.id)"""


@query(with_views(_CLOSURE + " SELECT id, scc, count(*) OVER (PARTITION BY scc) AS size, (count(*) OVER (PARTITION BY scc) > 1 OR id IN (SELECT src FROM e WHERE src = dst)) AS is_cycle FROM comp", "needs", recursive=True))
def scc_components(t: Tables) -> DataFrame:
    return dag.scc(t.needs())


@query(with_views(_CLOSURE + """, ce AS (SELECT DISTINCT x.scc AS src, y.scc AS dst FROM e JOIN comp x ON x.id = e.src JOIN comp y ON y.id = e.dst WHERE x.scc <> y.scc),
 lv(id, wave) AS (SELECT DISTINCT scc, 0 FROM comp UNION SELECT ce.dst, wave + 1 FROM lv JOIN ce ON ce.src = lv.id)
 SELECT comp.id, comp.scc, max(wave)::INT AS wave FROM comp JOIN lv ON lv.id = comp.scc GROUP BY comp.id, comp.scc""", "needs", recursive=True))
def condensed_waves(t: Tables) -> DataFrame:
    return dag.condensed_waves(t.needs())


@query(with_views(""", e AS (SELECT DISTINCT src, dst FROM needs), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), cyc AS (SELECT a.src AS id FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src), stuck(id) AS (SELECT id FROM cyc UNION SELECT e.dst FROM stuck JOIN e ON e.src = stuck.id),
 lv(id, wave) AS (SELECT id, 0 FROM n WHERE id NOT IN (SELECT id FROM stuck) UNION SELECT e.dst, wave + 1 FROM lv JOIN e ON e.src = lv.id WHERE e.dst NOT IN (SELECT id FROM stuck))
 SELECT n.id, max(wave)::INT AS wave FROM n LEFT JOIN lv ON lv.id = n.id GROUP BY n.id""", "needs", recursive=True))
def topo_unresolved(t: Tables) -> DataFrame:
    return dag.topological_waves(t.needs())


@query(with_views(", lv(id, wave) AS (SELECT DISTINCT src, 0 FROM geo WHERE src LIKE 'r:%' UNION SELECT dst, wave + 1 FROM lv JOIN geo ON geo.src = lv.id) SELECT id, max(wave)::INT AS wave FROM lv GROUP BY id", "geo", recursive=True))
def topo_waves(t: Tables) -> DataFrame:
    needs = t.geo().select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    edges = dag.prerequisite_edges(needs, "depends-on")
    return dag.topological_waves(edges, edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))))


_FCALLS = """, fcalls AS (SELECT src, dst FROM calls)"""


@query(with_views(_FCALLS + " SELECT a.module AS src, b.module AS dst, count(*) AS calls FROM fcalls JOIN functions a ON a.id = src JOIN functions b ON b.id = dst WHERE a.module <> b.module GROUP BY 1, 2", "functions", "calls"))
def module_plan_counts(t: Tables) -> DataFrame:
    return dag.module_dependencies(t.calls(), t.functions())


@query(with_views(_FCALLS + " SELECT a.file AS src, b.file AS dst, count(*) AS calls FROM fcalls JOIN functions a ON a.id = src JOIN functions b ON b.id = dst WHERE a.module IN ('Brand#1', 'Brand#2') AND a.module = b.module AND a.file <> b.file GROUP BY 1, 2", "functions", "calls"))
def file_plan_counts(t: Tables) -> DataFrame:
    f = t.functions().withColumn("token", dag.first_module("module", ["Brand#1", "Brand#2"])).where("token = module").select("id", F.col("file").alias("module"), F.col("module").alias("own"))
    counts = dag.module_dependencies(t.calls(), f)
    inside = F.element_at(F.split("src", "/"), 2) == F.element_at(F.split("dst", "/"), 2)
    return counts.where(inside)


_DEAD = """, seeds AS (SELECT 'o:' || o_orderkey AS id FROM orders WHERE o_orderkey % 40 = 0), e AS (SELECT DISTINCT src, dst FROM trade), live(id, depth) AS (SELECT id, 0 FROM seeds UNION SELECT dst, depth + 1 FROM live JOIN e ON e.src = live.id WHERE depth < 10),
 dead AS (SELECT f.id, f.file, coalesce(i.n, 0) AS inbound FROM functions f LEFT JOIN (SELECT dst, count(*) AS n FROM trade GROUP BY dst) i ON i.dst = f.id WHERE f.id NOT IN (SELECT id FROM live))"""


def _dead(t: Tables) -> DataFrame:
    seeds = t.orders.where("o_orderkey % 40 = 0").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"))
    return impact.dead_nodes(t.functions().select("id", "file"), t.trade(), seeds, 10, t.links())


@query(with_views(_DEAD + " SELECT id, file, inbound FROM dead", "trade", "functions", recursive=True))
def dead_nodes(t: Tables) -> DataFrame:
    return _dead(t)


@query(with_views(_DEAD + " SELECT file, count(*) AS n FROM dead GROUP BY file ORDER BY n DESC, file LIMIT 30", "trade", "functions", recursive=True))
def dead_top_groups(t: Tables) -> DataFrame:
    return _dead(t).groupBy("file").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file").limit(30)


_SIMPLE = """, walk AS (SELECT [src, dst] AS path, confidence AS score FROM nav WHERE src = 'signup' UNION ALL SELECT list_append(path, dst), score * confidence FROM walk JOIN nav ON nav.src = path[-1] WHERE len(path) <= 3 AND NOT list_contains(path, dst))"""


@query(with_views(_SIMPLE + " SELECT array_to_string(path, '>') AS path, round(max(score), 9) AS score, len(path)::INT - 1 AS length FROM walk GROUP BY path", "nav", recursive=True))
def screen_paths_ranked(t: Tables) -> DataFrame:
    paths = graph.best_paths(graph.simple_paths(t.nav(), _seed(t, "signup"), 3))
    ranked = paths.orderBy(F.desc("score"), "length", "path")
    return ranked.select(F.array_join("path", ">").alias("path"), F.round("score", 9).alias("score"), "length")


@query(with_views(", lv(entry, id) AS (SELECT DISTINCT src, src FROM geo WHERE src LIKE 'r:%' UNION SELECT entry, dst FROM lv JOIN geo ON geo.src = lv.id) SELECT substr(sha1(string_agg(id, '|' ORDER BY id)), 1, 16) AS workflow, entry, count(*) AS n FROM lv WHERE id LIKE '%n:%' GROUP BY entry", "geo", recursive=True))
def workflow_mining(t: Tables) -> DataFrame:
    return code.mined_workflows(t.geo(), keep="n:").drop("steps")


@query(with_views(", lv(entry, id, depth) AS (SELECT DISTINCT src, src, 0 FROM trade WHERE src IN ('o:1', 'o:2', 'o:3') UNION SELECT entry, dst, depth + 1 FROM lv JOIN trade ON trade.src = lv.id WHERE depth < 5), d AS (SELECT entry, id, min(depth) AS depth FROM lv GROUP BY 1, 2) SELECT entry, (row_number() OVER (PARTITION BY entry ORDER BY depth, id) - 1)::INT AS step, id, depth FROM d", "trade", recursive=True))
def execution_flows(t: Tables) -> DataFrame:
    return code.execution_flows(t.trade(), _seed(t, "o:1", "o:2", "o:3"))


@query(with_views(_FCALLS + " SELECT DISTINCT b.id, b.name, b.file FROM fcalls JOIN functions a ON a.id = src JOIN functions b ON b.id = dst WHERE contains(b.file, 'Brand#1/') AND NOT contains(a.file, 'Brand#1/') AND b.kind IS DISTINCT FROM 'lambda'", "functions", "calls"))
def entrypoints(t: Tables) -> DataFrame:
    f = t.functions()
    inside = f.where(F.col("file").contains("Brand#1/") & ~F.col("kind").eqNullSafe("lambda")).select("id", "name", "file")
    outside = f.where(~F.exists(F.array(F.lit("Brand#1/")), lambda m: F.contains(F.col("file"), m))).select(F.col("id").alias("src"))
    calls = t.calls().join(outside, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    return inside.join(calls, "id", "left_semi")


@query("SELECT n_name AS class, r_name AS base, count(s_suppkey) AS members FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1, 2")
def class_members_left(t: Tables) -> DataFrame:
    classes = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    members = t.supplier.where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("members"))
    return classes.join(members, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_name").alias("class"), F.col("r_name").alias("base"), F.coalesce("members", F.lit(0)).alias("members"))


@query(with_views("SELECT DISTINCT src, dst FROM trade WHERE rel_type = 'POSSIBLE_CALLS' AND dst LIKE 's:%'", "trade"))
def possible_calls(t: Tables) -> DataFrame:
    return t.trade().where("rel_type = 'POSSIBLE_CALLS' and dst like 's:%'").select("src", "dst").distinct()


@query("SELECT a.n_nationkey AS id, 'r:' || a.n_regionkey AS base, b.n_nationkey AS peer FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey % 5 = b.n_nationkey % 5 AND a.n_nationkey < b.n_nationkey")
def dispatch_candidates(t: Tables) -> DataFrame:
    n = t.nation
    ext = n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.concat(F.lit("k"), F.col("a.n_nationkey")).alias("base"), F.concat(F.lit("k"), F.col("b.n_nationkey")).alias("derived"))
    methods = n.select(F.concat(F.lit("k"), F.col("n_nationkey")).alias("class"), F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 5).alias("name"), F.lit(1).alias("arity"))
    out = code.dispatch_candidates(ext, methods)
    return out.join(n.select(F.col("n_nationkey").alias("src"), F.concat(F.lit("r:"), F.col("n_regionkey").cast("string")).alias("base")), "src").select(F.col("src").alias("id"), "base", F.col("dst").alias("peer"))


_RESOLVE = """, calls AS (SELECT l_orderkey * 10 + l_linenumber AS call, f.name, f.module AS own FROM lineitem JOIN functions f ON f.id = 'p:' || l_partkey ),
 cand AS (SELECT call, own, f.id, f.module FROM calls JOIN functions f USING (name)), one AS (SELECT call, count(*) AS n, min(id) AS any_id, count(*) FILTER (own = module) AS ns, min(id) FILTER (own = module) AS s FROM cand GROUP BY call)"""


def _calls(t: Tables) -> DataFrame:
    f = t.functions().select("id", "name", "module")
    lines = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call"), F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("id"))
    return lines.join(f, "id").select("call", "name", F.lit(0).alias("arity"), F.col("module").alias("scope"), F.lit(None).cast("string").alias("field_type"), F.col("id").alias("caller"))


@query(with_views(_RESOLVE + " SELECT call, CASE WHEN n = 1 THEN any_id ELSE s END AS callee FROM one WHERE n = 1 OR ns = 1", "functions"))
def call_resolution(t: Tables) -> DataFrame:
    f = t.functions().select("id", "name", F.lit(0).alias("arity"), F.col("module").alias("scope"))
    return code.resolve_calls(_calls(t), f)


@query(with_views(_RESOLVE + " SELECT 'unknown::' || name AS dst, count(*) AS n FROM calls WHERE call NOT IN (SELECT call FROM one WHERE n = 1 OR ns = 1) GROUP BY 1", "functions"))
def unresolved_calls(t: Tables) -> DataFrame:
    f = t.functions().select("id", "name", F.lit(0).alias("arity"), F.col("module").alias("scope"))
    calls = _calls(t)
    return code.unresolved(calls, code.resolve_calls(calls, f)).groupBy("dst").agg(F.count("*").alias("n"))


@query(with_views(", ev AS (SELECT DISTINCT event_type, 'p:' || (user_id % 50) AS f FROM events) SELECT f AS function, event_type AS event, CASE WHEN event_type = 'click' THEN 'EMITS_EVENT' ELSE 'HANDLES_EVENT' END AS rel_type FROM ev JOIN functions ON id = f", "functions"))
def event_edges(t: Tables) -> DataFrame:
    ev = t.events.select(F.col("event_type").alias("event"), F.when(F.col("event_type") == "click", "emit").otherwise("on").alias("kind"), F.concat(F.lit("p:"), (F.col("user_id") % 50).cast("string")).alias("ref")).distinct()
    return code.event_edges(ev, t.functions().select("id", "qualified_name", "name"))


@query("SELECT 'c:' || c_custkey AS file, r_name AS value, 2 AS depth FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'n:' || n_nationkey, r_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r:' || r_regionkey, r_name, 0 FROM region")
def include_closure(t: Tables) -> DataFrame:
    includes = t.geo().where("dst not like 's:%'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    defs = t.region.select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("file"), F.lit("REGION").alias("name"), F.col("r_name").alias("value"), F.lit(0).alias("pos"))
    return code.inherited(includes, defs, 5).select("file", "value", "depth")


@query("SELECT 'c:' || c_custkey AS id, 'r:' || n_regionkey AS terminal, 2 AS hops FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 1 FROM nation")
def alias_chain(t: Tables) -> DataFrame:
    links = t.geo().where("dst not like 's:%'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.terminal_of_chain(links)


@query("SELECT 's:' || s_suppkey AS dst, 'r:' || n_regionkey AS src, round(round(0.5 + (s_suppkey % 5)::DOUBLE / 10, 2) * 0.7, 3) AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def nav_attribution(t: Tables) -> DataFrame:
    targets = t.supplier.select(F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")).alias("base"), F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("target"), F.round(0.5 + (F.col("s_suppkey") % 5) / 10.0, 2).alias("confidence"))
    targets = targets.select(F.col("target").alias("caller"), "target", "confidence")
    screens = t.region.select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("id"))
    return code.navigation(targets, t.geo(), screens)


@query(with_views(", p AS (SELECT workflow AS path_id, step AS place, function AS id, file FROM steps LEFT JOIN functions ON functions.id = function) SELECT path_id, place, id, CASE WHEN place = 0 THEN 'entry' WHEN file = lag(file) OVER w THEN 'sequential' ELSE 'cross_file' END AS relation, 1.0::DOUBLE AS confidence FROM p WINDOW w AS (PARTITION BY path_id ORDER BY place)", "steps", "functions"))
def reconstructed_flow(t: Tables) -> DataFrame:
    paths = t.steps().groupBy(F.col("workflow").alias("path_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "function"))), lambda s: s["function"]).alias("nodes"))
    return code.reconstructed_flow(paths, t.functions().select("id", "file"))


_CHANGED = "'p:1', 'p:2', 'p:3'"


@query(with_views(f"SELECT workflow, min(step) AS step, 'p:' || substr(function, 3) AS function FROM steps WHERE function IN ({_CHANGED}) GROUP BY workflow, function", "steps"))
def workflows_containing(t: Tables) -> DataFrame:
    return t.steps().where(f"function in ({_CHANGED})").groupBy("workflow", "function").agg(F.min("step").alias("step"))


_IMPACT = f""", seed AS (SELECT DISTINCT function AS changed FROM steps WHERE function IN ({_CHANGED})), back AS (SELECT changed, changed AS id, 0 AS depth FROM seed UNION ALL SELECT changed, src, 1 FROM seed JOIN modcalls ON dst = changed WHERE src <> changed),
 best AS (SELECT changed, workflow, min((depth, step)) AS b FROM (SELECT changed, id, min(depth) AS depth FROM back GROUP BY 1, 2) JOIN steps ON function = id GROUP BY 1, 2),
 hit AS (SELECT changed, workflow, b[1] AS depth, b[2] AS step, domain FROM best JOIN workflows USING (workflow)),
 sev AS (SELECT *, CASE WHEN domain IN ('payment', 'auth') THEN CASE WHEN depth = 0 AND step <= 2 THEN 'critical' WHEN depth = 0 THEN 'high' ELSE 'medium' END WHEN domain IN ('order', 'loyalty') THEN 'medium' ELSE 'low' END AS severity FROM hit)"""
_MODCALLS = ", modcalls AS (SELECT DISTINCT src, dst FROM (SELECT function AS src, lead(function) OVER (PARTITION BY workflow ORDER BY step) AS dst FROM steps) WHERE dst IS NOT NULL)"


def _impacts(t: Tables) -> DataFrame:
    changed = t.functions().where(f"id in ({_CHANGED})").select("id")
    return impact.workflow_impact(t.steps(), t.workflows(), t.calls(), changed, 1)


@query(with_views(_MODCALLS + _IMPACT + " SELECT changed, workflow, step, depth, domain, severity FROM sev", "steps", "workflows"))
def workflow_impact(t: Tables) -> DataFrame:
    return _impacts(t)


@query(with_views(_MODCALLS + _IMPACT + ", r AS (SELECT changed, sum(CASE WHEN depth = 0 THEN 0.1::DOUBLE + CASE WHEN domain IN ('payment', 'auth') THEN 0.3 WHEN domain = 'order' THEN 0.2 ELSE 0.1 END + CASE WHEN step = 0 THEN 0.15 ELSE 0 END ELSE CASE WHEN domain IN ('payment', 'auth') THEN 0.1 WHEN domain = 'order' THEN 0.05 ELSE 0.02 END END) AS base FROM sev GROUP BY changed) SELECT changed, least(1.0, round(base + CASE WHEN (SELECT count(DISTINCT workflow) FROM steps WHERE function = changed) > 1 THEN 0.2 ELSE 0 END, 3))::DOUBLE AS risk FROM r", "steps", "workflows"))
def workflow_risk(t: Tables) -> DataFrame:
    hits = _impacts(t)
    return impact.workflow_risk(hits, impact.cascades(t.steps(), t.functions().where(f"id in ({_CHANGED})").select("id")))


@query(with_views("SELECT a.workflow AS w1, b.workflow AS w2, count(*) AS shared FROM (SELECT DISTINCT workflow, function FROM steps) a JOIN (SELECT DISTINCT workflow, function FROM steps) b USING (function) WHERE a.workflow < b.workflow GROUP BY 1, 2 HAVING count(*) > 1", "steps"))
def shared_step_pairs(t: Tables) -> DataFrame:
    return impact.shared_steps(t.steps(), 2)


@query(with_views("""SELECT c.community, c.size, coalesce(i.n, 0) AS internal, coalesce(x.n, 0) AS external, round(coalesce(i.n, 0)::DOUBLE / (c.size * (c.size - 1)), 6) AS cohesion, round(coalesce(x.n, 0)::DOUBLE / (coalesce(i.n, 0) + coalesce(x.n, 0)), 6) AS coupling
 FROM (SELECT module AS community, count(*) AS size FROM functions GROUP BY 1) c LEFT JOIN (SELECT a.module AS m, count(*) AS n FROM fc JOIN functions a ON a.id = src JOIN functions b ON b.id = dst WHERE a.module = b.module GROUP BY 1) i ON i.m = c.community
 LEFT JOIN (SELECT m, count(*) AS n FROM (SELECT unnest([a.module, b.module]) AS m FROM fc JOIN functions a ON a.id = src JOIN functions b ON b.id = dst WHERE a.module <> b.module) GROUP BY 1) x ON x.m = c.community""".join([_FCALLS.replace("fcalls", "fc") + " ", ""]), "functions", "calls"))
def cohesion_coupling(t: Tables) -> DataFrame:
    return impact.cohesion(t.calls(), t.functions().select("id", F.col("module").alias("community")))


@query()
def communities(t: Tables) -> DataFrame:
    """Louvain over all calls between functions; tests hold it against brute force on small graphs."""
    return impact.communities(t.calls())


@query(with_views(", e AS (SELECT src, dst FROM module_calls WHERE src <> dst), d AS (SELECT c, count(*) AS d FROM (SELECT left(src, 7) AS c FROM e UNION ALL SELECT left(dst, 7) FROM e) GROUP BY c) SELECT round((SELECT count(*) FILTER (left(src, 7) = left(dst, 7)) FROM e)::DOUBLE / (SELECT count(*) FROM e) - sum(d * d)::DOUBLE / (4 * (SELECT count(*) FROM e)::DOUBLE * (SELECT count(*) FROM e)), 6) AS modularity, count(*) AS communities FROM d", "module_calls"))
def modularity(t: Tables) -> DataFrame:
    edges = t.module_calls().select("src", "dst")
    members = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct().withColumn("community", F.substring("id", 1, 7))
    return impact.modularity(edges, members)


_USES = "SELECT 'p:' || l_partkey AS dst, 'p:' || min(p) AS src FROM (SELECT l_suppkey, l_partkey, min(l_partkey) OVER (PARTITION BY l_suppkey) AS p FROM lineitem) GROUP BY l_suppkey, l_partkey"


@query(with_views(f", ch AS (SELECT DISTINCT file FROM functions WHERE id IN ('p:1', 'p:2')), ids AS (SELECT id FROM functions WHERE file IN (SELECT file FROM ch)), deps AS (SELECT DISTINCT 'src/' || src || '/small.py' AS src, 'src/' || dst || '/economy.py' AS dst FROM module_calls), uses AS ({_USES}), hit AS (SELECT src AS file FROM deps WHERE dst IN (SELECT file FROM ch) UNION SELECT a.file FROM calls JOIN functions a ON a.id = src WHERE dst IN (SELECT id FROM ids) UNION SELECT a.file FROM uses JOIN functions a ON a.id = src WHERE dst IN (SELECT id FROM ids)) SELECT file FROM hit WHERE file NOT IN (SELECT file FROM ch)", "functions", "calls", "module_calls"))
def impacted_files(t: Tables) -> DataFrame:
    f = t.functions()
    changed = f.where("id in ('p:1', 'p:2')").select("file").distinct()
    path = lambda c, kind: F.concat(F.lit("src/"), F.col(c), F.lit(f"/{kind}.py")).alias(c)
    deps = t.module_calls().select(path("src", "small"), path("dst", "economy")).distinct()
    ident = lambda c: F.concat(F.lit("p:"), F.col(c).cast("string"))
    first = t.lineitem.groupBy("l_suppkey").agg(F.min("l_partkey").alias("p"))
    uses = t.lineitem.join(first, "l_suppkey").select(ident("p").alias("src"), ident("l_partkey").alias("dst")).distinct()
    return code.impacted_files(changed, deps, t.calls(), uses, f)


@query(with_views("SELECT DISTINCT a.workflow, b.function AS endpoint, w.domain FROM steps a JOIN steps b USING (workflow) JOIN workflows w USING (workflow) WHERE a.step = 0 AND b.step = 1 AND w.domain IN ('payment', 'order')", "steps", "workflows"))
def endpoint_callers(t: Tables) -> DataFrame:
    s = t.steps()
    first, second = s.where("step = 0").select("workflow"), s.where("step = 1").select("workflow", F.col("function").alias("endpoint"))
    return first.join(second, "workflow").join(t.workflows().where(F.col("domain").isin("payment", "order")), "workflow").select("workflow", "endpoint", "domain").distinct()


@query("SELECT o_orderkey, min(l_partkey) AS representative, count(l_orderkey) AS callers FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey")
def representative_caller(t: Tables) -> DataFrame:
    callers = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.min("l_partkey").alias("representative"), F.count("*").alias("callers"))
    return t.orders.join(callers, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "representative", F.coalesce("callers", F.lit(0)).alias("callers"))


@query(with_views(", api AS (SELECT o_orderkey, o_custkey, l_partkey, l_suppkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1) SELECT o_orderkey, c_name AS caller, p_name AS handler, s_name AS store FROM api JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0", "geo"))
def api_chain(t: Tables) -> DataFrame:
    first = t.lineitem.where("l_linenumber = 1").select("l_orderkey", "l_partkey", "l_suppkey")
    chain = t.orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    chain = chain.join(t.part.where("p_size > 10"), F.col("p_partkey") == F.col("l_partkey"), "left").join(t.supplier.where("s_acctbal > 0"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return chain.select("o_orderkey", F.col("c_name").alias("caller"), F.col("p_name").alias("handler"), F.col("s_name").alias("store"))


@query(with_views(_FCALLS + " SELECT a.module AS m1, b.module AS m2, count(*) AS n FROM fcalls JOIN functions a ON a.id = src JOIN functions b ON b.id = dst WHERE contains(a.file, 'Brand#1') AND contains(b.file, 'Brand#2') GROUP BY 1, 2", "functions", "calls"))
def module_pair_join(t: Tables) -> DataFrame:
    f = t.functions().select("id", "module", "file")
    a = f.where(F.col("file").contains("Brand#1")).select(F.col("id").alias("src"), F.col("module").alias("m1"))
    b = f.where(F.col("file").contains("Brand#2")).select(F.col("id").alias("dst"), F.col("module").alias("m2"))
    return t.calls().join(a, "src").join(b, "dst").groupBy("m1", "m2").agg(F.count("*").alias("n"))


@query("SELECT 'n:' || n_nationkey AS id, 1 AS depth FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 's:' || s_suppkey, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0 UNION ALL SELECT 'c:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0")
def class_hierarchy(t: Tables) -> DataFrame:
    return graph.bfs(t.geo(), _seed(t, "r:0"), 5).where("depth > 0")


@query(with_views(_BETWEEN + ", step AS (SELECT unnest(list_zip(path[:-2], path[2:])) AS s FROM best) SELECT DISTINCT s[1] AS src, s[2] AS dst FROM step", "functions", "calls", recursive=True))
def paths_to_subgraph(t: Tables) -> DataFrame:
    return graph.flatten_paths(_between(t))[1]
