"""Code-graph joins: call resolution, dispatch candidates, unresolved calls, events, includes, navigation, flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import bfs


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(call, callee): calls (call, name, arity, scope, field_type) to functions (id, name, arity, scope).

    Candidates have the name and arity, else the name alone. A single one is it; else the one whose scope ends with the
    field's type; else the one of the caller's scope; else the call stays unresolved and has no row.

    No call meets its candidates: functions are counted by name, arity and scope, each with its smallest id, and calls
    join these counts. Rows of one call are taken together, as are their candidates.
    """
    g = functions.groupBy("name", "arity", "scope").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    asked = calls.select("name", "arity", "scope", "field_type").where("name is not null").distinct()

    def counted(*keys: str) -> DataFrame:
        return g.groupBy(*keys).agg(F.struct(F.sum("n").alias("n"), F.min("id").alias("id")).alias("_".join(("by", *keys))))

    out = asked.join(counted("name"), "name")
    for keys in (["name", "arity"], ["name", "scope"], ["name", "arity", "scope"]):
        out = out.join(counted(*keys), keys, "left")
    typed = asked.where("field_type is not null").select("name", F.col("arity").alias("at"), F.col("field_type").alias("type")).distinct()
    typed = typed.join(g, "name").where(F.col("scope").endswith(F.col("type")))
    same = F.col("at") == F.col("arity")
    typed = typed.groupBy(F.col("name").alias("of"), "at", "type").agg(F.struct(F.sum("n").alias("n"), F.min("id").alias("id")).alias("by_type"), F.struct(F.sum(F.when(same, F.col("n"))).alias("n"), F.min(F.when(same, F.col("id"))).alias("id")).alias("by_type_arity"))
    out = out.join(typed, (F.col("name") == F.col("of")) & F.col("arity").eqNullSafe(F.col("at")) & (F.col("field_type") == F.col("type")), "left")
    # of more than one candidate the number counts, not which it is: 0, 1 or 2, and the id of a single one
    kinds = ["by_name_arity", "by_type_arity", "by_name_arity_scope", "by_name", "by_type", "by_name_scope"]
    few = [F.struct(F.least(F.coalesce(F.col(k)["n"], F.lit(0)), F.lit(2)).cast("byte").alias("n"), F.when(F.col(k)["n"] == 1, F.col(k)["id"]).alias("id")).alias(k) for k in kinds]
    out = out.select(*[F.col(c).alias(f"of_{c}") for c in ("name", "arity", "scope", "field_type")], *few)
    hits = calls.join(out, (F.col("name") == F.col("of_name")) & F.col("arity").eqNullSafe(F.col("of_arity")) & F.col("scope").eqNullSafe(F.col("of_scope")) & F.col("field_type").eqNullSafe(F.col("of_field_type")))
    one = hits.groupBy("call").agg(*[F.struct(F.sum(F.col(k)["n"]).alias("n"), F.min(F.col(k)["id"]).alias("id")).alias(k) for k in kinds])

    def pick(*kinds: str) -> Column:
        return F.coalesce(*[F.when(F.col(k)["n"] == 1, F.col(k)["id"]) for k in kinds])

    found = F.when(F.col("by_name_arity")["n"] > 0, pick(*kinds[:3])).otherwise(pick(*kinds[3:]))
    return one.select("call", found.alias("callee")).where("callee is not null")


def unresolved(calls: DataFrame, resolved: DataFrame) -> DataFrame:
    """(src, dst, site_id): calls without a callee as edges to a node named after what was called."""
    return calls.join(resolved, "call", "left_anti").select(F.col("caller").alias("src"), F.concat(F.lit("unknown::"), F.col("name")).alias("dst"), F.col("call").alias("site_id"))


def dispatch_candidates(extends: DataFrame, methods: DataFrame) -> DataFrame:
    """(src, dst): methods of a base class and those of a derived one (derived, base) with equal name and arity."""
    b = methods.select(F.col("class").alias("base"), F.col("id").alias("src"), "name", "arity")
    d = methods.select(F.col("class").alias("derived"), F.col("id").alias("dst"), "name", "arity")
    return extends.join(b, "base").join(d, ["derived", "name", "arity"]).select("src", "dst").distinct()


def event_edges(events: DataFrame, functions: DataFrame) -> DataFrame:
    """(function, event, rel_type): the function of events (event, kind, ref) by id, else full name, else first by name."""
    by_id = functions.select(F.col("id").alias("ref"), F.col("id").alias("f1"))
    by_full = functions.groupBy(F.col("qualified_name").alias("ref")).agg(F.min("id").alias("f2"))
    by_name = functions.groupBy(F.col("name").alias("ref")).agg(F.min("id").alias("f3"))
    found = events.join(by_id, "ref", "left").join(by_full, "ref", "left").join(by_name, "ref", "left")
    rel = F.when(F.col("kind") == "emit", "EMITS_EVENT").otherwise("HANDLES_EVENT")
    return found.select(F.coalesce("f1", "f2", "f3").alias("function"), "event", rel.alias("rel_type")).where("function is not null").distinct()


def inherited(includes: DataFrame, definitions: DataFrame, max_depth: int = 50) -> DataFrame:
    """(file, name, value, depth): definitions (file, name, value, pos) seen by each file through its includes
    (src, dst); the nearest counts, of equals the first."""
    files = definitions.select("file").unionByName(includes.select(F.col("src").alias("file"))).unionByName(includes.select(F.col("dst").alias("file"))).distinct()
    reach = bfs(includes, files.select(F.col("file").alias("root"), F.col("file").alias("id")), max_depth, keys=("root",))
    seen = reach.join(definitions, reach["id"] == definitions["file"]).select(F.col("root").alias("file"), "name", F.struct("depth", "id", "pos", "value").alias("d"))
    best = seen.groupBy("file", "name").agg(F.min("d").alias("d"))
    return best.select("file", "name", F.col("d.value").alias("value"), F.col("d.depth").alias("depth"))


def navigation(targets: DataFrame, edges: DataFrame, screens: DataFrame, max_depth: int = 6) -> DataFrame:
    """(src, dst, confidence): navigation calls (caller, target, confidence) given to the screens (id) that lead to the
    caller within max_depth hops; confidence falls by 0.15 a hop to half; the surest row of each pair counts."""
    back = bfs(edges, targets.select(F.col("caller").alias("origin"), F.col("caller").alias("id")).distinct(), max_depth, "in", keys=("origin",))
    found = back.join(screens.select("id"), "id", "left_semi")
    above = found.where("depth > 0").select("origin").distinct()
    found = found.where("depth > 0").unionByName(found.where("depth = 0").join(above, "origin", "left_anti"))
    rows = targets.join(found.select(F.col("origin").alias("caller"), F.col("id").alias("src"), "depth"), "caller").where("src != target")
    conf = F.round(F.col("confidence") * F.greatest(F.lit(0.5), 1 - 0.15 * F.col("depth")), 3)
    return rows.groupBy("src", F.col("target").alias("dst")).agg(F.max(conf).alias("confidence"))


def execution_flows(edges: DataFrame, entrypoints: DataFrame, max_depth: int = 5) -> DataFrame:
    """(entry, step, id, depth): nodes that each entry point (id) reaches, numbered by depth and id; one step is no flow."""
    reach = bfs(edges, entrypoints.select(F.col("id").alias("entry"), "id"), max_depth, keys=("entry",))
    w = Window.partitionBy("entry")
    rows = reach.withColumn("n", F.count("*").over(w)).where("n > 1")
    return rows.withColumn("step", F.row_number().over(w.orderBy("depth", "id")) - 1).select("entry", "step", "id", "depth")


def mined_workflows(edges: DataFrame, keep: str | None = None, max_depth: int = 20) -> DataFrame:
    """(workflow, entry, steps, n): flows from nodes that nothing leads to; the id is a digest of the sorted steps."""
    entries = edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")), "id", "left_anti")
    reach = bfs(edges, entries.select(F.col("id").alias("entry"), "id"), max_depth, keys=("entry",))
    if keep:
        reach = reach.where(F.col("id").contains(keep))
    flows = reach.groupBy("entry").agg(F.array_sort(F.collect_set("id")).alias("steps"), F.count("*").alias("n"))
    return flows.select(F.substring(F.sha1(F.array_join("steps", "|")), 1, 16).alias("workflow"), "entry", "steps", "n")


def reconstructed_flow(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path_id, place, id, relation, confidence) of flow paths (path_id, nodes array) over nodes (id, file, line).

    The first node enters the flow; others stand by place, within one file by line. A step to the same file is
    `sequential`, else `cross_file`; a path's confidence is the share of its nodes that are known.
    """
    long = paths.select("path_id", F.posexplode("nodes").alias("place", "id")).join(nodes, "id", "left")
    w = Window.partitionBy("path_id").orderBy("place")
    rows = long.withColumn("before", F.lag("file").over(w))
    relation = F.when(F.col("place") == 0, "entry").when(F.col("file").isNull() | F.col("before").isNull(), "uncertain").when(F.col("file") == F.col("before"), "sequential").otherwise("cross_file")
    known = F.round(F.avg(F.col("file").isNotNull().cast("double")).over(Window.partitionBy("path_id")), 3)
    return rows.select("path_id", "place", "id", relation.alias("relation"), known.alias("confidence"))


def impacted_files(changed: DataFrame, file_deps: DataFrame, calls: DataFrame, uses: DataFrame, functions: DataFrame) -> DataFrame:
    """Files that depend on changed files (file), call their functions, or use their types, without the changed ones."""
    f = functions.select("id", "file")
    deps = file_deps.join(changed.select(F.col("file").alias("dst")), "dst", "left_semi").select(F.col("src").alias("file"))
    callee = f.join(changed, "file", "left_semi").select(F.col("id").alias("dst"))
    callers = calls.join(callee, "dst", "left_semi").join(f.withColumnRenamed("id", "src"), "src").select("file")
    users = uses.join(callee, "dst", "left_semi").join(f.withColumnRenamed("id", "src"), "src").select("file")
    return deps.unionByName(callers).unionByName(users).where("file is not null").distinct().join(changed, "file", "left_anti")
