"""Traversal of property graphs: edges (src, dst[, rel_type, ...]) as DataFrames, level by level.

Each level is one join of the frontier with the edges, deduplicated before the anti join with what was visited, so the
work of a level follows the edges at the frontier. Levels are checkpointed; only their emptiness reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import at_most, cut, laid_out

DIRECTIONS = {"out": "out", "downstream": "out", "in": "in", "upstream": "in", "both": "both", "all": "both"}
#: Rows of a frontier that may be sent to all edges, and levels for which these are read again rather than dealt out
SENT, SCANS = 100_000, 3


#: What a flow follows by default, by family of languages
FLOW_TYPES = {
    "android": ["CALLS", "DECLARES", "CONTAINS", "USES_RESOURCE", "DECLARES_ROUTE", "STARTS_WITH_ROUTE", "ROUTE_CALLS", "DECLARES_COMPONENT", "STARTS_COMPONENT", "STARTS_INTENT", "SENDS_BROADCAST", "REGISTERS_RECEIVER", "DECLARES_INTENT_ACTION", "SENDS_HANDLER_MESSAGE", "ACTION_TARGETS_COMPONENT", "EMITS_EVENT", "HANDLES_EVENT", "ANNOTATED_WITH", "DEPENDS_ON", "TAKES_FUNCTION", "IMPLEMENTS", "EXTENDS"],
    "cplus": ["CALLS", "POSSIBLE_CALLS", "CALLS_FUNCTION_POINTER", "DECLARES", "CONTAINS", "DEPENDS_ON"],
    "generic": ["CALLS", "DECLARES", "CONTAINS", "DEPENDS_ON"],
}
FAMILIES = {"android": ["android", "android-kotlin", "kotlin-android", "java", "kotlin", "jvm"], "cplus": ["", "cplus", "cpp", "c++", "c", "clang", "delphi", "pascal", "vbnet", "vb6", "vba", "vbscript"]}


def flow_types(parser: str | None, asked: list[str] | None = None, available: list[str] | None = None) -> list[str]:
    """Relationship types that a trace follows: those asked for, else a language's defaults; of these the ones that the
    graph has, or all if it has none of them."""
    family = next((f for f, names in FAMILIES.items() if (parser or "").strip().lower() in names), "generic")
    wanted = [x.strip().upper() for x in asked] if asked else FLOW_TYPES[family]
    return [x for x in wanted if x in set(available or [])] or wanted


def clamp_depth(depth: int | None, most: int, default: int) -> int:
    """A depth argument forced into 1 .. most; what is no number becomes the default."""
    try:
        return max(1, min(int(depth), most))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return default


def oriented(edges: DataFrame, direction: str = "out", rel_types: list[str] | None = None) -> DataFrame:
    """(src, dst) pairs in walking order. Repeated edges stay: what they reach is deduplicated, which moves less."""
    if rel_types:
        edges = edges.where(F.col("rel_type").isin(rel_types))
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    way = DIRECTIONS[direction]
    return (out if way == "out" else back if way == "in" else out.unionByName(back)).where("src is not null and dst is not null")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, direction: str = "out", rel_types: list[str] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., id, depth): nodes within max_depth hops of the seeds (keys..., id), seeds included at depth 0.

    keys name columns that separate traversals, such as the seed itself; without keys all seeds share one traversal.
    In the first levels a frontier of at most SENT rows is sent to the edges, which stay where they are.
    """
    steps, dealt = oriented(edges, direction, rel_types), None
    by = [*keys, "id"]
    frontier = cut(seeds.select(*by).where("id is not null").distinct())
    levels = [frontier.withColumn("depth", F.lit(0))]
    visited = frontier
    for depth in range(1, max_depth + 1):
        if dealt is None and depth <= SCANS and at_most(frontier, SENT):
            reached = steps.join(F.broadcast(frontier), frontier["id"] == steps["src"])
        else:
            if dealt is None:  # computed and dealt out by src once, two columns wide, for the levels that are left
                dealt = laid_out(steps, "src") if depth < max_depth else steps
            reached = frontier.join(dealt, frontier["id"] == dealt["src"])
        frontier = cut(reached.select(*keys, F.col("dst").alias("id")).distinct().join(visited, by, "left_anti"))
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("depth", F.lit(depth)))
        visited = visited.unionByName(frontier)
    return reduce(DataFrame.unionByName, levels)


def subgraph_edges(edges: DataFrame, nodes: DataFrame, max_depth: int, direction: str = "out") -> DataFrame:
    """Edges that lie on some walk of at most max_depth from the start, given bfs() nodes (id, depth)."""
    near = nodes.where(F.col("depth") < max_depth).select(F.col("id"))
    near = F.broadcast(near) if at_most(near, SENT) else near
    way = DIRECTIONS[direction]
    by_src = edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").select(edges.columns)
    by_dst = edges.join(near.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)
    return by_src if way == "out" else by_dst if way == "in" else by_src.unionByName(by_dst).distinct()


def smallest_paths(edges: DataFrame, sources: DataFrame, max_depth: int = 8, direction: str = "out", rel_types: list[str] | None = None) -> DataFrame:
    """(source, id, path): a shortest path from each source (source) to each node within max_depth, itself included; of
    equals the smallest array of ids. One search for all sources.

    A node keeps only its smallest path, so a level has at most one row for each source and node.
    """
    steps = laid_out(oriented(edges, direction, rel_types).distinct(), "src")
    frontier = cut(sources.select("source").where("source is not null").distinct().select("source", F.col("source").alias("id"), F.array("source").alias("path")))
    visited, found = frontier.select("source", "id"), [frontier]
    for _ in range(max_depth):
        grown = frontier.join(steps, frontier["id"] == steps["src"]).select("source", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        grown = grown.groupBy("source", "id").agg(F.min("path").alias("path"))
        frontier = cut(grown.join(visited, ["source", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.select("source", "id"))
        found.append(frontier)
    return reduce(DataFrame.unionByName, found)


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int = 8, direction: str = "out", rel_types: list[str] | None = None) -> DataFrame:
    """(source, target, path, length): a shortest path for each pair, of equals the smallest array of ids."""
    pairs = pairs.select("source", "target").where("source != target").distinct()
    reached = smallest_paths(edges, pairs, max_depth, direction, rel_types).withColumnRenamed("id", "target")
    return pairs.join(reached, ["source", "target"]).withColumn("length", F.size("path") - 1)


def paths_between(edges: DataFrame, pairs: DataFrame, max_depth: int = 8, limit: int | None = None) -> DataFrame:
    """Directed shortest paths; where a request finds none at all, undirected ones."""
    found = cut(shortest_paths(edges, pairs, max_depth))
    if found.isEmpty():
        found = shortest_paths(edges, pairs, max_depth, "both")
    return found.orderBy("length", "source", "target").limit(limit) if limit else found


def paths_between_sets(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int = 8, limit: int | None = None, rel_types: list[str] | None = None) -> DataFrame:
    """As paths_between, from all sources (id) to all targets (id): no pair is formed before a path joins it."""
    def search(direction: str) -> DataFrame:
        reached = smallest_paths(edges, sources.select(F.col("id").alias("source")), max_depth, direction, rel_types)
        hits = reached.join(targets.select("id").distinct(), "id", "left_semi").where("source != id")
        return cut(hits.select("source", F.col("id").alias("target"), "path", (F.size("path") - 1).alias("length")))

    found = search("out")
    if found.isEmpty():
        found = search("both")
    return found.orderBy("length", "source", "target").limit(limit) if limit else found


def simple_paths(edges: DataFrame, starts: DataFrame, max_hops: int, ends: DataFrame | None = None, value: str = "confidence") -> DataFrame:
    """(path, score, length): walks without repeated nodes from starts (id), with the product of an edge column.

    Parallel edges give one path each; keep the best with best_paths(). Enumeration grows with the number of simple
    paths, so max_hops is the caller's bound.
    """
    steps = cut(edges.select("src", "dst", F.col(value).alias("step")))
    frontier = cut(starts.select(F.array("id").alias("path"), F.col("id").alias("at"), F.lit(1.0).alias("score")))
    levels = []
    for _ in range(max_hops):
        frontier = frontier.join(steps, frontier["at"] == steps["src"]).where(~F.array_contains("path", F.col("dst")))
        frontier = cut(frontier.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"), (F.col("score") * F.col("step")).alias("score")))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    if not levels:
        return frontier.select("path", "score", (F.size("path") - 1).alias("length")).limit(0)
    out = reduce(DataFrame.unionByName, levels)
    if ends is not None:
        out = out.join(ends.select(F.col("id").alias("at")).distinct(), "at", "left_semi")
    return out.select("path", "score", (F.size("path") - 1).alias("length"))


def best_paths(paths: DataFrame) -> DataFrame:
    """One row for each node sequence, that of the highest score."""
    return paths.groupBy("path", "length").agg(F.max("score").alias("score"))


def flatten_paths(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (src, dst) that occur in paths (path array)."""
    nodes = paths.select(F.explode("path").alias("id")).distinct()
    pairs = F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    edges = paths.where(F.size("path") > 1).select(F.explode(pairs).alias("e")).select("e.src", "e.dst").distinct()
    return nodes, edges


def hop_proximity(depth: Column) -> Column:
    """1, 0.8, 0.6, 0.4, 0.2 for 0 to 4 hops, 0 beyond or when unreachable."""
    return F.when(depth.isNull() | (depth > 4), 0.0).otherwise(F.round(1.0 - 0.2 * depth, 1))


def terminal_of_chain(links: DataFrame, max_depth: int = 10) -> DataFrame:
    """(id, terminal, hops): follow single-successor links (src, dst) to their end, at most max_depth steps."""
    state = links.select(F.col("src").alias("id"), F.col("dst").alias("terminal"), F.lit(1).alias("hops"))
    nxt = links.select(F.col("src").alias("terminal"), F.col("dst").alias("next"))
    for _ in range(max_depth - 1):
        state = cut(state.join(nxt, "terminal", "left").select("id", F.coalesce("next", "terminal").alias("terminal"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops"), F.col("next").isNotNull().alias("moved")))
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    return state.select("id", "terminal", "hops")
