"""Golden examples of text functions, scoring and sources."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.operators import dag, docs, graph, impact, match, score, search, sheets
from loomgraph.sources import files, sinks
from loomgraph.streaming import sync


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [('"/api/orders/" + orderId', "/api/orders/:orderId"), ("/api/data?page=1&limit=20", "/api/data"), ("/api/users/{id}/", "/api/users/:id"), ("`/api/${user.id}/x`", "/api/:id/x"), ("https://x.org/a", None), ("api//v1", "/api/v1"), ("/", None), ("", None)])
def test_url_pattern(spark, raw, want):
    assert one(spark, X.url_pattern(F.lit(raw))) == want


def test_urls(spark):
    assert one(spark, X.merged_url(F.lit("/api"), F.lit("/users/:id"))) == "/api/users/:id"
    assert one(spark, X.merged_url(F.lit("http://localhost:3000/api"), F.lit("/orders"))) == "/api/orders"
    assert one(spark, X.merged_url(F.lit(None).cast("string"), F.lit("/users"))) == "/users"
    for a, b, want in [("/a/b", "/a/b", 1.0), ("/a/:id", "/a/:key", 0.85), ("/a/b", "/a", 0.6), ("/a/b", "/a/c", 0.35), ("/x", "/a/c", 0.0)]:
        assert one(spark, X.path_match(F.lit(a), F.lit(b))) == want


def test_names(spark):
    assert one(spark, X.name_tokens(F.lit("fetchUserProfile"))) == ["fetch", "user", "profile"]
    assert one(spark, X.name_tokens(F.lit("get-orders-by-id"))) == ["get", "orders", "by", "id"]
    a, b = X.name_tokens(F.lit("fetchUser")), X.name_tokens(F.lit("getUserById"))
    assert one(spark, X.token_jaccard(a, b)) == 1.0
    assert one(spark, X.verb_class(F.lit("register"))) == "auth"


def test_intents(spark):
    for text, want in [("who calls the validateToken function", "structural"), ("refresh it", "temporal"), ("unlike that", "semantic"), ("", "default"), ("count rows", "default")]:
        assert one(spark, X.query_intent(F.lit(text))) == want


def test_hops_and_depths(spark):
    assert [one(spark, graph.hop_proximity(F.lit(d))) for d in (0, 1, 2, 3, 4, 5)] == [1.0, 0.8, 0.6, 0.4, 0.2, 0.0]
    assert [graph.clamp_depth(x, 10, 2) for x in (None, 0, 50, "3", "x")] == [2, 1, 10, 3, 2]


def test_min_max_of_equal_values_is_zero(spark):
    assert [r.v for r in score.min_max(spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, v double"), ["v"]).collect()] == [0.0, 0.0]


def test_traversal_of_cycles_and_empty_graphs(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), (None, "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.depth for r in graph.bfs(e, seeds, 10).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert graph.bfs(e.limit(0), seeds, 3).count() == 1 and graph.bfs(e, seeds.limit(0), 3).count() == 0
    nodes = spark.createDataFrame([(i,) for i in "abcdx"], "id string")
    assert {r.id: (r.scc, r.is_cycle) for r in dag.scc(e, nodes).collect()} == {"a": ("a", True), "b": ("a", True), "c": ("a", True), "d": ("d", False), "x": ("x", True)}
    assert {r.id: r.wave for r in dag.topological_waves(e, nodes).collect()} == dict.fromkeys("abcdx")
    assert {r.id: r.wave for r in dag.condensed_waves(e, nodes).collect()} == {"a": 0, "b": 0, "c": 0, "d": 1, "x": 0}


def test_paths_fall_back_to_undirected(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "d"), ("d", "c")], "src string, dst string")
    ask = lambda *p: [(r.path, r.length) for r in graph.paths_between(e, spark.createDataFrame([p], "source string, target string")).collect()]
    assert ask("a", "c") == [(["a", "d", "c"], 2)] and ask("b", "d") == [(["b", "a", "d"], 2)] and ask("a", "a") == []


def test_communities(spark):
    clique = lambda names: [(a, b) for a in names for b in names if a < b]
    e = spark.createDataFrame(clique("abcd") + clique("wxyz") + [("d", "w")], "src string, dst string")
    got = {r.id: r.community for r in impact.communities(e).collect()}
    assert len({got[i] for i in "abcd"}) == len({got[i] for i in "wxyz"}) == 1 and got["a"] != got["z"]


def test_relations_to_unknown_entities(spark):
    m = spark.createDataFrame([(0, "Ada Lovelace", "PERSON", 0.9), (1, "ada lovelace", "PERSON", None), (2, " ", "X", 1.0)], "pos int, name string, type string, confidence double")
    assert [(r.key, r.name, r.confidence, r.n) for r in docs.merge_entities(m).collect()] == [("PERSON::ada lovelace", "Ada Lovelace", 0.9, 2)]
    r = spark.createDataFrame([("ADA LOVELACE", "London", "")], "source string, target string, relation string")
    assert [tuple(x) for x in docs.link_relations(r, m).collect()] == [("PERSON::ada lovelace", "UNKNOWN::london", "RELATED")]


def test_sheets(spark):
    assert one(spark, sheets.row_hash(F.lit("a"), F.lit(None).cast("string"))) == one(spark, F.sha1(F.lit("a||")))


def test_vectors(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, [0.0, 0.0])], "id long, vector array<double>")
    assert [(r.id, r.score) for r in search.knn(p, [1.0, 1.0], 5).collect()] == [(1, 0.707107), (2, 0.707107)]
    with pytest.raises(Exception, match="vector of 1"):
        sinks.checked_vectors(p, 2).collect()


def test_file_sources(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name in ("a.py", "b.txt", "node_modules/c.py", "d.SQL"):
        (tmp_path / name).write_text("text")
    assert sorted((r.path.rsplit("/", 1)[1], r.parser) for r in files.owned_files(spark, str(tmp_path)).collect()) == [("a.py", "python"), ("d.SQL", "sql")]
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t xml:space='preserve'> there</w:t></w:r></w:p><w:p><w:t>Two</w:t></w:p>")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    got = {r.path.rsplit("/", 1)[1]: (r.text, bool(r.error)) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"b.txt": ("text", False), "x.docx": ("Hello there\nTwo", False), "broken.docx": (None, True)}
    manifest = tmp_path / "m.json"
    for text in (json.dumps(["a.py", "../up", "/abs"]), json.dumps({"files": ["a.py"]}), "a.py\n\n../up\n"):
        manifest.write_text(text)
        assert [r.path for r in files.read_manifest(spark, str(manifest), "/root").collect()] == ["a.py"]


def test_sql_dialects(spark):
    for text, want in [("create table t (a int)", "sql"), ("create or replace package p as begin null; end;", "plsql"), ("-- begin declare\nselect 1", "sql"), ("", "sql")]:
        assert one(spark, files.sql_dialect(F.lit(text))) == want


def test_streamed_upserts(spark, tmp_path):
    src, state = str(tmp_path / "in"), {"df": spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")}
    for i, rows in enumerate(([(2, "c")], [(3, "d"), (3, None)])):
        spark.createDataFrame(rows, "id long, v string").coalesce(1).write.mode("append").parquet(src)
        out = str(tmp_path / f"state{i}")

        def write(df, out=out):
            df.write.mode("overwrite").parquet(out)
            state["df"] = spark.read.parquet(out)

        sync.sync_upserts(sync.stream_folder(spark, src, "id long, v string"), lambda: state["df"], write, ["id"], str(tmp_path / "check")).awaitTermination()
    assert sorted((r.id, r.v) for r in state["df"].collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_sync_table(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "table")
    for rows in ([(i, "a") for i in range(40)], [(1, "b"), (50, "c")], [(2, None), (1, "d")]):
        spark.createDataFrame(rows, "id long, v string").coalesce(1).write.mode("append").parquet(src)
        before = {f: f.stat().st_mtime_ns for f in (tmp_path / "table").glob("bucket=*/*.parquet")}
        sync.sync_table(sync.stream_folder(spark, src, "id long, v string"), out, ["id"], str(tmp_path / "check"), buckets=8).awaitTermination()
        after = {f: f.stat().st_mtime_ns for f in (tmp_path / "table").glob("bucket=*/*.parquet")}
        assert not before or sum(before.get(f) == t for f, t in after.items()) >= 6  # of eight buckets two are touched
    got = {r.id: r.v for r in spark.read.parquet(out).collect()}
    assert got == {i: "a" for i in range(40)} | {1: "d", 50: "c"} and spark.read.parquet(out).count() == 41


def test_sync_table_ends_while_it_swaps(spark, tmp_path, monkeypatch):
    src, out, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    stream = lambda: sync.sync_table(sync.stream_folder(spark, src, "id long, v string"), out, ["id"], check, buckets=4)
    spark.createDataFrame([(i, "a") for i in range(40)], "id long, v string").coalesce(1).write.mode("append").parquet(src)
    stream().awaitTermination()
    spark.createDataFrame([(i, "b") for i in range(0, 60, 3)], "id long, v string").coalesce(1).write.mode("append").parquet(src)
    write = DataFrameWriter.parquet

    def ends(self, path, *args, **kwargs):  # all buckets gone, none written
        if path == out:
            for f in (tmp_path / "table").glob("bucket=*/*"):
                f.unlink()
            raise RuntimeError("the driver ends here")
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", ends)
    with pytest.raises(Exception, match="driver ends"):
        stream().awaitTermination()
    monkeypatch.undo()
    stream().awaitTermination()
    got = {r.id: r.v for r in spark.read.parquet(out).collect()}
    assert got == {i: "a" for i in range(40)} | {i: "b" for i in range(0, 60, 3)} and spark.read.parquet(out).count() == len(got)
    assert not list((tmp_path / "check" / "staged").glob("[0-9]*"))


def test_knn_join_over_many_batches(spark):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (500, 4)).astype(float)  # few values: many ties
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        got = search.knn_join(points.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"), points, 7, block=4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    want = {(q, int(i), r + 1) for q in range(0, 500, 50) for r, i in enumerate(np.lexsort((np.arange(500), -np.round(unit @ unit[q], 6)))[:7])}
    assert {(r.query_id, r.id, r["rank"]) for r in got} == want


def test_match_candidates(spark):
    urls = ["/api/users", "/api/users/:id", "/api/orders/:id/lines", "/:id", "/api/none", "/", "/API/Users"]
    paths = ["/api/users", "/api/users/:key", "/v1/api/orders/:id/lines", "/:x", "/lines/orders/api", "/api"]
    fixed = lambda p: {x for x in p.lower().split("/") if x and x[0] not in ":*"}
    size = lambda p: len([x for x in p.split("/") if x])
    want = set()
    for i, u in enumerate(urls):
        strong = {(i, j) for j, p in enumerate(paths) if fixed(u) and fixed(u) <= fixed(p)}
        want |= strong or {(i, j) for j, p in enumerate(paths) if abs(size(u) - size(p)) <= 1}
    calls, ends = spark.createDataFrame(list(enumerate(urls)), "id long, url string"), spark.createDataFrame(list(enumerate(paths)), "id long, path string")
    got = [tuple(r) for r in match.candidates(calls, ends).collect()]
    assert set(got) == want and len(got) == len(want)
    assert match.candidates(calls, ends.limit(0)).count() == match.candidates(calls.limit(0), ends).count() == 0


def test_upsert_keeps_what_new_rows_lack(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id long, name string, note string")
    new = spark.createDataFrame([(1, "z"), (3, "n"), (3, "m")], "id long, name string")
    assert sorted(tuple(r) for r in sinks.upsert(old, new, ["id"]).collect()) == [(1, "z", "x"), (2, "b", None), (3, "n", None)]
    assert sorted(r.name for r in sinks.upsert(old, new, ["id"], first_wins=("name",)).collect()) == ["a", "b", "n"]
