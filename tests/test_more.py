"""Detectors, workbooks, the document graph, lookups and query understanding on small examples."""

import io
import uuid
import zipfile

from pyspark.sql import functions as F

from loomgraph.api import GraphEngine
from loomgraph.functions import infer
from loomgraph.functions import text as X
from loomgraph.operators import detectors, frontend, graph, impact, lookup
from loomgraph.sources import docgraph, files


def test_detectors_of_all_languages(spark):
    rows = [
        ("cplus", "void Bus::run(int a) {", None), ("cplus", 'SendMessage(hwnd, "WM_SAVE", data);', ("WM_SAVE", "Bus::run", "hwnd", '"WM_SAVE"')),
        ("delphi", "procedure TForm.Save;", None), ("delphi", 'Publish("a", 1, Third)', ("a", "TForm.Save", "", "1")),
        ("java", "public void go(int x) {", None), ("java", 'registerReceiver(recv, "f", p);', ("recv", "go", "recv", '"f"')), ("java", 'send("x", 1, Third);', ("x", "go", "", "1")), ("java", 'post("x", 1, Third);', ("x", "go", "Third", "1")),
        ("kotlin", "suspend fun load(a: Int)", None), ("kotlin", "registerReceiver(recv, f)", ("recv", "load", "recv", "f")),
        ("android", "fun open(a: Int)", None), ("android", "startActivity(Detail, extras)", ("Detail", "open", "Detail", "extras")),
        ("python", "async def work(x):", None), ("python", "queue.push('job', target)", ("job", "work", "target", "target")),
        ("js", "const send2 = async (a) => {", None), ("js", "bus.enqueue('q', 5, worker)", ("q", "send2", "worker", "5")),
        ("ts", "private async run(a: T): void {", None), ("ts", "bus.produce(topic)", ("topic", "run", "", "topic")),
        ("php", "public function run($a)", None), ("php", '$bus->dispatch("e", Handler)', ("e", "run", "Handler", "Handler")),
        ("csharp", "public async Task Run(int a)", None), ("csharp", 'bus.SendAsync("e", Handler)', ("e", "Run", "Handler", "Handler")),
        ("sql", "CREATE OR REPLACE PROCEDURE pay.run", None), ("sql", "notify('ch', 'msg')", ("ch", "pay.run", "'msg'", "'msg'")),
        ("plsql", "procedure pay_all", None), ("plsql", "enqueue('q', job)", ("q", "pay_all", "job", "job")),
        ("vbnet", "Public Shared Sub Run", None), ("vbnet", 'RaiseEvent("Done", Me1)', ("Done", "Run", "Me1", "Me1")),
        ("vb6", "Private Function Go1", None), ("vb6", 'PostMessage(hwnd, WM_X)', ("hwnd", "Go1", "hwnd", "WM_X")),
        ("vba", "Sub Macro1", None), ("vba", 'notify("x", 1, Third)', ("x", "Macro1", "Third", "1")),
        ("vbscript", "Function Main1", None), ("vbscript", 'send("x", y)', ("x", "Main1", "y", "y")),
        ("cobol", "broadcast('all', null, them)", ("all", "f.cobol", "them", "null")),
    ]
    df = spark.createDataFrame([(f"d/f.{lang}", i, text, lang) for i, (lang, text, _) in enumerate(rows)], "file string, line int, text string, language string")
    got = {x.line: (x.name, x.sender, x.receiver, x.payload) for x in detectors.detect_messages(df, "p").collect()}
    want = {i: w for i, (_, _, w) in enumerate(rows) if w}
    # a message named after its window call's second argument needs quotes or takes it as it is
    want[next(i for i, r in enumerate(rows) if r[1].startswith("PostMessage"))] = ("hwnd", "Go1", "hwnd", "WM_X")
    assert got == want and set(detectors.DETECTORS) - {r[0] for r in rows} == {"generic"}


def workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>A &amp; B</t></si><si><r><t>two</t></r><r><t> parts</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><f>1+1</f><v>2</v></c><c r="B2" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    cells = files.read_cells(spark, str(tmp_path)).collect()
    good = sorted((x.sheet, x.r, x.c, x.value, x.formula, x.type) for x in cells if x.type != "error")
    assert good == [("sheet1", 1, 1, "A & B", None, "s"), ("sheet1", 1, 28, "two parts", None, "s"), ("sheet1", 2, 1, "2", "=1+1", "n"), ("sheet1", 2, 2, "in", None, "inlineStr")]
    assert [x.value.split(":")[0] for x in cells if x.type == "error"] == ["BadZipFile"]
    docs = {x.path.rsplit("/", 1)[-1]: x for x in files.read_documents(spark, str(tmp_path)).collect()}
    assert docs["a.xlsx"].text == "A & B\ttwo parts\n2\tin" and docs["broken.xlsx"].text is None and docs["broken.xlsx"].error


def test_document_graph(spark, tmp_path):
    mentions = spark.createDataFrame([("s", 1, "e1", 0.5, 7, "E"), ("s", 1, "e1", 0.9, 20, "Ee"), ("s", 1, "e1", 0.9, 3, "eE"), ("s", 2, "e2", None, None, None)], "source_id string, paragraph_id long, entity string, confidence double, start_char int, surface string")
    assert sorted((x.entity, x.start_char, x.surface, x.n) for x in docgraph.has_entity(mentions).collect()) == [("e1", 3, "eE", 3), ("e2", None, None, 1)]
    empty = {
        "documents": spark.createDataFrame([], "id string, name string"), "entities": spark.createDataFrame([("e1", "old", "T0", "n0")], "id string, name string, type string, name_norm string"),
        "paragraphs": spark.createDataFrame([("s", 1, "before", True, {"a": "1", "b": "2"})], "source_id string, paragraph_id long, text string, short boolean, props map<string,string>"),
        "has_entity": docgraph.has_entity(mentions).limit(0), "related": spark.createDataFrame([], "source string, target string, type string, source_id string, paragraph_id long"),
    }
    paragraphs = spark.createDataFrame([("s", 1, "text", False, {"b": "3"}), ("s", 2, "more", False, None)], empty["paragraphs"].schema)
    entities = spark.createDataFrame([("e1", "new", "T1", "n1"), ("e2", "two", "T2", "n2")], empty["entities"].schema)
    relations = spark.createDataFrame([("e1", "e2", "R", "s", 1), ("e1", "e2", "R", "s", 1), ("e1", "gone", "R", "s", 1)], empty["related"].schema)
    out = docgraph.ingest(empty, paragraphs, entities, mentions, relations)
    assert sorted((x.id, x.name, x.type) for x in out["entities"].collect()) == [("e1", "old", "T1"), ("e2", "two", "T2")]
    assert sorted((x.paragraph_id, x.text, x.props) for x in out["paragraphs"].collect()) == [(1, "text", {"a": "1", "b": "3"}), (2, "more", None)]
    assert (out["documents"].count(), out["related"].count(), out["has_entity"].count()) == (1, 1, 2)
    points = docgraph.passage_points(paragraphs.withColumn("vector", F.array(F.lit(1.0))), mentions).orderBy("paragraph_id").collect()
    assert [(p.payload.text, p.payload.entity_ids) for p in points] == [("text", ["e1"]), ("more", ["e2"])]
    out["related"].write.parquet(f"{tmp_path}/related")
    docgraph.reset(spark, [f"{tmp_path}/related", f"{tmp_path}/none"])
    assert not (tmp_path / "related").exists()
    (tmp_path / "ipc.json").write_text('{"messages": [{"id": "a", "name": "n", "line": 3, "extra": 1}, 5]}')
    assert [(x.id, x.name, x.line) for x in docgraph.read_messages(spark, f"{tmp_path}/ipc.json").collect()] == [("a", "n", 3)]


def test_lookups_and_names(spark):
    assert lookup.string_list(" a, b;;c ") == ["a", "b", "c"] and lookup.string_list(None) == [] and lookup.string_list([" x ", ""]) == ["x"] and lookup.string_list(5) == ["5"]
    one = spark.range(1).select(X.uuid5(F.lit("T::né")).alias("u"), X.find_span(F.lit("The LICENSE text"), F.lit("license")).alias("s"), X.find_span(F.lit("x"), F.lit("")).alias("n"), X.text_chunks(F.lit("abcde"), 2).alias("c"), X.workflow_id(F.array(F.lit("b"), F.lit("a"))).alias("w"), X.truncated(F.lit("abc"), 2).alias("t"), X.slug(F.lit(" A b--C! ")).alias("slug")).first()
    assert one.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "T::né")) and (one.s.start, one.s.end) == (4, 11) and one.n is None
    assert one.c == ["ab", "cd", "e"] and one.w.startswith("wf::") and len(one.w) == 20 and (one.t, one.slug) == ("ab", "a-b-c")
    assert graph.flow_types("Java")[-1] == "EXTENDS" and graph.flow_types("rust", None, ["CALLS", "X"]) == ["CALLS"] and graph.flow_types(None, ["x"], ["Y"]) == ["X"]
    q = spark.createDataFrame([("who calls xử lý and validates the thanh toán of login",)], "t string")
    x = q.select(infer.query_actions(F.col("t")).alias("a"), infer.domain_phrases(F.col("t")).alias("p"), infer.type_hint(F.array(F.lit("x"), F.lit("userEmail"))).alias("h")).first()
    assert x.a == ["validate", "call", "process", "payment"] and x.p[0] == "thanh toán" and "login" in x.p and x.h == "User"
    body = spark.createDataFrame([("a", "useEffect(() => setOpen(true)); navigation.goBack()", "react-native"), ("b", "this.$router.push('/x')", "vue"), ("c", "x", "angular"), ("d", None, "vue")], "id string, code string, framework string")
    assert {(s.function, s.intent) for s in frontend.framework_signals(body).collect()} == {("a", "side_effect"), ("a", "state_mutation"), ("a", "screen_navigate"), ("b", "screen_navigate")}


def test_reports(spark):
    nodes = spark.createDataFrame([("a", "Main", "m.Main", "x.py", False), ("b", "f", "Api.f", "x.py", None), ("c", "g", "g", "lib/y.py", True), ("d", "h", None, "z.py", False)], "id string, name string, qualified_name string, file string, exported boolean")
    ids = lambda **k: {x.id for x in impact.dead_code_seeds(nodes, **k).collect()}
    assert ids() == {"a", "c"} and ids(default_names=False, exported=False, qualified=["api."], files=["LIB/"]) == {"b", "c"} and ids(default_names=False, exported=False) == set()
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("b", "d", "DECLARES")], "src string, dst string, rel_type string")
    engine = GraphEngine(spark, nodes=nodes.withColumn("comment", F.lit(None).cast("string")).withColumn("summary", F.lit("")), edges=edges)
    assert {(x.id, x.depth) for x in engine.trace_flow("a", parser="python").collect()} == {("a", 0), ("b", 1), ("d", 2)}
    assert [x.id for x in engine.explore_graph("main").collect()][:1] == ["a"]
    engine.query_subgraph("a").count()
    engine.ttl = -1.0
    engine.query_subgraph("b").count()
    assert len(engine._kept) == 1
