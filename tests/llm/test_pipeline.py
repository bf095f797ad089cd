"""The pipeline's stages against brute force, and the registered queries on the smallest tables."""

import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomgraph.llm import queries

from .test_operators import DOCS, WORDS, brute_components, shingles, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def cut(data, spans):
    kept, last = b"", 0
    for a, b in spans:
        kept, last = kept + data[last:a], b
    return kept + data[last:]


def repeated(docs, least=200):
    count, out = {}, {}
    data = {i: t.encode() for i, t in docs.items()}
    for b in data.values():
        for s in range(len(b) - least + 1):
            count[b[s : s + least]] = count.get(b[s : s + least], 0) + 1
    for i, b in data.items():
        spans = []
        for s in range(len(b) - least + 1):
            if count[b[s : s + least]] > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + least
                else:
                    spans.append([s, s + least])
        left = cut(b, spans)
        if left or not b:
            out[i] = left.decode("utf-8", errors="ignore")
    return out


def decontaminated(docs, items):
    windows = {}
    for t in items:
        w = WORD.findall(low(t))
        k = min(13, len(w))
        windows |= {tuple(w[s : s + k]): k for s in range(len(w) - k + 1 if k else 0)}
    out = {}
    for i, t in docs.items():
        found = list(WORD.finditer(low(t)))
        w, hit = [m[0] for m in found], set()
        for k in set(windows.values()):
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    hit.update(range(s, s + k))
        if hit and 20 * len(hit) >= len(w):
            continue
        runs = []
        for h in sorted(hit):
            if runs and runs[-1][1] == h - 1:
                runs[-1][1] = h
            else:
                runs.append([h, h])
        kept, last = "", 0
        for a, b in runs:
            kept, last = kept + t[last : found[a].start()], found[b].end()
        out[i] = kept + t[last:]
    return out


@pytest.fixture(scope="module")
def folder_of_docs(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    t = texts()
    leak = " ".join(t[36].split()[:20])
    t += [leak + " tail words here", (t[33] + " ") + leak + " " + " ".join(f"w{i}" for i in range(500))]
    rows = [(i, x, ["en", "fr"][i % 2], f"src{i % 3}", len(x or "")) for i, x in enumerate(t)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {i: x for i, x, *_ in rows}, [leak]


def test_stages(spark, folder_of_docs):
    folder, given, items = folder_of_docs
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    took = lambda name: stages[name](spark, docs, folder)
    texts_of = lambda df: {r.doc_id: r.text for r in df.collect()}

    docs = took("language_id")
    assert docs.columns == columns
    now = {i: x for i, x in given.items() if x and any(c.isalpha() for c in x)}
    got = texts_of(docs)
    assert set(got) <= set(now) and len(got) >= 0.9 * len(now)
    now = got
    docs = took("ngram_jaccard_join")
    root = brute_components([(i, shingles(x)) for i, x in now.items()], lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y))
    now = {i: x for i, x in now.items() if root[i] == i}
    assert docs.columns == columns and texts_of(docs) == now
    docs = took("suffix_dedup")
    now = repeated(now)
    assert docs.columns == columns and texts_of(docs) == now and all(r.n_chars == len(r.text) for r in docs.collect())
    docs = took("benchmark_decontamination")
    now = decontaminated(now, items)
    assert docs.columns == columns and texts_of(docs) == now
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    last = took("bpe_encoding").collect()
    want = {i: hashlib.sha256(np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, x in now.items()}
    assert {r.doc_id: r.ids_sha256 for r in last} == want
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, folder).collect()} == want


def test_repeated_rows_and_null_ids_stay_once(spark, tmp_path):
    r = np.random.default_rng(3)
    prose = lambda: " ".join("".join(r.choice(WORDS, 2)) for _ in range(120))
    t = [prose() for _ in range(30)]
    rows = [(i, x) for i, x in enumerate(t)]
    lone, other = prose(), prose()
    rows += [(0, t[0]), (0, t[0]), (None, t[1]), (None, t[2]), (None, t[2]), (None, lone), (None, lone), (3, other), (40, t[4])]
    rows = [(i, x, "en", "src", len(x)) for i, x in rows]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "none of these words is in any of the texts above")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = sorted([*enumerate(t), (3, other), (-1, lone)])
    kept = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, docs, str(tmp_path))
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.text) for x in kept.collect()) == want
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    digest = lambda x: hashlib.sha256(np.array(library.encode(x, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.ids_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted((i, digest(x)) for i, x in want)


def test_further_columns_of_any_name(spark, tmp_path):
    r = np.random.default_rng(8)
    prose = lambda: " ".join("".join(r.choice(WORDS, 2)) for _ in range(60))
    t = [prose() for _ in range(12)]
    shared = prose()
    rows = [(i, x + (" " + shared if i in (3, 7) else ""), "en", "src", len(x)) for i, x in enumerate(t)]
    docs = spark.createDataFrame([*rows, rows[0], (None, prose(), "en", "src", 1), (20, None, "en", None, None)], DOCS)
    extra = {"score": 0.5, "lang_pred": "x", "kept": True, "found": 4, "cls": 5, "n_hit": 6, "carried": "c", "doc id.x": "quoted `name`", "row": 7, "component_id": 8}
    for name, value in extra.items():
        docs = docs.withColumn(name, F.lit(value))
    docs = docs.repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(t[5].split()[10:40]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = stage(spark, given, str(tmp_path))
        assert given.columns == columns, name
        got = given.collect()
        assert got and all(x[n] == v for x in got for n, v in extra.items()), name
        given = spark.createDataFrame(got, docs.schema)
    assert sorted(-1 if x.doc_id is None else x.doc_id for x in got) == [-1, 0, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11]
    assert all(shared not in x.text for x in got)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_return_a_row_for_each_row(spark, folder, name):
    table = {"op4_chat_format": "conversations", "op7_pivot_index": "embeddings"}.get(name, "documents")
    n = queries.QUERIES[name](spark, folder).count()
    assert n > 0 if name == "op2_token_packing" else n == spark.read.parquet(f"{folder}/{table}.parquet").count()
