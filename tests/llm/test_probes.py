"""Odd and hostile inputs, and inner steps, of the llm operators against brute force."""

import hashlib
import itertools
import json
import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgraph.llm import suffix_dedup as sd
from loomgraph.llm.chat_format import chat_format, message_parts
from loomgraph.llm.fm_decontaminate import fm_decontaminate
from loomgraph.llm.language_id import Model, language_id, viterbi
from loomgraph.llm.license_scan import RULES, SENTENCES, Rules, license_scan, normalise
from loomgraph.llm.ngram_jaccard_join import SHARED, _candidates, ngram_jaccard_join
from loomgraph.llm.pivot_index import embedding_near_dedup
from loomgraph.llm.quality_mil import GatedAttention
from loomgraph.llm.queries import op2_token_packing
from loomgraph.llm.token_packing import encoding

from .test_operators import WORDS, brute_components, shingles

# -- license scans


def cuts_of(text):
    out, last = [], 0
    for m in re.finditer(r"[.!?;:]+(?=\s|$)|[\r\n]+", text):
        out.append(text[last : m.end()])
        last = m.end()
    return [x for x in [*out, text[last:]] if normalise(x)]


def brute_licences(text, sentences, rules, gap):
    """Known sentences by trying all runs of cuts, rules by trying every place, as the docstring says."""
    known = {normalise(s): k for k, s in sentences.items()}
    cuts, found, i, number = cuts_of(text), [], 0, 0
    while i < len(cuts):
        ends = [j for j in range(i, len(cuts)) if sum((normalise(x) for x in cuts[i : j + 1]), ()) in known]
        if ends:
            found.append((number, known[sum((normalise(x) for x in cuts[i : max(ends) + 1]), ())]))
            i = max(ends)
        number, i = number + 1, i + 1
    spans = []
    for name, ids in rules:
        for s in range(len(found)):
            at, ok = s, found[s][1] == ids[0]
            for want in ids[1:]:
                nxt = next((k for k in range(at + 1, len(found)) if found[k][1] == want), None)
                ok = ok and nxt is not None and found[nxt][0] - found[at][0] - 1 <= gap
                at = nxt if ok else at
            if ok:
                spans.append((len(ids), s, at, name))
    kept = [m for m in spans if not any(k != m and k[1] <= m[1] and m[2] <= k[2] and k[0] > m[0] for k in spans)]
    return len(found), sorted({k[3] for k in kept})


def test_licences_by_brute_force():
    r = np.random.default_rng(5)
    rules, ids = Rules(SENTENCES, RULES), list(SENTENCES)
    filler = ["Some prose of no licence.", "x", "***", "1.", "The Software", "Permission is hereby", ""]
    for _ in range(150):
        parts = []
        name, want = RULES[int(r.integers(len(RULES)))]
        for x in want:
            parts += [SENTENCES[x], *r.choice(filler, int(r.integers(0, 5)))]
        parts += [SENTENCES[x] for x in r.choice(ids, int(r.integers(0, 4)))]
        text = str(r.choice(["\n", " ", "\n\n"])).join(parts)
        if r.random() < 0.5:
            text = re.sub(" ", lambda m: "\n" if r.random() < 0.1 else " ", text)
        found = rules.sentences(text)
        named = sorted({n for n, _, _ in rules.licences(found, 3)})
        assert (len(found), named) == brute_licences(text, SENTENCES, RULES, 3), text


def test_licences_of_any_length(spark):
    grant = "\n".join(SENTENCES["mit-grant"].split())
    lines = "\n".join(f"unrelated line {i}" for i in range(30))
    rows = [
        (1, "*" * 250 + " Released under the MIT License.", "MIT"), (2, "*" * 100_000 + "\n" + SENTENCES["apache-2-short"], "Apache-2.0"),
        (3, grant + "\n" + SENTENCES["mit-notice"], "MIT"), (4, f"{SENTENCES['mit-grant']}\n{lines}\n{SENTENCES['mit-notice']}", ""),
        (5, ("word " * 50 + "\n") * 4000 + "SPDX-License-Identifier: ISC\n" + "All rights reserved.\n" * 20_000, "ISC,proprietary"),
    ]
    out = {x.doc_id: x.licences for x in license_scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), matches=False).collect()}
    assert out == {i: want for i, _, want in rows}


# -- chat formatting

json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.text(max_size=4) | st.sampled_from(["\ud800", "a\udfffb"]), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["id", "name", "arguments", "depends_on", "tool_calls", "content", "tool_call_id", "x"]), x, max_size=4), max_leaves=12)
SCHEMAS = {"search": {"type": "object", "properties": {"x": {"type": ["integer", "null"]}}, "required": ["x"], "additionalProperties": False}}


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.sampled_from(["tool_calls", "tool_call_id", "content", "x"]), json_values, max_size=3), st.sampled_from(["tool", "user", None]))
def test_any_message_gives_parts(value, role):
    for text in (json.dumps(value), json.dumps({"tool_calls": [value, {"name": value, "id": value}, {"name": "search", "arguments": json.dumps(value)}]})):
        parts = message_parts(role, text, SCHEMAS)
        for kind, ident, name, needs, error, message in parts:
            assert kind in ("message", "call", "result") and json.loads(message, parse_constant=pytest.fail)
            for x in (ident, name, error, message, *needs):
                assert x is None or x.encode() is not None


def test_hostile_messages(spark):
    deep = '{"tool_calls":[{"id":"a","name":"search","arguments":' + "[" * 100_000 + "]" * 100_000 + "}]}"
    texts = [deep, '{"tool_calls":[{"id":"a","name":["x"],"arguments":{}}]}', '{"tool_calls":[{"id":"b","name":{"k":1}}]}', '{"tool_calls":[{"id":"\\ud800","name":"search","arguments":{"x":1}}]}', '{"tool_calls":[{"id":"c","name":"search","arguments":{"x":NaN}}]}', '{"tool_calls":[{"id":"d","name":"search","arguments":{"x":1e400}}]}', '{"tool_calls":[{"id":"e","name":"search","arguments":{"x":true}}]}']
    df = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = {x.turn: x for x in chat_format(df, SCHEMAS).collect()}
    assert [out[i].kind for i in range(7)] == ["message", "call", "call", "call", "message", "message", "call"]
    assert out[1].error == 'unknown tool ["x"]' and out[2].error == 'unknown tool {"k":1}' and out[3].call_id == "�" and out[3].error is None
    assert out[6].error == "$.x: not of type [\"integer\",\"null\"]" and json.loads(out[0].message)["content"] == deep


def test_chat_order_by_brute_force(spark):
    r = np.random.default_rng(12)
    rows, truth = [], {}
    for conv in range(40):
        n = int(r.integers(1, 9))
        needs = {i: sorted({int(x) for x in r.integers(0, n + 1, int(r.integers(0, 3)))} - {i}) for i in range(n)}  # n: a call that isn't there
        turn = {i: int(x) for i, x in enumerate(r.permutation(n))}
        answers = {i: n + int(r.integers(0, 5)) for i in range(n) if r.random() < 0.8}
        for i in range(n):
            rows.append((conv, turn[i], "assistant", json.dumps({"tool_calls": [{"id": f"c{i}", "name": "search", "arguments": {"x": i}, "depends_on": [f"c{k}" for k in needs[i]]}]})))
        rows += [(conv, t, "tool", json.dumps({"tool_call_id": f"c{i}", "content": i})) for i, t in answers.items()]
        level, place, answered, open_ = {}, {}, {}, set(range(n))
        while ready := [i for i in open_ if all(k == n or k in level for k in needs[i])]:
            for i in sorted(ready):
                real = [k for k in needs[i] if k < n]
                if any(k in open_ for k in real):
                    continue
                level[i] = 1 + max((level[k] for k in real), default=-1)
                place[i] = max([turn[i], *(answered[k] for k in real)])
                answered[i] = max(place[i], answers.get(i, -1))
                open_.discard(i)
        for i in range(n):
            error = "circular dependency" if i in open_ else "unknown dependency" if n in needs[i] else None
            truth[conv, f"c{i}"] = (2 * level[i] + 1 if i in level else 0, place.get(i, turn[i]), i in answers, error)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format(df, SCHEMAS).collect()
    assert {(x.conv_id, x.call_id): (x.level, x.place, x.linked, x.error) for x in out if x.kind == "call"} == truth
    assert all(x.linked for x in out if x.kind == "result")


# -- language ID


def test_viterbi_by_exhaustion():
    r = np.random.default_rng(6)
    for _ in range(60):
        n, k = int(r.integers(1, 7)), int(r.integers(1, 4))
        scores, penalty = r.standard_normal((n, k)).astype(np.float32), float(r.choice([0.1, 0.7, 2]))
        best = max(itertools.product(range(k), repeat=n), key=lambda p: sum(scores[i, x] for i, x in enumerate(p)) - penalty * sum(a != b for a, b in itertools.pairwise(p)))
        assert viterbi(scores, np.array([0, n]), penalty).tolist() == list(best)


def test_viterbi_of_long_documents_is_the_same():
    r = np.random.default_rng(7)
    n = [0, 3, 500, 41, 1, 160, 161]
    at = np.concatenate([[0], np.cumsum(n)])
    scores = np.cumsum(r.standard_normal((at[-1], 4)), 0).astype(np.float32) / 20
    want = viterbi(scores, at, 2.0)
    assert np.array_equal(viterbi(scores, at, 2.0, block=10), want) and len(np.unique(want)) > 1


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, "the and of this that with" if i % 2 else "это и не что как по", "en" if i % 2 else "ru") for i in range(80)]
    rows += [(1000, "the and of неведомое this that", None), (1001, "это и unbeknown что как по", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {x.doc_id: x for x in language_id(df).collect()}
    assert [s.lang for s in out[1000].spans] == ["en", "ru", "en"] and [s.lang for s in out[1001].spans] == ["ru", "en", "ru"]
    assert out[1000].lang_pred == "en" and out[1001].lang_pred == "ru"
    assert Model([], *(np.zeros(0, np.int64),) * 3).labels == []


# -- benchmark decontamination


def test_texts_of_one_item_are_one_item(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([(7, a), (7, b), (8, b)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{a} and {b}", 1.0, 5)], "doc_id long, text string, n_hit double, spans int")
    for most in (16 << 20, 10):
        x = fm_decontaminate(docs, bench, carry=("n_hit", "spans"), cut=True, most_bytes=most).collect()[0]
        assert (x.n_items, x.n_hit, x.kept, x.carried.c0, x.carried.c1) == (2, 40, " and ", 1.0, 5)


# -- embedding near-dedup


def test_vectors_under_one_id(spark):
    e1, e2 = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = lambda v: [x + 0.01 for x in v]
    df = spark.createDataFrame([(1, e1, 0), (1, e2, 0), (2, near(e2), 0), (3, near(e1), 0)], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(x) for x in embedding_near_dedup(df).collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


@pytest.mark.parametrize("dim", [16, 64, 384])
def test_recall_on_planted_pairs(spark, dim):
    """Pairs at a cosine just over the limit among random vectors, in lists of several blocks; pivots grow to 200."""
    r = np.random.default_rng(dim)
    n = 1500
    x = r.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.standard_normal((n, dim))
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = r.uniform(0.9801, 0.985, n)[:, None]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * side]))]
    out = {v.vec_id: v.n_links for v in embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=256, pivots=200).collect()}
    full = np.array([v for _, v, _ in rows])
    want = ((full @ full.T) >= 0.98).sum(1) - 1
    assert sum(out.values()) >= 0.99 * want.sum() and all(out[i] <= want[i] for i in out)


# -- n-gram Jaccard join


def test_large_clusters_are_split_and_stay_whole(spark):
    r = np.random.default_rng(21)
    base = [" ".join(r.choice(WORDS, 2, replace=False).tolist() + [f"w{i}_{k}" for k in range(40)]) for i in range(3)]

    def changed(t, n):
        w = t.split()
        for k in r.choice(len(w), n, replace=False):
            w[k] = f"new{r.integers(10**9)}"
        return " ".join(w)

    texts = [changed(base[i % 3], int(r.integers(0, 3))) for i in range(150)]
    chain = [f"w0_{k}" for k in range(60)]  # each links with the next one only
    texts += [" ".join(chain[i : i + 40]) for i in range(0, 20, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = brute_components([(i, shingles(t)) for i, t in enumerate(texts)], lambda x, y: 100 * len(x & y) >= 80 * len(x | y))
    for block in (4, 16, 256):
        assert {x.doc_id: x.component_id for x in ngram_jaccard_join(df, block=block).collect()} == want


def files_of_checkpoints(spark, work):
    """Files of each checkpoint that work() writes with 64 shuffle partitions, which AQE leaves as they are; in order."""
    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    before = set(top.glob("*/rdd-*"))
    try:
        for k, v in zip(kept, ("64", "false"), strict=True):
            spark.conf.set(k, v)
        out = work()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    new = sorted(set(top.glob("*/rdd-*")) - before, key=lambda p: int(p.name[4:]))
    return out, [len(list(p.glob("part-*"))) for p in new]


def test_small_tables_are_kept_in_few_files(spark):
    r = np.random.default_rng(4)
    texts = [" ".join([f"w{i % 2}_{k}" for k in range(60)] + [f"end{r.integers(10**9)}"] * (i % 3)) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out, files = files_of_checkpoints(spark, lambda: {x.doc_id: x.component_id for x in ngram_jaccard_join(df, block=4).collect()})
    assert out == brute_components([(i, shingles(t)) for i, t in enumerate(texts)], lambda x, y: 100 * len(x & y) >= 80 * len(x | y))
    assert len(files) >= 6 and max(files) <= spark.sparkContext.defaultParallelism

    passage = " ".join(f"p{k}" for k in range(80))
    rows = [(i, f"{texts[i]} {i} {passage} {i}") for i in range(20)]
    out, files = files_of_checkpoints(spark, lambda: sd.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), keep=False).collect())
    assert all(len(passage) <= x.n_removed < x.n_bytes for x in out) and len(out) == len(rows)
    assert len(files) == 3 and max(files[1:]) <= spark.sparkContext.defaultParallelism


def test_one_shared_shingle_makes_no_candidates():
    """Sets of 400 in a ring, each with one shingle of the next, and two that share ten; all at the first places."""
    token, cls = [7 * i + k for i in range(60) for k in (0, 7)], [i for i in range(60) for _ in range(2)]
    token, cls = [t % 420 for t in token] + [1000 + k for k in range(10)] * 2, cls + [100] * 10 + [101] * 10
    place = [0, 1] * 60 + list(range(10)) * 2
    columns = [np.array(x, kind).tobytes() for x, kind in ((token, np.uint64), (cls, np.int64), ([400] * len(cls), np.int32), (place, np.uint16))]
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), *(pa.array([x], pa.binary()) for x in columns)], names=["part", "tokens", "classes", "sizes", "places"])
    pairs = [x for b in _candidates(4, 5)(iter([batch, batch])) for x in b.to_pylist()]  # what two tasks have met counts once
    assert len(pairs) == 61 and {x["need"] for x in pairs} == {SHARED}
    assert [(x["a"], x["b"], x["n"]) for x in pairs if x["n"] >= x["need"]] == [(100, 101, 10)]


def test_links_of_all_sizes_by_brute_force(spark):
    r = np.random.default_rng(22)
    texts = []
    for n in [1, 2, 4, 5, 6, 8, 9, 12, 20, 35, 36, 37, 50, 68, 69, 100, 130, 260, 300]:
        base = [f"{w}{k % 90}" for k, w in enumerate(r.choice(WORDS, n))]
        for _ in range(8):
            w = list(base)
            for k in r.choice(n, min(n, int(r.integers(0, 2 + n // 40))), replace=False):
                w[k] = f"new{r.integers(40)}"
            texts.append(" ".join(w[int(r.integers(0, 1 + n // 12)) : n - int(r.integers(0, 1 + n // 12))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute_components([(i, shingles(t)) for i, t in enumerate(texts)], lambda x, y: 100 * len(x & y) >= 80 * len(x | y))
    assert {x.doc_id: x.component_id for x in ngram_jaccard_join(df).collect()} == want and 30 < len(set(want.values())) < 130


# -- suffix-array dedup


def brute_windows(texts, least):
    count = {}
    for t in texts:
        for s in range(len(t) - least + 1):
            count[t[s : s + least]] = count.get(t[s : s + least], 0) + 1
    return [[s for s in range(len(t) - least + 1) if count[t[s : s + least]] > 1] for t in texts]


@pytest.mark.parametrize("chunk", [1, 300, 1 << 19])
def test_groups_with_many_contexts(chunk):
    r = np.random.default_rng(chunk)
    line = bytes(r.integers(97, 123, 120).tolist())
    texts = []
    for i in range(40):
        around = [bytes(r.integers(97, 123, 60).tolist()) for _ in range(2)]
        if i % 5 == 0:
            around = [b"x" * 40 + b"common " * 3, b"tail " * 12]
        texts.append(around[0] + line + around[1])
    size = np.array([len(t) for t in texts])
    data = np.concatenate([np.frombuffer(b"".join(texts), np.uint8), np.zeros(8, np.uint8)])
    at = np.cumsum(size) - size
    hit = sd.repeated_in_groups(data, at, size, np.ones(len(texts), np.int64), np.zeros(len(texts), np.uint64), 150, chunk=chunk)
    got = [np.flatnonzero(hit[a : a + n]).tolist() for a, n in zip(at, size, strict=True)]
    assert got == brute_windows(texts, 150) and any(got)


def test_common_prefixes_of_a_repetitive_text(monkeypatch):
    """What comes again and again after itself is compared to the depth that counts, not to its end (60,000 bytes here)."""
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: (compared.append(len(x)), count(x))[1])
    rng = np.random.default_rng(5)
    line = rng.integers(97, 123, 61)
    passages = np.concatenate([np.concatenate([line, rng.integers(97, 123, 139)]) for _ in range(30)])
    for text in (np.tile(passages, 10), np.tile(rng.integers(97, 123, 300), 200), np.zeros(60_000)):
        n, padded = len(text), np.concatenate([text, np.zeros(16)]).astype(np.uint8)
        sa = sd.suffix_order(padded, n, 200)
        compared.clear()
        found = sd.common_prefixes(padded, n, sa, 200)
        assert sum(compared) <= 26 * n and len(compared) <= (sd.RUN + 200) // 8 + 1
        data = padded[:n].tobytes()
        for a, b in zip(sa[1::97].tolist(), sa[::97].tolist(), strict=False):
            assert found[a] == next((i for i in range(200) if max(a, b) + i == n or data[a + i] != data[b + i]), 200)


def test_a_passage_under_one_large_anchor(monkeypatch):
    """Contexts of one anchor that are split share copies of a passage, one after another, as on the pipeline's third stage."""
    compared, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: (compared.append(len(x)), count(x))[1])
    r = np.random.default_rng(35)
    passage, n = r.integers(97, 123, 280), 1200
    texts = [np.concatenate([r.integers(97, 123, 60), passage, r.integers(97, 123, 60)]).astype(np.uint8) for _ in range(n)]
    size = np.full(n, 400)
    data = np.concatenate([*texts, np.zeros(8, np.uint8)])
    hit = sd.repeated_in_groups(data, np.arange(n) * 400, size, np.ones(n, np.int64), np.zeros(n, np.uint64), 200, chunk=150_000)
    assert [np.flatnonzero(x).tolist() for x in hit.reshape(n, 400)] == brute_windows([t.tobytes() for t in texts], 200)
    assert 0 < sum(compared) <= 26 * len(hit)


def test_long_texts_go_in_stretches(spark, monkeypatch):
    r = np.random.default_rng(31)
    passage = bytes(r.integers(97, 123, 500).tolist()).decode()
    long = "".join(chr(x) for x in r.integers(97, 123, 9000))
    texts = [long[:3990] + passage + long[3990:], "head " + passage + " tail", "ab" * 2500, long[100:400] + "!", passage[:210]]
    buf, off = np.frombuffer("".join(texts).encode() + bytes(8), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = sd.anchors_of(buf, off, 200, 40)
    monkeypatch.setattr(sd, "STRETCH", 1000)
    parts = sd.anchors_of(buf, off, 200, 40)
    windows = lambda x: {(d, s, h) for d, h, _, lo, hi in zip(*(y.tolist() for y in x), strict=True) for s in range(lo, hi + 1)}
    assert windows(parts) == windows(whole)
    out = sd.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for x, found in zip(sorted(out), brute_windows([t.encode() for t in texts], 200), strict=True):
        covered = {p for s in found for p in range(s, s + 200)}
        assert x.n_removed == len(covered)


def test_shared_passages_over_many_tasks(spark, monkeypatch):
    """Settled places and marks: flushes of a few entries, and a passage that most documents have."""
    r = np.random.default_rng(33)
    words = lambda n: " ".join("".join(r.choice(WORDS, 2)) for _ in range(n))
    common, rare = words(60), words(60)
    texts = [words(20) + " " + common + " " + words(20) + (rare if i % 13 == 0 else "") for i in range(60)] + [words(50) for _ in range(5)]
    texts += texts[:2]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, cls int").repartition(6)
    out = sd.suffix_dedup(df, carry=("cls",)).collect()
    for x, found in zip(sorted(out), brute_windows([t.encode() for t in texts], 200), strict=True):
        covered = {p for s in found for p in range(s, s + 200)}
        assert (x.n_removed, x.carried.c0) == (len(covered), 1)


# -- token packing


def test_the_packing_query_returns_its_matrices(spark, folder):
    """Ids, padding and positions of every row; the segments of a document are its ids again, for every document."""
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    found = {}
    for x in op2_token_packing(spark, folder).collect():
        ids, positions, ends = np.frombuffer(x.ids, "<u4"), np.frombuffer(x.positions, "<u4"), x.cu_seqlens
        assert len(ids) == len(positions) == 2048 and hashlib.sha256(x.ids).hexdigest() == x.ids_sha256
        assert ends[-1] == x.n_tokens and not ids[x.n_tokens :].any()
        for doc, begin, lo, hi in zip(x.doc_ids, x.doc_begins, ends[:-1], ends[1:], strict=True):
            found.setdefault(doc, []).append((begin, ids[lo:hi].tolist()))
            assert positions[lo:hi].tolist() == list(range(hi - lo))
    enc = encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert {d: [t for _, p in sorted(x) for t in p] for d, x in found.items()} == {d: enc.encode_ordinary(t) for d, t in texts.items() if t}


# -- quality


def test_gradient_by_differences():
    r = np.random.default_rng(2)
    m = GatedAttention(5, hidden=4, gate=3)
    x, bag, y = r.standard_normal((9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -float(np.mean(y * np.log(m.forward(x, bag)["p"]) + (1 - y) * np.log(1 - m.forward(x, bag)["p"])))
    found = m.gradient(x, bag, y)
    for k, g in found.items():
        for i in np.ndindex(g.shape):
            old = m.w[k][i]
            m.w[k][i] = old + 1e-6
            up = loss()
            m.w[k][i] = old - 1e-6
            down = loss()
            m.w[k][i] = old
            assert abs((up - down) / 2e-6 - g[i]) < 1e-6


def test_carried_names_of_all_kinds(spark):
    docs = spark.createDataFrame([(1, "the and of this", "en", 1, 2.0, "x")], "doc_id long, text string, lang string, `a b` int, score double, `x.y` string")
    carry = ("lang", "a b", "score", "x.y")
    for df in (language_id(docs, carry=carry), sd.suffix_dedup(docs, carry=carry), fm_decontaminate(docs, docs.select(F.col("doc_id").alias("item_id"), "text").limit(0), carry=carry)):
        assert tuple(df.select("carried.*").first()) == ("en", 1, 2.0, "x")
