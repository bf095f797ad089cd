"""The llm operators against brute force on small fixtures, and their defined results for odd inputs."""

import hashlib
import json
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm.bpe_codec import WordBpe, bpe_codec
from loomgraph.llm.chat_format import chat_format
from loomgraph.llm.components import components
from loomgraph.llm.fm_decontaminate import FmIndex, fm_decontaminate
from loomgraph.llm.language_id import language_id
from loomgraph.llm.license_scan import license_scan
from loomgraph.llm.ngram_jaccard_join import ngram_jaccard_join, tree_links
from loomgraph.llm.pivot_index import embedding_near_dedup
from loomgraph.llm.quality_mil import GatedAttention, quality_mil
from loomgraph.llm.suffix_dedup import common_prefixes, repeated_windows, suffix_dedup, suffix_order
from loomgraph.llm.token_packing import best_fit_decreasing, encoding, token_packing

WORDS = "the of and in to is was for on that by with as at from this be it an are".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: columns with the names that operators use inside
CLASH = {"cls": 1, "n": 2, "token": 3, "found": 4, "rep": 5, "root": 6, "part": 7, "label_id": 8, "held_out": True, "spans": "x", "key": "k"}


def texts():
    r = np.random.default_rng(7)
    prose = lambda n: " ".join("".join(r.choice(WORDS, 2)) for _ in range(n))
    shared = prose(60)
    base = [prose(int(n)) for n in r.integers(3, 150, 40)]
    near = [" ".join(w if i % 40 else "changed" for i, w in enumerate(base[30].split())), base[31] + " one more"]
    odd = [None, "", "   \n\t", "x", "ÀÉ été ñ 日本語 🙂 " * 30, "aaaa" * 400, base[3] + "\n" + shared, shared + " " + base[4], (base[5] + " ") * 6, "ab " * 3000]
    return [*base, *near, base[30], base[30], *odd]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[35], rows[0], (None, "text without a number", None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    for name, value in CLASH.items():
        df = df.withColumn(name, F.lit(value))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(items, linked):
    up = {i: i for i, _ in items}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(items)):
        for b in range(a):
            if linked(items[a][1], items[b][1]):
                x, y = find(items[a][0]), find(items[b][0])
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in items}


def test_ngram_join(docs, empty):
    out = ngram_jaccard_join(docs, block_shingles=200).collect()
    assert len(out) == docs.count()
    sets = [(i, shingles(t)) for i, t in rows_of(docs) if i is not None]
    want = brute_components(sets, lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y))
    size = dict(sets)
    for r in out:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(size[r.doc_id]), want[r.doc_id])
        else:
            assert r.component_id is None
    assert ngram_jaccard_join(empty).count() == 0


def test_tree_links_find_all_components():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = r.choice(5000, int(r.integers(5, 120)), replace=False)
        for _ in range(6):
            drop = r.random(len(base)) < 0.08
            sets.append(np.unique(np.concatenate([base[~drop], r.choice(9000, int(r.integers(0, 4)))]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    named = [(i, set(s.tolist())) for i, s in enumerate(sets)]
    want = brute_components(named, lambda x, y: 100 * len(x & y) >= 80 * len(x | y))
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in tree_links(sets):
        assert 100 * len(named[a][1] & named[b][1]) >= 80 * len(named[a][1] | named[b][1])
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    assert {i: find(i) for i in range(len(sets))} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (100, 100), (None, 3), (7, 7)] + [(200, i) for i in range(201, 240)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, **{i: 200 for i in range(200, 240)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_arrays():
    r = np.random.default_rng(1)
    for trial in range(120):
        n, letters = int(r.integers(1, 200)), int(r.choice([1, 2, 3, 26]))
        b = bytes((97 + r.integers(0, letters, n)).tolist())
        b = (b[: max(1, n // 4)] * 5)[:n] if trial % 3 == 0 else b
        pad = np.concatenate([np.frombuffer(b, np.uint8), np.zeros(16, np.uint8)])
        sa = suffix_order(pad, n, 10**6)
        assert sa.tolist() == sorted(range(n), key=lambda i: b[i:])
        plcp = common_prefixes(pad, n, sa, 50)
        for k in range(1, n):
            x, y = b[sa[k] :], b[sa[k - 1] :]
            same = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert plcp[sa[k]] == min(same, 50)
        least = 1 + trial % 4
        if n >= 2 * least:
            off = np.array([0, n // 2, n])
            starts = [i for lo, hi in zip(off[:-1], off[1:], strict=True) for i in range(lo, hi - least + 1)]
            count = {}
            for i in starts:
                count[b[i : i + least]] = count.get(b[i : i + least], 0) + 1
            assert set(np.flatnonzero(repeated_windows(pad, off, np.ones(2, np.int64), least))) == {i for i in starts if count[b[i : i + least]] > 1}


@pytest.mark.parametrize("least", [200, 60])
def test_suffix_dedup(docs, empty, least):
    items = [(i, t.encode()) for i, t in rows_of(docs)]
    count = {}
    for _, b in items:
        for s in range(len(b) - least + 1):
            count[b[s : s + least]] = count.get(b[s : s + least], 0) + 1
    want = []
    for i, b in items:
        spans = []
        for s in range(len(b) - least + 1):
            if count[b[s : s + least]] > 1:
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = s + least
                else:
                    spans.append([s, s + least])
        kept, last = b"", 0
        for x, y in spans:
            kept, last = kept + b[last:x], y
        kept += b[last:]
        want.append((str(i), len(b), len(b) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup(docs, least, carry=("source",)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert suffix_dedup(empty, least).count() == 0


@pytest.mark.parametrize("whole", [True, False])
def test_bpe_long_words(whole):
    """Words of random letters, few letters and one letter, in rounds over all lowest pairs or one pair a round."""
    path = P.path("word_bpe_49k.json")
    bpe, rng = WordBpe(path), np.random.default_rng(7)
    bpe.whole_rounds = bpe.whole_rounds and whole
    words = ["".join(rng.choice(list(letters), n)) for letters, n in [("abcdefghijklmnopqrstuvwxyz", 20_000 if whole else 300), *[("ab", int(n)) for n in rng.integers(1, 60, 100)]]] + ["a" * n for n in range(1, 60)]
    library = Tokenizer.from_file(path)
    for w, ids in zip(words, bpe.encode(words), strict=True):
        assert ids.tolist() == library.encode(w, add_special_tokens=False).ids


def test_bpe(docs, empty):
    path = P.path("word_bpe_49k.json")
    own, library = WordBpe(path), Tokenizer.from_file(path)
    cases = ["", "don't I'LL<|endoftext|> x", "ΑΣ σ İ ﬁ", "á é 가 가", "₟⃷§", "12３ ½", "   ", "'s'T're", "aaab" * 300, "日本語🙂‍", "</w>"]
    for t in cases:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode([t])[0].tolist() == ids, t
        assert own.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False)
    own.whole_rounds = False
    own.cache.clear()
    assert own.encode(["banana bandana abracadabra"])[0].tolist() == library.encode("banana bandana abracadabra", add_special_tokens=False).ids
    got = bpe_codec(docs, path).collect()
    assert len(got) == docs.count()
    text = {}
    for i, t in rows_of(docs):
        text[i] = t
    for r in got:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_codec(empty, path).count() == 0


def test_fm_index():
    r = np.random.default_rng(2)
    for n in (1, 5, 40, 300):
        seq = r.integers(1, 5, n)
        index = FmIndex(seq, 5)
        for k in (1, 2, 4):
            phrases = np.array([r.integers(1, 5, k) for _ in range(20)])
            lo, hi = index.search(phrases)
            for p, a, b in zip(phrases, lo, hi, strict=True):
                at = sorted(index.locate(np.arange(a, b)).tolist())
                assert at == [i for i in range(n - k + 1) if (seq[i : i + k] == p).all()]


def test_decontamination(spark, docs, empty):
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in s))
    t = texts()
    items = [(1, " ".join(t[33].split()[5:30]).upper()), (2, "été ñ 日本語"), (3, ""), (4, None), (5, t[37]), (5, t[37]), (None, t[20])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, x in items:
        w = words(x or "") if i is not None else []
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add(str(i))
    text = {}
    for i, x in rows_of(docs):
        text[i] = x
    out = fm_decontaminate(docs, bench, carry=("source",)).collect()
    assert len(out) == docs.count() and any(r.contaminated for r in out)
    for r in out:
        w, hit, found = words(text[r.doc_id]), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in windows:
                    found |= windows[tuple(w[s : s + k])]
                    hit.update(range(s, s + k))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
        data = text[r.doc_id].encode()
        assert sum(len(words(data[s.begin : s.end].decode())) for s in r.spans) == len(hit)
    assert fm_decontaminate(empty, bench).count() == 0
    assert fm_decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    parts = {repr(r) for r in fm_decontaminate(docs, bench, most_bytes=300, carry=("source",)).collect()}
    assert parts == {repr(r) for r in out}


def test_language_id(spark, docs, empty):
    en, fr = "the and of this that with from have been which", "le la des une est dans pour avec sur être"
    r = np.random.default_rng(4)
    rows = [(i, " ".join(r.choice((en if i % 2 else fr).split(), 12)), "en" if i % 2 else "fr") for i in range(200)]
    mixed = (1000, " ".join([*en.split()] * 3 + [*fr.split()] * 4), None)
    odd = [(1001, None, "en"), (1002, "12 -- 34", "fr"), (1003, "日本", None), (None, "the and of", "en")]
    df = spark.createDataFrame([*rows, mixed, *odd, rows[0]], "doc_id long, text string, lang string")
    out = {(x.doc_id): x for x in language_id(df).collect()}
    for i, _, lang in rows:
        assert out[i].lang_pred == lang and 0 <= out[i].score <= 1
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [s.lang for s in out[1000].spans] == ["en", "fr"] and out[1000].lang_pred == "fr"
    assert out[1001].lang_pred == out[1002].lang_pred == "und" and out[1003].lang_pred in ("en", "fr")
    assert language_id(empty).count() == 0
    assert {x.lang_pred for x in language_id(df, learn_from=empty).collect()} == {"und"}
    assert language_id(docs, carry=("source",)).count() == docs.count()


def test_near_dedup(spark):
    r = np.random.default_rng(9)
    base = r.standard_normal((60, 16))
    rows, truth = [], []
    for i in range(300):
        v = base[i % 60] + r.standard_normal(16) * 0.02 * (i % 4)
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(400, rows[0][1], 0), (401, [x * 2 for x in rows[0][1]], 0), (402, None, 1), (403, [0.0] * 16, 1), (404, [float("nan")] * 16, 1), (405, rows[0][1], None), (406, [1.0, 2.0], 0), (407, [None] * 16, 1), (400, rows[0][1], 0), (408, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n", F.lit(1)).withColumn("cls", F.lit(2))
    out = embedding_near_dedup(df, block=16).collect()
    assert len(out) == len(rows)
    good = [(i, np.array(v, np.float64), label) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    for i, v, label in good:
        links.append(sum(label == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98 for _, w, m in good) - 1)
    got = {}
    for x in out:
        got.setdefault(x.vec_id, x)
        assert x.kept == (x.vec_id == x.component_id)
    pairs = sum(got[i].n_links for i, _, _ in good)
    assert all(got[i].n_links <= n for (i, _, _), n in zip(good, links, strict=True)) and pairs >= 0.9 * sum(links)
    for i in (402, 403, 404, 405, 407, 408):
        assert (got[i].n_links, got[i].component_id) == (0, i)
    assert embedding_near_dedup(df.limit(0)).count() == 0


def test_near_dedup_of_few_vectors(spark):
    r = np.random.default_rng(4)
    rows, want = [], {}
    for n in (2, 3, 4, 7, 40):  # so many near-equal vectors of a dimension each
        v = r.standard_normal(n + 3)
        for k in range(n):
            rows.append((100 * n + k, [float(x) for x in v + r.standard_normal(n + 3) * 0.01], 0))
            want[100 * n + k] = (n - 1, 100 * n)
    rows += [(9000 + k, [float(x) for x in r.standard_normal(16)], 0) for k in range(300)]
    v = r.standard_normal(24)
    few = [(9500 + k, [float(x) for x in v + r.standard_normal(24) * 0.01], 0) for k in range(3)]  # 3 of a larger table, sampled with a bound
    want |= {9500 + k: (2, 9500) for k in range(3)}
    df = spark.createDataFrame(rows + few, "vec_id long, embedding array<double>, label int")
    out = {x.vec_id: (x.n_links, x.component_id) for x in embedding_near_dedup(df, sample=200).collect()}
    assert {i: out[i] for i in want} == want
    alone = spark.createDataFrame(few, df.schema)
    assert {(x.n_links, x.component_id) for x in embedding_near_dedup(alone).collect()} == {(2, 9500)}


def test_packing(spark, docs, empty):
    r = np.random.default_rng(6)
    for most in (1, 2, 5, 16, 37):
        n = r.integers(1, most + 1, 50)
        rows = best_fit_decreasing(n, most)
        room, brute = [], 0
        for p in np.argsort(-n, kind="stable"):
            fit = [(x, i) for i, x in enumerate(room) if x >= n[p]]
            if fit:
                room[min(fit)[1]] -= n[p]
            else:
                room.append(most - n[p])
        assert sorted(sum(rows, [])) == list(range(50)) and len(rows) == len(room)
        assert all(n[x].sum() <= most for x in rows)
    path = P.path("byte_bpe_50k.tiktoken")
    enc = encoding(path, P.PATTERN)
    one = docs.dropDuplicates(["doc_id"])
    got = {}
    for row in token_packing(one, path, P.PATTERN, length=64, group_tokens=500).collect():
        ids, pos = np.frombuffer(row.ids, "<u4"), np.frombuffer(row.positions, "<u4")
        assert row.cu_seqlens[-1] == row.n_tokens and not ids[row.n_tokens :].any()
        for k in range(row.n_segments):
            a, b = row.cu_seqlens[k], row.cu_seqlens[k + 1]
            assert pos[a:b].tolist() == list(range(b - a))
            got.setdefault(row.doc_ids[k], {})[row.doc_begins[k]] = ids[a:b].tolist()
    for i, t in rows_of(one):
        parts = got.get(i, {})
        assert sum((parts[k] for k in sorted(parts)), []) == enc.encode_ordinary(t)
    assert token_packing(empty, path, P.PATTERN).count() == 0


def test_chat(spark):
    schemas = {"search": {"type": "object", "properties": {"q": {"type": "string"}, "n": {"type": "integer"}}, "required": ["q"], "additionalProperties": False}}
    call = lambda *calls: json.dumps({"tool_calls": list(calls)})
    rows = [
        (1, 0, "user", "hé \"q\""), (1, 1, "assistant", call({"id": "b", "name": "search", "arguments": {"q": 1}, "depends_on": ["a"]}, {"id": "a", "name": "search", "arguments": '{"n":2,"q":"x"}'})),
        (1, 2, "tool", '{"tool_call_id":"b","content":"B"}'), (1, 3, "tool", '{"content":"A","tool_call_id":"a"}'), (1, 4, "tool", '{"tool_call_id":"zz"}'),
        (2, 0, "assistant", call({"id": "c", "name": "search", "arguments": {"q": ""}, "depends_on": ["d"]}, {"id": "d", "name": "none", "depends_on": ["c"]}, {"id": "e", "name": "search", "arguments": {"q": "", "x": 1}}, {"id": "f", "name": "search", "arguments": {"q": ""}, "depends_on": ["gone"]})),
        (3, 0, "user", "{not json"), (3, 0, "user", "{not json"), (None, None, None, None), (4, 0, "assistant", call({"id": "e", "name": "search", "arguments": "["})),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("x"))
    out = chat_format(df, schemas).orderBy("conv_id", "place", "level", "turn", "part", "message").collect()
    first = [(x.kind, x.call_id, x.linked, x.error) for x in out if x.conv_id == 1]
    assert first == [("message", None, None, None), ("call", "a", True, None), ("result", "a", True, None), ("call", "b", True, "$.q: not of type string"), ("result", "b", True, None), ("result", "zz", False, None)]
    assert [x.message for x in out if x.call_id == "a"][0] == '{"role":"assistant","tool_call":{"arguments":{"n":2,"q":"x"},"id":"a","name":"search"}}'
    errors = {x.call_id: x.error for x in out if x.conv_id == 2}
    assert errors == {"c": "circular dependency", "d": "unknown tool none", "e": "$.x: unknown", "f": "unknown dependency"}
    assert len([x for x in out if x.conv_id == 3]) == 2 and [x.error for x in out if x.conv_id == 4] == ["$: arguments are not JSON"]
    assert [x.message for x in out if x.conv_id is None] == ['{"content":null,"role":null}']
    assert chat_format(df.limit(0), schemas).count() == 0


def test_licences(spark, docs, empty):
    apache = "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance\n# with the License.\n"
    rows = [(1, "Some prose.\nReleased under the MIT License.\nMore."), (2, apache), (3, None), (4, ""), (5, "you may not use this file except in compliance with the License."), (6, "All rights reserved. Licensed under CC BY-NC 4.0."), (None, "released under the mit license"), (7, "Neither this nor that. " * 50)]
    out = {x.doc_id: x for x in license_scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("licences", F.lit(1))).collect()}
    assert {k: v.licences for k, v in out.items()} == {1: "MIT", 2: "Apache-2.0", 3: "", 4: "", 5: "", 6: "CC-BY-NC-4.0,proprietary", None: "MIT", 7: ""}
    assert rows[0][1][out[1].matches[0].begin : out[1].matches[0].end].strip() == "Released under the MIT License."
    assert license_scan(empty).count() == 0 and license_scan(docs).count() == docs.count()


def test_quality(spark, empty):
    r = np.random.default_rng(8)
    prose = lambda: " ".join("".join(r.choice(WORDS, 2)) for _ in range(int(r.integers(20, 200))))
    rows = [(i, prose() if i % 3 else prose().upper().replace(" ", "!! "), int(bool(i % 3))) for i in range(300)]
    df = spark.createDataFrame([*[(i, t) for i, t, _ in rows], (900, None), (901, ""), (None, "x")], "doc_id long, text string").withColumn("y", F.lit(0))
    labels = spark.createDataFrame([*[(i, y) for i, _, y in rows], (0, 1), (1, None), (None, 1)], "doc_id long, quality int")
    out = {x.doc_id: x for x in quality_mil(df, labels).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held) and np.mean([out[i].predicted == rows[i][2] for i in held]) > 0.9
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) and abs(sum(x.attention) - 1) < 1e-6 for x in out.values()) and len(out) == 303
    assert {x.score for x in quality_mil(df, labels.limit(0)).collect()} == {0.5}
    assert quality_mil(empty.select("doc_id", "text"), labels).count() == 0


def test_quality_learns_from_whole_documents(spark, monkeypatch):
    size = {i: 1 + 5 * i for i in range(80)}  # passages of 4 words, up to 396
    df = spark.createDataFrame([(i, "word " * (4 * n)) for i, n in size.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in size], "doc_id long, quality int")
    learnt = [i for i in size if zlib.crc32(str(i).encode()) % 5]
    seen = []
    monkeypatch.setattr(GatedAttention, "fit", lambda self, x, bag, y: seen.append(np.diff(bag).tolist()))
    quality_mil(df, labels, passage=4).count()
    quality_mil(df, labels, passage=4, sample_passages=3000).count()
    assert seen[0] == [size[i] for i in learnt] and max(seen[0]) > 256
    assert 0 < len(seen[1]) < len(seen[0]) and set(seen[1]) < set(seen[0]) and 2000 < sum(seen[1]) <= 3000
    r = np.random.default_rng(1)
    model, bag = GatedAttention(5), np.array([0, 3, 10, 11, 31])
    x, y, i = r.standard_normal((31, 5)), np.array([0.0, 1, 1, 0]), np.array([2, 0, 3, 1])
    one, many = model.batch_gradient(x, bag, y, i), model.batch_gradient(x, bag, y, i, room=8)
    assert all(np.allclose(one[k], many[k]) for k in one)
