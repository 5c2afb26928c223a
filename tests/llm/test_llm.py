"""Each operator against brute force, a round trip or a library, with nulls, empty and repeated rows, and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import bpe, chat, cover_tree, exact_dedup, jaccard_join, licenses, packing, run_index, suffix_tree_lm, tools, toxicity, words

DOCS = "doc_id long, text string, id string, key string"  # two columns whose names operators use themselves


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def tokens(t):
    return [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    voc = [f"w{i}" for i in range(60)] + ["é🙂", "The", "the"]
    base = [" ".join(r.choice(voc) for _ in range(r.randrange(1, 90))) for _ in range(12)]
    texts = []
    for b in base:
        for _ in range(r.randrange(1, 9)):
            w = b.split(" ")
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = r.choice(voc)
            texts.append((" " if r.random() < 0.8 else "  \n").join(w))
    texts += [None, "", "", " \t", "A" * 3000, "a" * 3000, texts[0], "one two", "ONE TWO"]
    return list(enumerate(texts))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_words(corpus):
    w = words.split_words(pa.array([t for _, t in corpus]))
    assert w.per_doc.tolist() == [len(tokens(t)) for _, t in corpus]
    seen = {}
    for a, b in zip([x for _, t in corpus for x in tokens(t)], w.h.tolist(), strict=True):
        assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    e = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (None, 1)] + [(100, 100 + k) for k in range(1, 40)]
    got = dict(tools.connected_components(spark.createDataFrame(e, "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7} | {100 + k: 100 for k in range(40)}
    assert tools.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_lm(spark, corpus):
    got = by_id(suffix_tree_lm.score_texts(frame(spark, corpus)))
    tok = {i: tokens(t) + [None] for i, t in corpus}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tok}
    c = Counter(w for i, x in tok.items() if not held[i] for w in x)
    n, v = sum(c.values()), len(c)
    for i, x in tok.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"], r["n_known"]) == (held[i], len(x), n, sum(c[w] > 0 for w in x))
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), abs_tol=1e-8)
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())
    assert suffix_tree_lm.score_texts(frame(spark, []).limit(0)).count() == 0


def brute_tree(train, s):
    """P(x | longest retained context) by the definition: every context of every length is tested."""
    c = Counter(w for x in train for w in x)
    total, kinds = sum(c.values()), len(c)
    succession = {}
    for x in train:
        for k in range(1, len(x)):
            for length in range(1, min(s.depth, k) + 1):
                succession.setdefault(tuple(x[k - length : k]), Counter())[x[k]] += 1
    kept = {}

    def p(context, x):
        for k in range(len(context)):
            if context[k:] in kept:
                n, whole, rest = kept[context[k:]]
                return (n.get(x, 0) + (rest + s.mu) * p(context[k + 1 :], x)) / (whole + s.mu)
        return (c[x] + s.alpha) / (total + s.alpha * (kinds + 1))

    for length in range(1, s.depth + 1):
        found = {}
        for context, n in succession.items():
            if len(context) == length:
                whole, stored = sum(n.values()), {x: k for x, k in n.items() if k >= s.least}
                rest, escape, gained = whole - sum(stored.values()), 0.0, 0.0
                escape = math.log((rest + s.mu) / (whole + s.mu))
                for x, k in stored.items():
                    parent = float(np.float32(math.log(p(context[1:], x))))
                    gained += k * (math.log((k + (rest + s.mu) * math.exp(parent)) / (whole + s.mu)) - parent)
                gained += rest * escape
                if gained > 0.5 * len(stored) * math.log(max(total, 2)) and gained > s.kl_min * whole:
                    found[context] = (stored, whole, rest)
        kept |= found
    return p, kept


@pytest.mark.parametrize(("depth", "fan"), [(4, 64), (2, 2)])
def test_lm_is_the_whole_tree(spark, corpus, monkeypatch, depth, fan):
    monkeypatch.setattr(suffix_tree_lm, "FAN_IN", fan)
    monkeypatch.setattr(suffix_tree_lm, "BLOCK_BYTES", 4000)  # many blocks, and texts longer than one
    s = suffix_tree_lm.Settings(depth=depth)
    rows = [*corpus, *[(i + 500, t) for i, t in corpus if i % 3 == 0]]
    got = by_id(suffix_tree_lm.score_texts(frame(spark, rows), settings=s))
    tok = {i: [*tokens(t), None] for i, t in rows}
    p, kept = brute_tree([x for i, x in tok.items() if zlib.crc32(str(i).encode()) % 10], s)
    assert {len(x) for x in kept} >= {1, 2}
    for i, x in tok.items():
        assert math.isclose(got[i]["score"], sum(math.log10(p(tuple(x[max(0, k - depth) : k]), x[k])) for k in range(len(x))), abs_tol=1e-6)


def test_blocks_of_the_tree_gather_over_batches():
    batches = [pa.record_batch([pa.array([3 * k, 3 * k + 1, 3 * k + 2], pa.int64()), pa.array(["a b", None, "c " * k], pa.string()).fill_null(""), pa.array([False, True, False]), pa.array([3 * k, 3 * k + 1, 3 * k + 2], pa.int64())], ["doc_id", "text", "held_out", "rid"]) for k in range(50)]
    got = list(suffix_tree_lm._pack_blocks(iter(batches)))
    assert [b.column("block").to_pylist() for b in got] == [[0]]
    block = suffix_tree_lm.Block(got[0].column("payload")[0].as_py(), 0, 0, suffix_tree_lm.Settings())
    assert block.ids.tolist() == list(range(150)) and block.n_tokens.tolist() == [n for k in range(50) for n in (3, 1, k + 1)]


@pytest.mark.parametrize("bits", [0, 1, 20, 54, 64])
def test_sorted_keys(bits):
    r = np.random.default_rng(bits)
    some = r.integers(0, 1 << bits, 300, dtype=np.uint64) if 0 < bits < 64 else r.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) if bits else np.zeros(300, np.uint64)
    for keys in (some[r.integers(0, 300, 1000)], some[:1], some[:0], np.uint64(1 << 63) + r.integers(0, 9, 1000, dtype=np.uint64)):  # the last differ in low bits only
        order, s = suffix_tree_lm._sorted(keys)
        assert sorted(order.tolist()) == list(range(len(keys))) and s.tolist() == sorted(keys.tolist()) == keys[order].tolist()
        distinct, rank = suffix_tree_lm._ranked(keys)
        assert distinct.tolist() == sorted(set(keys.tolist())) and (distinct[rank] == keys).all()


def test_a_block_packs_its_messages_with_one_compressor(monkeypatch):
    batch = pa.record_batch([pa.array([1, 2], pa.int64()), pa.array([" ".join(f"w{k}" for k in range(500)), "w1 w2"]), pa.array([False, True]), pa.array([0, 1], pa.int64())], ["doc_id", "text", "held_out", "rid"])
    (got,) = suffix_tree_lm._pack_blocks(iter([batch]))
    block = suffix_tree_lm.Block(got.column("payload")[0].as_py(), 0, 0, suffix_tree_lm.Settings())
    made, real = [], suffix_tree_lm.zstandard.ZstdCompressor
    monkeypatch.setattr(suffix_tree_lm.zstandard, "ZstdCompressor", lambda **k: made.append(1) or real(**k))
    rows = block.rows(0, 50, 1)
    assert len(rows) == 50 and len(made) == 1
    words = [suffix_tree_lm._expanded(r["payload"], np.uint64, np.uint32, np.uint32, np.uint64, np.uint32, np.uint32) for r in rows]
    assert sum(len(x[0]) for x in words) == 501 and sum(int(x[2].sum()) for x in words) == 501


def test_suffix_tree_sums_to_one():
    s = suffix_tree_lm.Settings(kl_min=0.0)
    r = random.Random(9)
    train = [[r.choice("aab") + r.choice("xxy") for _ in range(40)] + [None] for _ in range(30)]
    p, kept = brute_tree(train, s)
    words_of = {w for x in train for w in x}
    c = sum(len(x) for x in train)
    for context in kept:
        unseen = 0.1 / (c + 0.1 * (len(words_of) + 1))
        for k in range(len(context)):
            if context[k:] in kept:
                _, whole, rest = kept[context[k:]]
                unseen *= (rest + s.mu) / (whole + s.mu)
        assert math.isclose(sum(p(context, w) for w in words_of) + unseen, 1.0, rel_tol=1e-9)


def test_lm_repeated_ids_nulls_and_no_training_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a"), (2, None)]
    got = suffix_tree_lm.score_texts(frame(spark, rows)).collect()
    assert len(got) == 4 and len({(r["base_score"], r["score"]) for r in got if r["doc_id"] == 1}) == 1
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = suffix_tree_lm.score_texts(frame(spark, [(held, "x y")])).first()
    assert (r["held_out"], r["n_known"], r["train_tokens"], r["score"]) == (True, 0, 0, r["base_score"])


def test_packing():
    r = random.Random(1)
    n = [r.randrange(0, 50) for _ in range(400)] + [250]
    source = [r.choice(["hot", "hot", "b", None]) for _ in n]
    cluster = [r.choice([None, *range(60)]) for _ in n]
    out = packing.pack(n, source, cluster, 100)
    assert [sum(k for _, k, _ in p) for p in out] == n
    load, held = Counter(), {}
    for i, p in enumerate(out):
        for _, k, b in p:
            load[b] += k
            if k < 100:
                for x in (("s", source[i]), ("c", cluster[i])):
                    assert x[1] is None or x not in held.setdefault(b, set())
                    held.setdefault(b, set()).add(x)
    assert max(load.values()) <= 100


def test_packing_is_best_fit():
    bins = packing.Bins(10, 4)
    assert [bins.put(6, [0]), bins.put(5, [1]), bins.put(4, [0])] == [0, 1, 1]  # bin 0 is tighter but holds the source


def test_packing_rows(spark, corpus):
    df = frame(spark, corpus).withColumnRenamed("key", "source")
    got = packing.pack_texts(df, capacity=40).groupBy("doc_id").sum("n_words").collect()
    assert {r[0]: r[1] for r in got} == {i: len(tokens(t)) for i, t in corpus}


def brute_groups(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = tokens(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    comp = {i: i for i, _ in rows}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((comp[a], comp[b]))
                comp = {i: p if c == q else c for i, c in comp.items()}
    return {i: (len(sets[i]), comp[i]) for i in comp}


@pytest.mark.parametrize("percent", [50, 60, 70, 80, 90])
def test_links_share_a_region(percent):
    division, r = jaccard_join.Division(percent), np.random.default_rng(percent)
    for n in range(1, 60):
        g = r.integers(0, 1 << 63, n * 100 // percent, dtype=np.uint64)
        place, region, _ = division.signatures(np.concatenate([g[:n], g]), np.array([0, n, n + len(g)]), 0)
        assert set(region[place == 0].tolist()) & set(region[place == 1].tolist())


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard(spark, corpus, n, percent):
    got = by_id(jaccard_join.jaccard_groups(frame(spark, corpus), n, percent))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_groups(corpus, n, percent)


def test_links_share_as_many_regions_as_least_says():
    r = np.random.default_rng(11)
    division = jaccard_join.Division(80)
    for _ in range(4000):
        n = int(r.integers(4, 17))
        more = int(r.integers(0, n // 4 + 1))
        g = r.integers(0, 1 << 63, n + more, dtype=np.uint64)
        assert 100 * n >= 80 * (n + more)
        place, region, least = division.signatures(np.concatenate([g[:n], g]), np.array([0, n, 2 * n + more]), 0)
        small, large = ({(x >> 20, k): x & ((1 << 20) - 1) for k, x in zip(region[place == i].tolist(), least[place == i].tolist(), strict=True)} for i in (0, 1))
        both = Counter(shell for shell, _ in small.keys() & large.keys())
        assert any(n >= max(min(m for (s, _), m in x.items() if s == shell) for x in (small, large)) for shell, n in both.items())


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_groups(frame(spark, []).limit(0)).count() == 0


def test_toxicity(spark):
    r = random.Random(2)
    voc = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(voc) for _ in range(r.randrange(3, 40))]
        bad = r.random() < 0.2
        if bad:
            w[r.randrange(len(w))] = r.choice(["Idiot", "zork" + r.choice(voc)])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, "")]
    chain = toxicity.learn(frame(spark, rows), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int"))
    got = by_id(toxicity.score_texts(frame(spark, rows), chain))
    test = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["predicted"] == t for i, t in test]) > 0.97
    assert got[900]["predicted"] == got[901]["predicted"] == 0
    hit = next(i for i, t in labels if t and "Idiot" in rows[i][1])
    a, b = got[hit]["spans"][0]["start"], got[hit]["spans"][0]["end"]
    assert rows[hit][1][a:b] == "Idiot"
    kept = toxicity.drop_toxic(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == ["doc_id", "text", "id", "key"] and 900 in by_id(kept)


def test_marginals_equal_enumeration(monkeypatch):
    monkeypatch.setattr(toxicity, "LINE", 4)  # texts of several lines
    r = np.random.default_rng(3)
    score, doc, tr = r.normal(size=22), np.repeat([0, 1, 2], [9, 3, 10]), np.array([[0.2, -0.3], [0.1, 0.6]])
    got = toxicity.marginals(np.exp(score), doc, np.exp(tr))[0]
    for d in range(3):
        e = score[doc == d]
        n, w, z = len(e), np.zeros(len(e)), 0.0
        for m in range(1 << n):
            y = [(m >> k) & 1 for k in range(n)]
            s = sum(a * b for a, b in zip(e, y, strict=True)) + sum(tr[a, b] for a, b in zip([0, *y], y, strict=False))
            z += math.exp(s)
            w += math.exp(s) * np.array(y)
        assert np.allclose(got[doc == d], w / z)


def test_tokens_and_offsets():
    texts = ["Été ÉTÉ x-y", None, "", "漢字 ok!", "a" * 9]
    t = toxicity.Tokens.of(pa.array(texts))
    assert [t.low[a : a + n].tobytes().decode() for a, n in zip(t.start, t.length, strict=True)] == ["été", "été", "x", "y", "漢字", "ok", "a" * 9]
    assert t.doc.tolist() == [0, 0, 0, 0, 3, 3, 4]
    m = np.array([0, 0.9, 0.2, 0.6, 0.1, 0.8, 0.7])
    assert [[(x["start"], x["end"]) for x in s] for s in toxicity.spans_of(m, t)] == [[(4, 7), (10, 11)], [], [], [(3, 5)], [(0, 9)]]


def test_toxicity_of_few_or_no_labels(spark):
    rows = [(1, "Foo"), (2, None), (2, None), (3, "x " * 40000)]
    chain = toxicity.learn(frame(spark, rows), spark.createDataFrame([(7, 1)], "doc_id long, toxic int"))
    got = toxicity.score_texts(frame(spark, rows), chain).collect()
    assert len(got) == 4 and all(r["score"] < 0.01 and not r["spans"] for r in got)
    assert toxicity.score_texts(frame(spark, rows).limit(0), chain).count() == 0


def test_licenses(spark):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "Licensed under the Apache Licence, Version 2.0."), (3, "the license of my car"), (4, None), (5, "")]
    got = {(r["doc_id"], r["license"], r["differences"]) for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert got == {(1, "MIT", 0), (2, "Apache-2.0", 1)}
    s = licenses.Scanner(licenses.TEMPLATES, 0.25)
    assert all(s.classify(t)[0] == n for n, t in licenses.TEMPLATES.items() if re.search(licenses.CANDIDATE, t))


def test_licenses_over_lines_and_several_in_one(spark):
    grant = licenses.TEXTS["MIT"].split(" ")
    rows = [
        (1, "Licensed under the Apache License,\nVersion 2.0."),
        (2, "Released under the MIT License. Some words between. Licensed under CC BY-SA 4.0. And then: Released under the MIT License."),
        (3, "word " * 900 + "\n".join(" ".join(grant[k : k + 9]) for k in range(0, len(grant), 9)) + " word" * 900),
        (4, "word " * 500 + "This work is licensed under the GNU Lesser General Public License, version 3."),
    ]
    got = sorted((r["doc_id"], r["start"], r["license"], r["differences"]) for r in licenses.scan_licenses(frame(spark, rows)).collect())
    assert [(i, n, d) for i, _, n, d in got] == [(1, "Apache-2.0", 0), (2, "MIT", 0), (2, "CC-BY-SA-4.0", 0), (2, "MIT", 0), (3, "MIT", 0), (4, "LGPL-3.0", 0)]
    own = licenses.scan_licenses(frame(spark, [(1, "one frobs the widget freely\nhere"), (2, "none")]), templates={"Own": "One frobs the widget freely here."}).collect()
    assert [(r["doc_id"], r["license"], r["start"], r["end"]) for r in own] == [(1, "Own", 0, 32)]


def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json")


def test_bpe(spark, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocabulary()
    t, v, r = tokenizers.Tokenizer.from_file(path), bpe.Vocabulary.load(path), random.Random(3)
    al = [*"ab é\n\t'sñ漢🙂0", "<|endoftext|>", "  ", "the ", "aaaa"]
    texts = ["".join(r.choice(al) for _ in range(r.randrange(60))) for _ in range(300)] + ["a" * 3000, "é漢" * 300, " " * 500]
    for x in texts:
        assert v.encode(x) == t.encode(x, add_special_tokens=False).ids
        assert v.decode(v.encode(x)) == x
    rows = list(enumerate(texts)) + [(9999, None)]
    got = by_id(bpe.token_digests(frame(spark, rows), path))
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i]["ids_sha256"] == sha(",".join(map(str, ids))) and got[i]["decoded_sha256"] == sha(t.decode(ids, skip_special_tokens=False))
    back = bpe.decode(bpe.encode(frame(spark, rows), path), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: x or "" for i, x in rows}


def test_bpe_tables(spark, monkeypatch):
    """Rows and the heap merge alike; a full table forgets pieces, not results; special strings; an empty table; clashing columns."""
    v, r = bpe.Vocabulary.load(vocabulary()), random.Random(4)
    pieces = ["".join(r.choice("abcdeinthé ") for _ in range(r.randrange(1, 129 if k % 2 else 9))).encode()[: bpe.SHORT] for k in range(400)]
    assert v.merge_many(pieces) == [v.merge_long(p) for p in pieces] and v.merge_many([]) == []
    texts = [" ".join("".join(r.choice("abcd") for _ in range(r.randrange(1, 6))) for _ in range(30)) + "x" * (200 if k % 9 == 0 else 0) + "<|endoftext|>" * (k % 2) for k in range(60)]
    whole = [v.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "CACHE", 40)
    small = bpe.Vocabulary.load(vocabulary())
    assert [small.encode(t) for t in texts] == whole and len(small.ids_of) <= 40 + 30 + 1
    assert small.decode(whole[1]) == texts[1]
    assert bpe.token_digests(frame(spark, []), vocabulary()).count() == 0
    clash = spark.createDataFrame([(1, "a b", "x", 3), (1, "a b", "x", 3), (2, None, None, 4)], "doc_id long, text string, ids_sha256 string, n_tokens long")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in bpe.token_digests(clash, vocabulary()).collect()) == [(1, 2), (1, 2), (2, 0)]


def brute_repeats(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        g = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                g[k : k + 50] = True
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out[i] = (len(b), int(g.sum()), spans, sha(np.frombuffer(b, np.uint8)[~g].tobytes()))
    return out


def test_repeats(spark, corpus):
    got = by_id(run_index.remove_repeats(frame(spark, corpus)))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == brute_repeats(corpus)
    cut = run_index.without_repeats(frame(spark, corpus))
    assert cut.columns == ["doc_id", "text", "id", "key"] and cut.count() == len(corpus)
    assert run_index.remove_repeats(frame(spark, []).limit(0)).count() == 0


def test_blocks_of_repeats_gather_over_batches():
    sizes = [[300, 400, 5000, 1], [200, 200], [], [900, 100, 100, 100, 100], *([[10] * 7] * 300)]
    texts, batches = [], []
    for row in sizes:
        mine = [f"{len(texts) + k:04d} ".ljust(n, "x")[:n] for k, n in enumerate(row)]
        batches.append(pa.record_batch([pa.array(range(len(texts), len(texts) + len(row)), pa.int64()), pa.array(mine, pa.string()), pa.array(range(len(texts), len(texts) + len(row)), pa.int64())], ["doc_id", "text", "rid"]))
        texts += mine
    for most, rows in ((1000, 100), (100, 3), (1, 1), (1 << 20, 1 << 20)):
        got = list(tools.gathered(iter(batches), most, rows))
        assert [t.as_py() for b in got for t in b.column("text")] == texts
        assert all(b.num_rows <= rows and (b.num_rows == 1 or sum(len(t.as_py()) for t in b.column("text")) <= most) for b in got)
        assert all(a.num_rows == rows or sum(len(t.as_py()) for t in a.column("text")) + len(b.column("text")[0].as_py()) > most for a, b in zip(got, got[1:], strict=False))
    got = list(run_index._pack_blocks(iter(batches)))  # the number of batches doesn't set that of blocks, as each block writes to each range
    assert [b.column("block").to_pylist() for b in got] == [[0]]
    assert len(run_index.Block(got[0].column("payload")[0].as_py()).ids) == len(texts)


def test_exact(spark, corpus):
    got = by_id(exact_dedup.exact_groups(frame(spark, corpus)))
    norm = {i: re.sub("[\x20\x09-\x0d]+", " ", t or "") for i, t in corpus}
    for i, x in norm.items():
        same = [j for j, y in norm.items() if y == x]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (min(same), len(same), i == min(same), sha(x))
    assert exact_dedup.exact_groups(frame(spark, [(None, "a"), (None, "a"), (3, "a")])).where("kept").count() == 1
    assert exact_dedup.exact_groups(frame(spark, []).limit(0)).count() == 0


FIVE = [(1, "a"), (5, "a"), (5, "unique text here"), (9, "z"), (9, "z")]


def test_dropping_goes_by_row(spark):
    df = spark.createDataFrame([(i, t, 1, None) for i, t in [*FIVE, (None, "a"), (None, "n n"), (None, "n n")]], "doc_id long, text string, row_0_id int, __gone string")
    got = exact_dedup.drop_copies(df)
    assert got.columns == df.columns
    assert sorted((r[0] or 0, r[1]) for r in got.collect()) == [(0, "n n"), (1, "a"), (5, "unique text here"), (9, "z")]
    got = jaccard_join.drop_near_copies(df.where("doc_id is not null"))
    assert got.columns == df.columns and sorted((r[0], r[1]) for r in got.collect()) == [(1, "a"), (5, "unique text here"), (9, "z")]
    texts = spark.createDataFrame([("x", "a b"), ("3", "a b")], "doc_id string, text string")  # identifiers that are no integers count as null
    assert [r[0] for r in exact_dedup.drop_copies(texts).collect()] == ["3"]
    assert exact_dedup.drop_copies(df.limit(0)).count() == jaccard_join.drop_near_copies(df.limit(0)).count() == 0


def test_cover_tree(spark):
    g = np.random.default_rng(4)
    base = g.normal(size=(40, 12))
    v = np.concatenate([base, base[:20] + 0.1 * g.normal(size=(20, 12)), base[:10], base[:10] + 0.15 * g.normal(size=(10, 12))])
    rows = [(i, [float(x) for x in y], int(i % 2)) for i, y in enumerate(v)] + [(200, None, 1), (201, [0.0] * 12, 1), (202, [1.0, None], 1), (203, [float("nan")] * 12, 0), (204, [1.0] * 12, None), (205, [1.0], 1)]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    link = (u @ u.T >= 0.93) & (np.arange(len(v))[:, None] % 2 == np.arange(len(v))[None] % 2)
    np.fill_diagonal(link, False)
    comp = list(range(len(v)))
    for a, b in zip(*np.nonzero(link), strict=True):
        p, q = sorted((comp[a], comp[b]))
        comp = [p if c == q else c for c in comp]
    got = {r["vec_id"]: r for r in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), chunk=16).collect()}
    for i in range(len(v)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), comp[i], comp[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(200, 206))


def test_chat(spark):
    r = random.Random(6)
    al = ["<s>", "</s>", "[INST]", " [/INST]", "\\", "a", " ", "[AS] ", " [/ROLE]", "<s>[ROLE] ", " </s>", "\n", "[OUT] "]
    rows = []
    for c in range(60):
        for k in range(r.randrange(1, 6)):
            rows.append((c, k, r.choice(["user", "assistant", "system", "", None]), r.choice([None, "".join(r.choice(al) for _ in range(r.randrange(8)))])))
    formatted = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for x in formatted.where("role in ('user', 'assistant')").collect():
        assert not re.search(r"</?s>|\[/?(INST|OUT|ROLE|AS)\]", chat.parse(x["formatted"]) and x["formatted"][len(chat._OPEN[x["role"]]) : -len(chat._CLOSE[x["role"]])])
    for x in formatted.where("role = 'assistant'").collect():
        assert chat.unescape(x["formatted"][x["loss_start"] : x["loss_end"]]) == x["text"]
    got = {x["conv_id"]: x for x in chat.conversation_digests(formatted).collect()}
    for c in range(60):
        mine = [(a or "", t or "") for i, _, a, t in rows if i == c]
        loss = "".join(t for a, t in mine if a == "assistant")
        assert got[c]["turns_sha256"] == sha("".join(f"{a}\n{t}\n" for a, t in mine))
        assert (got[c]["n_turns"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(mine), len(loss), sha(loss))
