"""Operators 3 and 5 and the components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vecmill.llm import components, simhash, suffixes, windows
from vecmill.session import written


def brute_cut(texts, size):
    seen = {}
    for b in texts:
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] = seen.get(b[i : i + size], 0) + 1
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def cases():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, line = text(30), text(6)
    base = text(60)
    near = [base.replace(" ", "  ", 1), base[:150] + "X" + base[150:], base[10:], base + text(5), base[:-3] + "é"]
    return [None, "", "short", base, base, *near, shared + text(20), text(20) + shared, text(9) + shared + text(9) + shared, (line + "\n") * 9, "a" * 300, "a" * 90 + "b", "ab" * 100, text(200), "x" + shared[5:-5], line * 3]


@pytest.mark.parametrize(("few_keys", "group_rows"), [(500_000, 4096), (0, 4096), (500_000, 1)])
def test_repeats_against_brute_force(spark, few_keys, group_rows):
    texts = cases()
    want = brute_cut([(t or "").encode() for t in texts], 40)
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    for gram in (13, 40):
        rows = suffixes.cut(docs, 40, gram, few_keys, group_rows=group_rows).collect()
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows}
        assert len(rows) == len(texts)
        for i, w in enumerate(want):
            assert got[i] == w, (i, texts[i])


def brute_words(texts, n):
    """Bytes that no passage of n words which occurs anywhere else covers."""
    listed = [[(m.group(), m.start(), m.end()) for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", b)] for b in texts]
    seen = Counter(tuple(w for w, _, _ in x[i : i + n]) for x in listed for i in range(len(x) - n + 1))
    out = []
    for b, x in zip(texts, listed, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(x) - n + 1):
            if seen[tuple(w for w, _, _ in x[i : i + n])] > 1:
                gone[x[i][1] : x[i + n - 1][2]] = True
        out.append(bytes(np.frombuffer(b, np.uint8)[~gone]))
    return out


@pytest.mark.parametrize(("words", "group_rows"), [(7, 4096), (25, 4096), (25, 2)])
def test_repeated_words_against_brute_force(spark, words, group_rows):
    rng = random.Random(3)
    pool = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 5))) for _ in range(200)]
    parts = [" ".join(rng.choices(pool, k=30)) for _ in range(5)]
    texts = [t or "" for t in cases()]
    texts += ["\n".join(rng.choice([rng.choice(parts), " ".join(rng.choices(pool, k=rng.randrange(1, 20)))]) for _ in range(8)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.cut(docs, 4000, 3000, words=words, group_rows=group_rows).collect()}
    assert [got[i] for i in range(len(texts))] == brute_words([t.encode() for t in texts], words)


def test_repeats_in_empty_and_odd_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.cut(docs).count() == 0
    twice = spark.createDataFrame([(None, "z" * 20), (1, "q" * 50), (1, "q" * 50)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffixes.cut(twice, 40, 20).collect())
    assert got == [(0, 0), (1, 50), (1, 50)]


def test_rolling_hashes_and_anchors():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 3, 500).astype(np.uint8)
    roll = windows.Rolling(data, 0)
    grams = roll.every(5)
    by = {}
    for i, h in enumerate(grams.tolist()):
        by.setdefault(data[i : i + 5].tobytes(), set()).add(h)
    assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by)
    x = rng.integers(0, 1 << 60, 100).astype(np.uint64)
    assert windows.sliding_least(x, 7).tolist() == [x[i : i + 7].min() for i in range(94)]
    a, lo, hi = windows.anchors(grams, 20)
    assert lo[0] == 0 and hi[-1] == len(grams) - 20 and (lo[1:] == hi[:-1] + 1).all()
    assert all(lo_ <= a_ and a_ < hi_ + 20 for a_, lo_, hi_ in zip(a, lo, hi, strict=True))


def test_anchors_at_borders_of_segments(monkeypatch):
    x = np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(np.uint64)
    want = windows.anchors(x, 20)
    for segment in (47, 101):
        monkeypatch.setattr(windows, "SEGMENT", segment)
        assert all(np.array_equal(a, b) for a, b in zip(windows.anchors(x, 20), want, strict=True))


def brute_components(fps, most):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= most:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("limit", [100_000, 2])
def test_links_against_brute_force(spark, limit):
    rng = random.Random(5)
    fps = set()
    for _ in range(30):
        f = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 9)):
            g = f
            for _ in range(rng.randrange(0, 5)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    half = rng.getrandbits(32)
    fps |= {half << 32 | rng.getrandbits(32) for _ in range(40)} | {0, 1, 2**63}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    want = brute_components(fps, 3)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in components.connected(simhash.star_edges(frame, 3, limit)).collect()}
    assert {f: roots.get(f, f) for f in fps} == want


def test_fingerprint_of_contract(spark):
    text = "The Cat\tsat\x0bon the the CAT  sat Ä"
    words = ["the", "cat", "sat", "on", "the", "the", "cat", "sat", "Ä"]
    parts = [" ".join(words[i : i + 3]) for i in range(7)]
    hashed = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > 7)
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert simhash.fingerprint("one two") & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_operator_five(spark):
    rows = [(5, None), (3, ""), (9, "a b c d"), (7, "A b C d"), (7, "a b c d"), (None, "a b c d"), (1, "something else entirely here")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 7), (1, 1), (3, 3), (5, 3), (7, 7), (7, 7), (9, 7)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_rows,bucket_bytes", [(20_000, 16 << 20), (3, 16 << 20), (20_000, 1800)])
def test_similar_texts(spark, monkeypatch, bucket_rows, bucket_bytes):
    monkeypatch.setattr(simhash.similar_texts, "__defaults__", (bucket_rows, bucket_bytes, written))
    rng = random.Random(9)
    text = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows, group = [], {}
    for g in range(6):
        base = text(200)
        for c in range(5):
            w = list(base)
            for _ in range(c):
                w[rng.randrange(200)] = "changed"  # at most 4 of 200 words: similarity over 0.8
            group[len(rows)] = g * 5
            rows.append((len(rows), " ".join(w)))
    for _ in range(10):
        group[len(rows)] = len(rows)
        rows.append((len(rows), " ".join(text(200))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, width=5, similarity=0.8).collect()}
    assert got == group
    assert simhash.near_duplicates(docs.limit(0), width=5, similarity=0.8).count() == 0


@pytest.mark.parametrize("bucket_rows", [20_000, 6])
def test_similar_texts_whose_centres_are_not_alike(spark, bucket_rows):
    rng = random.Random(11)
    rows = []
    for g in range(24):  # 15 copies of a text and 15 of another, which only two texts link: 0.867 to the next, 0.75 to the one after
        text = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(242)]
        for at in [0] * 15 + [42] * 15 + [14, 28]:
            w = text[at : at + 200]
            if at % 42 == 0:
                w[rng.choice([0, 199])] = f"changed{len(rows)}"
            rows.append((len(rows), " ".join(w)))
    edges = simhash.similar_texts(spark.createDataFrame(rows, "k long, text string"), 5, 0.8, bucket_rows)
    roots = {r["node"]: r["root"] for r in components.connected(edges).collect()}
    assert roots == {i: i // 32 * 32 for i in range(24 * 32)}


def test_similarity_is_decided_by_the_shingles(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for g in range(60):  # 196 shingles, one way: 21 apart on each side is 175 / 217 = 0.806; 23 apart 173 / 219 = 0.790
        text = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(223)]
        apart = (21, 23)[g % 2]
        rows += [(2 * g, " ".join(text[:200])), (2 * g + 1, " ".join(text[apart : apart + 200]))]
        if apart == 21:
            want[2 * g + 1] = 2 * g
    edges = {r["a"]: r["b"] for r in simhash.similar_texts(spark.createDataFrame(rows, "k long, text string"), 5, 0.8).collect()}
    assert all(want.get(a) == b for a, b in edges.items())  # none under 0.8
    assert len(edges) >= len(want) - 1  # one in 250 shares no band


def test_long_texts_of_one_bucket_are_dealt_by_their_bytes(spark):
    """40 texts of 3000 words, copies of four with a word changed: a bucket holds at most a few of them."""
    rng = random.Random(13)
    rows = []
    for g in range(4):
        words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
        for _ in range(10):
            w = list(words)
            w[rng.randrange(3000)] = f"changed{len(rows)}"
            rows.append((len(rows), " ".join(w)))
    edges = simhash.similar_texts(spark.createDataFrame(rows, "k long, text string"), 5, 0.8, bucket_bytes=40_000)
    roots = {r["node"]: r["root"] for r in components.connected(edges).collect()}
    assert roots == {i: i // 10 * 10 for i in range(40)}


def test_components_of_a_chain(spark):
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components.connected(chain).collect()} == {0}
    assert components.connected(chain.limit(0)).count() == 0


def test_few_edges_are_merged_by_one_task(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1300)]
    for kind in ("long", "string", "binary"):
        edges = spark.createDataFrame(pairs, "a long, b long").selectExpr(*[f"cast({'cast(%s as string)' % c if kind == 'binary' else c} as {kind}) {c}" for c in "ab"])
        few = {(r["node"], r["root"]) for r in components.connected(edges).collect()}
        assert few == {(r["node"], r["root"]) for r in components.connected(edges, few=0).collect()} and len(few) > 500
    plan = lambda **options: components.connected(edges, **options)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan() and "MapInArrow" not in plan(few=len(few) // 4)


def test_very_long_texts(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60_000)]
    long_, other = " ".join(words), " ".join(words[:100] + words[30_000:30_100])
    docs = spark.createDataFrame([(1, long_, 1), (2, other, 2), (3, long_[:-1] + "!", 3)], "doc_id long, text string, kept int")
    want = brute_cut([t.encode() for t in (long_, other, long_[:-1] + "!")], 400)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.cut(docs).collect()}
    assert [got[i] for i in (1, 2, 3)] == want
    assert simhash.fingerprint(long_) != 0 and len(simhash.hashed_shingles(long_, 5)) > 59_000
