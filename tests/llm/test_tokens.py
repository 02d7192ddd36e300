"""Operators 1 and 2 against the tokenizers library and brute force."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from vecmill.llm import bpe, packing

tokens = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

TEXTS = [
    None, "", " ", "Hello, World!", "don't I'LL x'S", "a" * 500, "ab" * 300, "!?" * 40, "Straße ÀÉÎ ñandú", "Σας ΑΣ", "İstanbul é", "x²½ ٣٤ Ⅷ", "漢字かな", "😀😀👩‍👩‍👧", "tab\tnl\nnbsp x\x1c\x85",
    "a<|endoftext|>b <|startoftext|> <|x|>", "</w> <w", "the the  the", "1234567", "​﻿", "aaaa bbbb aaaa", "line\r\nline",
]


@pytest.fixture(scope="module")
def word():
    path = tokens.path("word_bpe_49k.json")
    return path, bpe.encoder(path), Tokenizer.from_file(path)


def test_encoder_is_exact(word):
    _, enc, lib = word
    rng = random.Random(1)
    texts = [t for t in TEXTS if t] + ["".join(rng.choice("abcdeéñß '.!1") for _ in range(rng.randrange(60))) for _ in range(400)]
    for text in texts:
        ids = lib.encode(text, add_special_tokens=False).ids
        got = enc.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids, text
        assert enc.decode(got).decode() == lib.decode(ids, skip_special_tokens=False), text


def test_pairs_are_those_that_merging_leaves(word):
    _, enc, lib = word
    rng = random.Random(2)
    plain = [t for t, i in enc.by_text.items() if bpe.END not in t and i in enc.length and t.isascii() and t.isalpha()]
    for _ in range(400):
        a, b = rng.choice(plain), rng.choice(plain)
        whole = enc.by_text[a], enc.by_text[b]
        word_ids = lib.encode(a + b + "q", add_special_tokens=False).ids
        if enc.fits(*whole) is False:
            assert word_ids[:2] != list(whole)


def test_operator_one(spark, word):
    path, enc, _ = word
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "y"), (3, TEXTS[3], "again")], "doc_id long, text string, n_tokens string")
    rows = bpe.encode_decode(docs, path).collect()
    assert len(rows) == len(TEXTS) + 2
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["ids"] == b"" and by[0]["decoded"] == "" and by[1]["ids"] == b""
    assert all(bytes(r["ids"]) == enc.encode(t) for t, r in ((t, by[i]) for i, t in enumerate(TEXTS)))
    assert bpe.encode_decode(docs.limit(0), path).count() == 0


def test_fullest_is_fullest():
    rng = random.Random(3)
    for _ in range(200):
        stock = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        room = rng.randrange(0, 40)
        items = [k for k, v in stock.items() for _ in range(v)]
        best = max(sum(c) for n in range(len(items) + 1) for c in combinations(items, n) if sum(c) <= room)
        got = packing.fullest(stock, room)
        assert sum(got) == best and all(got.count(x) <= stock[x] for x in got)


def test_plan_uses_each_piece_once_and_few_bins():
    rng = random.Random(4)
    counts = {}
    for _ in range(20_000):
        n = min(1024, int(rng.lognormvariate(5, 1)) + 1)
        counts[n] = counts.get(n, 0) + 1
    plan = packing.plan_bins(counts, 1024)
    used = {}
    for lengths, times in plan:
        assert sum(lengths) <= 1024
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts
    assert sum(t for _, t in plan) <= -(-sum(k * v for k, v in counts.items()) // 1024) + 2
    assert packing.plan_bins({}, 1024) == []


def test_operator_two(spark):
    path = tokens.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    texts = [*TEXTS, "word " * 3000, "x"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(1, "repeat", 1), (1, "repeat", 1), (None, "no id", 1)], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack(docs, path, keep_ids=True).collect()
    used = {}
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] <= 4096
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for i, t in enumerate(texts):
        if i == 1:
            continue
        want = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        mine = sorted((r["piece"], r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == i)
        assert np.frombuffer(b"".join(x for _, _, x in mine), "<u4").tolist() == want
        assert [s for _, s, _ in mine] == [0, *np.cumsum([len(x) // 4 for _, _, x in mine])[:-1].tolist()]
        assert all(len(x) == 4096 for _, _, x in mine[1:])
    assert sum(r["doc_id"] == 1 for r in rows) == 3 and sum(r["doc_id"] is None for r in rows) == 1
    assert packing.pack(docs.limit(0), path).count() == 0
