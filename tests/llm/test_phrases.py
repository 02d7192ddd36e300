"""Operator 12 against counting every phrase in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from vecmill.llm import phrases

SCHEMA = "lang string, text string"


def brute(rows, top, most, least):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in found.items():
        if any(x == lang and len(v) > len(w) and b >= a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (x, v), b in found.items()):
            continue
        scores = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        s, k = min(scores)
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


def texts(seed, count, words):
    rng = random.Random(seed)
    make = lambda: "".join(rng.choice([rng.choice(words), rng.choice(words).upper()]) + rng.choice([" ", " ", " ", "\t ", ", ", "\n", "\x0b", "\x85"]) for _ in range(rng.randrange(60)))
    return [(rng.choice(["en", "de", None]), make()) for _ in range(count)]


ODD = [("en", None), ("en", ""), (None, "..,;"), ("de", "ß É é"), ("en", "a b c d e f g " * 40), ("en", "a b c d e f g " * 40), ("de", "x" * 5000 + " y " * 300), ("und", "to be")]


@pytest.mark.parametrize("least,buckets", [(3, 1 << 16), (3, 1 << 20), (300, 1 << 16)])
def test_counts_of_all_phrases(spark, least, buckets):
    rows = texts(4, 150, ["to", "be", "or", "not", "été", "Été", "a-b", "是"]) + ODD
    docs = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA + ", n int, phrase string, block int").repartition(3)
    got = [tuple(r) for r in phrases.collocations(docs, 25, 5, least, buckets).collect()]
    want = brute(rows, 25, 5, least)
    assert [(g[0], g[1], g[2], g[3], g[4], g[5], g[6], g[7]) for g in sorted(got)] == want
    assert want or least == 300


def test_slices_end_with_pieces(spark, monkeypatch):
    """In this process only: what tasks do with a slice of 50 bytes adds up to what they do with whole texts."""
    import pyarrow as pa

    rows = texts(5, 40, ["to", "be", "or", "not"]) + ODD
    batch = pa.record_batch({"lang": [x or "und" for x, _ in rows], "text": [t for _, t in rows]})

    def counted():
        out, pieces = Counter(), 0
        for data, ends, langs in phrases.slices(iter([batch])):
            words = phrases.Words(data, ends, langs)
            pieces += 1
            for k in (1, 2, 3):
                if len(at := np.flatnonzero(words.whole(k))):
                    for lang, phrase, n in zip(*words.counted(at, k), strict=True):
                        out[lang.as_py(), phrase.as_py()] += n
        return out, pieces

    whole, one = counted()
    monkeypatch.setattr(phrases, "SLICE_BYTES", 50)
    parts, many = counted()
    assert whole == parts and one == 1 and many > 20


def test_pruning_leaves_only_what_may_be_frequent(spark):
    rows = texts(6, 100, [f"w{i}" for i in range(40)])
    docs = spark.createDataFrame([(x or "und", t) for x, t in rows], SCHEMA)
    first = phrases.one_pass(docs, 1, 3, 12, 1 << 20, None)
    bits = phrases._frequent_buckets(first.where("block is not null").select("block", "counts"), 12, 1 << 20)
    singles = first.where("block is null").groupBy("lang", "phrase").sum("n").where("sum(n) >= 12").select("lang", "phrase")
    second = phrases.one_pass(docs, 2, 3, 12, 1 << 20, (bits, phrases._bitmap(singles, 1, 1 << 20)))
    counted = {(r[0], r[1]) for r in second.where("block is null").select("lang", "phrase").collect()}
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.lower()):
            words = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", f"{a} {b}") for a, b in zip(words, words[1:]))
    frequent = {p for p, n in f.items() if n >= 12}
    assert frequent <= counted and len(counted) < 0.2 * len(f) + len(frequent)


def test_empty_and_wrong(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None)], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        phrases.collocations(spark.createDataFrame([], SCHEMA), buckets=1000)
