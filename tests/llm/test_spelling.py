"""Operator 13 against comparing every two words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vecmill.llm import spelling

SCHEMA = "doc_id long, text string"


def differ_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, letters, least, times, one_in):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}
    near = {w: [x for x in n if differ_by_one(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-n[x], x))
            if n[best] >= times * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def got(docs, *args):
    return sorted(tuple(r) for r in spelling.variants(docs, *args).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("letters,times,one_in,alphabet", [(3, 2, 3, "abÉé"), (2, 5, None, "ab"), (4, 3, 2, "abcz÷ÿ")])
def test_words_near_each_other(spark, letters, times, one_in, alphabet):
    rng = random.Random(letters)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 7))) for _ in range(120)]
    weights = [4.0**-i for i in range(6)]
    rows = [(rng.randrange(40), " ".join(rng.choice([x, x.upper() if x.isascii() else x]) for x in rng.choices(words[:6] + words, weights + [0.02] * 120, k=rng.randrange(1, 60)))) for _ in range(120)]
    rows += [(None, None), (None, "aab, aab-aab"), (1, ""), (1, "Straße ÀÈ'ÀÈ1x ÿÿÿÿ ÿÿÿÿ")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", n int, word int").repartition(3)
    want = brute(rows, letters, 2, times, one_in)
    assert got(docs, letters, 2, times, one_in) == want
    assert any(w[1] for w in want) and any(w[1] and w[1] != w[2] for w in want) or one_in is None or times > 2


def test_chains_and_ties(spark):
    words = {"abcdef": 1000, "abcdeg": 200, "abcdhg": 40, "abcihg": 8, "xxxxxx": 5, "xxxxxy": 25, "xxxxxz": 25, "qqqqqq": 5, "qqqqq": 99, "qqqqqqq": 24}
    docs = spark.createDataFrame([(i, f"{w} " * n) for i, (w, n) in enumerate(words.items())], SCHEMA)
    by = {r[0]: r[1:] for r in got(docs, 6, 5, 5, None)}
    assert by["abcihg"] == ("abcdhg", "abcdef", 8, 1, 40)
    assert by["xxxxxx"] == ("xxxxxy", "xxxxxy", 5, 2, 25)
    assert by["qqqqqq"] == (None, "qqqqqq", 5, 1, None) and "qqqqq" not in by


def test_very_long_words_and_empty_tables(spark):
    long = "abcdefgh" * 6000
    rows = [(1, f"{long} " * 30), (2, f"{long[:777]}{long[778:]} " * 5), (3, f"x{long} " * 5)]
    found = got(spark.createDataFrame(rows, SCHEMA), 6, 5, 5, None)
    assert {r[0]: (r[1] == long, r[4]) for r in found} == {long: (False, 2), rows[1][1].split()[0]: (True, 1), "x" + long: (True, 1)}
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([], SCHEMA), times=1)


def test_meeting_keys_are_sums_of_powers(spark):
    rows = spelling.meetings(spark.createDataFrame([(1, "abba", 5), (2, "ÿz", 6)], "id long, word string, n long")).collect()
    power = lambda w: sum(ord(c) ** 5 for c in w)
    assert sorted((r["id"], r["place"], r["meet"], r["fresh"]) for r in rows) == [
        (1, -1, power("abba"), True), (1, 0, power("bba"), True), (1, 1, power("aba"), True), (1, 2, power("aba"), False), (1, 3, power("abb"), True),
        (2, -1, power("ÿz"), True), (2, 0, power("z"), True), (2, 1, power("ÿ"), True)]


def test_remainders_tell_order():
    listed = [b"abc", b"bac", b"cab", b"xabc", b"abxc"]
    letters = np.frombuffer(b"".join(listed), np.uint8)
    size = np.array([len(w) for w in listed])
    last = np.cumsum(size)
    place = np.arange(len(letters)) - np.repeat(last - size, size)
    own, rest = spelling._remainders(letters, place, last - size, last, 0)
    assert len(set(own.tolist())) == 5
    assert rest[last[2]] == own[0] == rest[last[3] + 2]  # xabc without x, abxc without x
    assert pa.array(rest.view(np.int64)).null_count == 0
