"""Operators 6, 7, 8 and 9."""

import os
import hashlib
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmill.llm import forest, licenses, media, urls


def test_png_round_trip():
    for n in (1, 7):
        payload = bytes(range(192)) * n
        assert media.from_png(media.to_png(payload)).tobytes() == payload
    broken = bytearray(media.to_png(b" " * 192))
    broken[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(broken))


def test_sequences_keep_order_and_captions():
    html = '<p>one</p><figure><img src="media:aa" alt="A"><img src="x.png"><figcaption>both <b>of</b> them</figcaption></figure>two<script>no</script><video src="media:bb"></video>'
    items = media.read_html(html)
    assert [(i["position"], i["kind"], i["digest"], i["caption"]) for i in items] == [(0, "text", None, None), (1, "media", "aa", "both of them"), (2, "media", None, "both of them"), (3, "text", None, None), (4, "media", "bb", None)]
    assert media.read_html(None) == [] and media.read_html("<figure><img src='media:z'>")[0]["digest"] == "z"


def test_operator_six(spark, tmp_path):
    texts = [None, "", "x" * 192, "y" * 193, "é" * 100, "a & b < c </p> &amp;", "x" * 192]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "no id")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in media.op6_media(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) + 1
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.to_png(payload)).hexdigest() and r["media_bytes"] == len(media.to_png(payload))
    assert rows[2]["feature"] == rows[6]["feature"]


def test_unknown_digests_stay(spark):
    pages = spark.createDataFrame([(1, '<img src="media:zz">text'), (2, None)], "page_id long, html string")
    store = spark.createDataFrame([("other", b"x")], "digest string, media binary")
    got = media.resolved(media.sequences(pages, ["page_id"]), store, ["page_id"]).collect()
    assert [(r["page_id"], r["position"], r["media"]) for r in got] == [(1, 0, None)]


def brute(vectors, queries, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    out = {}
    for q in queries:
        s = (x * vectors[q]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [ids[i] for i in order]
    return out


def test_forest_recall_and_order(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 16)) * 2
    v = {i: (centres[i % 20] + rng.standard_normal(16) * 0.7) * (1 + i % 3) for i in range(6000)}
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "vec_id long, embedding array<double>").repartition(5)
    rows = forest.neighbours(frame, F.col("vec_id") % 100 == 0, k=10, group_rows=700, group_queries=20).collect()
    want = brute(v, range(0, 6000, 100), 10)
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    assert all([n for n, _, _ in g] == list(range(1, 11)) for g in got.values())
    assert all(abs(s - float(np.dot(v[q], v[i]))) < 1e-9 for q, g in got.items() for _, i, s in g)
    recall = np.mean([len({i for _, i, _ in got[q]} & set(want[q])) / 10 for q in want])
    assert recall >= 0.9


def forest_recall(spark, v, queries, **how):
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "vec_id long, embedding array<double>").repartition(4)
    want, got = brute(v, queries, 20), {}
    for r in forest.neighbours(frame, F.col("vec_id").isin(*queries), **how).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    return {q: len(got[q] & set(want[q])) / 20 for q in queries}


def test_forest_of_queries_with_mixed_depths(spark):
    rng = np.random.default_rng(3)
    v = dict(enumerate(rng.standard_normal((2000, 16))))
    recall = forest_recall(spark, v, list(range(0, 2000, 40)), group_rows=300, group_queries=7)
    assert np.mean(list(recall.values())) >= 0.9


def test_forest_with_an_outlying_query(spark):
    rng = np.random.default_rng(4)
    mean = rng.standard_normal(16) * 2
    v = dict(enumerate(mean + rng.standard_normal((3000, 16))))
    v[0] = -mean
    recall = forest_recall(spark, v, list(range(0, 3000, 100)))
    assert recall[0] >= 0.8 and np.mean(list(recall.values())) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_forest_as_registered(spark, sf):
    if not os.path.isdir(f"/root/testdata/{sf}"):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").where("embedding is not null").collect()
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    want, got = brute(v, [i for i in sorted(v) if i % 20 == 0], 20), {}
    for r in forest.op7_forest(spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    recall = [len(set(got[q]) & set(want[q])) / 20 for q in want]
    assert set(got) == set(want) and np.mean(recall) >= 0.9 and all(len(x) == 20 for x in got.values())


def test_forest_looks_at_few_rows_of_clustered_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((100, 32)) * 2
    v = {i: centres[i % 100] + rng.standard_normal(32) * 0.3 for i in range(20_000)}
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "vec_id long, embedding array<float>").repartition(5)
    rows = forest.neighbours(frame, F.col("vec_id") % 500 == 0).collect()
    v = {i: x.astype(np.float32).astype(float) for i, x in v.items()}
    want, got = brute(v, range(0, 20_000, 500), 20), {}
    for r in rows:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.9
    assert np.mean([r["n_scored"] for r in rows]) < 0.5 * len(v)  # in 40 trees together; a full scan of each were 800,000


def test_forest_of_repeated_ids(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (2, [0.5, 0.5]), (2, [0.4, 0.4]), (3, [0.1, 0.2])], "vec_id long, embedding array<double>")
    rows = forest.neighbours(frame, F.col("vec_id") == 0, k=5).collect()
    assert sorted(r["vec_id"] for r in rows) == [1, 2, 3] and sorted(r["rank"] for r in rows) == [1, 2, 3]


def test_forest_of_odd_vectors(spark):
    same = [1.0, 2.0]
    rows = [(0, same), (5, same), (3, same), (20, [0.5, 0.0]), (40, None), (41, []), (60, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [float("inf"), 1.0]), (None, same), (11, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in forest.neighbours(frame, F.col("vec_id") % 20 == 0, k=3).collect())
    assert got == [(0, 1, 3), (0, 2, 5), (0, 3, 20), (20, 1, 0), (20, 2, 3), (20, 3, 5)]
    assert forest.neighbours(frame.limit(0), F.lit(True)).count() == 0
    assert forest.neighbours(frame, F.lit(False)).count() == 0


CASES = [
    ("Prose here.\nLicensed under the Apache License, Version 2.0.\nMore prose.", ["Apache-2.0"]),
    ("x\nReleased under the MIT License.", ["MIT"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("this work is licenced under the gnu general public license version 2", ["GPL-2.0"]),
    ("Licensed under CC BY-NC 4.0.\nprose\nprose\nReleased under the MIT License.", ["CC-BY-NC-4.0", "MIT"]),
    ("A driving license is needed. The warranty of my car ended.", []),
    ("", []),
    (None, []),
    ("word " * 5000 + "Released under the MIT License. " + "word " * 5000, ["MIT"]),
    ("# " + licenses.TEMPLATES[3][1].replace("Software", "Program", 1), ["MIT"]),
]


def test_licenses(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(None, CASES[1][0])], "doc_id long, text string")
    rows = {r["doc_id"]: r["found"] for r in licenses.find_licenses(docs).collect()}
    for i, (t, want) in enumerate(CASES):
        assert sorted({f["license"] for f in rows[i]}) == want, t and t[:80]
    exact = rows[0][0]
    assert exact["words_differ"] == 0 and CASES[0][0][exact["start"] : exact["end"]].startswith("Licensed under the Apache")
    assert rows[None][0]["license"] == "MIT"
    assert licenses.find_licenses(docs.limit(0)).count() == 0


def test_licenses_wrapped_and_repeated(spark):
    notice = {k: max((w for n, w in licenses.TEMPLATES if n == k), key=len) for k in ("MIT", "GPL-3.0", "Apache-2.0", "ISC", "BSD-3-Clause")}
    prose = "".join(f"Some line of prose, number {i}, about nothing in particular.\n" for i in range(40))
    texts = [(prose + textwrap.fill(w, width, break_on_hyphens=False, break_long_words=False) + "\n" + prose, [k], w) for k, w in notice.items() for width in (30, 80)]
    texts.append((prose + textwrap.fill(notice["MIT"], 72, initial_indent="# ", subsequent_indent="# ") + "\n", ["MIT"], None))
    texts += [(gap.join([notice[k]] * 3), [k] * 3, None) for k in ("MIT", "GPL-3.0") for gap in ("\n", "\n\n" + prose, " ")]
    texts += [("\n".join(["Released under the MIT License."] * 7), ["MIT"] * 7, None)]
    mangled = " ".join(notice["MIT"].split()[:60])
    sound = " ".join("other" if i % 20 == 9 else w for i, w in enumerate(notice["MIT"].split()))
    texts.append((mangled + "\n" + sound, ["MIT"], None))
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r["found"] for r in licenses.find_licenses(docs).collect()}
    for i, (t, want, w) in enumerate(texts):
        assert [f["license"] for f in rows[i]] == want, (i, t[:60])
        if w:
            assert t[rows[i][0]["start"] : rows[i][0]["end"]].split() == w.rstrip(".").split()


URLS = [None, "", "no scheme.com/", "http://Example.COM/en/x?y", "https://www.example.com/en/", "http://a.b.net/es/1", "http://net/fr/", "http://notnet/fr/", "http://x.com", "http://x.com/", "http://x.com?q=/en/", "ftp://example.com/en/#f", "http://example.com/en", "http://.com/", "http:///en/", "http://a.net\n/es/", "http://X.NET/ES/", "http://Ä.com/x"]


def expected(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h), len(p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)] + [(3, URLS[3], "again"), (None, URLS[4], "")], "page_id long, url string, host string")
    for most in (131_072, 1):
        rows = urls.judge(pages.drop("host"), urls.rule_table(spark, urls.RULES), max_words=most).collect()
        assert len(rows) == len(URLS) + 2
        for r in rows:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == expected(r["url"]), r["url"]
    assert urls.judge(pages, urls.rule_table(spark, urls.RULES)).count() == len(URLS) + 2
    assert urls.judge(pages.limit(0), urls.rule_table(spark, urls.RULES)).count() == 0


@pytest.mark.parametrize("small", [urls.BROADCAST_BYTES, 0])
def test_urls_of_any_length_hot_urls_and_names(spark, small):
    long = ["http://" + "a." * 40_000 + "net/es/" + "x" * 50_000, "http://" + "b" * 100_000 + ".example.com/en/" + "/y" * 50_000, "http://" + "z" * 100_000]
    listed = long + ["http://no.rule.org/here"] * 300 + ["http://net.hot/a"] * 200 + ["http://net/es/"] * 200 + URLS
    names = ["best", "row", "bloom", "possible", "c", "labels", "lengths", "counts", "__row", "r_host", "Verdict"]
    frame = spark.createDataFrame([(i, u, *[f"{n}-{i}" for n in names]) for i, u in enumerate(listed)], "page_id long, url string, " + ", ".join(f"`{n}` string" for n in names)).repartition(3)
    for most in (131_072, 1):
        rows = urls.judge(frame, urls.rule_table(spark, urls.RULES), max_words=most, broadcast_bytes=small).collect()
        assert len(rows) == len(listed)
        for r in rows:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == expected(listed[r["page_id"]])
            assert all(r[n] == f"{n}-{r['page_id']}" for n in names[:-1])
    none = urls.judge(frame, urls.rule_table(spark, urls.RULES).limit(0), broadcast_bytes=small).select("rule", "verdict").distinct().collect()
    assert [tuple(r) for r in none] == [(None, "allow")]


def test_urls_without_a_hit_are_not_shuffled(spark):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    plan = urls.judge(frame, urls.rule_table(spark, urls.RULES))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "Aggregate" not in plan.split("Scalar")[0].split("Subquery")[0]


def test_many_rules_pass_through_the_filter(spark):
    many = [("block" if i % 2 else "allow", f"h{i}.org", f"/{i % 9}/") for i in range(300)]
    pages = spark.createDataFrame([(i, f"http://s.h{i}.org/{i % 9}/x") for i in range(400)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, urls.rule_table(spark, many)).collect()}
    assert all(got[i] == ((f"h{i}.org/{i % 9}/", many[i][0]) if i < 300 else (None, "allow")) for i in range(400))


def brute_notices(text, templates, share=0.2):
    """Every template that some run of the text's words matches, no more than that share of the template's words differing."""
    from difflib import SequenceMatcher

    found, listed = set(), [w for w, _, _ in licenses.words(text)]
    for name, wording in templates:
        want = [w for w, _, _ in licenses.words(wording)]
        for size in range(max(1, int(0.8 * len(want))), int(1.2 * len(want)) + 2):
            for at in range(len(listed) - size + 1):
                if len(set(listed[at : at + size]) & set(want)) < 0.6 * len(set(want)):
                    continue
                same = sum(m.size for m in SequenceMatcher(None, want, listed[at : at + size], autojunk=False).get_matching_blocks())
                if len(want) + size - 2 * same <= share * len(want):
                    found.add(name)
    return found


def test_licenses_against_every_window():
    short = [t for t in licenses.TEMPLATES if len(t[1]) < 300]
    scan = licenses.scanner(tuple(short), 0.3, 0.2)
    prose = "the quick brown fox jumps over the lazy dog and no licence is known to it ".split()
    rng = np.random.default_rng(8)
    for name, wording in short:
        listed = wording.split()
        other = list(listed)
        other[int(rng.integers(len(other)))] = "changed"
        for words_ in (listed, other, listed[: len(listed) // 2]):
            text = " ".join([*rng.choice(prose, 12), *words_, *rng.choice(prose, 9)])
            want = brute_notices(text, short)
            got = {f[2] for f in scan(text)}
            # what is left of a changed notice of few words may save too little to be looked at
            small = len(listed) < 12 and words_ is not listed
            assert got <= want and ((len(want) == 0) == (len(got) == 0) or small), (name, want, got)


def test_very_long_texts(spark):
    notice = licenses.TEMPLATES[3][1]
    long_ = "plain words of a long text " * 40_000 + notice + " and more of it" * 20_000
    docs = spark.createDataFrame([(1, long_, 7), (None, long_, 8)], "doc_id long, text string, found int")
    rows = licenses.find_licenses(docs).collect()
    assert len(rows) == 2 and all([f["license"] for f in r["found"]] == ["MIT"] for r in rows)
    png = media.to_png(b"x" * 192 * 20_000)
    assert media.from_png(png).shape == (20_000, 192)
