"""Scans of whole texts."""

from vecmill.functions import text as T
from vecmill.operators import scans


def test_windows_do_not_cross_texts(spark):
    piece = "abcdefghijkl\U0001f600nopqrstuvwx"
    assert len(piece) == 24
    texts = spark.createDataFrame([(0, "xx" + piece + "y"), (1, piece[:12] + "z" * 12), (2, piece[12:] + "z" * 12), (3, piece), (4, "z" * 13 + piece[:12]), (5, piece[12:] + "zz" * 9)], "doc_id int, s string").coalesce(1)
    bits = scans.leak_bits(spark.createDataFrame([(piece,)], "piece string"), "piece")
    got = {(r["doc_id"], r["piece"]) for r in scans.marked_windows(texts, "doc_id", bits).collect()}
    assert {(0, piece), (3, piece)} <= got
    assert all(w in dict(texts.collect())[i] for i, w in got)


def test_patterns_follow_the_sql(spark):
    import duckdb

    rows = [(0, None, "3 days"), (1, "a 55-inch TV and 5 Km", "x"), (2, "55 inches wide", None), (3, "10 km", "10 km"), (4, "5 cm\x0b", "5\x0bcm")]
    d = spark.createDataFrame(rows, "doc_id int, text string, counted string")
    p = {f: ("text", T.DETECTORS[f]) for f in ("measure", "size")} | {"count": ("counted", T.DETECTORS["measure"])}
    got = sorted(tuple(r) for r in scans.matched(d, "doc_id", p).collect())
    con = duckdb.connect()
    want = [(i, *con.execute("select regexp_matches(?::varchar, ?), regexp_matches(?::varchar, ?), regexp_matches(?::varchar, ?)", [t, T.DETECTORS["measure"], t, T.DETECTORS["size"], c, T.DETECTORS["measure"]]).fetchone()) for i, t, c in rows]
    assert got == want
    assert got[0][1] is None  # was false before, unlike the SQL
