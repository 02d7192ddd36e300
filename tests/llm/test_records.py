"""Operator 11: files of records, their index, damage, and the query against the tokenizers library."""

import random
import struct
import zlib

import numpy as np
import pytest

from vecmill.llm import records

tokens = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def plain_crc32c(data):
    x = 0xFFFFFFFF
    for b in data:
        x ^= b
        for _ in range(8):
            x = x >> 1 ^ (0x82F63B78 if x & 1 else 0)
    x ^= 0xFFFFFFFF
    return ((x >> 15 | x << 17) + 0xA282EAD8) & 0xFFFFFFFF


def test_checksums():
    masked = 0xE3069283  # of the digits 1 to 9, as published
    assert records.checksums([b"123456789"])[0] == ((masked >> 15 | masked << 17) + 0xA282EAD8) & 0xFFFFFFFF
    rng = random.Random(3)
    parts = [rng.randbytes(n) for n in [0, 1, 2, 3, 4, 5, 8, 63, 64, 65, 127, 128, 129, 1000, 5000, 64 * 33]]
    assert records.checksums(parts).tolist() == [plain_crc32c(p) for p in parts]


def wanted(rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_files_index_and_shuffled_reads(spark, tmp_path):
    texts = [(7, "the end"), (3, None), (5, ""), (1, "Hello <|endoftext|> wörld " * 40), (9, "long text, " * 30_000), (2, "x"), (2, "x"), (-4, "漢字 😀")]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in texts], "doc_id long, text string, file string, part int").repartition(3)
    path = f"file://{tmp_path}/out"
    index = records.write_records(docs, tokens.path("byte_bpe_50k.json"), path)
    want = wanted(sorted(texts, key=lambda r: r[0]))
    got = records.with_starts(records.read_records(index, path, keep_ids=True), index).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got] == want
    some = records.read_index(spark, path).where("doc_id in (9, 2, 1)").orderBy("size").repartition(2)
    again = records.read_records(some, path, keep_ids=True).collect()
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in again) == sorted((w[0], w[3]) for w in want if w[0] in (9, 2, 1))
    # the files alone: plain frames, in the order of their names
    seen = []
    for f in sorted((tmp_path / "out" / "records").glob("*.rec")):
        data, at = f.read_bytes(), 0
        while at < len(data):
            (n,) = struct.unpack_from("<Q", data, at)
            assert struct.unpack_from("<I", data, at + 8)[0] == plain_crc32c(data[at : at + 8])
            seen.append(np.frombuffer(data[at + 12 : at + 12 + n], "<u2").tolist())
            at += n + 16
    assert seen == [w[4] for w in want]


def test_damage_is_seen(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    index = records.write_records(spark.createDataFrame([(1, "one two three")], "doc_id long, text string"), tokens.path("byte_bpe_50k.json"), path)
    (file,) = (tmp_path / "out" / "records").glob("*.rec")
    data = bytearray(file.read_bytes())
    data[13] ^= 1
    file.write_bytes(bytes(data))
    for hidden in file.parent.glob(".*.crc"):
        hidden.unlink()
    with pytest.raises(Exception, match="damaged"):
        records.read_records(index, path).collect()


def test_leftovers_of_lost_tasks_and_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    (tmp_path / "out" / "records").mkdir(parents=True)
    (tmp_path / "out" / "records" / "0000000-lost.rec").write_bytes(b"half a rec")
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (None, None)], "doc_id long, text string")
    index = records.write_records(docs, tokens.path("byte_bpe_50k.json"), path)
    assert not (tmp_path / "out" / "records" / "0000000-lost.rec").exists()
    rows = records.with_starts(records.read_records(index, path), index).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 1] and rows[-1]["start"] == sum(r["n_tokens"] for r in rows[:2])
    none = records.write_records(docs.limit(0), tokens.path("byte_bpe_50k.json"), f"file://{tmp_path}/none")
    assert records.with_starts(records.read_records(none, f"file://{tmp_path}/none"), none).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = records.op11_records(spark, SF).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [w[:4] for w in wanted([tuple(r) for r in docs])]
