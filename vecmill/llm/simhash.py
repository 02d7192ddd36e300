"""SimHash near-duplicate detection (operator 5).

Method. Deletion-variant signatures: a 64-bit fingerprint is cut into two segments, so that of up to three differing
bits at most one lies in one of them.  Each segment is indexed as it is and with each of its bits wildcarded; an
equal index key makes two fingerprints meet, and they are linked if they differ in three bits or fewer in all.
Links meet under one key only: under the plain segment if it is equal, else under the wildcard of the bit that differs.

Scale. Documents with equal fingerprints are one vertex from the start, so groups of copies cost one row.  The
index holds 66 rows per distinct fingerprint and is shuffled once.  In a bucket no pairs are written: a search
that only compares what is not yet reached yields a star per component.  A bucket in which more fingerprints
could meet than `bucket_limit` is indexed again by the other segment (two halves, one wildcard each), which
leaves 18 free bits, so no group exceeds 2^18 fingerprints.  Nothing is dropped or capped.

Similarity. Three bits of 64 find copies with very few changes; a pair of texts whose word shingles have a Jaccard
similarity of 0.8 differs in about ten bits, which no index of one-wildcard segments reaches.  With `similarity` the
operator therefore also links texts by signatures of 256 minima: texts meet where one of 14 bands of five minima is
equal (99.6 % of pairs at 0.8, more above).  The share of equal minima only spares comparisons: where it is less than
0.1 under the asked similarity or higher (all but one in 10,000 pairs at 0.8), the similarity of the two sets of
shingles, as distinct 32-bit hashes, decides.  In a band's bucket, again, no pairs are written.  A bucket of more than `bucket_rows` texts, or
of more than `bucket_bytes` bytes in their sets, is dealt into parts; each part first meets about 16 texts of the bucket, and what is outside the largest component that comes of it then meets the
whole bucket, part by part.  So a large group of copies takes time in proportion to its size, and no link is lost.

Edge cases. Null and empty texts have no words and fingerprint zero, linked like any other.  Repeated rows stay
repeated rows.  A null doc_id is no candidate for component_id unless the whole component has none.  Texts may be of any
length.  Other columns are carried by `without_copies`, in a struct, whatever their names, and not looked at elsewhere.
Texts are told apart by 128-bit hashes.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.components import connected
from vecmill.llm.tasks import HOT_KEYS, group_starts, met, whole_groups
from vecmill.llm.windows import Rolling
from vecmill.session import prepare, scratch, table, written

SEED = 42
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingles(text: str, width: int) -> list[bytes]:
    """Word shingles of a text with A-Z lower-cased, repeats included; the whole sequence if it is shorter."""
    words = text.encode("utf-8").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[s:e] for s, e in zip(starts[: 1 - width or None].tolist(), ends[width - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, width: int = 3) -> int:
    from xxhash import xxh64_intdigest

    parts = shingles(text or "", width)
    if not parts:
        return 0
    hashed = np.fromiter((xxh64_intdigest(x, SEED) for x in parts), np.uint64, len(parts)).astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.concatenate([np.bincount(hashed[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * bits > len(parts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = [fingerprint(texts[i].as_py(), width) for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits differ. Unsigned: the bit count of a negative number is that of its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def stars(fps: np.ndarray, sides: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(member, least member of its component) within one bucket; links are within `most` bits and between sides.

    sides: 0 or 1, or 2 where any two may be linked.
    """
    out = []
    rest = np.argsort(fps)
    fps, sides = fps[rest], sides[rest]
    open_ = np.arange(len(fps))
    while len(open_) > 1:
        root, frontier, open_ = open_[0], [open_[0]], open_[1:]
        while frontier and len(open_):
            x = frontier.pop()
            near = differing(fps[open_], fps[x : x + 1]) <= most
            if sides[x] != 2:
                near &= sides[open_] != sides[x]
            if near.any():
                hit = open_[near]
                out += [(fps[y], fps[root]) for y in hit]
                frontier += hit.tolist()
                open_ = open_[~near]
    return out


def _variants(name: str, shift: int, size: int, tag0: int) -> str:
    """SQL for an array of (tag, key, side): the segment plain and with each bit wildcarded."""
    part = f"(shiftrightunsigned({name}, {shift}) & {(1 << size) - 1}L)"
    return (
        f"concat(array(named_struct('tag', {tag0}, 'key', {part}, 'side', 2)), "
        f"transform(sequence(0, {size - 1}), i -> named_struct('tag', {tag0 + 1} + i, 'key', {part} & ~shiftleft(1L, i), "
        f"'side', cast(shiftrightunsigned({part}, i) & 1L as int))))"
    )


def star_edges(distinct_fps: DataFrame, most: int = 3, bucket_limit: int = 100_000) -> DataFrame:
    """Edges (a, b) whose components are those of all links within `most` (at most 3) bits."""
    if most > 3:
        raise ValueError("two segments with one wildcard find at most three differing bits")
    spread = int(distinct_fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct_fps = distinct_fps.repartition(spread)  # each row becomes 66
    index = distinct_fps.select("fp", F.expr(f"explode(concat({_variants('fp', 0, 32, 0)}, {_variants('fp', 32, 32, 33)}))").alias("v")).select("fp", "v.tag", "v.key", "v.side")
    halves = distinct_fps.select("fp", F.expr("explode(array(named_struct('seg', 0, 'half', fp & 4294967295L), named_struct('seg', 1, 'half', shiftrightunsigned(fp, 32))))").alias("h"))
    large = halves.groupBy("h.seg", "h.half").count().where(F.col("count") > bucket_limit).select("seg", "half")
    if large.isEmpty():
        index = index.select("fp", "tag", "key", "side", F.lit(0).alias("sub"), F.lit(0).cast("long").alias("subkey"))
    else:
        spread = F.expr(f"explode(if(seg = 0, {_variants('half', 0, 32, 0)}, {_variants('half', 0, 32, 33)}))")
        hot = large.select(spread.alias("v")).select("v.tag", "v.key").distinct().withColumn("hot", F.lit(True))
        marked = index.join(hot, ["tag", "key"], "left")
        other = "if(tag < 33, shiftrightunsigned(fp, 32), fp & 4294967295L)"
        again = marked.where("hot").withColumn("o", F.expr(other)).select("fp", "tag", "key", "side", F.expr(f"explode(concat({_variants('o', 0, 16, 1)}, {_variants('o', 16, 16, 18)}))").alias("w"))
        index = marked.where("hot is null").select("fp", "tag", "key", "side", F.lit(0).alias("sub"), F.lit(0).cast("long").alias("subkey")).unionByName(again.select("fp", "tag", "key", "side", F.col("w.tag").alias("sub"), F.col("w.key").alias("subkey")))
    keys = ["tag", "key", "sub", "subkey"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def emit(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            ids, fp, side = cols[:4], cols[4], cols[5]
            new = np.ones(len(fp), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in ids])
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(fp)))
            two = begin[size == 2]
            ok = (differing(fp[two], fp[two + 1]) <= most) & ((side[two] == 2) | (side[two] != side[two + 1]))
            a, b = [fp[two[ok]]], [fp[two[ok] + 1]]
            more: list[tuple[int, int]] = []
            for at, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                s = side[at : at + n]
                if s[0] == 2 or (s[0] != s).any():
                    more += stars(fp[at : at + n], s, most)
            if more:
                a.append(np.array([x for x, _ in more], np.int64))
                b.append(np.array([y for _, y in more], np.int64))
            found = pa.array(np.concatenate(a)), pa.array(np.concatenate(b))
            return pa.RecordBatch.from_arrays(list(found), names=["a", "b"]) if len(found[0]) else None

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(6)]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            changed = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:4]]))
            if not len(changed):
                held = cols
                continue
            cut = changed[-1] + 1
            held = [c[cut:] for c in cols]
            if (out := emit([c[:cut] for c in cols])) is not None:
                yield out
        if held is not None and (out := emit(held)) is not None:
            yield out

    dealt = index.select(*keys, "fp", "side").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(link, "a long, b long").distinct()


MINIMA, BANDS, BAND_ROWS, PIVOTS = 256, 14, 5, 16
FEW_KEYS = 500_000
_FACTORS = (np.random.default_rng(11).integers(0, 1 << 31, MINIMA, np.uint32) << np.uint32(1)) | np.uint32(1)
_SHIFTS = np.random.default_rng(12).integers(0, 1 << 32, MINIMA, np.uint32)


def hashed_shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct 32-bit hashes of the word shingles of a text, ascending."""
    listed = (text or "").encode("utf-8").lower().split()
    if not listed:
        return np.empty(0, np.uint32)
    joined = np.frombuffer(b" ".join(listed), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in listed]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(listed) - width + 1)
    return np.unique((Rolling(joined, 0).ranges(starts[:n], ends[-n:]) >> np.uint64(32)).astype(np.uint32))


def minima(hashed: np.ndarray) -> np.ndarray:
    """Least of 256 hashes over hashed shingles."""
    least = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashed), 1024):
        x = (hashed[at : at + 1024, None] ^ _SHIFTS) * _FACTORS
        np.minimum(least, x.min(0), out=least)
    return least


class Sets:
    """Sets of numbers, one after another in `flat`; `similar` compares one with many exactly."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        known, self.flat = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(len(known), bool)

    def of(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] - self.sizes[i] : self.ends[i]]

    def similar(self, x: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the others have at least that Jaccard similarity to x."""
        self.mark[self.of(x)] = True
        out = np.zeros(len(others), bool)
        for at in range(0, len(others), 1024):
            part = others[at : at + 1024]
            sizes = self.sizes[part]
            common = np.add.reduceat(self.mark[np.concatenate([self.of(y) for y in part])], np.cumsum(sizes) - sizes, dtype=np.int64)
            out[at : at + 1024] = common >= similarity * (sizes + self.sizes[x] - common) - 1e-9
        self.mark[self.of(x)] = False
        return out


def _signed_bands(least: np.ndarray) -> list[int]:
    """One 64-bit key for each band; the band's number is part of it."""
    from xxhash import xxh64_intdigest

    rows = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    keys = [xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)]
    return [k - (1 << 64) if k >> 63 else k for k in keys]


def similar_texts(texts: DataFrame, width: int, similarity: float, bucket_rows: int = 20_000, bucket_bytes: int = 16 << 20, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """texts: (k, text), k a hash of the text. Edges (a, b) between hashes of texts at least that similar.

    keep writes intermediate tables, which the edges depend on."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, x, minima(x)) for i in range(batch.num_rows) if len(x := hashed_shingles(batch.column(1)[i].as_py(), width))]
            if found:
                take, bands = pa.array([i for i, _, _ in found]), [_signed_bands(x) for _, _, x in found]
                sigs, sets = [x.astype("<u2").tobytes() for _, _, x in found], [x.astype("<u4").tobytes() for _, x, _ in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), pa.array(sets, pa.binary())], names=["k", "bands", "sig", "set"])

    prepare(texts.sparkSession)
    kind = texts.schema["k"].dataType.simpleString()
    signed = keep(texts.select("k", "text").mapInArrow(sign, f"k {kind}, bands array<long>, sig binary, set binary"), "signatures")
    keys = signed.select("k", F.octet_length("set").cast("long").alias("w"), F.explode("bands").alias("h")).distinct()
    shared = keep(keys.groupBy("h").agg(F.count("*").alias("n"), F.sum("w").alias("b")).where("n > 1"), "bands")
    together = keep(met(keys, shared, ["h"], signed.count() * BANDS, "n"), "together")
    ids = keep(together.select("k").distinct(), "similar")
    ids = F.broadcast(ids) if ids.count() <= FEW_KEYS else ids  # sets are as large as texts: others are left out before the shuffle
    one = signed.join(ids, "k", "left_semi").dropDuplicates(["k"]).select("k", "sig", "set")
    least_equal = int(np.ceil((similarity - 0.1) * MINIMA))

    def similar(x: int, others: np.ndarray, block: np.ndarray, sets: Sets) -> np.ndarray:
        near = (block[others] == block[x]).sum(1) >= least_equal
        near[near] = sets.similar(x, others[near], similarity)
        return near

    def grouped(batches: Iterator[pa.RecordBatch], links: Callable) -> Iterator[pa.RecordBatch]:
        """links(k, first, block, sets) of every group of rows (h, cut, k, first, sig, set): pairs of places."""
        for part in whole_groups(batches, 2):
            h, cut, k, first = (part[c].to_numpy() for c in ("h", "cut", "k", "first"))
            begin = group_starts([h, cut])
            sig, set_ = part["sig"].combine_chunks(), part["set"].combine_chunks()
            out: list[np.ndarray] = []
            for at, n in zip(begin.tolist(), np.diff(np.append(begin, len(h))).tolist(), strict=True):
                block = np.stack([np.frombuffer(sig[i].as_buffer(), "<u2") for i in range(at, at + n)])
                listed = [np.frombuffer(set_[i].as_buffer(), "<u4") for i in range(at, at + n)]
                sets = Sets(np.concatenate(listed), np.array([len(x) for x in listed]))
                out += [k[at + pairs] for pairs in links(k[at : at + n], first[at : at + n], block, sets)]
            if out:
                a, b = np.concatenate(out).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def stars_of(k: np.ndarray, first: np.ndarray, block: np.ndarray, sets: Sets) -> Iterator[np.ndarray]:
        """Each text with the least of its component."""
        open_ = np.argsort(k)
        while len(open_):
            root, frontier, open_ = open_[0], [open_[0]], open_[1:]
            while frontier and len(open_):
                near = similar(frontier.pop(), open_, block, sets)
                yield np.stack([open_[near], np.full(near.sum(), root)], 1)
                frontier += open_[near].tolist()
                open_ = open_[~near]

    def to_first(k: np.ndarray, first: np.ndarray, block: np.ndarray, sets: Sets) -> Iterator[np.ndarray]:
        """Each text with all of the first ones that it is similar to."""
        rest = np.flatnonzero(~first)
        for x in np.flatnonzero(first):
            hit = rest[similar(x, rest, block, sets)]
            yield np.stack([hit, np.full(len(hit), x)], 1)

    def linked(rows: DataFrame, links: Callable) -> DataFrame:
        """rows: (h, cut, k, first). Pairs (a, b) of similar texts within each (h, cut)."""
        held = rows.join(one, "k").select("h", "cut", "k", "first", "sig", "set").repartition("h", "cut").sortWithinPartitions("h", "cut")
        return held.mapInArrow(lambda batches: grouped(batches, links), f"a {kind}, b {kind}").where("a <> b").distinct()

    each, no, yes = F.lit(0).cast("long"), F.lit(False), F.lit(True)
    buckets = lambda rows, size: F.greatest(rows / bucket_rows, size / bucket_bytes)
    together = together.withColumn("buckets", buckets(F.col("n"), F.col("b")))
    edges = keep(linked(together.where("buckets <= 1").select("h", each.alias("cut"), "k", no.alias("first")), stars_of), "edges")
    large = together.where("buckets > 1").withColumn("parts", F.ceil(2 * F.col("buckets")))
    if large.isEmpty():
        return edges
    spread = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), m - 1))
    part = lambda m: F.pmod(F.xxhash64("k", "h"), m)
    pivots = large.where(F.pmod(F.xxhash64("k", "h", F.lit(1)), F.col("n")) < PIVOTS)
    beside = large.select("h", part(F.col("parts")).alias("cut"), "k", no.alias("first")).unionByName(pivots.select("h", spread(F.col("parts")).alias("cut"), "k", yes.alias("first")))
    edges = keep(edges.unionByName(linked(beside, to_first)), "edges")
    # texts of one component need not meet again; any other link has an end outside the bucket's largest component
    rooted = keep(large.join(connected(edges).withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k")), "rooted")
    sizes = rooted.groupBy("h", "root").agg(F.count("*").alias("c"))
    largest = keep(sizes.groupBy("h").agg(F.max(F.struct("c", "root"))["root"].alias("most"), F.sum("c").alias("n")), "largest")
    outside = keep(met(rooted.drop("n"), largest, ["h"], rooted.count(), "n").where("root <> most").select("h", "k", "w", "parts"), "outside")
    chunks = keep(outside.groupBy("h").agg(F.ceil(2 * buckets(F.count("*"), F.sum("w"))).alias("chunks"), F.count("*").alias("n")), "chunks")
    across = met(outside, chunks, ["h"], outside.count(), "n").select("h", "k", "parts", part(F.col("chunks")).alias("i"), spread(F.col("parts")).alias("j"))
    known = chunks.drop("n")
    along = large.join(F.broadcast(known) if known.count() <= FEW_KEYS else known, "h").select("h", "k", "parts", spread(F.col("chunks")).alias("i"), part(F.col("parts")).alias("j"))
    cut = (F.col("i") * F.col("parts") + F.col("j")).alias("cut")
    blocks = across.select("h", cut, "k", no.alias("first")).unionByName(along.select("h", cut, "k", no.alias("first"))).distinct()
    return edges.unionByName(linked(blocks, stars_of))


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3, bucket_limit: int = 100_000, similarity: float | None = None) -> DataFrame:
    """The operator: (doc_id, fp, component_id) for each row; component_id is the least doc_id reachable over links.

    With similarity, links of that Jaccard similarity of word shingles count too, and fp is left out.
    """
    if similarity is not None:
        groups = text_groups(docs, width, most, bucket_limit, similarity)
        return docs.select("doc_id", text_key().alias("k")).join(groups.select("k", F.col("least").alias("component_id")), "k").select("doc_id", "component_id")
    fps = written(fingerprints(docs, width), "fingerprints")
    vertices = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    roots = connected(star_edges(vertices.select("fp"), most, bucket_limit))
    rooted = vertices.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(_of_root(rooted, F.min("least").alias("component_id")).select("fp", "component_id", "c"), "named")
    return met(fps, named, ["fp"], fps.count()).select("doc_id", "fp", "component_id")


def text_key() -> Column:
    """A 128-bit hash of the text."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _of_root(members: DataFrame, *facts: Column) -> DataFrame:
    """members (root, ...) with facts of all rows of their root."""
    members = written(members, "members")
    of_root = written(members.groupBy("root").agg(*facts, F.count("*").alias("__c")), "roots")
    return met(members, of_root, ["root"], members.count(), "__c").drop("__c")


def text_groups(docs: DataFrame, width: int, most: int, bucket_limit: int, similarity: float) -> DataFrame:
    """A row per text, by its key k: n rows, root of its group; of the group: rows, least doc_id, and the row that stands
    for it (least doc_id, then least key): rep_k, rep_id, rep_n rows with both."""
    texts = docs.select(text_key().alias("k"), "doc_id").groupBy("k", "doc_id").agg(F.count("*").alias("m"))
    texts = texts.groupBy("k").agg(F.sum("m").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "m")).alias("first"))
    by_bits = near_duplicates(docs.select(text_key().alias("doc_id"), "text"), width, most, bucket_limit).where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).distinct()
    with scratch(docs.sparkSession) as keep:
        edges = by_bits.unionByName(similar_texts(docs.select(text_key().alias("k"), "text"), width, similarity, keep=keep))
        roots = connected(edges)
    rooted = texts.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    best = F.min(F.struct("first.none", "first.doc_id", "k", "first.m")).alias("best")
    found = _of_root(rooted, F.sum("n").alias("rows"), best)
    return found.select("k", "n", "root", "rows", F.col("best.doc_id").alias("least"), F.col("best.k").alias("rep_k"), F.col("best.doc_id").alias("rep_id"), F.col("best.m").alias("rep_n"))


def without_copies(docs: DataFrame, width: int = 5, most: int = 3, bucket_limit: int = 100_000, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, of each group of near-duplicate texts one only: that of the least doc_id, then of the least hash
    of the text, then of all its columns.  Rows without doc_id come last.  Rows of one doc_id whose texts are not alike all stay."""
    groups = written(text_groups(docs, width, most, bucket_limit, similarity).where("rows > 1").select("k", "n", "rep_k", "rep_id", "rep_n"), "copies")
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "doc_id", text_key().alias("k"))
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if groups.count() <= FEW_KEYS:
        judged = rows.join(F.broadcast(groups), "k", "left")
    else:
        hot = F.broadcast(groups.where(F.col("n") > total / HOT_KEYS))
        cold = rows.join(hot.select("k"), "k", "left_anti").join(groups.where(F.col("n") <= total / HOT_KEYS), "k", "left")
        judged = cold.unionByName(rows.join(hot, "k"))
    kept = judged.where(F.col("rep_k").isNull() | ((F.col("k") == F.col("rep_k")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))))
    once = kept.where("rep_n is null or rep_n = 1").select("row")
    if not groups.where("rep_n > 1").isEmpty():
        hashed = [F.col("row")[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        once = once.unionByName(kept.where("rep_n > 1").groupBy("k").agg(F.min_by("row", F.xxhash64(*hashed)).alias("row")).select("row"))
    return once.select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
