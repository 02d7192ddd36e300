"""Removal of repeated byte strings (operator 3).

Method. Depth-limited radix sort of suffixes by most-significant-digit passes; groups of one leave after every pass,
and groups that are still together at the depth of the window are exactly the repeated windows.  A window's digits are
taken from its anchor on, not from its first byte: the anchor is the place of the gram with the least hash (rightmost
of equals) among those within the window, so equal windows have it at the same distance, and the windows of one anchor,
about a hundred, form a run that goes through the passes as one row with its bytes.  The passes are

1. the gram at the anchor (160 bytes, by its hash): counted over all data, before the shuffle in part;
2. all bytes that the windows of a run cover (by two independent 64-bit hashes): equal runs are repeated as a whole and
   go on as one row;
3. in the groups of pass 1, dealt to tasks whole, the remaining bytes: one byte a pass to the right of the anchor and
   one to the left, compared as bytes, up to the depth of the window.

A group of more than `group_rows` unequal runs is not dealt to one task.  Its runs are cut into blocks of 16 starts,
by the bytes that these windows share and those that they cover, then into single windows, counted by key.

Scale. About one row in a hundred bytes is shuffled, not one per byte; counts are combined before the shuffle, and keys
of very many rows, of which there can only be few, are joined by broadcast.  Texts are shuffled only for documents in
which something repeats, where the keys of these are few enough to be broadcast (`few_keys`), else joined by key.

Words. With `words` the operator also finds passages of that many words that occur anywhere else, however few bytes
they have, and removes them too unless `cut_words` is false.  Words are what lies between ASCII white space; the same
passes run over their 64-bit hashes, so the words have to be equal and the white space between them need not be.

Edge cases. Null counts as empty; texts shorter than the window keep all; copies of a text are all removed if long
enough, repeated rows are copies too.  Texts may have any length: their grams are looked at in segments.  Equal texts
get equal results, so doc_id may be null or repeated.  An empty table has no result.  Columns to keep must not be named
like those that are made here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.tasks import checked, met, whole_groups, with_columns
from vecmill.llm.windows import Rolling, anchors, mixed
from vecmill.session import prepare, scratch, table, written

OUT_ROWS = 20_000
SLICE = 1024
BLOCK = 16
BYTES, WORDS = 0, 1
WORD_GRAM = 20
PASSAGE_WORDS = 51
MADE = ["n_bytes", "n_removed", "n_spans", "n_passages", "passage_bytes", "kept"]
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def word_ranges(data: np.ndarray, borders: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, in bytes. borders: places where no word goes on."""
    space = _SPACE[data]
    before, after = np.concatenate([[True], space[:-1]])[: len(space)], np.concatenate([space[1:], [True]])[: len(space)]
    if borders is not None:
        inner = borders[(borders > 0) & (borders < len(data))]
        before[inner], after[inner - 1] = True, True
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Contexts:
    """The symbols, bytes or words, that runs of windows cover, one run after another."""

    def __init__(self, column: pa.Array, words: bool):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        self.at = offsets - offsets[0]
        self.symbols = data
        if words:
            begin, end = word_ranges(data, self.at)
            self.symbols, self.at = Rolling(data, 0).ranges(begin, end), np.searchsorted(begin, self.at)

    def numbered(self) -> tuple[np.ndarray, int]:
        """Small numbers for the symbols, and how many there are."""
        if self.symbols.dtype == np.uint8:
            return self.symbols.astype(np.int32), 256
        known, number = np.unique(self.symbols, return_inverse=True)
        return number.astype(np.int32), max(1, len(known))


def classes(group: np.ndarray, symbols: np.ndarray, kinds: int, start: np.ndarray, step: int, limit: np.ndarray, first: int) -> np.ndarray:
    """Digit passes: for each depth from `first` on, the class of each row by its group and so many symbols from `start` on.

    -1 where a row is alone in its class, or the depth is beyond the row's limit.
    """
    n, deepest = len(group), int(limit.max(initial=0))
    out = np.full((max(deepest, first) - first + 1, n), -1, np.int32)
    _, c, size = np.unique(group, return_inverse=True, return_counts=True)
    alive = np.flatnonzero(size[c] > 1)
    c = c[alive]
    if first == 0:
        out[0, alive] = c
    seen = np.empty(n + 1, np.int64)
    for depth in range(1, deepest + 1):
        keep = limit[alive] >= depth
        if not keep.all():
            alive, c = alive[keep], c[keep]
        if not len(alive):
            break
        digit = symbols[start[alive] + step * (depth - 1)]
        seen[c] = digit
        if (seen[c] != digit).any():  # else every class stays together
            _, c, size = np.unique(c.astype(np.int64) * kinds + digit, return_inverse=True, return_counts=True)
            keep = size[c] > 1
            alive, c = alive[keep], c[keep]
        if depth >= first:
            out[depth - first, alive] = c
    return out


def repeated_windows(group: np.ndarray, near: np.ndarray, far: np.ndarray, symbols: np.ndarray, kinds: int, base: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, least, greatest distance from the anchor) of the runs of windows that another row of the group has too."""
    n, deepest = len(group), int(far.max())
    left = classes(group, symbols, kinds, base - 1, -1, far, 0)
    right = classes(group, symbols, kinds, base, 1, size - near, size - deepest)
    hit = np.zeros((n, deepest + 2), bool)
    for o in range(int(near.min()), deepest + 1):
        there = np.flatnonzero((near <= o) & (o <= far) & (left[o] >= 0) & (right[deepest - o] >= 0)) if deepest - o < len(right) else []
        if len(there):
            _, c, many = np.unique(left[o][there].astype(np.int64) * (n + 1) + right[deepest - o][there], return_inverse=True, return_counts=True)
            hit[there[many[c] > 1], o] = True
    edge = np.diff(hit, axis=1, prepend=False).ravel()
    border = np.flatnonzero(edge)
    row, place = border // hit.shape[1], border % hit.shape[1]
    return row[::2], place[::2], place[1::2] - 1


def run_rows(texts: DataFrame, size: int, gram: int, words: int | None) -> DataFrame:
    """A row per anchor: its text, kg (hash of its gram), its place, the first and last start of its windows, g1 and g2
    (hashes of all that they cover), and where that lies in the text, in bytes. The lowest bit of kg says bytes or words."""
    names = ["dkey", "a", "lo", "hi", "begin", "length", "kg", "g1", "g2"]

    def found(data: np.ndarray) -> Iterator[list[np.ndarray]]:
        one = Rolling(data, 0)
        looked = [(BYTES, one, Rolling(data, 1), size, gram)]
        if words:
            begin, end = word_ranges(data)
            hashed = one.ranges(begin, end)
            looked.append((WORDS, Rolling(hashed, 0), Rolling(hashed, 1), words, min(words, WORD_GRAM)))
        for kind, x, y, window, part in looked:
            if len(x.sums) <= window:
                continue
            grams = x.every(part)
            a, lo, hi = anchors(grams, window - part + 1)
            shape = ((a - lo).astype(np.uint64) << np.uint64(32)) | (a - hi).astype(np.uint64)
            kg = (grams[a] & ~np.uint64(1)) | np.uint64(kind)
            at, stop = (lo, hi + window) if kind == BYTES else (begin[lo], end[hi + window - 1])
            yield [a, lo, hi, at, stop - at, kg, mixed(x.ranges(lo, hi + window) ^ shape), y.ranges(lo, hi + window)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[np.ndarray]] = []
            count = 0
            for i in range(batch.num_rows):
                for cols in found(np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)):
                    held.append([np.full(len(cols[0]), i), *cols])
                    count += len(cols[0])
                if held and (count >= OUT_ROWS or i + 1 == batch.num_rows):
                    c = [np.concatenate(x) for x in zip(*held, strict=True)]
                    cols = [batch.column(0).take(pa.array(c[0])), *(pa.array(x.astype(np.int32)) for x in c[1:6]), *map(_signed, c[6:])]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                    held, count = [], 0

    asked = texts.where(F.octet_length("text") >= min(size, 2 * words - 1 if words else size))
    return asked.select("dkey", F.col("text").cast("binary").alias("text")).mapInArrow(run, "dkey binary, a int, lo int, hi int, begin int, length int, kg long, g1 long, g2 long")


def _parts(batches: Iterator[pa.RecordBatch], sizes: tuple[int, int | None]) -> Iterator[tuple[pa.RecordBatch, Contexts, int]]:
    """Few rows at a time, and those of bytes apart from those of words: the working arrays are many times the contexts."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            kind = part.column(0).to_numpy() & 1
            for k in (BYTES, WORDS):
                some = part.filter(pa.array(kind == k)) if (kind == k).any() else None
                if some is not None:
                    yield some, Contexts(some.column(some.schema.get_field_index("ctx")), k == WORDS), sizes[k]


def _sorted_runs(contexts: DataFrame, sizes: tuple[int, int | None]) -> DataFrame:
    """Pass 3 in tasks: (dkey, kind, lo, hi) of the repeated windows of runs that are single so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, 1):
            whole = rows.combine_chunks().to_batches(max_chunksize=rows.num_rows)[0]
            kind = whole.column(0).to_numpy() & 1
            for k in (BYTES, WORDS):
                if not (kind == k).any():
                    continue
                some = whole.filter(pa.array(kind == k))
                kg, n, a, lo, hi = (some.column(i).to_numpy() for i in (0, 1, 3, 4, 5))
                held = Contexts(some.column(6), k == WORDS)
                symbols, kinds = held.numbered()
                row, near, far = repeated_windows(kg, a - hi, a - lo, symbols, kinds, held.at[:-1] + a - lo, sizes[k])
                open_ = n[row] == 1
                row, near, far = row[open_], near[open_], far[open_]
                cols = [some.column(2).take(pa.array(row)), pa.array(np.full(len(row), k, np.int32)), pa.array((a[row] - far).astype(np.int32)), pa.array((a[row] - near).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["dkey", "kind", "lo", "hi"])

    dealt = contexts.select("kg", "n", "dkey", "a", "lo", "hi", "ctx").repartition("kg").sortWithinPartitions("kg")
    return dealt.mapInArrow(run, "dkey binary, kind int, lo int, hi int")


def _block_rows(contexts: DataFrame, sizes: tuple[int, int | None]) -> DataFrame:
    """For each 16 starts of a run: hashes of what the windows share and of what they cover. Starts count back from a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held, size in _parts(batches, sizes):
            kg, n, a, lo, hi = (part.column(i).to_numpy() for i in (0, 1, 3, 4, 5))
            one, two = Rolling(held.symbols, 0), Rolling(held.symbols, 1)
            near, far = a - hi, a - lo
            blocks = far // BLOCK - near // BLOCK + 1
            row = np.repeat(np.arange(len(a)), blocks)
            block = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks) + (near // BLOCK)[row]
            o1, o2 = np.maximum(near[row], block * BLOCK), np.minimum(far[row], block * BLOCK + BLOCK - 1)
            base = held.at[:-1][row] + far[row]  # the anchor's place
            core = mixed(one.ranges(base - block * BLOCK, base - block * BLOCK - BLOCK + 1 + size) ^ mixed(block.astype(np.uint64)))
            shape = (o1.astype(np.uint64) << np.uint64(32)) | o2.astype(np.uint64)
            cover = mixed(two.ranges(base - o2, base - o1 + size) ^ mixed(shape))
            cols = [pa.array(kg[row]), _signed(core), _signed(cover), pa.array(n[row]), part.column(2).take(pa.array(row)), *(pa.array(x.astype(np.int32)) for x in (a[row], o1, o2))]
            yield pa.RecordBatch.from_arrays(cols, names=["kg", "core", "cover", "n", "dkey", "a", "o1", "o2"])

    return contexts.select("kg", "n", "dkey", "a", "lo", "hi", "ctx").mapInArrow(run, "kg long, core long, cover long, n long, dkey binary, a int, o1 int, o2 int")


def _window_rows(contexts: DataFrame, sizes: tuple[int, int | None]) -> DataFrame:
    """contexts with the arrays o1s and o2s of open blocks: a row per start, with its window's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held, size in _parts(batches, sizes):
            kg, n, a, lo = (part.column(i).to_numpy() for i in (0, 1, 3, 4))
            two = Rolling(held.symbols, 1)
            open_ = part.column(6)
            row = np.repeat(np.arange(len(a)), pa.compute.list_value_length(open_).to_numpy())
            flat = open_.flatten()
            o1, o2 = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            many = o2 - o1 + 1
            each = np.repeat(np.arange(len(row)), many)
            o = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many) + o1[each]
            row = row[each]
            start = held.at[:-1][row] + (a - lo)[row] - o
            hashed = mixed(two.ranges(start, start + size) ^ mixed(o.astype(np.uint64)))
            cols = [pa.array(kg[row]), _signed(hashed), pa.array(n[row]), part.column(2).take(pa.array(row)), pa.array((a[row] - o).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["kg", "window", "n", "dkey", "start"])

    return contexts.select("kg", "n", "dkey", "a", "lo", "ctx", "open").mapInArrow(run, "kg long, window long, n long, dkey binary, start int")


KIND = "cast(kg & 1 as int) as kind"


def _counted_runs(contexts: DataFrame, sizes: tuple[int, int | None], keep) -> DataFrame:
    """Pass 3 by keys, for groups too large for a task: as _sorted_runs."""
    blocks = keep(_block_rows(contexts, sizes), "blocks")
    total = blocks.count()
    counted = lambda rows, key: keep(rows.groupBy("kg", key).agg(F.sum("n").alias("repeats"), F.count("*").alias("c")).where("repeats > 1").select("kg", key, "c"), key)
    shared = met(blocks, counted(blocks, "core"), ["kg", "core"], total).drop("c")
    shared = keep(shared, "shared")
    covered = keep(met(shared, counted(shared, "cover"), ["kg", "cover"], total).select("kg", "dkey", "a", "o1", "o2"), "covered")
    open_ = shared.join(covered.select("dkey", "a", "o1", F.lit(True).alias("all")), ["dkey", "a", "o1"], "left").withColumn("all", F.coalesce("all", F.lit(False)))
    by_block = open_.where("all and n = 1").select("dkey", F.expr(KIND), F.expr("a - o2").alias("lo"), F.expr("a - o1").alias("hi"))
    # a block that is accepted still takes part in the last pass, for windows that only some of the others share
    listed = open_.groupBy("kg", "dkey", "a").agg(F.collect_list(F.struct("o1", "o2")).alias("open"))
    windows = keep(_window_rows(contexts.join(listed, ["kg", "dkey", "a"]), sizes), "windows")
    by_window = met(windows.where("n = 1"), counted(windows, "window"), ["kg", "window"], windows.count()).select("dkey", F.expr(KIND), F.col("start").alias("lo"), F.col("start").alias("hi"))
    return by_block.unionByName(by_window)


def keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in `keep`, text and dkey: null texts as empty ones, and 128 bits of the text's SHA-256."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*keep, text.alias("__text")).withColumn("dkey", F.unhex(F.substring(F.sha2(F.col("__text").cast("binary"), 256), 1, 32)))


def _only(texts: DataFrame, keys: DataFrame, few_keys: int) -> DataFrame:
    """texts without those whose key is not among keys, before they are shuffled, if the keys are few enough to broadcast."""
    keys = keys.distinct()
    return texts.join(F.broadcast(keys), "dkey", "left_semi") if keys.count() <= few_keys else texts


def repeated_starts(texts: DataFrame, size: int = 400, gram: int = 160, words: int | None = None, few_keys: int = 500_000, group_rows: int = 1024) -> DataFrame:
    """texts: (dkey, text). A written table (dkey, spans, word_spans), arrays of structs (lo, hi): the starts, from lo
    through hi, of windows that also start anywhere else; those in word_spans count words."""
    if not 1 <= gram <= size or size - gram > 2000:
        raise ValueError("the gram has to be within the window and at most 2000 bytes shorter")
    sizes = (size, words)
    with scratch(texts.sparkSession) as keep:
        runs = keep(run_rows(texts, size, gram, words), "runs")
        total = runs.count()
        grams = keep(
            runs.groupBy("kg").agg(F.count("*").alias("c"), F.min("g1").alias("x1"), F.max("g1").alias("y1"), F.min("g2").alias("x2"), F.max("g2").alias("y2"))
            .where("c > 1").select("kg", "c", F.expr("x1 = y1 and x2 = y2").alias("alike")),
            "grams",
        )
        together = keep(met(runs, grams, ["kg"], total).drop("c"), "together")
        unlike = together.where("not alike")
        equal = keep(unlike.groupBy("kg", "g1", "g2").agg(F.count("*").alias("c"), F.min(F.struct("dkey", "a", "lo", "hi", "begin", "length")).alias("one")), "equal")
        place = ["dkey", F.expr(KIND), "lo", "hi"]
        whole = together.where("alike").select(*place).unionByName(met(unlike, equal.where("c > 1").select("kg", "g1", "g2", "c"), ["kg", "g1", "g2"], total).select(*place))

        large = keep(equal.groupBy("kg").agg(F.count("*").alias("c")).where(F.col("c") > group_rows).select("kg"), "large")
        single = equal.select("kg", F.col("c").alias("n"), "one.*")
        needed = _only(texts, single.select("dkey"), few_keys).select("dkey", F.col("text").cast("binary").alias("raw")).dropDuplicates(["dkey"])
        contexts = keep(needed.join(single, "dkey").select("kg", "n", "dkey", "a", "lo", "hi", F.substring(F.col("raw"), F.col("begin") + 1, F.col("length")).alias("ctx")), "contexts")
        found = whole
        if large.isEmpty():
            found = found.unionByName(_sorted_runs(contexts, sizes))
        else:  # fewer than one in group_rows runs is such a group
            hot = F.broadcast(large) if large.count() <= few_keys else large
            found = found.unionByName(_sorted_runs(contexts.join(hot, "kg", "left_anti"), sizes)).unionByName(_counted_runs(keep(contexts.join(hot, "kg", "left_semi"), "large"), sizes, keep))
        spans = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.struct("lo", "hi")))
        return written(found.groupBy("dkey").agg(spans(BYTES).alias("spans"), spans(WORDS).alias("word_spans")), "starts")


def kept_ranges(n: int, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the n bytes that no range begin..end covers."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    start, stop = np.concatenate([[0], end]), np.append(begin, n)
    keep = stop > start
    return start[keep], stop[keep]


def _runs(n: int, start: np.ndarray, stop: np.ndarray) -> int:
    """How many maximal runs lie between ranges that are kept."""
    return len(start) + 1 - int(len(start) > 0 and start[0] == 0) - int(len(stop) > 0 and stop[-1] == n)


def whole_characters(data: bytes, start: int, stop: int) -> bytes:
    """data[start:stop] without the ends of characters that are cut in two."""
    while start < stop and data[start] & 0xC0 == 0x80:
        start += 1
    while stop < len(data) and start < stop and data[stop] & 0xC0 == 0x80:
        stop -= 1
    return data[start:stop]


def cut(docs: DataFrame, size: int = 400, gram: int = 160, few_keys: int = 500_000, keep: list[str] | None = None, words: int | None = None, cut_words: bool = True, characters: bool = False, group_rows: int = 1024) -> DataFrame:
    """The operator: the columns in `keep` (doc_id by default) with n_bytes, n_removed, n_spans, n_passages and
    passage_bytes (maximal runs of repeated words, and their bytes) and kept, the remaining bytes.

    With words, repeated passages of so many words are found, and removed too if cut_words.  With characters, what is
    left of a character that was cut in two is left out of kept (n_removed counts it).
    """
    prepare(docs.sparkSession)
    keep = checked(keep or ["doc_id"], MADE)
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__keep"), "text")
    texts = keyed(docs, ["__keep"])
    starts = repeated_starts(texts.select("dkey", F.col("__text").alias("text")), size, gram, words, few_keys, group_rows)

    def changed(data: bytes, spans, word_spans) -> tuple:
        n, raw = len(data), np.frombuffer(data, np.uint8)
        lo, hi = spans.field(0).to_numpy(), spans.field(1).to_numpy() + size
        n_passages = passage_bytes = 0
        if len(word_spans):
            begin, end = word_ranges(raw)
            first, last = begin[word_spans.field(0).to_numpy()], end[word_spans.field(1).to_numpy() + words - 1]
            free = kept_ranges(n, first, last)
            n_passages, passage_bytes = _runs(n, *free), n - int((free[1] - free[0]).sum())
            if cut_words:
                lo, hi = np.concatenate([lo, first]), np.concatenate([hi, last])
        start, stop = kept_ranges(n, lo, hi)
        kept = b"".join(whole_characters(data, b, s) if characters else data[b:s] for b, s in zip(start.tolist(), stop.tolist(), strict=True))
        return n, n - len(kept), _runs(n, start, stop), n_passages, passage_bytes, kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = list(zip(*[changed(batch.column(1)[i].as_py(), batch.column(2)[i].values, batch.column(3)[i].values) for i in range(batch.num_rows)], strict=True))
            if c:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in c[:5]), pa.array(c[5], pa.binary())], names=["__keep", *MADE])

    none = F.lit(0).cast("long")
    raw = F.col("__text").cast("binary")
    if starts.count() <= few_keys:
        keys = F.broadcast(starts.select("dkey"))
        some = texts.join(keys, "dkey", "left_semi").join(starts, "dkey")
        other = texts.join(keys, "dkey", "left_anti")
    else:
        both = texts.join(starts, "dkey", "left")
        some, other = both.where("spans is not null"), both.where("spans is null")
    after = some.select("__keep", raw.alias("text"), "spans", "word_spans").mapInArrow(run, with_columns(docs, ["__keep"], "n_bytes long, n_removed long, n_spans long, n_passages long, passage_bytes long, kept binary"))
    same = other.select("__keep", F.octet_length("__text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), none.alias("n_passages"), none.alias("passage_bytes"), raw.alias("kept"))
    return after.unionByName(same).select("__keep.*", *MADE)


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document, for windows of 400 bytes; and n_passages and
    passage_bytes, which tell of passages of more than 50 words that occur anywhere else but remove none."""
    found = cut(table(spark, sf_dir, "documents"), words=PASSAGE_WORDS, cut_words=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "passage_bytes")
