"""BPE encoding and decoding (operator 1).

Method. A text is normalised and split into words; each word is encoded by walking left to right over the
longest vocabulary tokens that an Aho-Corasick automaton found at each position.  A token may follow its
predecessor only if the pair is compatible, that is, if byte-pair merging of the two strings together would
leave exactly these two tokens.  When no compatible token fits, the walk backs up and tries the next shorter
one.  The walk that reaches the end is the result of the merges, without performing them.  Decoding gathers
bytes through an offset table: token i is bytes[offset[i]:offset[i + 1]].

Scale. Rows are independent, so there is no shuffle; words are memoised per Python worker in a dictionary of
bounded size.

Edge cases. A null text counts as empty: no ids, empty decoded text.  Texts are whole, of any length.  Rows are
independent: doc_id may be null or repeated, repeated rows stay repeated, an empty table gives no rows, and other columns
are not looked at, whatever their names.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.session import prepare, table

END = ""  # stands for the end-of-word suffix, so that no text can look like it
CACHED_WORDS = 300_000
OUT_BYTES = 8_000_000
if sys.byteorder != "little":
    raise ImportError("ids are packed in the machine's byte order, which has to be little-endian")

# Letters of ASCII and Latin-1; the faster standard pattern is right for texts with no other characters.
_L = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼½¾"
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
_PLAIN = re.compile(r"[!-~]*").fullmatch  # the byte alphabet keeps these as they are
_OUTSIDE = re.compile("[^\x00-\x1b\x20-\x84\x86-\xff]")


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest for characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def lowered(text: str) -> str:
    """Lower case character by character (no rule for a final sigma)."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


class Encoder(dict):
    """A memo from word to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        self.suffix = suffix
        marked = lambda s: s[: -len(suffix)] + END if suffix and s.endswith(suffix) and s != suffix else s
        self.alphabet = byte_alphabet()
        vocab = model["vocab"]
        self.by_text = {marked(s): i for s, i in vocab.items()}
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((left, right), rank)
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = rank, (left, right)
        self.automaton = ahocorasick.Automaton()
        self.length: dict[int, int] = {}
        usable = {i for s, i in vocab.items() if i in self.rank or len(marked(s).rstrip(END)) == 1}
        for s, i in self.by_text.items():
            if i in usable:
                self.automaton.add_word(s, (len(s), i))
                self.length[i] = len(s)
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        size = 1 + max([*vocab.values(), *self.special.values()])
        shown = [""] * size
        for s, i in [*vocab.items(), *self.special.items()]:
            shown[i] = s
        raw = [f"{s} ".encode() for s in shown]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b together ends in exactly a, b.

        Undo merges from the last one backwards; at each earlier time the two pieces that touch the border must
        not have a merge that comes before the time at which one of them grew on.  On equal ranks the left place wins.
        """
        key = (a, b)
        known = self.compatible.get(key)
        if known is not None:
            return known
        rank, parts, merge = self.rank, self.parts, self.merge
        before = len(merge) + 1
        good = True
        while True:
            crossing = merge.get((a, b))
            if crossing is not None and crossing < before:
                good = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                before, a = ra, parts[a][1]
            else:
                before, b = rb + 1, parts[b][0]
        if len(self.compatible) > 400_000:
            self.compatible.clear()
        self.compatible[key] = good
        return good

    def next_shorter(self, token: int, text: str) -> int | None:
        """The longest token that is a proper prefix of this token's text."""
        if token not in self.shorter:
            found = None
            for n in range(len(text) - 1, 0, -1):
                found = self.by_text.get(text[:n])
                if found is not None and found in self.length:
                    break
                found = None
            self.shorter[token] = found
        return self.shorter[token]

    def encode_word(self, word: str) -> list[int]:
        """word: in the byte alphabet, with END last where the vocabulary marks word ends."""
        whole = self.by_text.get(word)
        if whole is not None and whole in self.length:
            return [whole]
        n = len(word)
        longest: list[int | None] = [None] * (n + 1)
        for end, (size, token) in self.automaton.iter(word):
            longest[end + 1 - size] = token  # ends come in ascending order: the last one is the longest
        out: list[int] = []
        at, token = 0, longest[0]
        dead = bytearray(n + 1)  # places from which no compatible rest was found
        length, fits, known = self.length, self.fits, self.compatible.get
        while True:
            last = out[-1] if out else None
            while token is not None:
                to = at + length[token]
                if not dead[to]:
                    if last is None:
                        break
                    good = known((last, token))
                    if fits(last, token) if good is None else good:
                        break
                token = self.next_shorter(token, word[at:to])
            if token is not None:
                out.append(token)
                at = to
                if at == n:
                    return out
                token = longest[at]
            else:
                dead[at] = 1
                if not out:
                    raise ValueError("a word has no encoding in this vocabulary")
                token = out.pop()
                at -= length[token]
                token = self.next_shorter(token, word[at : at + length[token]])

    def __missing__(self, word: str) -> bytes:
        text = word if _PLAIN(word) else "".join(map(self.alphabet.__getitem__, word.encode("utf-8")))
        ids = array("I", self.encode_word(text + END if self.suffix else text)).tobytes()
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode_plain(self, text: str) -> bytes:
        if _OUTSIDE.search(text):
            words = self.pattern.findall(lowered(unicodedata.normalize("NFC", text)))
        else:
            words = _FAST.findall(text.lower())
        return b"".join(map(self.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; strings of special tokens are these tokens."""
        if not text:
            return b""
        if "<|" not in text:
            return self.encode_plain(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [self.encode_plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.encode_plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """Tokens as the vocabulary writes them, a space between two; in UTF-8."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(tokens):
            return b""
        pieces = []
        for i in range(0, len(tokens), 1 << 18):
            part = tokens[i : i + (1 << 18)]
            start = self.offsets[part]
            size = self.offsets[part + 1] - start
            ends = np.cumsum(size)
            place = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
            pieces.append(self.bytes[place].tobytes())
        return b"".join(pieces)[:-1]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_decode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The operator: (id, ids binary of little-endian uint32, decoded string) for each row, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab_path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            start, ids, decoded, held = 0, [], [], 0
            for i in range(len(texts)):
                x = enc.encode(texts[i].as_py())
                y = enc.decode(x)
                ids.append(x)
                decoded.append(y.decode())
                held += len(x) + len(y)
                if held >= OUT_BYTES or i + 1 == len(texts):
                    schema = pa.schema([(id_col, keys.type), ("ids", pa.binary()), ("decoded", pa.string())])
                    yield pa.RecordBatch.from_arrays([keys.slice(start, i + 1 - start), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], schema=schema)
                    start, ids, decoded, held = i + 1, [], [], 0

    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    import public_tokenizers

    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
