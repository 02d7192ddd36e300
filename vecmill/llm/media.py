"""Interleaved document sequences with media (operator 6).

Method. HTML is parsed into an ordered sequence of structs, text or media reference; a reference names its payload by
digest and keeps its position, alternative text and caption.  Payloads are stored once per row as 8-bit grey PNG
images, 192 samples a line, in a table of their own; references meet them by a join on the digest.

Scale. Payload bytes are never shuffled: the store is written and read in place, and only what is computed from a
payload (a narrow row per digest) takes part in the join.  Documents with one text share one digest; the store's side
of the join is unique by digest, and the references' side is split where one digest is very frequent.

Edge cases. A null html is an empty sequence; a null text is an empty payload of padding.  Unknown digests leave the
reference unresolved (null media columns), positions and captions stay.  Equal payloads have equal stored forms.  Texts may
be of any length; rows are independent, repeated ones stay, doc_id may be null, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.tasks import HOT_KEYS
from vecmill.session import prepare, table, written

WIDTH = 192
PAD = 32
SCHEME = "media:"
OUT_BYTES = 8_000_000
ITEM = "struct<position int, kind string, text string, digest string, alt string, caption string>"
_SKIPPED = {"script", "style", "noscript", "template"}
_BREAKS = {"p", "div", "li", "ul", "ol", "br", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "header", "footer", "nav", "tr", "table", "figure", "figcaption", "blockquote", "pre", "title", "body", "html", "head"}
_PNG = b"\x89PNG\r\n\x1a\n"


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.buffer: list[str] = []
        self.skipped = 0
        self.figures: list[dict] = []
        self.captions: list[list[str]] = []

    def flush(self) -> None:
        text = "".join(self.buffer)
        self.buffer = []
        if text.strip():
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "alt": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.skipped += 1
        elif tag == "figcaption":
            self.captions.append([])
        elif tag in ("img", "audio", "video", "source"):
            found = dict(attrs)
            if found.get("src"):
                self.flush()
                digest = found["src"].removeprefix(SCHEME) if found["src"].startswith(SCHEME) else None
                item = {"position": len(self.items), "kind": "media", "text": None if digest else found["src"], "digest": digest, "alt": found.get("alt"), "caption": None}
                self.items.append(item)
                if self.figures:
                    self.figures[-1]["items"].append(item)
        elif tag == "figure":
            self.flush()
            self.figures.append({"items": [], "caption": None})
        elif tag in _BREAKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.skipped = max(0, self.skipped - 1)
        elif tag == "figcaption" and self.captions:
            text = " ".join("".join(self.captions.pop()).split())
            if self.figures:
                self.figures[-1]["caption"] = text
        elif tag == "figure" and self.figures:
            self._caption(self.figures.pop())
        elif tag in _BREAKS:
            self.flush()

    @staticmethod
    def _caption(figure: dict) -> None:
        for item in figure["items"]:
            item["caption"] = figure["caption"]

    def handle_data(self, data):
        if self.skipped:
            return
        (self.captions[-1] if self.captions else self.buffer).append(data)

    def finish(self) -> list[dict]:
        self.close()
        self.flush()
        for figure in self.figures:
            self._caption(figure)
        return self.items


def read_html(html: str | None) -> list[dict]:
    reader = _Reader()
    reader.feed(html or "")
    return reader.finish()


def sequences(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns in `keep` with the sequence of each page: array of (position, kind, text, digest, alt, caption)."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("alt", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(len(keep))
            start, held, size = 0, [], 0
            for i in range(batch.num_rows):
                text = html[i].as_py()
                held.append(read_html(text))
                size += len(text or "")
                if size >= OUT_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, len(held)) for c in batch.columns[: len(keep)]), pa.array(held, kind)], names=[*keep, "sequence"])
                    start, held, size = i + 1, [], 0

    prepare(pages.sparkSession)
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(run, f"{schema}, sequence array<{ITEM}>")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """8-bit grey PNG of lines of WIDTH samples."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """Samples of a PNG that to_png wrote: rows by columns."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, width, rows = 8, [], 0, 0
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            width, rows = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, width + 1)[:, 1:]


def padded(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none), filled with spaces up to a positive multiple of WIDTH."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / WIDTH)).cast("int") * WIDTH
    return F.rpad(raw, size, F.lit(bytes([PAD])))


def stored(payloads: DataFrame) -> DataFrame:
    """payloads: (digest, payload). Writes the media table and returns it read back: (digest, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, size = 0, [], 0
            for i in range(batch.num_rows):
                held.append(to_png(batch.column(1)[i].as_py()))
                size += len(held[-1])
                if size >= OUT_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(held)), pa.array(held, pa.binary())], names=["digest", "media"])
                    start, held, size = i + 1, [], 0

    prepare(payloads.sparkSession)
    return written(payloads.select("digest", "payload").mapInArrow(run, "digest string, media binary"), "media")


def described(store: DataFrame) -> DataFrame:
    """What the stored bytes say when read back, a row per digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                media = batch.column(1)[i].as_py()
                samples = from_png(media)
                payload = samples.tobytes()
                counts = np.bincount(samples.ravel(), minlength=256)
                share = counts[counts > 0] / len(payload)
                values = np.arange(256)
                mean = float((counts * values).sum() / len(payload))
                spread = float(np.sqrt(max(0.0, (counts * values * values).sum() / len(payload) - mean * mean)))
                feature = f"{samples.shape[1]}x{samples.shape[0]} mean={mean:.4f} std={spread:.4f} entropy={float(-(share * np.log2(share)).sum()):.4f}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            c = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(c, kinds, strict=True))], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    found = store.mapInArrow(run, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    names = [f.name for f in found.schema if f.name != "digest"]
    return found.groupBy("digest").agg(*[F.first(c).alias(c) for c in names], F.count("*").alias("stored"))


def resolved(pages: DataFrame, media: DataFrame, keep: list[str]) -> DataFrame:
    """The operator's join: the columns in `keep`, position and caption of each media reference, and its media's columns.

    Digests that very many references share are few; they are broadcast, the others joined by key.
    """
    refs = written(pages.select(*keep, F.explode("sequence").alias("item")).where("item.kind = 'media'").select(*keep, "item.position", "item.alt", "item.caption", "item.digest"), "references")
    often = F.broadcast(refs.groupBy("digest").count().where(F.col("count") > refs.count() / HOT_KEYS).select("digest"))
    hot = media.join(often, "digest", "left_semi")
    cold = refs.join(often, "digest", "left_anti").join(media, "digest", "left")
    return cold.unionByName(refs.join(often, "digest", "left_semi").join(F.broadcast(hot), "digest", "left"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    digest = F.sha2(padded(F.col("text")), 256)
    media = written(described(stored(docs.select(digest.alias("digest"), padded(F.col("text")).alias("payload")))), "described")
    escaped = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<article><p>"), escaped, F.lit('</p><figure><img src="media:'), digest, F.lit('" alt="text as samples"><figcaption>'), F.col("doc_id").cast("string"), F.lit("</figcaption></figure></article>"))
    pages = sequences(docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.coalesce(html, F.concat(F.lit('<figure><img src="media:'), digest, F.lit('"></figure>'))).alias("html")), ["doc_id", "n_bytes"])
    return resolved(pages, media, ["doc_id", "n_bytes"]).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
