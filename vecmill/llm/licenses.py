"""License scans (operator 8).

Method. Conditional compression: blocks around licence words are compressed with zstandard, alone and with each template
as raw dictionary.  Blocks are taken twice: the lines next to a licence word, in which short notices stand out, and as
many words to either side as the longest notice may have, so that a notice may be wrapped anyhow.  Every template that
saves a fair share of its own compressed size is then held against the block word by word, and is confirmed if no more
than `max_difference` of its words differ; the rest of the block is held against it again.  Where confirmed templates overlap in the text, the one with the fewest
differing words, then the longest, stays.

Scale. One pass without a shuffle; a test on the JVM leaves texts without any licence word out of Python.  Blocks of
any length are scanned in overlapping pieces that no template outgrows, so work is linear in the text.

Edge cases. Null and empty texts have no blocks.  Texts may be of any length.  Rows are independent: doc_id may be null
or repeated, repeated rows stay repeated, an empty table gives no rows, and other columns are not looked at.  Of equally
good matches that overlap, the one that begins first stays, then the first name of the alphabet.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.session import prepare, table

CUES = r"licen[cs]|copyright|spdx|warrant|permission is hereby|redistribution|cc by|public domain"
_CUE = re.compile(CUES, re.I)
_WORD = re.compile(r"[^\W_]+(?:[.\-'][^\W_]+)*")
NEAR_LINES = 1

#: Public licence notices: name, wording.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
]


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, end) sorted by start, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def blocks(text: str) -> list[tuple[int, int]]:
    """Character ranges of runs of lines with licence words, with the lines next to them."""
    out = []
    for at in (m.start() for m in _CUE.finditer(text)):
        start, end = at, at
        for _ in range(NEAR_LINES + 1):
            start = text.rfind("\n", 0, max(0, start - 1)) + 1 if start else 0
            end = (text.find("\n", end + 1) + 1 or len(text) + 1) - 1 if end < len(text) else end
        out.append((start, end))
    return joined(out)


def wide_blocks(text: str, listed: list[tuple[str, int, int]], reach: int) -> list[tuple[int, int]]:
    """Ranges of places in the listed words: up to `reach` of them to either side of each licence word."""
    starts = [w[1] for w in listed]
    at = [bisect_right(starts, m.start()) for m in _CUE.finditer(text)]
    return joined([(max(0, i - 1 - reach), min(len(listed), i + reach)) for i in at])


def notices(wording: list[str], plain: list[str], max_difference: float) -> list[tuple[int, int, int]]:
    """(first word, last word, words that differ) of every place where no more than that share of the words differs."""
    out = []
    most = int(max_difference * len(wording))
    least_run = max(1, (len(wording) - most) // (most + 1))  # of the words in common; so long is the longest run at least
    rest = [(0, len(plain))]
    while rest:
        begin, end = rest.pop()
        if end - begin < len(wording) - most:
            continue
        core = SequenceMatcher(None, wording, plain[begin:end], autojunk=False).find_longest_match()
        if core.size < least_run:
            continue
        # the longest common run is surely part of a notice or of what looks like one; runs too far from it are chance
        at = begin + core.b
        low, high = max(begin, at - 2 * core.a - 4), min(end, at + core.size + 2 * (len(wording) - core.a - core.size) + 4)
        same = [m for m in SequenceMatcher(None, wording, plain[low:high], autojunk=False).get_matching_blocks() if m.size]
        common = sum(m.size for m in same)
        first, last = low + same[0].b, low + same[-1].b + same[-1].size
        differ = len(wording) - common + last - first - common
        if differ <= max_difference * len(wording):
            out.append((first, last - 1, differ))
        else:
            first, last = at, at + core.size
        rest += [(begin, first), (last, end)]
    return out


@lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...], least_saved: float, max_difference: float):
    import zstandard as zstd

    alone = zstd.ZstdCompressor(level=3)
    known = []
    for name, wording in templates:
        raw = wording.encode()
        help_ = zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT))
        known.append((name, [w for w, _, _ in words(wording)], help_, len(raw), len(alone.compress(raw))))
    # a notice has at most so many words more than its template
    reach = int(max((len(k[1]) for k in known), default=1) * (1 + max_difference)) + 1

    def scan(text: str) -> list[tuple[int, int, str, int, float, int]]:
        """(start, end, licence, bytes saved, saved as a share of the template, words that differ)."""
        found = []
        listed = words(text)
        starts = [w[1] for w in listed]
        narrow = [(bisect_left(starts, begin), bisect_left(starts, end)) for begin, end in blocks(text)]
        for first, last in sorted({*narrow, *wide_blocks(text, listed, reach)}):
            block = listed[first:last]
            for at in range(0, max(1, len(block) - 2 * reach), 2 * reach):
                piece = block[at : at + 4 * reach]
                if not piece:
                    continue
                start, stop = piece[0][1], piece[-1][2]
                stop += text[stop : stop + 1] in (".", ";")
                raw = text[start:stop].encode()
                base = len(alone.compress(raw))
                ranked = sorted(((base - len(k[2].compress(raw))) / k[4], i) for i, k in enumerate(known))[::-1]
                plain = [w for w, _, _ in piece]
                for share, i in ranked:
                    if share < least_saved:
                        break
                    name, wording, _, _, size = known[i]
                    for a, b, differ in notices(wording, plain, max_difference):
                        found.append((piece[a][1], piece[b][2], name, round(share * size), share, differ, len(wording)))
        kept: list[tuple] = []
        for f in sorted(set(found), key=lambda f: (f[5] / f[6], -(f[1] - f[0]), f[0], f[2])):
            at = bisect_left(kept, f[:2], key=lambda k: k[:2])
            if (at == 0 or kept[at - 1][1] <= f[0]) and (at == len(kept) or f[1] <= kept[at][0]):
                kept.insert(at, f)
        return [f[:6] for f in kept]

    return scan


def find_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least_saved: float = 0.3, max_difference: float = 0.2) -> DataFrame:
    """The operator: (doc_id, found array<struct<start, end, license, bytes_saved, share_saved, words_differ>>) for each row."""
    frozen = tuple(map(tuple, templates))
    item = "struct<start int, end int, license string, bytes_saved int, share_saved double, words_differ int>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("bytes_saved", pa.int32()), ("share_saved", pa.float64()), ("words_differ", pa.int32())]))
    names = [f.name for f in kind.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(frozen, least_saved, max_difference)
        for batch in batches:
            texts = batch.column(1)
            rows = [[dict(zip(names, f, strict=True)) for f in scan(texts[i].as_py())] if texts[i].is_valid else [] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "found"])

    prepare(docs.sparkSession)
    asked = docs.select("doc_id", F.when(F.col("text").rlike(f"(?i){CUES}"), F.col("text")).alias("text"))
    return asked.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found array<{item}>")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_found, licenses (distinct names, sorted, joined by commas), first_start, bytes_saved, words_differ for every document."""
    found = find_licenses(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("found").alias("n_found"),
        F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
        F.get("found", F.lit(0))["start"].alias("first_start"),
        F.aggregate("found.bytes_saved", F.lit(0), lambda a, x: a + x).alias("bytes_saved"),
        F.aggregate("found.words_differ", F.lit(0), lambda a, x: a + x).alias("words_differ"),
    )
