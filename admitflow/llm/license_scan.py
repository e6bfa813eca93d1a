"""License scan with built-in expressions only: MinHash bands retrieve templates, containment verifies them.

Texts and templates are lower-cased words of letters and digits; a shingle is five of them. Overlapping windows of 1,
2, 4 and 8 shingles cover the whole text (CLASSES: width, stride, bands, rows of a band). A template of s shingles is
cut into all its own windows of one class, see `width_of`. Windows of either side get a MinHash signature: the least of
their shingles under each of bands * rows random hash functions; the rows of a band are hashed together with the class
and band, and a template is retrieved where a window of the text and one of its own agree on a band.

Chances: windows with the same shingles agree surely, windows of similarity J with 1 - (1 - J**rows)**bands (0.84 for
8-shingle windows that differ in one shingle at an end, J = 7/9). A stretch that holds 80 % of a template's shingles in
place has an unbroken run of all s of them (s < 5), s - 1 (s < 10), or 8 or more, as a changed, lost or added word
inside breaks at least four. A run of width + stride - 1 holds a window of the text that is also the template's, so
templates of fewer than 12 shingles are found surely. Beyond, a run of 9 suffices; where both runs around one change
have 8 only (20 shingles), every second one is found surely, and each has two windows at J = 7/9 beside it otherwise:
chance above 0.98.

Retrieved templates are verified exactly: of the stretches of text that start at a shared shingle and are a quarter
longer than the template, the best must hold at least `least` of the template's distinct shingles.

One row per document and template found: key, template (its number), license, containment, first_word and last_word
(0-based words of the best, earliest stretch's first and last shared shingle).

Templates are a table of signatures. Up to MAX_LISTED signatures are listed in the filter of the scan, so a window
without a match goes no further than its own row; more are joined on the band's hash, dealt over salts.

Defined cases: null and empty texts, and texts of fewer than five words, find nothing; templates of fewer
than five words are refused; repeated rows are scanned each; only key and text are read, so extra columns can't clash
(a key named like a result column gets an underscore); an empty table gives an empty result. Only rows with a retrieved
template are shuffled.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from admitflow.plans.shared import free_name, materialise

SHINGLE = 5
#: (shingles of a window, stride in the text, bands, rows of a band), widest last.
CLASSES = ((1, 1, 1, 1), (2, 1, 1, 2), (4, 2, 1, 2), (8, 2, 2, 2))
WIDEST = CLASSES[-1][0]
#: Spots of the text that share a row; a class of stride 1 has a window at each.
STEP = 2
#: Signatures that are listed in the scan's filter; more are joined.
MAX_LISTED = 20_000
#: Salts over which windows with a frequent signature are dealt in that join.
SALTS = 16
RESULT = ("template", "license", "containment", "first_word", "last_word")

#: Well-known public license notices (fixed values).
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
]


def width_of(shingles: int) -> int:
    """The class of a template: the widest window whose run survives a fifth of the template's shingles being broken."""
    return 1 if shingles < 2 else 2 if shingles < 6 else 4 if shingles < 12 else 8


def _let(name: str, value: str, body: str) -> str:
    """value, evaluated once, under a name in body: optimizer rules would copy a column's expression into each use."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\\\p{{L}}\\\\p{{N}}]+', 0)"


def _shingles(text: str) -> str:
    gets = ", ".join(f"get(w, i + {k})" for k in range(SHINGLE))
    return _let("w", _words(text), f"if(size(w) >= {SHINGLE}, transform(sequence(0, size(w) - {SHINGLE}), i -> xxhash64({gets})), cast(array() as array<bigint>))")


_SEEDS = random.Random(5)
_HASHES = {(width, i): _SEEDS.getrandbits(63) for width, _, bands, rows in CLASSES for i in range(bands * rows)}


def _signature(width: int, band: int, rows: int, offset: int = 0) -> str:
    """One band's signature of the window at an offset in w (fields h0, h1, ...)."""
    hashed = lambda i, r: f"xxhash64(w.h{offset + i} ^ {_HASHES[width, band * rows + r]}L)"
    least = lambda r: "least(" + ", ".join(hashed(i, r) for i in range(width)) + ")" if width > 1 else hashed(0, r)
    return f"xxhash64({', '.join(least(r) for r in range(rows))})"


def _bands() -> list[tuple[int, int, int]]:
    """(width, rows, band in its class) of every band of every class."""
    return [(width, rows, band) for width, _, bands, rows in CLASSES for band in range(bands)]


def _tests() -> list[tuple[int, str, str]]:
    """(band, condition, signature) for each window that a row of the text has."""
    stride = {width: stride for width, stride, _, _ in CLASSES}
    return [
        (b, f"w.left >= {width + offset}", _signature(width, band, rows, offset))
        for b, (width, rows, band) in enumerate(_bands()) for offset in range(0, STEP, stride[width])
    ]


def _windows(h: str, spots: str) -> str:
    """Structs of the number of shingles from a spot on, and the first WIDEST of them (0 beyond the end)."""
    gets = ", ".join(f"'h{i}', coalesce(get({h}, c + {i}), 0L)" for i in range(WIDEST))
    return f"transform({spots}, c -> named_struct('left', size({h}) - c, {gets}))"


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(template, license, own): distinct shingle hashes, by the same expressions as texts; written to the shared folder."""
    frame = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    table = materialise(frame.select("template", "license", F.expr(_shingles("text")).alias("h")), "templates")
    if short := [r["template"] for r in table.filter("size(h) = 0").select("template").limit(20).collect()]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    return table.withColumn("own", F.array_distinct("h"))


def signatures(table: DataFrame) -> DataFrame:
    """(band, signature, template) of all windows of each template in its class."""
    size = F.size("h")
    width = F.when(size < 2, 1).when(size < 6, 2).when(size < 12, 4).otherwise(8)
    cut = table.withColumn("width", width).select("template", "width", F.explode(F.expr(_windows("h", "sequence(0, size(h) - width)"))).alias("w"))
    each = [F.when(F.col("width") == w, F.struct(F.lit(i).alias("band"), F.expr(_signature(w, band, rows)).alias("signature"))) for i, (w, rows, band) in enumerate(_bands())]
    return cut.select("template", F.explode(F.array_compact(F.array(*each))).alias("s")).select("s.band", "s.signature", "template").distinct()


def _segments(docs: DataFrame, span: int, key: str, text: str) -> DataFrame:
    """(key, row, at, lo, hi, h): a text's shingles in segments, each with as much of its neighbours as a template is long."""
    core = -(-max(64, 2 * span) // 2) * 2
    parts = f"named_struct('at', greatest(s - {span}, 0), 'lo', s, 'hi', least(s + {core}, size(h)) - 1, 'h', slice(h, greatest(s - {span}, 0) + 1, least(s, {span}) + {core + span + WIDEST}))"
    cut = _let("h", _shingles("text"), f"if(size(h) > 0, transform(sequence(0, size(h) - 1, {core}), s -> {parts}), null)")
    frame = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    # explode_outer, as explode's inferred filter would evaluate its argument a second time
    return frame.select("key", "row", F.explode_outer(F.expr(cut)).alias("s")).filter("s is not null").select("key", "row", "s.*")


def _retrieve(segments: DataFrame, listed: list, bands: DataFrame) -> DataFrame:
    """(key, row, at, h, template) of segments with a window that agrees with one of the template's on a band."""
    spots = f"sequence(lo - at, hi - at, {STEP})"
    cut = segments.select("key", "row", "at", "h", F.explode_outer(F.expr(_windows("h", spots))).alias("w")).filter("w is not null")
    tests = _tests()
    if listed is not None:
        own = {b: ", ".join(f"{s}L" for band, s in listed if band == b) for b, _ in listed}
        tests = [t for t in tests if t[0] in own]
        cut = cut.filter(" or ".join(f"({stands} and {signature} in ({own[b]}))" for b, stands, signature in tests))
    agree = [F.expr(f"case when {stands} then named_struct('band', {b}, 'signature', {signature}) end") for b, stands, signature in tests]
    hits = cut.select("key", "row", "at", "h", F.explode(F.array_compact(F.array(*agree))).alias("s")).select("key", "row", "at", "h", "s.*")
    if listed is not None:
        return hits.join(F.broadcast(bands), ["band", "signature"])  # MAX_LISTED rows at most
    spread = bands.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    narrow = hits.select("row", "at", "band", "signature", F.pmod(F.xxhash64("row", "at"), F.lit(SALTS)).cast("int").alias("salt"))
    found = narrow.join(spread, ["band", "signature", "salt"]).select("row", "at", "template").distinct()
    return segments.select("key", "row", "at", "h").join(found, ["row", "at"])


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = 0.8, key: str = "doc_id", text: str = "text", max_listed: int = MAX_LISTED) -> DataFrame:
    """One row per document and template found; see the module's description. The bands are made for a containment of 0.8 and more: a smaller `least` is refused."""
    if least < 0.8:
        raise ValueError(f"bands find templates contained by 0.8 or more, not by {least}")
    table = template_table(docs.sparkSession, templates)
    bands = materialise(signatures(table), "signatures")
    few = bands.limit(max_listed + 1).collect()
    listed = [(r["band"], r["signature"]) for r in few] if len(few) <= max_listed else None
    longest = table.agg(F.max(F.size("own"))).first()[0] or 0
    segments = _segments(docs, longest + longest // 4, key, text)
    if listed is None:
        segments = materialise(segments, "segments")  # its row numbers are joined
    elif not listed:
        segments = segments.limit(0)
        listed = [(0, 0)]
    hits = _retrieve(segments, listed, bands).groupBy("row", "at", "template").agg(F.first("key").alias("key"), F.first("h").alias("h"))
    met = hits.join(table.select("template", "license", "own"), "template")
    stretch = "(size(own) + size(own) div 4)"
    best = f"array_max(transform(spots, i -> named_struct('n', size(array_intersect(slice(h, i + 1, {stretch}), own)), 'back', -i)))"
    last = f"array_max(filter(spots, i -> i < -best.back + {stretch})) + {SHINGLE - 1}"
    found = f"named_struct('share', best.n / size(own), 'back', best.back - at, 'last', {last} + at)"
    verified = _let("spots", "filter(sequence(0, size(h) - 1), i -> array_contains(own, get(h, i)))", _let("best", best, found))
    each = met.select("key", "row", "template", "license", F.expr(verified).alias("v"))
    each = each.groupBy("row", "template").agg(F.first("key").alias("key"), F.first("license").alias("license"), F.max("v").alias("v")).filter(F.col("v.share") >= least)
    return each.select(
        F.col("key").alias(free_name(key, RESULT)), "template", "license", F.round("v.share", 6).alias("containment"),
        F.expr("-v.back").alias("first_word"), F.col("v.last").alias("last_word"),
    )
