"""Licence scans: MinHash bands over overlapping text windows retrieve licence
templates, exact shingle containment verifies them.  DataFrame operations only.

Shingles are of five words; a template of fewer words is one shingle of all its
words, and the windows for it are made of shingles of that many words.

A template that spans ``n`` shingles belongs to the smallest class 2^c >= n and is
looked for in windows of 2 * 2^c shingles that start every 2^c, so that an
occurrence lies wholly inside one window.  At containment 0.8 the similarity of
window and template is at least 0.8 d / (2 * 2^c + 0.2 d) for d different
shingles, 0.19 where none repeats; ``BANDS`` one-row bands then collide with
probability 1 - 0.81^64 > 0.999998.  A retrieved (window, template) pair is
confirmed by the exact share of the template's shingles that the window holds.

A band collides only where the shingle that is a template's minimum in that band
stands in the window.  These minima, at most ``BANDS`` a template whatever its
length, are what the first scan looks for: one hash per shingle of a text, and
only windows around a minimum are sketched.  Their bands meet the templates' bands
(``MAX_TEMPLATES * BANDS`` rows at most, hence broadcast) in a join that carries
ids alone; the shingles of windows and templates join the surviving pairs.

Defined results: null and empty texts and texts shorter than every template match
nothing; rows repeating an id are scanned each, and their matches are reported
together under the id (null ids too, ids of any type); a template needs at least
one word; ``first_word`` is the smallest place of a template shingle in any
confirmed window, so ties do not arise.  Texts are read whole, however long, and
a template may be a full licence.  Only id and text are read, so no extra column
can clash.  Empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import computed, written

WIDTH = 5
CONTAINMENT = 0.8
BANDS = 64
MAX_TEMPLATES = 1000
#: Words are runs of letters and digits, in lower case.
GAP = r"[^\p{L}\p{N}]+"

#: Common licence notices and full texts.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "CC-BY-SA notice": "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "All rights reserved": "All rights reserved. No part of this publication may be reproduced without prior written permission.",
    "All rights reserved notice": "All rights reserved.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software"),
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "BSD redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS "
        "OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
        "DAMAGE."),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not "
        "claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
        "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution."),
}


def scan_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _hashes(words: Column, width: Column) -> Column:
    """64-bit hashes of the shingles of a word array; empty if it has too few words."""
    n = F.size(words)
    return F.when(n >= width, F.transform(F.sequence(F.lit(1), n - (width - 1)),
                                          lambda i: F.xxhash64(F.slice(words, i, width)))).otherwise(
        F.array().cast("array<bigint>"))


def _minima(shingles: Column, bands: int) -> Column:
    """Per band (bands are independent hash functions) its smallest value and the shingle that has it."""
    return F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda b: F.array_min(
        F.transform(shingles, lambda h: F.struct(F.xxhash64(h, b).alias("value"), h.alias("x")))))


def _bands(shingles: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(bands)),
                       lambda b: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))))


def template_table(spark: SparkSession, templates: dict[str, str], width: int = WIDTH) -> DataFrame:
    """template, width, shingles (distinct hashes), size, step (2^c) - at most MAX_TEMPLATES rows."""
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"at most {MAX_TEMPLATES} templates")
    rows = spark.createDataFrame(sorted(templates.items()), "template string, body string")
    w = computed(rows.withColumn("w", scan_words(F.col("body")))).filter(F.size("w") > 0)
    t = w.withColumn("width", F.least(F.size("w"), F.lit(width))).withColumn(
        "h", _hashes(F.col("w"), F.col("width"))).withColumn("shingles", F.array_distinct("h"))
    step = F.element_at(F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda c: F.pow(F.lit(2), c).cast("int")),
                                 lambda p: p >= F.size("h")), 1)
    return t.select("template", "width", "shingles", F.size("shingles").alias("size"), step.alias("step"))


def windows(df: DataFrame, minima: dict[tuple[int, int], list[int]], text: str, key: str) -> DataFrame:
    """key, width, step, start, shingles: every window of a (width, step) that holds one of its minima."""
    by_width: dict[int, list[int]] = {}
    for (width, _), known in sorted(minima.items()):
        by_width[width] = sorted(set(by_width.get(width, [])) | set(known))
    w = computed(df.select(F.col(key).alias("key"), scan_words(F.col(text)).alias("w")))
    h = computed(w.select("key", *[_hashes(F.col("w"), F.lit(n)).alias(f"h{n}") for n in by_width]))

    def hits(n: int) -> Column:
        return F.filter(F.transform(f"h{n}", lambda x, i: F.when(x.isin(by_width[n]), F.struct(x.alias("x"), i.alias("i")))),
                        lambda s: s.isNotNull())

    at = computed(h.select("*", *[hits(n).alias(f"at{n}") for n in by_width])).filter(
        " OR ".join(f"size(at{n}) > 0" for n in by_width))

    def around(n: int, step: int) -> Column:
        own = F.filter(f"at{n}", lambda s: s["x"].isin(minima[n, step]))
        numbers = F.array_distinct(F.flatten(F.transform(own, lambda s: F.filter(
            F.array(F.floor(s["i"] / step), F.floor(s["i"] / step) - 1), lambda k: k >= 0))))
        return F.transform(numbers, lambda k: F.struct(
            F.lit(n).alias("width"), F.lit(step).alias("step"), (k * step).alias("start"),
            F.slice(f"h{n}", (k * step + 1).cast("int"), 2 * step).alias("shingles")))

    return at.select("key", F.explode(F.concat(*[around(n, s) for n, s in sorted(minima)])).alias("x")).select("key", "x.*")


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", templates: dict[str, str] | None = None,
         containment: float = CONTAINMENT, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """key, template, containment (the best window's), n_windows, first_word."""
    t = written(template_table(df.sparkSession, TEMPLATES if templates is None else templates, width), "licence-templates")
    index = written(t.select("template", "width", "step", F.posexplode(_minima(F.col("shingles"), bands)).alias("band", "m"))
                    .select("template", "width", "step", "band", "m.*"), "licence-bands")
    minima: dict[tuple[int, int], list[int]] = {}
    for r in index.select("width", "step", "x").distinct().collect():  # at most MAX_TEMPLATES * bands
        minima.setdefault((r["width"], r["step"]), []).append(r["x"])
    if not minima:
        minima[width, 1] = []  # no template: nothing is known, so nothing is found
    win = written(windows(df, minima, text, key).withColumn("id", F.monotonically_increasing_id()), "licence-windows")
    banded = win.select("id", "width", "step", F.posexplode(_bands(F.col("shingles"), bands)).alias("band", "value"))
    pairs = banded.join(F.broadcast(index.drop("x")), ["width", "step", "band", "value"]).select("id", "template").distinct()
    both = pairs.join(win.select("id", "key", "start", "shingles"), "id").join(
        t.select("template", "size", F.col("shingles").alias("wanted")), "template")
    share = F.size(F.array_intersect("shingles", "wanted")) / F.col("size")
    good = computed(both.select("key", "template", "start", "shingles", "wanted", share.alias("share"))).filter(
        F.col("share") >= containment)
    first = F.array_position(F.transform("shingles", lambda x: F.array_contains("wanted", x)), F.lit(True)) - 1
    placed = good.select("key", "template", "start", "share", (F.col("start") + first).alias("word"))
    return placed.groupBy(F.col("key").alias(key), "template").agg(
        F.max("share").alias("containment"), F.count_distinct("start").alias("n_windows"),
        F.min("word").cast("long").alias("first_word"))
