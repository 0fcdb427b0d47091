"""License scans by MinHash bands over overlapping windows (DataFrame functions only).

Texts become words, words become hashed shingles of five. For each size class of the templates a document is
covered by overlapping windows of that size, an eighth of it apart, wherever it has an anchor (see below). A window's MinHash values, one a band, meet the
templates' in an equi-join; with ``BANDS`` bands of one row a window whose shingles have Jaccard similarity s with a
template's is retrieved with probability 1 - (1 - s) ** BANDS (at s = 0.4, the least that a match of 0.8 can have in
the best placed window of its class, 0.9997). A retrieved template is verified by exact containment: the share of
its shingles that stand in the window or an eighth beyond either end.

Windows are made only where they, or a stride beyond them, hold an anchor: words are chosen so that what is without any
of them lacks too many shingles of every template to match it, and skipping it loses nothing. Texts are cut into segments of
``SEGMENT`` words before, each with the words around it that its windows reach, so that no row holds the windows of a whole long text.

Edge cases: null and empty texts, and texts of fewer words than a shingle has, match only templates as short
(whole word sequences count as one shingle); a template found in many windows counts once, with its best score; very
long texts are covered whole; rows with equal doc_id and text get equal results, rows with equal doc_id and other
text their own; null ids are kept; an empty table gives an empty result. Columns other than the named ones are
ignored.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import ascii_lower, inline_rows, let

WORD = "[a-z0-9]+"
SHINGLE, LEAST, BANDS = 5, 0.8, 16
#: Words of a text whose windows start in one row.
SEGMENT = 2048

#: Notices of public licenses, and whole short licenses.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-2-clause-whole": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause-whole": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-whole": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mit-whole": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-whole": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.',
    "zlib-whole": 'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.',
}
#: Templates times bands up to this many rows are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def window_class(n: int) -> int:
    """The least window size that holds ``n`` words: SHINGLE at least, each class half as long again."""
    size = SHINGLE
    while size < n:
        size += max(1, size // 2)
    return size


def stride(size: int) -> int:
    return max(1, size // 8)


def anchors(templates: dict[str, str], least: float = LEAST) -> list[str]:
    """Words without any of which no template can be contained.

    A match may miss a share of 1 - least of a template's shingles, so it has one of any larger choice of them; the
    choice is the shingles with the longest words, and an anchor is such a word.
    """
    found = set()
    for text in templates.values():
        w = template_words(text)
        best = sorted((max(x, key=lambda y: (len(y), y)) for x in {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}), key=lambda y: (-len(y), y))
        found |= set(best[: len(best) - math.ceil(Fraction(str(least)) * len(best)) + 1])
    return sorted(x for x in found if not any(y != x and y in x for y in found))


def shingles(words: Column, size: int = SHINGLE) -> Column:
    """Hash of each run of ``size`` words; a shorter sequence is one run; no words, none."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(words, i, size), " ")))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def mask(band: int) -> int:
    """Fixed pseudo-random 63 bits for a band."""
    return (0x9E3779B97F4A7C15 * (2 * band + 1) >> 1) & (1 << 63) - 1


def minhashes(values: Column) -> Column:
    """(band, least value) of each band, over one hash read through BANDS masks."""
    return F.array(*[F.struct(F.lit(b).alias("band"), F.array_min(F.transform(values, _masked(b))).alias("least")) for b in range(BANDS)])


def _masked(band: int):
    return lambda h: F.xxhash64(h.bitwiseXOR(F.lit(mask(band))))


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    rows = [{"license": k, "words": " ".join(template_words(v)), "class": window_class(len(template_words(v))), "whole": int(len(template_words(v)) < SHINGLE)} for k, v in templates.items()]
    own = F.array_distinct(shingles(F.split("words", " ")))
    short = F.array(F.xxhash64("words"))
    return inline_rows(spark, rows).select("license", "class", F.when(F.col("whole") == 1, F.size(F.split("words", " "))).otherwise(SHINGLE).alias("size"), F.when(F.col("whole") == 1, short).otherwise(own).alias("set"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, n_licenses, licenses (names in order, comma-joined) and score (best containment) for each row of ``docs``."""
    spark = docs.sparkSession
    body = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    mark = F.xxhash64("text")
    table = template_table(spark, templates)
    bands = table.select("license", "class", "size", "set", F.explode(minhashes(F.col("set"))).alias("_b")).select("license", F.col("class").alias("_tc"), F.col("size").alias("_ts"), "set", F.col("_b.band").alias("_tb"), F.col("_b.least").alias("_tl"))
    if len(templates) * BANDS <= BROADCAST_ROWS:
        bands = F.broadcast(bands)

    low = docs.select(F.col("doc_id").alias("_id"), mark.alias("_mark"), F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("_low"), body.alias("_body"))
    held = F.lit(False)
    known = anchors(templates, least)
    for word in known:
        held = held | F.contains("_low", F.lit(word))
    kinds = sorted({(window_class(len(w)), len(w) if len(w) < SHINGLE else SHINGLE) for w in map(template_words, templates.values())})
    texts = low.where(held).select("_id", "_mark", F.regexp_extract_all("_body", F.lit(f"({WORD})"), 1).alias("_words"))
    runs = sorted({r for _, r in kinds})
    back, ahead = max(stride(size) for size, _ in kinds), max(size + stride(size) for size, _ in kinds)

    def segments(words: Column) -> Column:
        def one(k: Column) -> Column:
            at = k * SEGMENT
            return let(F.greatest(at - back, F.lit(0)), lambda lo: F.struct(F.size(words).alias("n"), at.alias("at"), lo.alias("lo"), F.slice(words, lo + 1, at - lo + SEGMENT + ahead).alias("words")))

        return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / SEGMENT).cast("int")), one))

    texts = texts.select("_id", "_mark", F.explode(let(F.col("_words"), segments)).alias("_s"))
    held_at = F.filter(F.transform("_s.words", lambda w, i: F.when(w.rlike("|".join(known)), i + 1 + F.col("_s.lo"))), lambda i: i.isNotNull())
    texts = texts.withColumn("_held", held_at).where(F.size("_held") > 0)
    texts = texts.withColumns({f"_h{r}": shingles(F.col("_s.words"), r) for r in runs})
    windows = F.flatten(F.array(*[let(F.col(f"_h{r}"), _windows_in(size, r)) for size, r in kinds]))
    cut = texts.select("_id", "_mark", F.explode(windows).alias("_w")).select("_id", "_mark", F.col("_w.*"))
    near = cut.withColumn("_b", F.explode(minhashes(F.col("_core"))))
    found = (
        near.join(bands, (F.col("_tc") == F.col("_class")) & (F.col("_ts") == F.col("_run")) & (F.col("_tb") == F.col("_b.band")) & (F.col("_tl") == F.col("_b.least")))
        .withColumn("_score", F.size(F.array_intersect("set", "_wide")) / F.size("set"))
        .where(F.col("_score") >= least)
        .groupBy("_id", "_mark")
        .agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.countDistinct("license").alias("n_licenses"), F.max("_score").alias("score"))
    )
    rows = docs.select("doc_id", mark.alias("_m"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["_m"] == found["_mark"]), "left")
    return out.select("doc_id", F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _windows_in(size: int, run: int):
    """Windows of a class around the anchors at the words ``_held``, of those that start in the segment ``_s``: their own shingles, and those
    up to a stride beyond. Places are those of the whole text, from 1; of the hashes the first is that of the word after ``_s.lo``."""
    step, count = stride(size), size - run + 1
    s = F.col("_s")

    def around(p: Column) -> Column:
        first, last = F.floor((p - (size + step + 1)) / step), F.floor((p + step) / step)
        return F.sequence(F.greatest(first, F.lit(0)).cast("int"), last.cast("int"))

    def of(hashes: Column) -> Column:
        starts = F.transform(F.array_distinct(F.flatten(F.transform("_held", around))), lambda k: k * step + 1)
        inside = F.filter(starts, lambda i: (i > s["at"]) & (i <= s["at"] + SEGMENT) & (i <= F.greatest(s["n"] - run + 1, F.lit(1))))

        def one(i: Column) -> Column:
            lo = F.greatest(i - step, F.lit(1))
            return F.struct(F.lit(size).alias("_class"), F.lit(run).alias("_run"), F.slice(hashes, i - s["lo"], count).alias("_core"), F.slice(hashes, lo - s["lo"], i - lo + count + step).alias("_wide"))

        return F.transform(inside, one)

    return of
