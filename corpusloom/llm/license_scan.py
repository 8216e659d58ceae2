"""License scan: MinHash bands over overlapping windows retrieve templates.

Words are lower-cased runs of letters and digits; shingles are five words
(a shorter template is one shingle of all its words and looked up as such).
Templates fall into size classes.  The windows of a class hold four times as
many shingles as its smallest template and advance by half of that, so every
whole occurrence lies in a window and makes up a quarter of it or more.  Each
of BANDS hash functions has a band of one row: a window that holds a whole
template meets it in some band with probability 1 - (1 - 1/4)**48 > 0.999998,
and one that holds 0.8 of it with 1 - (1 - 1/5.25)**48 > 0.9999.

A window can meet a template in a band only if the window holds the very
shingle that is smallest there, so only windows around such shingles are
signed.  Every window retrieved is then compared exactly: the share of the
template's distinct shingles that the window holds.

All of it is DataFrame functions without a shuffle.  The templates are a
parameter and become rows: one row of bit arrays, which tells where signing a
window may be of use, a table of band keys that windows are joined to by
(class, band, key), and one of shingles for the comparison.  All are broadcast
and bounded by MAX_TEMPLATES and MAX_TEMPLATE_CHARS; more templates are taken
in blocks, a pass over the documents each.

Defined results: null and word-less texts match nothing and have no row;
repeated documents are scanned each by itself; without templates, or with
templates without words only, the result is empty.  Other columns of the input
are ignored.  A text of any length is scanned whole, and what is made of it
grows with its length.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

SHINGLE = 5
BANDS = 48
CONTAINMENT = 0.8
MAX_TEMPLATE_CHARS = 1_000_000
MAX_TEMPLATES = 2_000
#: Bit arrays have two to this power words of 64 bits at least, and a word for each key.
_WORD_BITS = 4
#: Public license notices, permission texts and whole licenses.
TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "mit-short": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "gpl-3.0-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _shingles(hashes: Column, n: int = SHINGLE) -> Column:
    """Hashes of n consecutive words, from the words' hashes."""
    return F.when(F.size(hashes) >= n, F.transform(F.sequence(F.lit(1), F.size(hashes) - (n - 1)), lambda i: F.xxhash64(*(F.element_at(hashes, i + j) for j in range(n))))).otherwise(F.array().cast("array<long>"))


def _seeded(h: Column, band: int) -> Column:
    """One of BANDS orderings of shingle hashes."""
    return F.xxhash64(h, F.lit(band))


class Templates:
    """Shingles, size classes and band keys; made by the same expressions as the documents' shingles."""

    def __init__(self, spark, texts: dict[str, str]):
        if sum(map(len, texts.values())) > MAX_TEMPLATE_CHARS or len(texts) > MAX_TEMPLATES:
            raise ValueError("templates exceed MAX_TEMPLATE_CHARS or MAX_TEMPLATES")
        self.size = {k: min(SHINGLE, n) for k, t in texts.items() if (n := len(_template_words(t)))}
        self.shingles: dict[str, list[int]] = {}
        self.keys: dict[str, list[int]] = {}
        for size in sorted(set(self.size.values())):
            own = {k: texts[k] for k, n in self.size.items() if n == size}
            df = spark.createDataFrame(pa.table({"id": sorted(own), "text": [own[k] for k in sorted(own)]})).withColumn("h", F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)))
            df = df.withColumn("s", F.array_distinct(_shingles(F.col("h"), size)))
            least = F.array(*(F.array_min(F.transform("s", lambda h: F.struct(_seeded(h, b).alias("o"), h.alias("h"))))["h"] for b in range(BANDS)))
            for r in df.select("id", "s", least.alias("k")).collect():
                self.shingles[r["id"]], self.keys[r["id"]] = r["s"], r["k"]
        #: Names by (words of a shingle, size class).
        self.classes: dict[tuple[int, int], list[str]] = {}
        for k, s in self.shingles.items():
            self.classes.setdefault((self.size[k], len(s).bit_length() - 1), []).append(k)

    def bands(self, spark) -> DataFrame:
        """(size, c, band, key, template): BANDS rows a template."""
        rows = [(n, c, b, h, t) for (n, c), names in self.classes.items() for t in names for b, h in enumerate(self.keys[t])]
        kinds = {"size": pa.int32(), "c": pa.int32(), "band": pa.int32(), "key": pa.int64(), "template": pa.string()}
        return spark.createDataFrame(pa.table({n: pa.array(v, kinds[n]) for n, v in zip(kinds, zip(*rows))}))

    def filters(self, spark) -> DataFrame:
        """One row: for each class a bit array of its band keys, two bits a key; as wide as the keys are many."""
        columns = {}
        wanted = {f"{n}_{c}": names for (n, c), names in self.classes.items()}
        for n in {n for n, _ in self.classes}:  # and one of all classes of a shingle size
            wanted[str(n)] = [t for (m, _), names in self.classes.items() if m == n for t in names]
        for name, names in wanted.items():
            keys = {h for t in names for h in self.keys[t]}
            words = [0] * (1 << max(_WORD_BITS, len(keys).bit_length()))
            for h in keys:
                for at, bit in ((h, h >> 32), (h >> 16, h >> 26)):
                    words[at & (len(words) - 1)] |= 1 << (bit & 63)
            columns[f"b{name}"] = pa.array([[w - (1 << 64) if w >> 63 else w for w in words]], pa.list_(pa.int64()))
        return spark.createDataFrame(pa.table(columns))

    def whole(self, spark) -> DataFrame:
        """(template, keys, own): band keys and distinct shingles, a row a template."""
        longs = pa.list_(pa.int64())
        names = sorted(self.shingles)
        return spark.createDataFrame(pa.table({"template": names, "keys": pa.array([self.keys[t] for t in names], longs), "own": pa.array([self.shingles[t] for t in names], longs)}))


def _may(bits: str, h: str) -> str:
    """SQL: whether a bit array may hold a key; others pass by chance, one in hundreds."""
    tests = [f"(get({bits}, cast(shiftright({h}, {a}) & (size({bits}) - 1) as int)) & shiftleft(1L, cast(shiftright({h}, {b}) & 63 as int))) <> 0" for a, b in ((0, 32), (16, 26))]
    return " and ".join(tests)


def blocks(templates: dict[str, str]) -> list[dict[str, str]]:
    """Templates in blocks that one pass over the documents takes."""
    out, chars = [{}], 0
    for k, t in templates.items():
        if out[-1] and (chars + len(t) > MAX_TEMPLATE_CHARS or len(out[-1]) == MAX_TEMPLATES):
            out.append({})
            chars = 0
        out[-1][k] = t
        chars += len(t)
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = CONTAINMENT) -> DataFrame:
    """(doc_id, template, window_start, first_word, containment): a row for each window that holds a template.

    Words count from 0; first_word is where the first of the template's shingles
    lies.  Templates beyond MAX_TEMPLATES or MAX_TEMPLATE_CHARS take a pass over
    the documents for each block; one that is longer by itself is an error.
    """
    found = [_scan(docs, b, least) for b in blocks(TEMPLATES if templates is None else templates)]
    return reduce(DataFrame.unionByName, found)


def _scan(docs: DataFrame, templates: dict[str, str], least: float) -> DataFrame:
    spark = docs.sparkSession
    made = Templates(spark, templates)
    if not made.shingles:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id")).limit(0).selectExpr("doc_id", "'' as template", "0 as window_start", "0 as first_word", "cast(0 as double) as containment")
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(_words(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w)).alias("h"))
    signed = hashed.select("doc_id", *(_shingles(F.col("h"), n).alias(f"s{n}") for n in sorted({n for n, _ in made.classes})))
    # one row of bit arrays, so that what the plan says does not depend on the templates
    signed = signed.join(F.broadcast(made.filters(spark)))
    # places that may be of use to any class are found once
    some = {n: F.expr(f"filter(transform(s{n}, (h, i) -> case when {_may(f'b{n}', 'h')} then struct(h as h, i as i) end), x -> x is not null)").alias(f"c{n}") for n in {n for n, _ in made.classes}}
    signed = signed.select("*", *some.values())
    windows = []
    for size, c in sorted(made.classes):
        step, s = 2 << c, F.col(f"s{size}")
        at = F.expr(f"transform(filter(c{size}, x -> {_may(f'b{size}_{c}', 'x.h')}), x -> x.i)")
        # each place is in two windows; the last window reaches the end
        last = F.greatest(F.lit(0), F.ceil((F.size(s) - 2 * step) / step)).cast("int")
        place = lambda i, back: F.greatest(F.lit(0), F.least(F.floor(i / step).cast("int") - back, last))
        number = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(place(i, 0), place(i, 1)))))
        windows.append(F.transform(number, lambda w: F.struct(F.lit(size).alias("size"), F.lit(c).alias("c"), (w * step).alias("window_start"), F.slice(s, w * step + 1, F.lit(2 * step)).alias("x"), F.col(f"b{size}_{c}").alias("bits"))))
    # a document without any of the templates' smallest shingles has no window to sign; a row has its own window's shingles only
    rows = signed.select("doc_id", F.explode(F.concat(*windows)).alias("w")).select("doc_id", "w.*")
    rows = rows.withColumn("k", F.array(*(F.array_min(F.transform("x", lambda h: F.struct(_seeded(h, b).alias("o"), h.alias("h"))))["h"] for b in range(BANDS))))
    # windows meet templates by band; a pair that meets in several bands is taken from the first
    some = F.expr(f"filter(transform(k, (h, i) -> struct(i as band, h as key)), x -> {_may('bits', 'x.key')})")
    near = rows.withColumn("some", some).drop("bits").select("*", F.inline("some")).drop("some").join(F.broadcast(made.bands(spark)), ["size", "c", "band", "key"])
    met = near.join(F.broadcast(made.whole(spark)), "template").filter(F.array_position(F.zip_with("k", "keys", lambda a, b: a == b), True) == F.col("band") + 1)
    held = met.withColumn("common", F.array_intersect("x", "own"))  # in the order of x
    held = held.withColumn("containment", F.size("common") / F.size("own")).filter(F.col("containment") >= least)
    first = F.col("window_start") + F.array_position("x", F.col("common")[0]) - 1
    return held.select("doc_id", "template", "window_start", first.cast("int").alias("first_word"), "containment")
