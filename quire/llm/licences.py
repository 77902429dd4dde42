"""Licence scans: lines, whole texts and windows of words compared with licence templates.

A text is normalised (lower case, every run of characters other than letters and digits becomes one space) and
taken as its set of word bigrams; a single word counts as one bigram of itself. The Dice coefficient
2 |A & B| / (|A| + |B|) of a segment and a template must reach ``least``. That bounds sizes: |B| must lie
between least / (2 - least) * |A| and (2 - least) / least * |A|, which prunes the templates that a segment is compared with.
It also bounds what is common: a segment that matches has all but (1 - least / (2 - least)) |B| of the template's bigrams. So of
any larger subset, its ``signals`` (the longest bigrams), it has one, and texts without a signal of any template leave at once.

Segments:

* the lines of a text and, if it has more than one, the whole text (line_no 0): the template of the highest coefficient, of equal ones
  the smallest name;
* windows of as many words as a template has, laid so that one of its signals is where the template has it (a notice within a line,
  over several lines, or the text of a licence within a file). Of windows that overlap only those stay that no better one overlaps:
  by coefficient, name, first word. They have line_no null and first_word, counted from 0 in the normalised text.

Only DataFrame functions; templates and signals are literals, which grow with the list of templates alone.

Edge cases: null and empty texts and segments without a letter or digit match nothing; repeated rows give their
rows again; templates with null or empty texts are ignored; very long texts are scanned whole; an empty table or list gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (name, notice) of common licences as they stand in source files and pages.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_COPIES = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A '
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)


def _gnu(name: str, which: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, {which}. "
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


#: Texts and file headers of licences (fixed values: the licences' own words).
TEMPLATES += [
    ("AGPL-3.0", _gnu("GNU Affero General Public License", "either version 3 of the License, or (at your option) any later version")),
    ("GPL-2.0", _gnu("GNU General Public License", "either version 2 of the License, or (at your option) any later version")),
    ("GPL-3.0", _gnu("GNU General Public License", "either version 3 of the License, or (at your option) any later version")),
    ("LGPL-3.0", _gnu("GNU Lesser General Public License", "either version 3 of the License, or (at your option) any later version")),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", f"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. {_COPIES} 2. {_BINARY} {_AS_IS}"),
    (
        "BSD-3-Clause",
        f"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. {_COPIES} 2. {_BINARY} 3. Neither the name of the copyright holder "
        f"nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS}",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY '
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT '
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    ),
]


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(words))


def plain_sequence(notice: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in notice.lower()).split()
    return [" ".join(x) for x in zip(words, words[1:], strict=False)] or words


def plain_bigrams(notice: str) -> list[str]:
    return sorted(set(plain_sequence(notice)))


def signals(sequence: list[str], least: float) -> list[str]:
    """The longest bigrams of a template, so many that any segment that matches has one of them."""
    own = sorted(set(sequence), key=lambda g: (-len(g), g))
    common = math.ceil(least * len(own) / (2 - least) - 1e-9)
    return own[: len(own) - common + 1]


def places(kinds: list[tuple[str, list[str]]], least: float) -> dict[str, list[tuple[int, int]]]:
    """By signal: the templates that have it, and where."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, seq) in enumerate(kinds):
        for g in signals(seq, least):
            out.setdefault(g, []).extend((t, o) for o, x in enumerate(seq) if x == g)
    return dict(sorted(out.items()))


def sequences(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    return sorted((name, seq) for name, notice in templates if (seq := plain_sequence(notice or "")))


def _literal(rows: list, schema: str) -> Column:
    return F.from_json(F.lit(json.dumps(rows)), schema)


def scan(documents: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, line_no (from 1; 0 for the whole text, null for windows), first_word (of windows), licence, n_bigrams, dice of ``documents`` (doc_id, text)."""
    kinds = sequences(templates)
    documents = documents.select("doc_id", "text")
    if not kinds:
        kind = documents.schema["doc_id"].dataType.simpleString()
        return documents.limit(0).selectExpr(f"cast(doc_id as {kind}) as doc_id", "0L as line_no", "0L as first_word", "'' as licence", "0L as n_bigrams", "0D as dice")
    known = [{"name": name, "t": t, "n": len(set(seq)), "size": len(seq), "grams": sorted(set(seq))} for t, (name, seq) in enumerate(kinds)]
    sizes = [k["n"] for k in known]
    lo, hi = min(sizes) * least / (2 - least), max(sizes) * (2 - least) / least
    signs = places(kinds, least)
    all_templates = _literal(known, "array<struct<name:string,t:int,n:int,size:int,grams:array<string>>>")
    marks = _literal(list(signs), "array<string>")
    words = _literal(sorted({max(g.split(), key=len) for g in signs}), "array<string>")
    where = _literal([{"g": g, "at": [{"t": t, "o": o} for t, o in at]} for g, at in signs.items()], "array<struct<g:string,at:array<struct<t:int,o:int>>>>")

    def once(value: Column) -> Column:
        # a costly value is made by a generator of one row: no filter on it moves below, so it is evaluated once
        return F.explode(F.array(value))

    def dice(grams: Column, t: Column) -> Column:
        return 2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["n"])

    def fits(grams: Column, t: Column) -> Column:
        return (F.size(grams) * (least / (2 - least)) <= t["n"]) & (F.size(grams) * ((2 - least) / least) >= t["n"])

    texts = documents.select("doc_id", "text", once(F.split(normalise(F.col("text")), " ")).alias("words"))
    texts = texts.where(F.arrays_overlap("words", words))
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))
    texts = texts.select("doc_id", "text", once(F.when(F.size("words") > 1, pairs).otherwise(F.col("words"))).alias("all"), "words")
    # single words are bigrams of themselves in lines of one word
    texts = texts.where(F.arrays_overlap("all", marks) | F.arrays_overlap("words", marks)).select("doc_id", "text", "all")

    lines = F.split("text", "\n", -1)
    segments = F.concat(F.when(F.size(lines) > 1, F.array(F.struct(F.lit(0).cast("bigint").alias("line_no"), F.col("text").alias("segment")))).otherwise(F.array()), F.transform(lines, lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), x.alias("segment"))))
    out = texts.select("doc_id", F.explode(segments).alias("s")).select("doc_id", "s.line_no", "s.segment")
    out = out.select("doc_id", "line_no", once(F.split(normalise(F.col("segment")), " ")).alias("words"))
    out = out.where((F.size("words") >= max(1, int(lo))) & (F.element_at("words", 1) != ""))
    out = out.where(F.size(F.array_distinct("words")) - 1 <= hi)
    out = out.select("doc_id", "line_no", once(bigrams(F.col("words"))).alias("grams"))
    out = out.where((F.size("grams") >= lo) & (F.size("grams") <= hi) & F.arrays_overlap("grams", marks))
    grams = F.col("grams")
    scores = F.transform(F.filter(all_templates, lambda t: fits(grams, t)), lambda t: F.struct((-dice(grams, t)).alias("less"), t["name"].alias("licence")))
    out = out.select("doc_id", "line_no", F.size("grams").cast("bigint").alias("n_bigrams"), once(F.array_min(scores)).alias("best")).where(F.col("best.less") <= -least)
    out = out.select("doc_id", "line_no", F.lit(None).cast("bigint").alias("first_word"), F.col("best.licence").alias("licence"), "n_bigrams", F.round(-F.col("best.less"), 6).alias("dice"))

    every = F.sequence(F.lit(1), F.size("all"))
    at = lambda w: F.transform(F.filter(every, lambda i: F.element_at("all", i) == w["g"]), lambda i: F.transform(w["at"], lambda e: F.struct(e["t"].alias("t"), (i - 1 - e["o"]).alias("start"))))
    starts = F.array_distinct(F.flatten(F.transform(F.filter(where, lambda w: F.array_contains("here", w["g"])), lambda w: F.flatten(at(w)))))

    def window(c: Column) -> Column:
        t = F.element_at(all_templates, c["t"] + 1)
        first = F.greatest(c["start"], F.lit(0))
        own = F.array_distinct(F.slice("all", first + 1, c["start"] + t["size"] - first))
        made = F.transform(F.array(own), lambda g: F.struct((-dice(g, t)).alias("less"), t["name"].alias("licence"), c["start"].alias("start"), c["t"].alias("t"), (c["start"] + t["size"]).alias("end"), F.size(g).alias("n")))
        return F.element_at(made, 1)

    def alone(x: Column) -> Column:
        better = lambda y: F.struct(y["less"], y["licence"], y["start"], y["t"]) < F.struct(x["less"], x["licence"], x["start"], x["t"])
        return ~F.exists("scored", lambda y: (y["start"] <= x["end"]) & (x["start"] <= y["end"]) & better(y))

    windows = texts.select("doc_id", "all", once(F.array_intersect("all", marks)).alias("here")).where(F.size("here") > 0)
    windows = windows.select("doc_id", once(F.filter(F.transform(starts, window), lambda x: x["less"] <= -least)).alias("scored")).where(F.size("scored") > 0)
    windows = windows.select("doc_id", F.explode(F.filter("scored", alone)).alias("x"))
    windows = windows.select("doc_id", F.lit(None).cast("bigint").alias("line_no"), F.greatest("x.start", F.lit(0)).cast("bigint").alias("first_word"), F.col("x.licence").alias("licence"), F.col("x.n").cast("bigint").alias("n_bigrams"), F.round(-F.col("x.less"), 6).alias("dice"))
    return out.unionByName(windows)
