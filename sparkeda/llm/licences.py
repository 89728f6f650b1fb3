"""Licence scans by Dice coefficient over word bigrams (operator 10).

Lines, blocks between blank lines, whole texts and passages anywhere in a text are normalised and
compared with licence templates: twice the number of common bigrams over the sum of both sizes.
A template is a candidate only if its size lets it reach the threshold, and a text is looked at
only if it has one of the bigrams without which no template can.  A passage has its template's
number of words and starts where one of the template's rarer bigrams puts it, whatever lines and
comment marks it runs over.  Only DataFrame functions, no shuffle.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import DataFrame, functions as F

_WARRANTY = ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
             "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
             "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
             "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_MIT = ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _WARRANTY)
_ISC = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, '
        "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
        "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
        "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
#: Licence notices, whole licences and their paragraphs (fixed values): identifier -> texts.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
                   'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
                   "specific language governing permissions and limitations under the License.",
                   "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.",
            *_MIT, " ".join(_MIT), "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
                "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
                "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"),
    "ISC": (*_ISC, " ".join(_ISC), "SPDX-License-Identifier: ISC"),
    "BSD-2-Clause": (" ".join(_BSD[:3] + _BSD[4:]), "SPDX-License-Identifier: BSD-2-Clause"),
    "BSD-3-Clause": (_BSD[0], _BSD[3], " ".join(_BSD), "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
                "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
}
THRESHOLD = 0.8
#: Word characters of the normal form; everything else separates words.
NOT_WORD = "[^a-z0-9.]+"
#: Words too common to tell that a text has a licence (fixed values).
COMMON = set("the of and or to in a is be an any as at by for with this under on that shall you it not no all use general are".split())


def normal_words(text: str) -> list[str]:
    """Lower case, words of letters, digits and inner dots (``version 2.0.`` -> ``version``, ``2.0``)."""
    words = (re.sub(r"^\.+|\.+$", "", w) for w in re.split(NOT_WORD, _lower(text)))
    return [w for w in words if w]


def _lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def template_rows(templates: dict = TEMPLATES) -> list[tuple[str, int, list[str]]]:
    """``(licence, part, bigrams)`` per template text."""
    return [(k, n, bigrams(normal_words(t))) for k, texts in templates.items() for n, t in enumerate(texts)]


def anchor_bigrams(templates: dict = TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """``(bigram, template text, offset)``: of each text so many of its rarer bigrams that whatever reaches the
    threshold has one of them, with all offsets in words that they stand at; texts are numbered as in
    ``template_rows`` without those that have no bigram.

    To reach it, a unit shares at least ``threshold / (2 - threshold)`` of the text's bigrams, so it has one of any
    set of bigrams that is larger than the rest."""
    rows = [(normal_words(templates[k][n]), grams) for k, n, grams in template_rows(templates) if grams]
    seen, chosen = Counter(g for _, grams in rows for g in grams), []
    for number, (words, grams) in enumerate(rows):
        at = [f"{a} {b}" for a, b in zip(words, words[1:])]
        need = len(grams) - threshold / (2 - threshold) * len(grams)
        rare = sorted(grams, key=lambda g: (sum(w in COMMON for w in g.split()), at.count(g), seen[g], g))[:int(need + 1e-9) + 1]
        chosen += [(g, number, p) for g in rare for p, x in enumerate(at) if x == g]
    return chosen


def bigram_pattern(grams: list[str]) -> str:
    """A pattern that finds every lower-case text with one of the bigrams, by first letter, first word and second word."""
    tree: dict = {}
    for a, b in sorted(g.split() for g in set(grams)):
        tree.setdefault(a[0], {}).setdefault(a[1:], []).append(b)

    def one(first, seconds):
        return re.escape(first) + r"\.*[^a-z0-9.][^a-z0-9]*(?:" + "|".join(map(re.escape, seconds)) + ")"

    letters = [c + "(?:" + "|".join(one(a, b) for a, b in rest.items()) + ")" for c, rest in tree.items()]
    return "(?<![a-z0-9])(?:" + "|".join(letters) + ")(?![a-z0-9])"


def _ascii_lower(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: What keeps a passage's start positive beside its template's number: no template has as many words.
_ORIGIN = 1 << 16


def _passages(grams, parts, anchors, n_licences: int, score, threshold: float):
    """Passages of a text whose bigrams are ``grams``, in order: ``(unit_no, n_words, dice of each licence)``."""
    places = F.from_json(F.lit(json.dumps(anchors)), "map<string,array<bigint>>")  # one constant
    hits = F.filter(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda h: h.g.isin(list(anchors)))
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(places, h.g), lambda p: p + h.i))))

    def window(c):
        part, start = F.get(parts, F.shiftright(c, 32).cast("int")), (c.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(_ORIGIN)).cast("int")
        return F.struct(part.alias("part"), F.greatest(start, F.lit(0)).alias("lo"), F.least(start + part.n, F.size(grams) + 1).alias("hi"))

    def scored(x):
        own = F.array_distinct(F.slice(grams, x.lo + 1, x.hi - x.lo - 1))
        # an array of one element names the bigrams once
        dice = F.element_at(F.transform(F.array(own), lambda g: score(g, x.part.grams)), 1)
        return F.struct(x.lo.alias("lo"), x.hi.alias("hi"), x.part.licence.alias("k"), dice.alias("dice"))

    found = F.array_sort(F.filter(F.transform(F.transform(starts, window), scored), lambda x: x.dice >= F.lit(threshold)))
    none = F.array_repeat(F.lit(0.0), n_licences)

    def closed(acc):
        return F.array(F.struct(acc.start.alias("unit_no"), (acc.end - acc.start).alias("n_words"), acc.dice.alias("dice")))

    def step(acc, x):
        new = x.lo >= acc.end
        dice = F.transform(F.when(new, none).otherwise(acc.dice), lambda d, k: F.when(k == x.k, F.greatest(d, x.dice)).otherwise(d))
        return F.struct(F.when(new, x.lo).otherwise(acc.start).alias("start"), F.greatest(acc.end, x.hi).alias("end"), dice.alias("dice"),
                        F.when(new & (acc.end >= 0), F.concat(acc.done, closed(acc))).otherwise(acc.done).alias("done"))

    empty = F.array().cast("array<struct<unit_no:int,n_words:int,dice:array<double>>>")
    zero = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), none.alias("dice"), empty.alias("done"))
    return F.aggregate(found, zero, step, lambda acc: F.when(acc.end < 0, empty).otherwise(F.concat(acc.done, closed(acc))))


def scan(docs: DataFrame, templates: dict = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per unit of text and licence that it reaches ``threshold`` with:
    ``doc_id, unit, unit_no, n_words, licence, dice, best``.

    ``unit`` is ``line``, ``block`` (lines between blank lines, if more than one), ``text`` (if more than one
    block) or ``passage``; ``unit_no`` counts from 0 within the text, for a passage it is the offset of its first word among the
    text's.  A passage is a run of windows that reach the threshold and share words; a window has its template's
    number of words (fewer at the text's ends) and is placed by one of ``anchor_bigrams``.  Of a licence's
    texts and windows the best counts; ``best`` marks the unit's highest ``dice``, ties included.  Bigrams are sets, texts lower-case A-Z.
    Null and empty texts and units under two words match nothing; repeated rows repeat their results."""
    rows = [(k, n, g) for k, n, g in template_rows(templates) if g]
    names = list(dict.fromkeys(k for k, _, _ in rows))
    anchors: dict = {}
    for g, number, p in anchor_bigrams(templates, threshold):
        anchors.setdefault(g, []).append((number << 32) + _ORIGIN - p)
    some = bigram_pattern(list(anchors))
    d = docs.select(F.col(id_col).alias("doc_id"), _ascii_lower(F.col(text_col)).alias("t")).where(F.col("t").rlike(some))
    lines = F.expr("transform(split(t, '\\n', -1), (x, i) -> struct('line' AS unit, i AS unit_no, x AS body))")
    blocks = F.expr(r"transform(split(t, '\\n[ \\t\\r]*\\n', -1), (x, i) -> struct('block' AS unit, i AS unit_no, x AS body))")
    d = d.select("doc_id", "t", lines.alias("lines"), blocks.alias("blocks"))
    blocks = F.expr(r"filter(blocks, b -> instr(b.body, '\n') > 0)")
    whole = F.expr("IF(size(blocks) > 1, array(struct('text' AS unit, 0 AS unit_no, t AS body)), slice(lines, 1, 0))")
    any_ = F.expr("array(struct('passage' AS unit, 0 AS unit_no, t AS body))")
    u = d.select("doc_id", F.explode(F.concat(F.col("lines"), blocks, whole, any_)).alias("u")).select("doc_id", "u.*").where(F.col("body").rlike(some))
    words = F.filter(F.transform(F.split("body", NOT_WORD), lambda w: F.regexp_replace(w, r"^\.+|\.+$", "")), lambda w: w != "")
    u = u.select("doc_id", "unit", "unit_no", words.alias("w"))
    u = u.select("doc_id", "unit", "unit_no", F.size("w").alias("n_words"), F.expr(
        "transform(slice(w, 2, greatest(size(w) - 1, 0)), (x, i) -> concat(w[i], ' ', x))").alias("grams"))
    u = u.select("*", F.array_distinct("grams").alias("g"))
    # no filter here: it would be pushed below the arrays and build them again for each element
    # the templates are one constant: an array of their texts' bigrams, and one of them by licence
    parts = [{"licence": names.index(k), "n": len(normal_words(templates[k][n])), "grams": g} for k, n, g in rows]
    known = F.from_json(F.lit(json.dumps([[p["grams"] for p in parts if names[p["licence"]] == k] for k in names])), "array<array<array<string>>>")
    parts = F.from_json(F.lit(json.dumps(parts)), "array<struct<licence:int,n:int,grams:array<string>>>")
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9

    def dice(g, t):
        return F.when(F.size(g).between(F.lit(low) * F.size(t), F.lit(high) * F.size(t)),
                      F.lit(2.0) * F.size(F.array_intersect(g, t)) / (F.size(g) + F.size(t))).otherwise(F.lit(0.0))

    each = F.transform(known, lambda texts: F.array_max(F.transform(texts, lambda t: dice(F.col("g"), t))))
    found = F.when(F.col("unit") == "passage", _passages(F.col("grams"), parts, anchors, len(names), dice, threshold)).otherwise(
        F.array(F.struct("unit_no", "n_words", each.alias("dice"))))
    r = u.select("doc_id", "unit", F.explode(found).alias("f"))
    licences = F.transform(F.array(*[F.lit(k) for k in names]), lambda k, i: F.struct(
        k.alias("licence"), F.get(F.col("f.dice"), i).alias("dice"), (F.get(F.col("f.dice"), i) == F.array_max("f.dice")).alias("best")))
    r = r.select("doc_id", "unit", "f.unit_no", "f.n_words", F.explode(F.filter(licences, lambda x: x.dice >= F.lit(threshold))).alias("m"))
    return r.select("doc_id", "unit", "unit_no", "n_words", "m.licence", "m.dice", "m.best")
