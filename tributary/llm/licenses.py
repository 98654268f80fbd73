"""License scans, native: normalised segments of a text against licence templates by the Dice coefficient over word bigrams.

A text's segments are its lines, its paragraphs, itself, and windows of words wherever a key word stands: as long as a template that has the word, and placed as if the
word were the template's. So a notice is found within a line, and over lines and paragraphs, whatever stands around it. Segments are compared as normalised words. A segment is compared with a template only if their sizes allow the
coefficient: with a threshold t, a segment of a distinct bigrams and a template of b can reach it only for b * t / (2 - t) <= a <= b * (2 - t) / t. Before that a
segment must hold one of a few key words, chosen so that no segment without any of them can reach the threshold with any template (see
key_words); this drops no match.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import ascii_lower, let
from .shared import column

#: Percent of the Dice coefficient that counts as a match.
PERCENT = 80

#: Licence notices as their publishers word them.
TEMPLATES: dict[str, str] = {
    "Apache-2.0/short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT/short": "Released under the MIT License.",
    "MIT/permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "GPL-3.0/short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0/short": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD/redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC/permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0/short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0/short": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT/full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause/full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC/full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense/first": "This is free and unencumbered software released into the public domain.",
}


#: Words that prose is full of; they become key words only where a template has no others left.
COMMON = frozenset("a an and any are as at be by can by either for from free has have following in into is it its may no not of on one or other rights source that the this to under use version was with without work you".split())


def plain_words(text: str) -> list[str]:
    return re.sub(r"[^A-Za-z0-9]+", " ", text).lower().split()


def plain_bigrams(text: str) -> set[str]:
    """Distinct word bigrams of a normalised text; of one word, the word."""
    w = plain_words(text)
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)} or set(w)


def bounds(size: int, percent: int) -> tuple[int, int]:
    """Fewest and most distinct bigrams of a segment that can reach the threshold with a template of so many."""
    t = Fraction(percent, 100)
    return math.ceil(size * t / (2 - t)), math.floor(size * (2 - t) / t)


def key_words(templates: dict[str, str], percent: int) -> list[str]:
    """Words of which every segment that reaches the threshold holds one at least.

    With a template of b bigrams, a segment must share t / 2 * (a + b) >= b * t / (2 - t) of them. So of any b - ceil(b * t / (2 - t)) + 1 bigrams of the
    template it holds one; words are chosen until the bigrams that they touch are so many: first words that other templates gave, then, of those that
    prose seldom has, the ones that touch most.
    """
    found: list[str] = []
    for text in templates.values():
        own = plain_bigrams(text)
        must = len(own) - bounds(len(own), percent)[0] + 1
        for w in sorted({w for x in own for w in x.split()}, key=lambda w: (w not in found, w in COMMON or w.isdigit(), -sum(w in x.split() for x in own), -len(w), w)):
            if sum(any(k in x.split() for k in found) for x in own) >= must:
                break
            if w not in found:
                found.append(w)
    return sorted(found)


def key_places(templates: dict[str, str], percent: int) -> list[tuple[str, int, int]]:
    """(key word, its place in a template, the template's words), each once."""
    keys = set(key_words(templates, percent))
    return sorted({(w, i, len(own)) for own in map(plain_words, templates.values()) for i, w in enumerate(own) if w in keys})


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")


def _windows(words: Column, places: list[tuple[str, int, int]]) -> Column:
    """Normalised windows around the key words; those that reach over an end of the text are shorter there."""
    of: dict[str, list[Column]] = {}
    for w, i, n in places:
        of.setdefault(w, []).append(F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")))
    table = F.create_map(*(x for w, at in of.items() for x in (F.lit(w), F.array(*at))))

    def around(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), F.element_at(table, w).alias("places"))), lambda h: h["places"].isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(h["places"], lambda p: F.struct((h["at"] - p["i"]).alias("at"), p["n"].alias("n"))))))
        low = lambda s: F.greatest(s["at"], F.lit(0))
        return F.transform(starts, lambda s: F.array_join(F.slice(words, low(s) + 1, s["at"] + s["n"] - low(s)), " "))

    return let(words, around)


def _bigrams(segment: Column) -> Column:
    return let(_words(segment), lambda w: F.when(F.size(w) > 1, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1))))).otherwise(F.array_distinct(w)))


def segment_matches(segment: Column, templates: dict[str, str], percent: int) -> Column:
    """array<struct<dice, template>> of the templates that the segment matches; dice is in millionths, rounded down."""
    table = []
    for name, text in sorted(templates.items()):
        own = plain_bigrams(text)
        low, high = bounds(len(own), percent)
        table.append(F.struct(F.lit(name).alias("template"), F.lit(len(own)).alias("n"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.split(F.lit("|".join(sorted(own))), r"\|").alias("own")))

    def of(b: Column) -> Column:
        may = F.filter(F.array(*table), lambda t: F.size(b).between(t["low"], t["high"]))
        shared = F.transform(may, lambda t: F.struct(F.size(F.array_intersect(t["own"], b)).alias("shared"), (F.size(b) + t["n"]).alias("total"), t["template"].alias("template")))
        good = F.filter(shared, lambda x: 200 * x["shared"] >= percent * x["total"])
        return F.transform(good, lambda x: F.struct(F.floor(F.lit(2_000_000) * x["shared"] / x["total"]).cast("bigint").alias("dice"), x["template"].alias("template")))

    return let(_bigrams(segment), of)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: id, n_matches (different segments, as normalised words, that match a template), licenses (templates matched, sorted, comma-joined),
    best (the template of the highest coefficient; of equals, the first name), best_dice (rounded down to six decimals; null without a match).

    A segment counts for its best template only. Null and empty texts match nothing. Whole texts are read; repeated rows get equal results, an empty table gives an empty
    one. Only id and text are read, so other columns may have any name.
    """
    templates = TEMPLATES if templates is None else templates
    most = max((bounds(len(plain_bigrams(x)), percent)[1] for x in templates.values()), default=0)
    # not \b, which sees letters beyond ASCII and the underscore otherwise than the normalisation does
    words = key_words(templates, percent)
    starts = sorted({w[0] for w in words})
    keys = f"(?i)(?<![a-z0-9])(?:{'|'.join(c + '(?:' + '|'.join(w[1:] for w in words if w[0] == c) + ')' for c in starts)})(?![a-z0-9])"
    text = F.coalesce(F.col("_text"), F.lit(""))
    # a segment has at least a character and a separator for each of its words, but repeats may keep its bigrams few: no bound on length is used
    parts = F.array_distinct(F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n"), F.array(text)))
    plain = F.transform(F.filter(parts, lambda s: s.rlike(keys)), lambda s: F.array_join(_words(s), " ")) if templates and most else F.array().cast("array<string>")
    segments = F.array_distinct(F.concat(plain, _windows(_words(text), key_places(templates, percent)))) if templates and most else plain
    found = F.transform(segments, lambda s: _best(segment_matches(s, templates, percent)))
    found = F.when(text.rlike(keys), F.filter(found, lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<dice:bigint,template:string>>"))
    rows = docs.select(column(id_col).alias("_id"), column(text_col).alias("_text")).select("_id", let(found, _summary).alias("m"))
    return rows.select(F.col("_id").alias(id_col), "m.*")


def _best(matches: Column) -> Column:
    """struct<dice, template> of the highest coefficient, first name among equals; null for none."""
    return F.get(F.array_sort(F.transform(matches, lambda x: F.struct((-x["dice"]).alias("dice"), x["template"].alias("template")))), 0)


def _summary(found: Column) -> Column:
    first = F.get(F.array_sort(found), 0)
    return F.struct(
        F.size(found).cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["template"]))), ",").alias("licenses"),
        first["template"].alias("best"),
        (-first["dice"] / 1_000_000).alias("best_dice"),
    )
