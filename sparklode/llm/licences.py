"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Normalised: A-Z lower-cased, every run of ASCII characters other than letters and digits becomes one space. Units of a
text are each of its lines (kind `line`, numbered from 0), each block of at least two lines between empty lines (kind
`block`, numbered by its place among the stretches between empty lines) and, if it has several lines, the whole text
(kind `text`, 0). A unit's bigrams are the distinct pairs of neighbouring words; a unit of fewer than two words has none
and matches nothing. The Dice coefficient of sets A and B is 2 |A and B| over |A| + |B|; at least `DICE` of it is needed,
so |B| has to lie between DICE / (2 - DICE) and (2 - DICE) / DICE times |A|, and other templates are never candidates.
Ties go to the alphabetically first template.

Every input row gives one result row: null and empty texts match nothing, repeated rows and rows without an id are
matched each by itself, other columns are ignored whatever their names, an empty table gives no rows.

A text is normalised in one pass that keeps its line feeds, so lines, blocks and whole text come from the same string.
Units with too few words for any template, or with more distinct words than the largest could explain, are left out
before their bigrams are made (d distinct words in a row make at least d - 1 distinct bigrams). So are units, and texts,
without an anchor: a match shares at least DICE / (2 - DICE) of a template's bigrams, so of any set of more than the rest
of them it has one; `anchors` picks words and word pairs that make up such a set for every template. Bigrams meet the
templates' in a broadcast join: the templates are a fixed list, whatever the input. Only bigrams that a fitting template
has are shuffled, counted first where they are found.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklode.llm.exact import LOWER, UPPER

DICE = 0.8

# Published licence notices and short licences.
TEMPLATES = {
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. "
        "If not, see <https://www.gnu.org/licenses/>."
    ),
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        'documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" '
        "AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, "
        "OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" '
        "AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, "
        "OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
        "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-3.0-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. "
        "If not, see <https://www.gnu.org/licenses/>."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions "
        "that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an "
        "overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, "
        "please refer to <https://unlicense.org>"
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that "
        "you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution."
    ),
}


def normalised(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(licence, template_size, bigram): one row per distinct bigram of each template."""
    rows = spark.createDataFrame(list(templates.items()), "licence string, text string")
    bigrams = rows.select("licence", bigrams_of(F.split(normalised(F.col("text")), " ")).alias("bigrams"))
    return bigrams.select("licence", F.size("bigrams").alias("template_size"), F.explode("bigrams").alias("bigram"))


def bigrams_of(words: Column) -> Column:
    """The distinct pairs of neighbouring words, each joined by a space."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def anchors(templates: dict[str, str], dice: float = DICE) -> str:
    """A pattern that is found, in either case of A-Z, in every text that any template reaches `dice` with.

    Words and pairs of words are taken one after another, those first that cover most of what is still needed; short ones
    count as costly, for they are found in many texts.
    """
    need: dict[str, int] = {}
    covers: dict[tuple[str, ...], set[tuple[str, tuple[str, str]]]] = {}
    for name, text in templates.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        bigrams = set(itertools.pairwise(words))
        need[name] = len(bigrams) - math.ceil(len(bigrams) * dice / (2 - dice) - 1e-9) + 1
        for pair in bigrams:
            for item in {pair[:1], pair[1:], pair}:
                covers.setdefault(item, set()).add((name, pair))
    chosen: list[tuple[str, ...]] = []
    covered: set[tuple[str, tuple[str, str]]] = set()

    def gain(item: tuple[str, ...]) -> float:
        fresh = Counter(name for name, _ in covers[item] - covered)
        return sum(min(n, max(0, need[name])) for name, n in fresh.items()) / (1 + 2000 * 3.0 ** -len("".join(item)))

    while any(n > 0 for n in need.values()):
        best = max(sorted(covers), key=gain)
        for name, n in Counter(name for name, _ in covers[best] - covered).items():
            need[name] -= n
        covered |= covers.pop(best)
        chosen.append(best)
    # Alternatives are grouped by their first character, and tried only where a word may start.
    gap = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    grouped: dict[str, list[str]] = {}
    for item in sorted(chosen):
        written = gap.join(map(re.escape, item))
        grouped.setdefault(item[0][0], []).append(written.removeprefix(re.escape(item[0][0])))
    return "(?i)(?<![a-z0-9])(?:" + "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in grouped.items()) + ")"


#: The kind of a row that stands for its document, whether or not anything matches.
NO_UNIT = "none"


def units(docs: DataFrame, anchor: str) -> DataFrame:
    """(row, doc_id, kind, number, words) of docs (row, doc_id, text), the words normalised; and one row of kind `NO_UNIT` a document.

    Texts without the anchor have no units, and units without it no words.
    """
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    # Every run of other ASCII characters but line feeds becomes a space, then spaces beside line feeds go.
    spaced = F.regexp_replace(low, r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    flat = docs.select("row", "doc_id", F.trim(F.regexp_replace(spaced, " ?\n ?", "\n")).alias("flat"))
    parts = flat.select("row", "doc_id", "flat", F.split("flat", "\n", -1).alias("lines"), F.split("flat", "\n\n+", -1).alias("stretches"))

    def made(kind: str, number: Column, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), number.cast("int").alias("number"), text.alias("text"))

    none = F.array().cast("array<struct<kind:string,number:int,text:string>>")
    lines = F.transform("lines", lambda line, k: made("line", k, line))
    stretches = F.transform("stretches", lambda part, k: made("block", k, F.btrim(part, F.lit("\n"))))
    several = F.transform(F.filter(stretches, lambda b: F.instr(b["text"], "\n") > 0), lambda b: made("block", b["number"], F.translate(b["text"], "\n", " ")))
    blocks = F.when(F.array_contains("lines", ""), several).otherwise(none)
    whole = F.when(F.size("lines") > 1, F.array(made("text", F.lit(0), F.trim(F.regexp_replace("flat", "\n+", " "))))).otherwise(none)
    own = F.array(made(NO_UNIT, F.lit(0), F.lit("")))
    every = F.when(F.col("flat").isNotNull(), F.concat(lines, blocks, whole, own)).otherwise(own)
    found = parts.select("row", "doc_id", F.explode_outer(every).alias("u"))
    return found.select("row", "doc_id", "u.kind", "u.number", F.when(F.col("u.text").rlike(anchor), F.split("u.text", " ")).alias("words"))


def unit_matches(docs: DataFrame, templates: dict[str, str], dice: float) -> DataFrame:
    """(row, doc_id, kind, number, licence, dice) of docs (row, doc_id, text): the templates each unit reaches `dice` with.

    One more row of kind `NO_UNIT`, without a licence, stands for every document.
    """
    known = template_table(docs.sparkSession, templates)
    smallest, largest = known.agg(F.min("template_size"), F.max("template_size")).first()
    least, most = smallest * dice / (2 - dice), largest * (2 - dice) / dice
    fits = (F.size("words") - 1 >= F.lit(least)) & (F.size(F.array_distinct("words")) - 1 <= F.lit(most))
    bigrams = F.when(F.col("kind") == NO_UNIT, F.array(F.lit(""))).when(fits, bigrams_of(F.col("words")))
    # The size is taken below the explosion, which else would copy the array to each of its rows; an outer explosion infers
    # no filter on the array, which would make it once more.
    each = units(docs, anchors(templates, dice)).select("row", "doc_id", "kind", "number", bigrams.alias("bigrams"))
    each = each.select("row", "doc_id", "kind", "number", "bigrams", F.size("bigrams").alias("unit_size"))
    each = each.select("row", "doc_id", "kind", "number", "unit_size", F.explode_outer("bigrams").alias("bigram"))
    wanted = known.select("licence", "template_size", F.col("bigram").alias("wanted"))
    wanted = wanted.unionByName(docs.sparkSession.createDataFrame([(None, 1, "")], "licence string, template_size int, wanted string"))
    bound = (F.col("template_size") >= F.col("unit_size") * (dice / (2 - dice))) & (F.col("template_size") <= F.col("unit_size") * ((2 - dice) / dice))
    shared = each.join(F.broadcast(wanted), (F.col("bigram") == F.col("wanted")) & bound)
    found = shared.groupBy("row", "doc_id", "kind", "number", "unit_size", "licence", "template_size").agg(F.count("*").alias("both"))
    score = 2.0 * F.col("both") / (F.col("unit_size") + F.col("template_size"))
    return found.select("row", "doc_id", "kind", "number", "licence", score.alias("dice")).where(F.col("dice") >= dice)


def best_first(licence: str = "licence", dice: str = "dice") -> Column:
    """The alphabetically first of the best templates, as (dice, licence)."""
    return F.struct((-F.col(dice)).alias("minus"), F.col(licence).alias("licence"))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def licence_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """(doc_id, kind, number, licence, dice): the best template of every unit that reaches `dice`."""
    found = unit_matches(numbered(docs, id_col, text_col), templates or TEMPLATES, dice).where(F.col("licence").isNotNull())
    best = found.groupBy("row", "doc_id", "kind", "number").agg(F.min(best_first()).alias("best"))
    return best.select("doc_id", "kind", "number", F.col("best.licence").alias("licence"), (-F.col("best.minus")).alias("dice"))


def licences_by_document(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, dice: float = DICE) -> DataFrame:
    """(doc_id, n_matches, licences, best_dice), one row per input row; licences sorted and comma-joined, best_dice null without one."""
    found = unit_matches(numbered(docs, id_col, text_col), templates or TEMPLATES, dice)
    best = found.groupBy("row", "doc_id", "kind", "number").agg(F.min(F.when(F.col("licence").isNotNull(), best_first())).alias("best"))
    by_row = best.groupBy("row", "doc_id").agg(
        F.count("best").alias("n_matches"), F.array_join(F.sort_array(F.collect_set("best.licence")), ",").alias("licences"), F.max(-F.col("best.minus")).alias("best_dice")
    )
    return by_row.drop("row")
