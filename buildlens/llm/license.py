"""Licence scans: Dice coefficient over word bigrams of normalised text. DataFrame operations only.

A template is held against windows of a text: as many consecutive words as the template has, from a place where one of its
bigrams stands (fewer at the text's end). So a notice is found within a line, wrapped over lines, behind comment marks, and
in the middle of a long file alike.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buildlens.llm.common import doc_key

#: Notices by which works name their licence, and short licences in full.
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
LEAST_DICE = 0.75
#: Frequent words; a bigram of these says least about a licence.
PLAIN = frozenset("a all an and any are as at be but by for free from if in including is it may must not of on one or other out see such that the this to under use used version was will with without work you".split())


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams_of(text: str) -> set[str]:
    words = template_words(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def anchors_of(grams: set[str], least: float = LEAST_DICE) -> list[str]:
    """Bigrams of which one at least stands in every window of the least Dice or more.

    From 2 * common >= least * (a + b) and a >= common, common is least / (2 - least) * b at least. So all others may be
    left aside if they are fewer than that; those of plain and short words are.
    """
    needed = math.ceil(round(least / (2 - least) * len(grams), 9))
    by_weight = sorted(grams, key=lambda g: (-sum(w not in PLAIN for w in g.split()), -len(g), g))
    return sorted(by_weight[: len(grams) - needed + 1])


def bigrams(text: Column) -> Column:
    """Word bigrams of the text in order: letters and digits count, in lower case."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.transform(F.array(words), lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))[0]


def license_matches(docs: DataFrame, least: float = LEAST_DICE) -> DataFrame:
    """key, license, dice: of each text its templates of that Dice or more, each with its best window's.

    Dice of sets of a and b bigrams can't reach the least unless the smaller is least / (2 - least) of the larger: only
    windows in these bounds are counted. Templates are constants of the expressions and texts are not shuffled; a text is
    split once, and goes on only with a template one of whose anchors it has.
    """
    table = [(name, len(template_words(text)), sorted(bigrams_of(text)), anchors_of(bigrams_of(text), least)) for name, text in TEMPLATES.items()]
    strings = lambda xs: F.array(*map(F.lit, xs))
    templates = F.array(*[F.struct(F.lit(n).alias("license"), F.lit(w).alias("words"), strings(g).alias("grams"), strings(a).alias("anchors")) for n, w, g, a in table])
    ratio = least / (2 - least)
    anchors = sorted({a for t in table for a in t[3]})
    cut = docs.select(doc_key().alias("key"), F.explode(F.array(bigrams(F.coalesce("text", F.lit("")))))).toDF("key", "grams")
    held = cut.select("key", "grams", F.filter("grams", lambda g: g.isin(anchors)).alias("found")).filter(F.size("found") > 0)
    near = held.select("key", "grams", F.explode(F.filter(templates, lambda t: F.arrays_overlap(t["anchors"], F.col("found")))).alias("t"))
    grams, t, n = F.col("grams"), F.col("t"), F.size("t.grams")
    starts = F.filter(F.sequence(F.lit(1), F.size("grams")), lambda i: F.array_contains(t["grams"], F.element_at(grams, i)))
    windows = near.select("key", "grams", "t", F.explode(starts).alias("start"))
    windows = windows.select("key", "t", F.array_distinct(F.slice(grams, F.col("start"), t["words"] - 1)).alias("own"))
    windows = windows.filter((F.size("own") >= n * ratio) & (F.size("own") * ratio <= n))
    dice = F.lit(2) * F.size(F.array_intersect("own", t["grams"])) / (F.size("own") + n)
    return windows.select("key", F.col("t.license").alias("license"), dice.alias("dice")).filter(F.col("dice") >= least).groupBy("key", "license").agg(F.max("dice").alias("dice"))


def scan_licenses(docs: DataFrame, least: float = LEAST_DICE) -> DataFrame:
    """doc_id, n_licenses, licenses (names in order, comma-joined), best_license, best_dice of every document.

    No match, null or empty text: 0, empty, null, null. A tie of Dice goes to the smaller name. Rows that repeat a
    doc_id and text give the same result each; an empty table gives no rows.
    """
    keyed = docs.select(doc_key().alias("key"), "doc_id")
    per_doc = license_matches(docs, least).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.concat_ws(",", F.array_sort(F.collect_list("license"))).alias("names"),
        F.min(F.struct((-F.col("dice")).alias("dice"), "license")).alias("best"),
    )
    return keyed.join(per_doc, "key", "left").select(
        "doc_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce("names", F.lit("")).alias("licenses"),
        F.col("best.license").alias("best_license"),
        (-F.col("best.dice")).alias("best_dice"),
    )


def _oracle() -> str:
    rows = ", ".join("('" + "', '".join(s.replace("'", "''") for s in item) + "')" for item in TEMPLATES.items())
    grams = r"list_filter([w[i] || ' ' || w[i + 1] for i in range(1, len(w))], lambda s: s IS NOT NULL)"
    words = r"list_filter(string_split_regex(lower(x), '[^\p{L}\p{N}]+'), lambda s: s <> '')"
    return f"""
WITH t AS (SELECT license, len(w) AS k, list_distinct({grams}) AS g FROM (SELECT license, {words} AS w FROM (VALUES {rows}) v(license, x))),
d AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {words} AS w FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents))),
p AS (SELECT doc_id, g, unnest(range(1, len(g) + 1)) AS i FROM d),
h AS (SELECT DISTINCT doc_id, i, license, list_distinct(p.g[i : i + t.k - 2]) AS o, t.g FROM p JOIN (SELECT license, k, g, unnest(g) AS x FROM t) t ON p.g[i] = t.x),
m AS (SELECT doc_id, license, max(2 * len(list_intersect(o, g)) / (len(o) + len(g))) AS dice FROM h WHERE 2 * len(list_intersect(o, g)) / (len(o) + len(g)) >= {LEAST_DICE} GROUP BY ALL),
r AS (SELECT doc_id, count(*) AS n, string_agg(license, ',' ORDER BY license) AS names, arg_min(license, (-dice, license)) AS best, max(dice) AS d FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_licenses, coalesce(names, '') AS licenses, best AS best_license, d AS best_dice
FROM documents LEFT JOIN r USING (doc_id)
"""


ORACLE = _oracle()
