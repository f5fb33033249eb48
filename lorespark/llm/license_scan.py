"""License scans by Dice coefficient over word bigrams, in column expressions only.

Each line of a document, and the whole text, is normalised (letters and digits, lower case, one space) and compared
with licence templates: 2 |A and B| / (|A| + |B|) over their distinct word bigrams. Bigram sets whose sizes are too
far apart cannot reach the threshold t: |A| must lie within t / (2 - t) and (2 - t) / t times |B|, which leaves few
templates, mostly none, to compare with. Every window of as many bigrams as a template has is compared with it too, so
that a wrapped notice among other lines and a sentence of a longer line are found.

A match shares at least t / (2 - t) of a template's bigrams. So texts without any of a few words, chosen so that fewer
bigrams of every template do without them, are passed over before anything is hashed, and a template's windows are only
looked at in texts with so many of its bigrams; both lose nothing. Nothing is shuffled; a document is judged where it is read.

Bigrams stand as XXH64 hashes. The templates are a parameter of bounded size, folded into the plan as a constant.

Defined results: a null or empty text and units of fewer than two words match nothing. A line or the
whole text goes before a window of the same licence or score; of equal scores the earlier template, then the earlier
unit wins. Equal texts get equal results; further columns stay as they are.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Sequence

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Notices and licence texts as their publishers word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
    ("BSD-2-Clause", "Licensed under the 2-Clause BSD License."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.'),
    ("LGPL-3.0", 'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("AGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.'),
    ("GPL-2.0", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.'),
    # what licence files open with: the files themselves are longer than any window need be
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("MPL-2.0", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES."),
    ("CC-BY-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution-NonCommercial 4.0 International Public License"),
)

OTHER = r"[^\p{L}\p{N}\n]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.sub(r"[\W_]+", " ", text.lower()).split(" ") if w]


#: Words that say little: a template is known by others where it has them.
COMMON = frozenset("a an and any are as be by for in is of on or other the this to under with you".split())


def bigrams(text: str) -> list[tuple[str, str]]:
    words = words_of(text)
    return sorted(set(zip(words, words[1:], strict=False)))


def telling(templates: Sequence[tuple[str, str]], threshold: float) -> list[str]:
    """Words of which every text that reaches the threshold with a template has one.

    Per template, words go in that are in most bigrams yet without one, long ones first as they are rarer in other texts,
    until the bigrams without them are too few.
    """
    found: set[str] = set()
    for _, text in templates:
        grams = bigrams(text)
        need, left = len(grams) * threshold / (2 - threshold) - 1e-9, [g for g in grams if not found.intersection(g)]
        while left and len(left) >= need:
            count = Counter(w for g in left for w in set(g))
            word = max(count, key=lambda w: (w not in COMMON, len(w) >= 7, count[w], len(w), w))
            found.add(word)
            left = [g for g in left if word not in g]
    return sorted(found)


def _templates(templates: Sequence[tuple[str, str]]) -> Column:
    """A constant array of (rank, license, n, w, grams); w counts bigrams with repeats."""
    rows = []
    for rank, (name, text) in enumerate(templates):
        grams = sorted({xxhash.xxh64_intdigest(f"{a} {b}", seed=42) for a, b in bigrams(text)})
        rows.append({"rank": rank, "license": name, "n": len(grams), "w": len(words_of(text)) - 1, "grams": [g - (1 << 64) if g >= 1 << 63 else g for g in grams]})
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<rank:int,license:string,n:int,w:int,grams:array<bigint>>>")


def _hashed(words: Column) -> Column:
    """The bigrams of an array of words, in turn, as hashes."""
    return F.get(F.transform(F.array(words), lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, k: F.xxhash64(F.concat_ws(" ", x, F.get(w, k + 1))))), 0)


def _grams(unit: Column) -> Column:
    """The distinct bigrams of a normalised text, as hashes."""
    return F.array_distinct(_hashed(F.split(F.trim(unit), " ")))


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """docs with license, dice, line (from 1; 0: the whole text), word, n_matches; all null and 0 matches where there is none.

    n_matches is the number of matching units, or where only windows match of the templates that have one. Where a window
    is the best match, line is null and word its first word (from 0).
    """
    # normalised once as a whole, line ends kept; as columns, since each is used more than once
    names = ("license", "dice", "line", "word", "n_matches")
    own = {c: c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)}  # own names cannot clash
    rows = docs.toDF(*own.values()).withColumn("_clean", F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), OTHER, " "))
    rows = rows.withColumn("_words", F.split("_clean", r"[ \n]+"))
    # all words but the telling ones are let go here
    rows = rows.withColumn("_some", F.arrays_overlap("_words", F.array(*[F.lit(w) for w in telling(templates, threshold)])))
    rows = rows.withColumn("_lines", F.when(F.col("_some"), F.split("_clean", "\n", -1)))
    lines = F.col("_lines")
    units = F.when(F.size(lines) > 1, F.concat(F.array(F.regexp_replace("_clean", r"[ \n]+", " ")), lines)).otherwise(lines)
    # a single line is line 1
    shift = F.when(F.size(lines) > 1, F.lit(0)).otherwise(F.lit(1))
    known, low, high = _templates(templates), threshold / (2 - threshold), (2 - threshold) / threshold

    def dice(g: Column, t: Column) -> Column:
        return 2.0 * F.size(F.array_intersect(g, t.grams)) / (F.size(g) + t.n)

    def best(g: Column, k: Column) -> Column:
        """The best template of a unit; null below the threshold."""
        fit = F.filter(known, lambda t: (t.n > 0) & (F.size(g) >= F.ceil(t.n * low - 1e-9)) & (F.size(g) <= F.floor(t.n * high + 1e-9)))
        scored = F.transform(fit, lambda t: F.struct(dice(g, t).alias("dice"), (-t["rank"]).alias("rank"), (-k).alias("unit"), t.license.alias("license")))
        return F.array_max(F.filter(scored, lambda s: s.dice >= threshold))

    none = F.array().cast("array<struct<dice:double,rank:int,unit:int,license:string>>")
    found = F.filter(F.transform(F.transform(units, _grams), best), lambda s: s.isNotNull())
    rows = rows.withColumn("_shift", shift).withColumn("_units", F.when(F.col("_some"), found).otherwise(none))
    rows = rows.withColumn("_turn", F.when(F.col("_some"), _hashed(F.filter("_words", lambda w: w != ""))))
    rows = rows.withColumn("_set", F.array_distinct("_turn"))

    def window(t: Column) -> Column:
        """The best window of a template: windows begin where one of its bigrams does."""
        starts = F.filter(F.transform("_turn", lambda g, k: F.when(F.array_contains(t.grams, g), k)), lambda k: k.isNotNull())
        scored = F.transform(starts, lambda k: F.struct(dice(F.array_distinct(F.slice(F.col("_turn"), k + 1, t.w)), t).alias("dice"), (-t["rank"]).alias("rank"), (-k).alias("unit"), t.license.alias("license")))
        return F.array_max(F.filter(scored, lambda s: s.dice >= threshold))

    likely = F.filter(known, lambda t: (t.n > 0) & (F.size(F.array_intersect(F.col("_set"), t.grams)) >= F.ceil(t.n * low - 1e-9)))
    rows = rows.withColumn("_windows", F.when(F.col("_turn").isNotNull(), F.filter(F.transform(likely, window), lambda s: s.isNotNull())).otherwise(none))
    rows = rows.withColumn("_unit", F.array_max("_units")).withColumn("_window", F.array_max("_windows"))
    rows = rows.withColumn("_whole", F.col("_unit").isNotNull() & (F.col("_window").isNull() | (F.col("_unit.dice") >= F.col("_window.dice")) | (F.col("_unit.license") == F.col("_window.license"))))
    unit, part = F.col("_unit"), F.col("_window")
    return rows.select(
        *[F.col(o).alias(c) for c, o in own.items() if c not in names],
        *[F.when(F.col("_whole"), unit[x]).otherwise(part[x]).alias(x) for x in ("license", "dice")],
        F.when(F.col("_whole"), F.col("_shift") - unit.unit).alias("line"), F.when(~F.col("_whole"), -part.unit).alias("word"),
        F.when(F.size("_units") > 0, F.size("_units")).otherwise(F.size("_windows")).cast("long").alias("n_matches"),
    )
