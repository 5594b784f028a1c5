"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from ancestor directories.

Every line of a file is a possible header, every line of a licence file a possible notice. A licence
file's neighbouring lines are also compared as one, and its joined lines with full notices. A line and
a template are compared by the cosine of their TF-IDF vectors; the weights come from the templates,
and terms of no template weigh as much as a term that no template has. Variants (Lesser, NonCommercial) must be the template's, and version numbers among the
line's, so another version or variant is not taken for it. A file's own licence is the
template of its best line at ``threshold`` or more (ties: the first name). A file without one inherits
from the licence file in its nearest ancestor directory (its own directory included; of several in
one directory, the one with the smallest id).

Scale: lines are scored in their rows. Only lines with a telling term are scored, which for a template
with version numbers have one of these besides: without any of a template's telling terms no line can
reach the threshold, because the remaining weights are too small, so the filter loses nothing. Ancestors are exploded (one row for each directory above a file)
and joined with one row for each licensed directory, which is counted and then broadcast or salted,
so a directory with a third of all files is spread over tasks.

Defined cases: null and empty texts have no own licence; a null path has no ancestors, so nothing is
inherited. Repeated rows get equal results. Only the named columns are read. Empty tables give an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch, attach
from ._text import let

# Usual notices and titles of well-known licences, as they stand in a line.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3.", "GNU Affero General Public License, version 3", "GNU Affero General Public License, version 3, 19 November 2007"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Apache License", "Apache License, Version 2.0, January 2004"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Creative Commons Attribution 4.0 International"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2.", "GNU General Public License, version 2", "GNU General Public License, version 2, June 1991"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3.", "GNU General Public License, version 3", "GNU General Public License, version 3, 29 June 2007"],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1.", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 2.1, February 1999"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License, version 3, 29 June 2007"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under the MIT License.", "MIT License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License, version 2.0"],
}
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program."
_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_NEITHER = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
# Full notices, which a licence file has over several lines.
NOTICES = {
    "AGPL-3.0": [_GNU.format("Affero ", "3")],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "BSD-2-Clause": [_CLAUSES + _AS_IS],
    "BSD-3-Clause": [_CLAUSES + _NEITHER + _AS_IS],
    "GPL-2.0": [_GNU.format("", "2")],
    "GPL-3.0": [_GNU.format("", "3")],
    "LGPL-2.1": [_GNU.format("Lesser ", "2.1")],
    "LGPL-3.0": [_GNU.format("Lesser ", "3")],
    "MIT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
# Words that many lines have. They weigh what their TF-IDF says; the exact filter on lines
# only prefers other words to them.
EVERYDAY = frozenset("a an and any be can file for found in is it may not of on or subject that the this to under use with work you".split())
# Terms that tell a licence from its variants: a line has all and only those of the template.
VARIANTS = ("affero", "lesser", "nc", "nd", "noderivatives", "noncommercial", "sa", "sharealike")
# Version numbers: a line has all of the template's.
VERSIONS = ("1", "2", "3", "4", "5")
THRESHOLD = 0.75
_TERM = r"[A-Za-z0-9]+"


class Model:
    """TF-IDF weights of the templates, and the terms without which no line reaches the threshold."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        rows = [(name, Counter(re.findall(_TERM, t.lower()))) for name, texts in templates.items() for t in texts]
        df = Counter(t for _, tf in rows for t in tf)
        self.idf, self.other = {t: math.log((1 + len(rows)) / (1 + n)) + 1 for t, n in df.items()}, math.log(1 + len(rows)) + 1
        self.rows = []
        self.needs: list[tuple[list[str], list[str]]] = []
        # Terms of which a line has one, and those that it must have one of besides.
        self.telling: set[str] = set()
        self.guarded: set[str] = set()
        self.guards: set[str] = set()
        for name, tf in rows:
            w = {t: n * self.idf[t] for t, n in tf.items()}
            norm = math.sqrt(sum(v * v for v in w.values()))
            w = {t: v / norm for t, v in w.items()}
            self.rows.append((name, w))
            # A title is as short as a name, so a line must have all of it.
            short = len(tf) <= 2
            self.needs.append((sorted(t for t in VARIANTS if t in tf), sorted(t for t in tf if t in VERSIONS or short)))
            needed = self.needs[-1][1]
            if short:
                self.telling.add(min(needed, key=lambda t: (-w[t], t)))
                continue
            # Words that few lines have first, the heaviest of them first, until what is left cannot
            # reach the threshold. A template with version numbers also needs one of these.
            into = self.guarded if needed else self.telling
            self.guards.update(needed)
            for t in sorted(set(w) - set(needed), key=lambda t: (t in EVERYDAY, -w[t], t)):
                if math.sqrt(sum(v * v for u, v in w.items() if u not in into)) < threshold:
                    break
                into.add(t)

    def likely(self, line: Column) -> Column:
        """False only for lines that no template can match."""
        some = lambda terms, of: F.exists(terms, lambda t: t.isin(sorted(of)))
        return let(_terms(line), lambda x: some(x, self.telling) | (some(x, self.guards) & some(x, self.guarded)))

    def score(self, line: Column) -> Column:
        """Array of the line's cosines, one for each template."""

        def of(terms: Column) -> Column:
            known = F.array_distinct(terms)

            def counted(t: Column) -> Column:
                idf = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in self.idf.items() for x in kv]), t), F.lit(self.other))
                return F.struct(t.alias("t"), (F.size(F.filter(terms, lambda u: u == t)) * idf).alias("w"))

            def agrees(found: Column, variants: list[str], needed: list[str]) -> Column:
                return reduce(lambda a, t: a & F.array_contains(known, t), needed, found == F.lit(" ".join(variants)))

            def cosines(v: Column) -> Column:
                norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
                dot = lambda w: F.aggregate(v, F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in w.items() for y in kv]), x["t"]), F.lit(0.0)))
                found = F.array_join(F.array_sort(F.filter(known, lambda t: t.isin(*VARIANTS))), " ")
                return let(F.struct(norm.alias("n"), found.alias("f")), lambda x: F.array(*[F.when(agrees(x["f"], *need), dot(w) / x["n"]).otherwise(0.0) for (_, w), need in zip(self.rows, self.needs, strict=True)]))

            return let(F.transform(known, counted), cosines)

        return let(_terms(line), of)

    def best(self, lines: Column) -> Column:
        """``struct(score, name)`` of the best template over all lines; null below the threshold."""
        names = F.array(*[F.lit(name) for name, _ in self.rows])
        likely = F.filter(lines, self.likely)

        def top(line: Column) -> Column:
            return let(self.score(line), lambda s: F.struct(F.round(F.array_max(s), 9).alias("score"), F.get(names, F.array_position(s, F.array_max(s)).cast("int") - 1).alias("name")))

        tops = let(F.transform(likely, top), lambda a: F.filter(a, lambda x: x["score"] >= self.threshold))
        return _highest(tops)


def _highest(tops: Column) -> Column:
    """Highest score, then the first name."""
    return F.aggregate(tops, F.lit(None).cast("struct<score:double,name:string>"), lambda a, x: F.when(a.isNull() | (x["score"] > a["score"]) | ((x["score"] == a["score"]) & (x["name"] < a["name"])), x).otherwise(a))


def _terms(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda t: t != "")


def ancestors(path: Column) -> Column:
    """Directories above a path, from the root down: ``a/b/c`` has ``''``, ``a`` and ``a/b``."""
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/+")
    return let(parts, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/")))


def scan(spark: SparkSession, files: DataFrame, *, model: Model | None = None) -> DataFrame:
    """``id, path, own_license, own_score, license, inherited_from`` for every row of
    ``files(id, path, lines, is_licence_file)``; a file's lines are an array."""
    store, model = Scratch(spark, "licenses"), model or Model()
    notices = Model(NOTICES, model.threshold)
    lines, carrier = F.coalesce("lines", F.array().cast("array<string>")), F.coalesce("is_licence_file", F.lit(False))
    # A licence file's title may take two lines, and its notice all of them.
    two = let(lines, lambda a: F.when(F.size(a) > 1, F.zip_with(F.slice(a, F.lit(1), F.size(a) - 1), F.slice(a, F.lit(2), F.size(a) - 1), lambda x, y: F.concat_ws(" ", x, y))).otherwise(F.array().cast("array<string>")))
    texts = F.when(carrier, F.concat(lines, two)).otherwise(lines)
    full = F.when(carrier, notices.best(F.array(F.array_join(lines, " "))))
    own = _highest(F.filter(F.array(model.best(texts), full), lambda x: x.isNotNull()))
    rows = files.select("id", "path", own.alias("own"), carrier.alias("carrier"))
    rows = store.cut(rows.select("id", "path", F.col("own.name").alias("own_license"), F.col("own.score").alias("own_score"), "carrier"), "own")
    granted = rows.where("carrier and own_license is not null and path is not null").select(F.element_at(ancestors(F.col("path")), -1).alias("dir"), "id", "own_license")
    granted = granted.groupBy("dir").agg(F.min(F.struct(F.col("id").isNull(), "id", "own_license"))["own_license"].alias("given"))
    bare = rows.where("own_license is null and path is not null").select("path").distinct()
    above = bare.select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "dir"))
    near = attach(above, granted, ["dir"]).groupBy("path").agg(F.max(F.struct("depth", "dir", "given")).alias("g"))
    near = near.select(F.col("path").alias("_path"), F.col("g.dir").alias("inherited_from"), F.col("g.given").alias("given"))
    out = rows.join(near, (F.col("path") == F.col("_path")) & F.col("own_license").isNull(), "left")
    return out.select("id", "path", "own_license", "own_score", F.coalesce("own_license", "given").alias("license"), "inherited_from")


def page_files(pages: DataFrame) -> DataFrame:
    """Web pages as files: the path is host and path of the address, lines are the markup's blocks,
    and a page is a licence file if its name says so or a licence notice is its title."""
    address = F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^?#]*)", 1)
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    inline = F.regexp_replace(bare, r"(?i)</?(?:b|i|em|strong|span|a|code)\b[^>]*>", "")
    lines = F.filter(F.split(inline, "<[^>]*>|\n"), lambda x: x.rlike("[A-Za-z]"))
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title>(.*?)</title>", 1)
    named = address.rlike(r"(?i)/(?:licen[cs]e|copying|notice)[^/]*/?$") | F.lower(title).rlike(r"licen[cs]e")
    return pages.select(F.col("page_id").alias("id"), F.when(address != "", address).alias("path"), lines.alias("lines"), named.alias("is_licence_file"))
