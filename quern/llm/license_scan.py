"""Licence scan by sparse TF-IDF cosine, with directory inheritance (DataFrame functions only).

Headers are a text's sentences and its runs of commented lines, a licence file
is a whole text. All are compared with templates (statements and SPDX tags,
standard headers, and whole licence texts, which are the files of `licences/`)
by the cosine of their TF-IDF vectors, with 1 + ln(n) for n occurrences.
Inverse document frequencies of the templates' terms count all documents; any
other term weighs as one that no document holds. Only texts and sentences with
an anchor can reach the threshold: the rarest terms of each template, such that
the others' share of its norm is under the threshold (by the Cauchy-Schwarz
inequality nothing is lost).

A licence file covers its directory. A text without a header of its own takes
the licence of the nearest ancestor directory that has one; that is resolved
for distinct directories, by joins on their paths.

Defined results: null text counts as empty, a null path has no directory and
inherits nothing. Ties go to the licence first by name, in a directory first
to the better file. Rows that repeat a path and text come out as often as they
went in. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from importlib import resources

from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.common import join_groups, materialize

#: Statements by which public licences are declared.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
]
#: The headers that licences ask for in source files.
HEADERS = [
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Affero General Public License for more details.
You should have received a copy of the GNU Affero General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Lesser General Public License for more details.
You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]
#: SPDX identifiers; each is a template `SPDX-License-Identifier: <identifier>`.
IDENTIFIERS = ["AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "MIT", "MPL-2.0", "Unlicense"]


def whole_texts() -> list[tuple[str, str]]:
    """(licence, text) of the files of `licences/`."""
    found = [f for f in resources.files("quern.llm").joinpath("licences").iterdir() if f.name.endswith(".txt")]
    return sorted((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in found)


def all_templates() -> list[tuple[str, str]]:
    """Statements first, which win ties, then headers, tags and whole texts; tags count for the licence without its suffix."""
    tags = [(re.sub("-(only|or-later)$", "", i), f"SPDX-License-Identifier: {i}") for i in IDENTIFIERS]
    return [*TEMPLATES, *HEADERS, *tags, *whole_texts()]


#: Cosine from which a sentence is a header, and a text a licence file.
HEADER, FILE = 0.75, 0.5


#: Runs of a-z, 0-9, and of single dots and hyphens that a-z or 0-9 follow; bounded, so that no text exhausts the stack.
TOKEN = r"[.-]?[a-z0-9]++(?:[.-][a-z0-9]++){0,200}"


def tokens(text: Column) -> Column:
    """The lower-cased tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


#: A line that a comment mark begins, and two or more such lines in a row.
COMMENTED = r"[ \t]*(?:/\*|\*|//|#|--|;|<!--)[^\n]*"
BLOCK = rf"(?m)^{COMMENTED}(?:\n{COMMENTED})+"


def sentences(text: Column) -> Column:
    """Cut at line ends and after full stops, exclamation and question marks that white space follows; then the runs of commented lines, whole."""
    return F.concat(F.split(text, r"\n|(?<=[.!?])[ \t]+"), F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)))


class Model:
    """The statements' vectors for given document frequencies."""

    def __init__(self, total: int, frequency: dict[str, int], templates: list[tuple[str, str]]) -> None:
        self.default = math.log(1 + total) + 1
        self.idf = {t: math.log((1 + total) / (1 + frequency.get(t, 0))) + 1 for _, text in templates for t in _tokens(text)}
        self.postings: list[tuple[str, int, float]] = []
        self.names = [name for name, _ in templates]
        self.vectors: list[dict[str, float]] = []
        for number, (_, text) in enumerate(templates):
            terms = _tokens(text)
            weights = {t: (1 + math.log(n)) * self.idf[t] for t, n in Counter(terms).items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.vectors.append({t: w / norm for t, w in weights.items()})
            self.postings += [(t, number, w / norm) for t, w in sorted(weights.items())]

    def anchors(self, threshold: float) -> list[str]:
        found = set()
        for vector in self.vectors:
            rest = 1.0
            for term, w in sorted(vector.items(), key=lambda x: (-self.idf[x[0]], -x[1], x[0])):
                if math.sqrt(max(0.0, rest)) < threshold:
                    break
                found.add(term)
                rest -= w * w
        return sorted(found)


def _terms(near: DataFrame, terms: list[str]) -> DataFrame:
    """Terms of the templates as a table for a broadcast, whatever the input: a hash lookup inside generated code."""
    return F.broadcast(near.sparkSession.createDataFrame([(t,) for t in terms], "t string"))


def fit(texts: DataFrame, templates: list[tuple[str, str]]) -> Model:
    """Document frequencies of the templates' terms over all texts; the driver gets one number a term."""
    vocabulary = sorted({t for _, text in templates for t in _tokens(text)})
    held = texts.select(F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("t"))
    counts = held.join(_terms(texts, vocabulary), "t", "left_semi").groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()
    return Model(texts.count(), {r["t"]: r["n"] for r in counts}, templates)


def matches(units: DataFrame, keys: list[str], model: Model, threshold: float) -> DataFrame:
    """keys, template, cosine of the units (keys, unit) whose cosine with a statement reaches the threshold."""
    spark = units.sparkSession
    # Both tables hold the templates' terms only, whatever the input.
    idf = F.broadcast(spark.createDataFrame(sorted(model.idf.items()), "t string, idf double"))
    postings = F.broadcast(spark.createDataFrame(model.postings, "t string, template int, w double"))
    split = units.select(*keys, tokens(F.col("unit")).alias("terms")).filter(F.arrays_overlap("terms", F.lit(model.anchors(threshold))))
    terms = split.select(*keys, F.explode("terms").alias("t")).groupBy(*keys, "t").agg(F.count(F.lit(1)).alias("tf"))
    weighed = terms.join(idf, "t", "left").select(*keys, "t", ((1 + F.ln("tf")) * F.coalesce("idf", F.lit(model.default))).alias("u"))
    norms = weighed.groupBy(*keys).agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("norm"))
    dots = weighed.join(postings, "t").groupBy(*keys, "template").agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 9)
    return dots.join(norms, keys).select(*keys, "template", cosine.alias("cosine")).filter(F.col("cosine") >= threshold)


def _best(found: DataFrame, keys: list[str], names: list[str], into: str) -> DataFrame:
    """The best licence of each key: highest cosine, then first template."""
    best = found.groupBy(*keys).agg(F.max(F.struct("cosine", (-F.col("template")).alias("order"))).alias("b"))
    name = F.element_at(F.lit(names), 1 - F.col("b.order"))
    return best.select(*keys, name.alias(into), F.col("b.cosine").alias(f"{into}_score"))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, to the root ''."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def inherited(directories: DataFrame, covered: DataFrame) -> DataFrame:
    """directory, inherited, inherited_from: the licence of the nearest covered ancestor (or itself). covered: directory, license."""
    steps = directories.select("directory").distinct().select("directory", F.posexplode(ancestors(F.col("directory"))).alias("depth", "above"))
    met = steps.join(covered.select(F.col("directory").alias("above"), "license"), "above")
    nearest = met.groupBy("directory").agg(F.max(F.struct("depth", "license", "above")).alias("n"))
    return nearest.select("directory", F.col("n.license").alias("inherited"), F.col("n.above").alias("inherited_from"))


def scan(files: DataFrame, templates: list[tuple[str, str]] | None = None, header: float = HEADER, whole: float = FILE) -> DataFrame:
    """All rows of files (id, path, text) as id, path, header, header_score, file, file_score, inherited, inherited_from, license."""
    model = fit(files.select("text"), templates or all_templates())
    body = F.coalesce("text", F.lit(""))
    rows = files.select("id", "path", F.xxhash64("id", "path", "text").alias("k1"), F.xxhash64("text", F.lit(7), "path", "id").alias("k2"), body.alias("text"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("directory"))
    keys = ["k1", "k2"]
    # Anchors of the lower threshold hold those of the higher: one pass finds the texts that either could match.
    anchors = model.anchors(min(header, whole))
    met = rows.select(*keys, "text", F.explode(tokens(F.col("text"))).alias("t")).join(_terms(files, anchors), "t", "left_semi")
    likely, _ = materialize(met.groupBy(*keys).agg(F.first("text").alias("text")), "licence-texts")
    cuts = likely.select(*keys, F.posexplode(sentences(F.col("text"))).alias("pos", "unit"))
    headers = _best(matches(cuts, [*keys, "pos"], model, header), keys, model.names, "header")
    wholes = _best(matches(likely.select(*keys, F.col("text").alias("unit")), keys, model, whole), keys, model.names, "file")
    judged, _ = materialize(rows.select("id", "path", *keys, "directory").join(headers, keys, "left").join(wholes, keys, "left"), "judged")
    files_of = judged.filter(F.col("file").isNotNull() & F.col("directory").isNotNull())
    order = F.struct("file_score", (-F.array_position(F.lit(model.names), F.col("file"))).alias("o"), F.col("file").alias("license"))
    covered = files_of.groupBy("directory").agg(F.max(order).alias("m")).select("directory", F.col("m.license").alias("license"))
    above = inherited(rows.filter(F.col("directory").isNotNull()), covered)
    # The rows of a large directory are summed to nothing here, so they are joined apart; rows without a directory match none.
    housed = judged.filter(F.col("directory").isNotNull())
    sizes = housed.groupBy("directory").agg(F.count(F.lit(1)).alias("_n"))
    told = join_groups(housed, sizes.join(above, "directory", "left"), "directory", "_n", rows.count())
    out = told.unionByName(judged.filter(F.col("directory").isNull()), allowMissingColumns=True)
    return out.select("id", "path", "header", "header_score", "file", "file_score", "inherited", "inherited_from", F.coalesce("header", "file", "inherited").alias("license"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """scan over documents, whose path is /<source>/<lang>/<doc_id>; id is returned as doc_id."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    path = F.concat(F.lit("/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), part("doc_id"))
    return scan(docs.select(F.col("doc_id").alias("id"), path.alias("path"), "text")).withColumnRenamed("id", "doc_id")
