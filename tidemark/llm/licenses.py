"""License scans by diagonal voting.

1. Every run of `k` words of a text and of the templates is hashed; a Spark join of the hashes gives (text, template, position
   there, position here).
2. Matches of one copy lie on one diagonal: position in the text minus position in the template. They are counted by diagonal.
3. Neighbouring diagonals of a template, at most `slack` apart, are merged: words put in or left out move a copy by as many.
4. Spans with votes for enough of the template's runs are verified on the text's own words, in their order: the share is twice the longest
   common subsequence of span and template over their lengths together, so that scattered words of a license don't make one.

A template is a notice, or a paragraph of a license: a copy may hold some paragraphs only. They are a constant of the code, so that
their table is always broadcast. The base phrases are looked for in place; where only they stand, a license is mentioned and not shown to be
granted, which gives the score `MENTION`, and otherwise the score is the largest share of a span.

Defined results: null and empty texts have no words, labels or spans and score 0; an empty table gives an empty one. Whole texts are
scanned, however long. Templates that tie both give their labels. A row is known by its doc_id and text, so ids may be null
or repeated; one row out for each row in; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import NON_WORDS, bounded, fresh, split_words, stored

K, SLACK, LEAST_HITS, LEAST_SHARE, MENTION = 3, 8, 0.4, 0.7, 0.5


class Template(NamedTuple):
    label: str
    text: str


#: Notices of public licenses, as they are commonly written, and the paragraphs of short licenses.
TEMPLATES = (
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    Template("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    Template("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    Template("apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    Template("mit", "Released under the MIT License."),
    Template("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    Template("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    Template("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    Template("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    Template("bsd", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Phrases that give a base label wherever their words stand one after another.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def words(text: Column) -> Column:
    """Lower-cased words. Letters beyond A-Z are folded too; no such letter turns into one of a phrase's."""
    return split_words(F.lower(text), NON_WORDS)


def grams(w: str, k: int = K) -> Column:
    hashed = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))
    return F.when(F.size(w) >= k, F.slice(hashed, F.lit(1), F.size(w) - (k - 1)))


def template_grams(docs: DataFrame, templates: tuple[Template, ...], k: int = K) -> DataFrame:
    """(gram, template, tpos, of): of is how many runs the template has."""
    df = docs.sparkSession.createDataFrame([(i, t.text) for i, t in enumerate(templates)], "template int, text string").select("template", words(F.col("text")).alias("w"))
    df = df.select("template", grams("w", k).alias("g")).where("g is not null")
    return df.select("template", F.size("g").alias("of"), F.posexplode("g").alias("tpos", "gram"))


def candidates(docs: DataFrame, templates: tuple[Template, ...], k: int, slack: int, least: float, doc_id: str, text: str) -> DataFrame:
    """(key, mark, template, start, end): spans, in words, of merged diagonals with enough of a template's runs."""
    g = docs.select(F.col(doc_id).alias("key"), F.xxhash64(text).alias("mark"), words(F.col(text)).alias("w")).select("key", "mark", grams("w", k).alias("g"))
    # the outer form: for the inner one Spark infers a filter on g and pushes it below the words, to split the text once a word
    hits = g.select("key", "mark", F.posexplode_outer("g").alias("pos", "gram")).join(F.broadcast(template_grams(docs, templates, k)), "gram")
    group = ["key", "mark", "template"]
    by = hits.groupBy(*group, "of", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("tpos"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    w = Window.partitionBy(*group).orderBy("diagonal")
    by = by.withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(w) > slack).cast("int")).withColumn("band", F.sum(F.coalesce("new", F.lit(0))).over(w))
    merged = by.groupBy(*group, "band").agg(F.min("low").alias("start"), (F.max("high") + k).alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("tpos")))).alias("n"), F.first("of").alias("of"))
    return merged.where(F.col("n") >= F.greatest(F.lit(1), F.ceil(F.col("of") * least))).select(*group, "start", "end")


def base_places(w: str) -> Column:
    """An array of (at, label) for every place of a base phrase."""

    def at(x: Column, i: Column) -> Column:
        found = F.lit(None).cast("struct<at:int,label:string>")
        for phrase, label in PHRASES:
            first, *rest = phrase.split()
            same = reduce(lambda a, b: a & b, [F.get(w, i + j + 1) == p for j, p in enumerate(rest)], x == first)
            found = F.coalesce(F.when(same, F.struct(i.alias("at"), F.lit(label).alias("label"))), found)
        return found

    return F.filter(F.transform(w, at), lambda x: x.isNotNull())


def common(template: list[str], span: list[str]) -> int:
    """The length of the longest common subsequence, a bit for each word of the template."""
    at: dict[str, int] = {}
    for i, x in enumerate(template):
        at[x] = at.get(x, 0) | 1 << i
    full = row = (1 << len(template)) - 1
    for x in span:
        u = row & at.get(x, 0)
        row = (row + u | row - u) & full
    return len(template) - row.bit_count()


def shares(templates: list[list[str]]):
    """For each candidate span of a text: the ordered share of its template's words and its own."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for which, spans in fresh(parts):
            out = [None if w is None else [2 * common(templates[t], list(x)) / (len(templates[t]) + len(x)) for t, x in zip(w, s)] for w, s in zip(which, spans)]
            yield pd.Series(out, dtype="object")

    return run


def licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = K, slack: int = SLACK, least: float = LEAST_HITS, share: float = LEAST_SHARE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, base (at, label) and spans (label, start, end, share), in words, for each row of docs."""
    found = candidates(docs, templates, k, slack, least, doc_id, text)
    # as many as a text has places for templates
    found = bounded(stored(found.groupBy("key", "mark").agg(F.collect_list(F.struct("template", "start", "end")).alias("c")), "licenses"))
    df = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    df = df.join(found, F.col("id").eqNullSafe(F.col("key")) & (F.col("h") == F.col("mark")), "left")
    df = df.select("id", "c", "t", split_words(F.col("t"), NON_WORDS).alias("w"))
    none = F.expr("array()")
    base = F.when(F.contains("t", F.lit("license")) | F.contains("t", F.lit("cc")), base_places("w"))
    df = df.select("id", "c", F.size("w").cast("long").alias("n_words"), F.coalesce(base, none.cast("array<struct<at:int,label:string>>")).alias("base"), F.when(F.size("w") > 0, F.transform("c", lambda x: F.slice("w", x.start + 1, x.end - x.start))).alias("own"))
    verified = shares([w.words for w in docs.sparkSession.createDataFrame([(t.text,) for t in templates], "text string").select(words(F.col("text")).alias("words")).collect()])
    labels = F.array(*[F.lit(t.label) for t in templates])
    df = df.withColumn("shares", verified(F.transform("c", lambda x: x.template), "own"))
    spans = F.transform("c", lambda x, i: F.struct(F.get(labels, x.template).alias("label"), x.start.alias("start"), x.end.alias("end"), F.get("shares", i).alias("share")))
    return df.select(F.col("id").alias(doc_id), "n_words", "base", F.coalesce(F.filter(spans, lambda x: x.share >= share), none.cast("array<struct<label:string,start:int,end:int,share:double>>")).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    base, own = F.transform("base", lambda x: x.label), F.transform("spans", lambda x: x.label)
    listed = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    at = F.transform("base", lambda x: x.at)
    score = F.greatest(F.when(F.size("base") > 0, F.lit(MENTION)).otherwise(0.0), F.coalesce(F.array_max(F.transform("spans", lambda x: x.share)), F.lit(0.0)))
    return licenses(docs).select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"), listed(base).alias("base_labels"), listed(F.concat(base, own)).alias("labels"), score.alias("score"))
