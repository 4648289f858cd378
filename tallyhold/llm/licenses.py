"""License scan by diagonal voting.

The hashes of all runs of three words of a document are joined with the places of the license templates' runs,
and verified as strings. A match votes for its diagonal, the offset between its place in the document and in the
template. Diagonals at most ``GAP`` apart are merged, since a word put in or left out moves the rest by one; what a
merged diagonal covers of the template, and the length of its span, decide; if the span is too long, the
stretch of allowed length in it that covers most does. Templates are fixed, so their side of the join is small, and
runs whose hash none of them has are left out before the join, within the row. Only DataFrame functions run.

Base labels come from phrases whose words stand consecutively. Null and empty texts have no words and no
labels; repeated rows each get their row; empty tables give empty ones. The words of a text are held in its row, a
text of any length in one task. Columns of docs named like the results (RESULTS) are replaced, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .decontaminate import sql_words

RUN = 3
GAP = 3
LEAST_SHARE = 0.75
MAX_STRETCH = 1.5

# Phrases and their labels.
PHRASES = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# License notices, in whole and by their opening sentences.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    ),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("cc0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means"),
)
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()


def template_runs() -> list[tuple[int, str, int, int, str]]:
    """(template, label, runs of the template, place, run)."""
    found = []
    for i, (label, text) in enumerate(TEMPLATES):
        w = _words(text)
        found += [(i, label, len(w) - RUN + 1, p, " ".join(w[p : p + RUN])) for p in range(len(w) - RUN + 1)]
    return found


def phrase_places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    fits = lambda i: F.coalesce(F.get(words, i + (len(parts) - 1)) == parts[-1], F.lit(False))

    def at(i: Column) -> Column:
        test = fits(i)
        for k, p in enumerate(parts[:-1]):
            test = test & (F.get(words, i + k) == p)
        return test

    return F.filter(F.transform(words, lambda w, i: F.when((w == parts[0]) & at(i), i)), lambda i: i.isNotNull())


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Adds to docs, in place of text: n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted), score and spans (label, start, end, score)."""
    spark = docs.sparkSession
    hashed = lambda w, i: F.xxhash64(*[F.get(w, i + k) for k in range(RUN)])
    runs = spark.createDataFrame(template_runs(), "template int, label string, runs int, place int, run string").withColumn("hash", hashed(F.split("run", " "), F.lit(0)))
    listed = [r.hash for r in runs.select("hash").distinct().collect()]  # fixed templates

    def measure(w: Column) -> Column:
        places = F.when(F.size(w) >= RUN, F.filter(F.sequence(F.lit(0), F.size(w) - RUN), lambda i: hashed(w, i).isin(listed)))
        joined = F.transform(places, lambda i: F.struct(i.alias("at"), hashed(w, i).alias("hash"), F.array_join(F.slice(w, i + 1, F.lit(RUN)), " ").alias("run")))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.struct(*[phrase_places(w, p).alias(f"p{k}") for k, p in enumerate(PHRASES)]).alias("base"), joined.alias("runs"))

    rest = common.others(docs, "text", *RESULTS)
    others = F.struct(*map(common.ref, rest), F.lit(0).alias("_"))
    found = common.written(docs.select(F.monotonically_increasing_id().alias("_row"), others.alias("_doc"), common.let(common.plain_words(F.col("text")), measure).alias("m")), "licenses")
    met = found.select("_row", F.explode("m.runs").alias("r")).select("_row", "r.at", "r.hash", F.col("r.run").alias("words"))
    votes = met.join(F.broadcast(runs), "hash").filter(F.col("words") == F.col("run"))
    diagonals = votes.groupBy("_row", "template", "label", "runs", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"), F.min("at").alias("low"), F.max("at").alias("high"))
    near = W.partitionBy("_row", "template").orderBy("diagonal")
    marked = diagonals.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(near) <= GAP, 0).otherwise(1)).withColumn("part", F.sum("new").over(near))
    merged = marked.groupBy("_row", "template", "label", "runs", "part").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"), F.min("low").alias("low"), (F.max("high") + RUN).alias("end"))
    most = MAX_STRETCH * (F.col("runs") + RUN - 1)
    group = ["_row", "template", "label", "runs", "part"]
    whole = W.partitionBy(*group)
    long = marked.withColumn("span", F.max("high").over(whole) + RUN - F.min("low").over(whole)).filter(F.col("span") > most)
    ahead = whole.orderBy("at").rangeBetween(0, int(MAX_STRETCH * (max(r[2] for r in template_runs()) + RUN - 1)) - RUN)
    seen = long.select(*group, "diagonal", F.explode("places").alias("place")).select(*group, (F.col("diagonal") + F.col("place")).alias("at"), "place")
    stretches = seen.withColumn("next", F.collect_list(F.struct("at", "place")).over(ahead)).withColumn("next", F.filter("next", lambda x: x["at"] + RUN - F.col("at") <= most))
    fits = F.struct(F.size(F.array_distinct(F.col("next.place"))).alias("covered"), (-F.col("at")).alias("before"), (-(F.array_max("next.at") + RUN)).alias("end"))
    best = stretches.groupBy(*group).agg(F.max(fits).alias("b")).select(*group, F.col("b.covered").alias("covered"), (-F.col("b.before")).alias("low"), (-F.col("b.end")).alias("end"))
    score = F.col("covered") / F.col("runs")
    spans = merged.filter(F.col("end") - F.col("low") <= most).unionByName(best).withColumn("score", score).filter(F.col("score") >= LEAST_SHARE)
    by_row = spans.groupBy("_row").agg(F.max("score").alias("score"), F.collect_set("label").alias("found"), F.sort_array(F.collect_list(F.struct(F.col("low").alias("start"), "end", "label", "score"))).alias("spans"))
    base = F.concat(*[F.col(f"m.base.p{k}") for k in range(len(PHRASES))])
    base_labels = F.filter(F.array(*[F.when(F.size(f"m.base.p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    no_labels = F.array().cast("array<string>")
    return found.join(by_row, "_row", "left").select(
        *[F.col("_doc")[c].alias(c) for c in rest], "m.n_words", F.size(base).cast("long").alias("n_base"), F.array_min(base).cast("long").alias("first_word"), F.array_max(base).cast("long").alias("last_word"),
        F.sort_array(F.array_distinct(base_labels)).alias("base_labels"), F.sort_array(F.array_union(base_labels, F.coalesce("found", no_labels))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,label:string,score:double>>")).alias("spans"),
    )


def op7_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


_RUNS = ", ".join(f"({t}, '{label}', {n}, {p}, '{run}')" for t, label, n, p, run in template_runs())
_PHRASES = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES.items())
OP7_SQL = f"""
WITH t(template, label, runs, place, run) AS (VALUES {_RUNS}), ph(phrase, size, label) AS (VALUES {_PHRASES}),
d AS (SELECT row_number() OVER () AS r, doc_id, {sql_words('text')} AS w FROM documents),
x AS (SELECT r, i, array_to_string(w[i + 1:i + 3], ' ') AS run, array_to_string(w[i + 1:i + 4], ' ') AS longer FROM (SELECT r, w, unnest(range(0, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM x JOIN ph ON phrase = CASE WHEN size = 3 THEN run ELSE longer END GROUP BY r),
g AS (SELECT r, template, label, runs, i - place AS diagonal, list(place) AS places, min(i) AS low, max(i) AS high FROM x JOIN t USING (run) GROUP BY ALL),
m AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS part FROM (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS new FROM g)),
s AS (SELECT r, template, label, runs, part, len(list_distinct(flatten(list(places)))) AS covered, min(low) AS low, max(high) + 3 AS stop FROM m GROUP BY r, template, label, runs, part),
e AS (SELECT r, template, part, label, runs, diagonal + place AS i, place FROM (SELECT r, template, part, m.label, m.runs, diagonal, unnest(places) AS place FROM m JOIN s USING (r, template, part) WHERE s.stop - s.low > {MAX_STRETCH} * (m.runs + 2))),
v AS (SELECT a.r, a.label, a.runs, a.template, a.part, a.i, count(DISTINCT b.place) AS covered FROM e AS a JOIN e AS b ON a.r = b.r AND a.template = b.template AND a.part = b.part AND b.i >= a.i AND b.i + 3 - a.i <= {MAX_STRETCH} * (a.runs + 2) GROUP BY ALL),
f AS (SELECT r, max(covered / runs) AS score, list(DISTINCT label) AS labels FROM (
  SELECT r, label, runs, covered FROM s WHERE stop - low <= {MAX_STRETCH} * (runs + 2) UNION ALL SELECT r, label, runs, max(covered) FROM v GROUP BY r, template, label, runs, part
) WHERE covered / runs >= {LEAST_SHARE} GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN f USING (r)
"""
