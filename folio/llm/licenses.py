"""License scans by diagonal voting.

All rolling word pairs of all texts are joined by hash to the pairs of the license templates; a hit's diagonal is its place in
the text less its place in the template. Hits are counted per diagonal, neighbouring diagonals (a word missing or added) are
merged, and a merged span is verified: the words compared as strings must cover a share of the template. The templates are a
given list, whatever the corpus: up to a checked size they are broadcast, and what is shuffled are hits and one row a text; beyond
it the words that any template holds are met by a shuffle in which the rows of common pairs are dealt into parts.

Defined results: null text has no words; no base place gives null first and last words and empty base labels; repeated rows
each give a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from .common import WORD, staged, table, words_of

#: Phrases that must stand whole (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Wording of public licenses' notices and grants (fixed values).
TEMPLATES = [
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS", "apache"),
    ("Released under the MIT License", "mit"),
    ("Licensed under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl"),
]
#: The terms of public licenses, whole (fixed values).
TERMS = [
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons
to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "mit"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "isc"),
    ("""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code
must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", "bsd"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment
in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. 3. This notice may not be removed or altered from any source distribution.""", "zlib"),
]
SHARE, SLIP = 0.7, 2


def _words(text: str) -> list[str]:
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def template_rows(templates=TEMPLATES + TERMS) -> list[tuple]:
    """(template, label, base, pairs, at, a, b); template -1 is the row that every text meets once."""
    rows = [(-1, "", False, 1, 0, "", "")]
    for k, (text, label, base) in enumerate([(t, v, True) for t, v in BASE.items()] + [(t, v, False) for t, v in templates]):
        w = _words(text)
        rows += [(k, label, base, len(w) - 1, i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    return rows


def scan(docs: DataFrame, share: float = SHARE, templates=TEMPLATES + TERMS, most_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs(doc_id, text).

    templates: (text, label) of any length, of two words at least, a list in the driver's memory; up to most_bytes they are broadcast.
    """
    spark = docs.sparkSession
    held = template_rows(templates)
    small = sum(len((r[5] + r[6] + r[1]).encode()) + 64 for r in held) <= most_bytes
    known = spark.createDataFrame(held, "template int, label string, base boolean, pairs int, at int, ta string, tb string").withColumn("hash", F.xxhash64("ta", "tb"))
    w = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), words_of(F.col("text")).alias("w"))
    w = w.select("row", "doc_id", F.size("w").alias("n"), F.arrays_zip(F.concat(F.array(F.lit("")), F.col("w")).alias("a"), F.concat(F.array(F.lit("")), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), F.array(F.lit(None).cast("string"))).alias("b")).alias("p"))
    each = w.select("row", "doc_id", "n", F.posexplode("p").alias("pos", "p")).select("row", "doc_id", "n", "pos", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    each = each.withColumn("hash", F.xxhash64("a", "b"))
    if small:
        met = each.join(F.broadcast(known), "hash")
    else:  # every text's place 0 meets one row, here without a shuffle
        each, first = staged(each, "pairs"), F.col("template") < 0
        met = spread_join(each.where("pos > 0"), known.where(~first), ["hash"]).unionByName(each.where("pos = 0").join(F.broadcast(known.where(first)), "hash"))
    hits = met.where("a = ta and b = tb and (template >= 0 or pos = 0)")
    diagonals = hits.groupBy("row", "doc_id", "n", "template", "label", "base", "pairs", (F.col("pos") - 1 - F.col("at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("at").alias("met"))
    own = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(own) > SLIP) | (F.col("lo") - F.lag("hi").over(own) > F.col("pairs")) | F.lag("diagonal").over(own).isNull()
    spans = diagonals.withColumn("span", F.sum(fresh.cast("int")).over(own))
    spans = spans.groupBy("row", "doc_id", "n", "template", "label", "base", "pairs", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("met")))).alias("covered"),
        F.count_if(F.col("votes") == F.col("pairs")).alias("whole"),
        F.min(F.when(F.col("votes") == F.col("pairs"), F.col("diagonal"))).alias("first"), F.max(F.when(F.col("votes") == F.col("pairs"), F.col("diagonal"))).alias("last"))
    part = F.col("covered") / F.col("pairs")
    based = F.col("base") & (F.col("whole") > 0)
    found = spans.groupBy("row", "doc_id", "n").agg(
        F.coalesce(F.sum(F.when(F.col("base"), F.col("whole"))), F.lit(0)).alias("n_base"),
        F.min(F.when(based, F.col("first"))).alias("first_word"), F.max(F.when(based, F.col("last"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(based, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(based | (~F.col("base") & (F.col("template") >= 0) & (part >= share)), F.col("label")))), ",").alias("labels"),
        F.max(F.when(F.col("template") < 0, 0.0).when(based, 1.0).when(F.col("base"), 0.0).otherwise(part)).alias("score"))
    long = lambda c: F.col(c).cast("long").alias(c)
    return found.select("doc_id", F.col("n").cast("long").alias("n_words"), long("n_base"), long("first_word"), long("last_word"), "base_labels", "labels", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda x: "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x).lower()
    values = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in template_rows() if r[0] >= 0)
    return f"""
WITH k(template, label, base, pairs, place, ta, tb) AS (VALUES {values}),
t AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
e AS (SELECT row, unnest(w) AS a, unnest(w[2:]) AS b, generate_subscripts(w, 1) - 1 AS pos FROM t),
d AS (SELECT row, template, label, base, pairs, pos - place AS diagonal, count(*) AS votes, min(pos) AS lo, max(pos) AS hi, list(place) AS met FROM e JOIN k ON a = ta AND b = tb GROUP BY row, template, label, base, pairs, pos - place),
f AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER o > {SLIP} OR lo - lag(hi) OVER o > pairs, true) AS fresh FROM d WINDOW o AS (PARTITION BY row, template ORDER BY diagonal)),
g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM f),
s AS (SELECT row, template, label, base, pairs, span, len(list_distinct(flatten(list(met)))) / pairs AS part, count(*) FILTER (votes = pairs) AS whole, min(diagonal) FILTER (votes = pairs) AS first, max(diagonal) FILTER (votes = pairs) AS last FROM g GROUP BY row, template, label, base, pairs, span),
r AS (SELECT row, sum(whole) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(last) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND whole > 0) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND whole > 0 OR NOT base AND part >= {SHARE}) AS labels,
  max(CASE WHEN base AND whole > 0 THEN 1.0 WHEN base THEN 0.0 ELSE part END)::DOUBLE AS score FROM s GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM t LEFT JOIN r USING (row)
"""


ORACLE = _oracle()
