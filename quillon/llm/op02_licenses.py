"""License scans: sparse TF-IDF cosine to templates, then inheritance along directories, all in
DataFrame functions.

Blocks, of every text: each line; each run of two or more lines that no line without words parts
(notices are wrapped); the comment at the head; and of licence files (base name LICENSE, LICENCE,
COPYING, NOTICE or UNLICENSE) the whole. A block's vector has (1 + ln count) * idf for the templates'
terms, with the number of blocks that hold a term from all blocks; each word outside the templates is
a term of its own that no other block holds. Counts are taken only where the number of distinct terms
lets a block reach the threshold at all. A block whose templates' terms cannot reach the threshold, whatever
the template, leaves before the join: cosine is at most the block's weight on templates' terms over
its norm, so nothing is lost.

A file's own licence is its best block's best template (then the first name); "Proprietary" counts
only where no other licence reaches the threshold, since "All rights reserved" stands in many. Disclaimers
that many licences share are templates without a name: a block that is nearest to one of them
names no licence, so a licence that is unknown here isn't taken for one with the same disclaimer. A file
without one takes that of the nearest ancestor directory that holds a licence file: directories, not
files, are joined with their ancestors, and files join their directory.

Templates are bounded (this module's table), so they and their terms' weights may be broadcast.
Null or empty texts have no block; null paths have no directory and inherit nothing. Rows that
share a path each get their own verdict. Empty tables give none. Columns named license, score or how
are replaced; working columns are one struct, `__q`; other columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.6
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([-.](txt|md|mit|apache|bsd|gpl|mpl))?$"
WORDLESS = r"[^\p{L}\p{N}\n]"
# the comment that a file starts with: a block, or lines with a mark
HEAD = r"^\s*(?:/\*[\s\S]*?\*/|(?:[ \t]*(?:#|//|--|;|%)[^\n]*\n)+)"

# Public licences, their titles and the wording of their notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of "
        "the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of "
        "the License, or (at your option) any later version.",
    ),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"),
    (
        "GPL-1.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or "
        "(at your option) any later version.",
    ),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
    ),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version "
        "2.1 of the License, or (at your option) any later version.",
    ),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    (
        "LGPL-2.0",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version "
        "2 of the License, or (at your option) any later version.",
    ),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
    ),
    ("GFDL-1.1", "GNU Free Documentation License Version 1.1, March 2000"),
    ("GFDL-1.2", "GNU Free Documentation License Version 1.2, November 2002"),
    ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
    ("Artistic-1.0", "The Artistic License"),
    ("Artistic-2.0", "The Artistic License 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be "
        "used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
        "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
        "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY "
        "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    (
        "MPL-1.1",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the "
        "License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an AS IS basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the "
        "specific language governing rights and limitations under the License.",
    ),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    (
        "EPL-1.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at "
        "http://www.eclipse.org/legal/epl-v10.html",
    ),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Proprietary", "All rights reserved"),
    # wording that licences share, which names none
    (
        "",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
        "General Public License for more details.",
    ),
)
# Licence files of the query's tree: path, and the template that stands in it. Documents are the
# files below their source's directory.
TREE = (("src1/LICENSE", 3), ("src2/LICENSE", 7), ("src2/en/COPYING", 10))


def _counts(text: str) -> dict[str, int]:
    return Counter(x for x in re.split(r"[^a-z0-9]+", text.lower()) if x)


VOCABULARY = sorted({t for _, x in TEMPLATES for t in _counts(x)})


def _possessive(pattern: str) -> str:
    """The same repetitions without a way back, which Java's engine takes without recursion."""
    return pattern.replace(")+", ")++")


def blocks(files: DataFrame) -> DataFrame:
    """(f, block, known, counts, n_other): each block's templates' terms, their counts (null where
    the block cannot reach the threshold), and how many other words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # two lines with words: what follows leading lines without any has a line break before a word
    wrapped = lambda x: F.regexp_replace(x, _possessive(f"^(?:{WORDLESS}*\n)+"), "").rlike(r"\n[^\p{L}\p{N}]*+[\p{L}\p{N}]")
    runs = F.filter(F.split(text, _possessive(f"\n(?:{WORDLESS}*\n)+")), wrapped)
    head = F.filter(F.array(F.regexp_extract(text, _possessive(HEAD), 0)), lambda x: x != "")
    whole = F.when(F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False)), F.array(text)).otherwise(F.array().cast("array<string>"))
    parts = files.select("f", F.posexplode(F.concat(F.split(text, "\n"), runs, head, whole)).alias("block", "part"))
    b = parts.select("f", "block", F.filter(F.split(F.lower("part"), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("t")).where(F.size("t") > 0)
    b = b.select("f", "block", F.size("t").alias("n"), F.filter("t", lambda w: w.isin(VOCABULARY)).alias("k"))
    b = b.select("f", "block", "n", "k", F.array_distinct("k").alias("known"))
    n_other, kinds = F.col("n") - F.size("k"), F.size("known")
    # counts of one sum weigh most if they are equal, and no idf is above that of other words
    most = kinds * F.pow(1 + F.log(F.size("k") / F.greatest(kinds, F.lit(1))), 2)
    counts = F.transform("known", lambda w: (F.size("k") - F.size(F.array_remove("k", w))).cast("int"))
    reach = (kinds > 0) & (most * (1 - THRESHOLD**2) >= n_other * THRESHOLD**2)
    return b.select("f", "block", "known", F.when(reach, counts).alias("counts"), n_other.alias("n_other"))


def scanned(files: DataFrame) -> DataFrame:
    """(f, license, score): the best template of each file's blocks, if it reaches THRESHOLD."""
    spark = files.sparkSession
    b = common.written(blocks(files))
    # at most one count per templates' term, and one of all blocks
    df = {r["t"]: r["n"] for r in b.select(F.explode("known").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = b.count()
    idf = {t: math.log((1 + total) / (1 + df.get(t, 0))) + 1 for t in VOCABULARY}
    other = math.log(1 + total) + 1
    weight = F.map_from_arrays(F.array(*map(F.lit, VOCABULARY)), F.array(*(F.lit(idf[t] ** 2) for t in VOCABULARY)))
    b = b.where("counts is not null").withColumn("x", F.zip_with("known", F.transform("counts", lambda c: 1 + F.log(c)), lambda t, c: F.struct(t.alias("t"), c.alias("c"))))
    on = F.aggregate("x", F.lit(0.0), lambda s, x: s + x["c"] * x["c"] * F.element_at(weight, x["t"]))
    b = b.select("f", "block", "x", on.alias("on"), "n_other").withColumn("norm2", F.col("on") + F.col("n_other") * F.lit(other**2))
    b = b.where(F.col("on") >= THRESHOLD**2 * F.col("norm2"))
    rows = []
    for k, (name, text) in enumerate(TEMPLATES):
        c = {t: 1 + math.log(n) for t, n in _counts(text).items()}
        norm = sum((n * idf[t]) ** 2 for t, n in c.items())
        rows += [(k, name, t, n * idf[t] ** 2, norm) for t, n in c.items()]
    table = spark.createDataFrame(rows, "template int, license string, t string, w2 double, tnorm2 double")
    dots = b.select("f", "block", "norm2", F.explode("x").alias("x")).select("f", "block", "norm2", "x.t", "x.c").join(F.broadcast(table), "t")
    scores = dots.groupBy("f", "block", "norm2", "template", "license", "tnorm2").agg(F.sum(F.col("c") * F.col("w2")).alias("dot"))
    scores = scores.withColumn("score", F.round(F.col("dot") / F.sqrt(F.col("norm2") * F.col("tnorm2")), 6)).where(F.col("score") >= THRESHOLD)
    order = F.struct((F.col("license") == "Proprietary").alias("p"), (-F.col("score")).alias("s"), "license")
    block = scores.groupBy("f", "block").agg(F.min(order).alias("m")).where("m.license <> ''")
    best = block.groupBy("f").agg(F.min("m").alias("m"))
    return best.select("f", F.col("m.license").alias("license"), (-F.col("m.s")).alias("score"))


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def licenses(files: DataFrame) -> DataFrame:
    """Adds license, score and how (`own`, `inherited` or null) to files of (path, text)."""
    names = [c for c in files.columns if c not in ("text", "license", "score", "how")]
    key = F.struct(F.coalesce("path", F.lit("")).alias("p"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    found = common.written(scanned(files.select(key.alias("f"), "path", "text")))
    thin = files.withColumn("__q", F.struct(key.alias("f"), _directory(F.col("path")).alias("dir"))).select(*names, "__q")
    found = found.select(F.struct(F.col("f").alias("g"), "license", "score").alias("__r"))
    thin = common.written(thin.join(found, F.col("__q.f") == F.col("__r.g"), "left"))
    held = thin.where(F.col("path").rlike(LICENCE_FILE) & F.col("__r.license").isNotNull()).groupBy(F.col("__q.dir").alias("up")).agg(F.min(F.struct((-F.col("__r.score")).alias("s"), F.col("__r.license").alias("license"))).alias("m"))
    held = held.select("up", F.col("m.license").alias("lic"))
    dirs = thin.where(F.col("path").isNotNull()).select(F.col("__q.dir").alias("dir")).distinct()
    ups = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(F.split("dir", "/")))).alias("k"))
    ups = ups.withColumn("up", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("k")), "/")).join(held, "up")
    near = ups.groupBy("dir").agg(F.max(F.struct("k", "lic")).alias("m")).select(F.struct("dir", F.col("m.lic").alias("lic")).alias("__n"))
    out = thin.join(common.written(near), (F.col("__q.dir") == F.col("__n.dir")) & F.col("__r").isNull() & F.col("path").isNotNull(), "left")
    how = F.when(F.col("__r").isNotNull(), "own").when(F.col("__n").isNotNull(), "inherited")
    return out.select(*(F.col(f"`{c}`") for c in names), F.coalesce("__r.license", "__n.lic").alias("license"), F.col("__r.score").alias("score"), how.alias("how"))


def tree(docs: DataFrame) -> DataFrame:
    """Documents as files `source/lang/doc_id.txt`, with the query's licence files (doc_id null)."""
    spark = docs.sparkSession
    extra = spark.createDataFrame([(p, TEMPLATES[k][1]) for p, k in TREE], "path string, text string")
    files = docs.select(F.col("doc_id"), F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("text").cast("string"))
    return files.unionByName(extra.withColumn("doc_id", F.lit(None).cast("long")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses(tree(common.table(spark, sf_dir, "documents")))
    return got.where("doc_id is not null").select("doc_id", "path", "license", "score", "how")


# DuckDB: the same scores of every block against every template, and inheritance by path prefixes.
_ROWS = ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
_TREE = ", ".join(f"('{path}', '{TEMPLATES[k][1]}')" for path, k in TREE)
_TERMS = "[x FOR x IN regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+') IF x <> '']"
SQL = f"""
WITH tpl AS (SELECT k, license, {_TERMS.format("text")} AS ts FROM (VALUES {_ROWS}) AS v(k, license, text)),
tt AS (SELECT k, license, t, 1 + ln(count(*)) AS c FROM (SELECT k, license, unnest(ts) AS t FROM tpl) GROUP BY ALL),
vocab AS (SELECT DISTINCT t FROM tt),
docs AS (SELECT row_number() OVER () AS f, doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents),
files AS (SELECT f, doc_id, path, text, false AS lic FROM docs UNION ALL SELECT -row_number() OVER (), NULL, path, text, true FROM (VALUES {_TREE}) AS v(path, text)),
cuts AS (SELECT f, string_split(text, chr(10)) || [p FOR p IN regexp_split_to_array(text, '\n(?:{WORDLESS}*\n)+') IF regexp_matches(p, '[\\p{{L}}\\p{{N}}][^\n]*\n[^\n]*[\\p{{L}}\\p{{N}}]')]
  || [h FOR h IN [regexp_extract(text, '{HEAD}')] IF h <> ''] || CASE WHEN lic THEN [text] ELSE [] END AS parts FROM files),
lines AS (SELECT f, unnest(parts) AS line, generate_subscripts(parts, 1) AS b FROM cuts),
blocks AS (SELECT f, b, ts FROM (SELECT f, b, {_TERMS.format("line")} AS ts FROM lines) WHERE len(ts) > 0),
terms AS (SELECT f, b, t, count(*) AS m, 1 + ln(count(*)) AS c FROM (SELECT f, b, unnest(ts) AS t FROM blocks) GROUP BY ALL),
total AS (SELECT count(*) AS n FROM blocks),
idf AS (SELECT t, ln((1 + any_value(n)) / (1 + count(f))) + 1 AS w FROM vocab LEFT JOIN terms USING (t), total GROUP BY t),
known AS (SELECT f, b, t, c, terms.m AS words, w FROM terms JOIN idf USING (t)),
size AS (SELECT f, b, len(ts) AS m FROM blocks),
norm AS (SELECT f, b, sum(c * c * w * w) + (any_value(m) - sum(words)) * pow(ln(1 + any_value(n)) + 1, 2) AS norm2 FROM known JOIN size USING (f, b), total GROUP BY f, b),
tnorm AS (SELECT k, license, sum(c * c * w * w) AS tnorm2 FROM tt JOIN idf USING (t) GROUP BY k, license),
dots AS (SELECT f, b, k, sum(known.c * tt.c * w * w) AS dot FROM known JOIN tt USING (t) GROUP BY f, b, k),
scores AS (SELECT f, b, license, round(dot / sqrt(norm2 * tnorm2), 6) AS score FROM dots JOIN norm USING (f, b) JOIN tnorm USING (k)),
best AS (SELECT f, b, min((license = 'Proprietary', -score, license)) AS m FROM scores WHERE score >= {THRESHOLD} GROUP BY f, b),
own AS (SELECT f, -m[2] AS score, m[3] AS license FROM (SELECT f, min(m) AS m FROM best WHERE m[3] <> '' GROUP BY f)),
held AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, license FROM files JOIN own USING (f) WHERE doc_id IS NULL),
near AS (SELECT f, arg_max(held.license, length(dir)) AS license FROM docs JOIN held ON starts_with(path, dir || '/') GROUP BY f)
SELECT doc_id, path, coalesce(own.license, near.license) AS license, own.score, CASE WHEN own.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' END AS how
FROM docs LEFT JOIN own USING (f) LEFT JOIN near USING (f)
"""
