"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from directories.

1. Texts that say anything of licences are taken apart into words, of which those of templates are kept with their places: sparse
   vectors, by a join with the table of template terms. For each template the best stretch of a text is the run of words whose terms
   outweigh the other words in it (a maximum sum over whole numbers, in one pass); it may lie anywhere, within a line of prose or over
   wrapped lines, and is as long as it is. The cosine of that stretch with the template, other words counting as the rarest, is the
   similarity; a licence file is compared as a whole too. A stretch without a word of licensing does not count.
2. SPDX-License-Identifier tags name a licence with similarity 1.
3. Inheritance: a directory's licence is that of its licence files (LICENSE, COPYING, ...). Distinct directories of
   files without an own licence are joined with licensed directories over all their ancestors, and the nearest wins.
   Files meet only one row for each directory, in a join that adaptive execution may split.

All of it is DataFrame functions. Defined results: null and empty texts have no licence; a null path has no directory; of similarities equal in tenths the match of more
words holds, then the greater similarity, then the licence that comes last by name; repeated rows are scanned each; columns of `keep` with the names of results are an error; an empty
table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.common import free_name, materialize, numbered

# Statements by which licences are known.
_GPL_NOTICE = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details.
You should have received a copy of the GNU {kind} Public License along with this program."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0", _GPL_NOTICE.format(kind="Affero General", version="3")),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", f"{_BSD_GRANT}\n{_BSD_AS_IS}"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", f"{_BSD_GRANT}\n{_BSD_NAMES}\n{_BSD_AS_IS}"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "Released under the CC0 1.0 Universal Public Domain Dedication"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", _GPL_NOTICE.format(kind="General", version="2")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", _GPL_NOTICE.format(kind="General", version="3")),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", _GPL_NOTICE.format(kind="Lesser General", version="2.1")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", _GPL_NOTICE.format(kind="Lesser General", version="3")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MIT", f"{_MIT_GRANT}\n{_AS_IS}"),
    ("MPL-2.0", "This work is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
)
TEMPLATES += tuple((name, f"GNU {kind} Public License version {v}") for name, kind, v in (("AGPL-3.0", "Affero General", "3"), ("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3")))
KEYWORD = r"(?i)licen[sc]e|spdx|public domain|redistribution and use|permission is|permission to use"
LICENCE_FILE = r"(?i)^(?:licen[sc]e|copying|unlicense)(?:[._-].*)?$"
IDENTIFIER = r"(?i)SPDX-License-Identifier:[ \t]*\(*([A-Za-z0-9][A-Za-z0-9.+-]*)"
#: Words of licensing, of which a stretch has one.
ANCHORS = {"license", "licence", "licensed", "licenced", "licenses", "domain", "redistribution", "permission"}
#: Words that tell nothing and are left out everywhere.
STOP = "a all an and any are as at be by for from in is it its may not of on or that the this to with you".split()

THRESHOLD = 0.6
#: Thousandths by which a stretch loses for each word that is no term of the template, and gains for a word of licensing.
OTHER, ANCHOR = 1000, 3000
#: A tag counts as so many words.
TAG_WORDS = 1 << 30


def template_words(text: str) -> Counter:
    return Counter(w for w in re.split(r"[^a-z0-9]+", text.lower()) if w and w not in STOP)


def terms(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple[list[tuple], float]:
    """(template, licence, word, gain, weight, share) of every word of every template: what a stretch gains by it, its inverse document
    frequency, and that times its part of the unit vector; and the weight of a word of no template."""
    counts = [template_words(t) for _, t in templates]
    df = Counter(w for c in counts for w in c)
    idf = {w: math.log(1 + len(counts) / n) for w, n in df.items()}
    rows = []
    for k, ((name, _), c) in enumerate(zip(templates, counts, strict=True)):
        size = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        rows += [(k, name, w, round(1000 * idf[w]) + ANCHOR * (w in ANCHORS), idf[w], idf[w] * n * idf[w] / size) for w, n in sorted(c.items())]
    return rows, math.log(1 + len(counts))


def words_of_text(text: Column) -> Column:
    """The words of a text that tell something, in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.isin(STOP))


def identifier(text: Column) -> Column:
    """The licence of the last SPDX tag by name, without "only" and "or later"; null if it is none of the templates'."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(1)), lambda x: F.regexp_replace(F.upper(x), r"(-ONLY|-OR-LATER|\+)$", ""))
    known = sorted({(n.upper(), n) for n, _ in TEMPLATES})
    named = F.create_map(*(F.lit(x) for pair in known for x in pair))
    return F.array_max(F.transform(found, lambda x: F.try_element_at(named, x)))


def _best_stretch(hits: Column) -> Column:
    """Indices (from 0) of the first and last of hits (pos, gain, ...) in the run with the greatest sum, the first of equals; a run goes on as
    long as what it has gained outweighs the other words on the way to the next hit."""
    start = F.struct(F.lit(0).cast("long").alias("now"), F.lit(0).alias("begin"), F.lit(0).cast("long").alias("best"), F.lit(0).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("i"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, h: Column) -> Column:
        left = a["now"] - OTHER * (h["pos"] - a["at"] - 1)
        goes_on = (a["i"] > 0) & (left > 0)
        now, begin = F.when(goes_on, left).otherwise(0) + h["gain"], F.when(goes_on, a["begin"]).otherwise(a["i"])
        better = now > a["best"]
        return F.struct(
            now.alias("now"), begin.alias("begin"), F.greatest(a["best"], now).alias("best"), F.when(better, begin).otherwise(a["first"]).alias("first"),
            F.when(better, a["i"]).otherwise(a["last"]).alias("last"), (a["i"] + 1).alias("i"), h["pos"].alias("at"),
        )

    return F.aggregate(hits, start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _cosine(hits: Column, n_other: Column, unknown: float) -> Column:
    """The cosine of a stretch with the template that hits (word, weight, share) are of; 0 without a word of licensing."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    dot = total(F.transform(hits, lambda h: h["share"]))
    each = F.array_distinct(F.transform(hits, lambda h: F.struct(h["word"].alias("word"), h["weight"].alias("weight"))))
    squares = total(F.transform(each, lambda t: F.pow(t["weight"] * F.size(F.filter(hits, lambda h: h["word"] == t["word"])), F.lit(2.0))))
    anchored = F.exists(hits, lambda h: h["word"].isin(sorted(ANCHORS)))
    return F.when(anchored, F.round(dot / F.sqrt(squares + n_other * F.lit(unknown * unknown)), 6)).otherwise(F.lit(0.0))


def _table(spark: SparkSession) -> tuple[DataFrame, float]:
    rows, unknown = terms()
    return spark.createDataFrame(rows, "template int, licence string, word string, gain long, weight double, share double"), unknown


def own_licences(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key, own: struct(tenths, n_words, similarity, licence) of the best match of each of texts (key, text, is_file) that has one: the most
    similar in tenths, of these the one of most words, as one licence's text may hold another's."""
    table, unknown = _table(texts.sparkSession)
    said = texts.where(F.coalesce(F.col("text").rlike(KEYWORD), F.lit(False)))
    placed = said.select("key", "is_file", F.posexplode(words_of_text(F.col("text"))).alias("pos", "word"))
    met = placed.join(F.broadcast(table), "word")
    hit = F.struct(F.col("pos").cast("long").alias("pos"), "word", "gain", "weight", "share")
    listed = met.groupBy("key", "template").agg(F.first("licence").alias("licence"), F.sort_array(F.collect_list(hit)).alias("hits"))
    run = listed.withColumn("run", _best_stretch(F.col("hits")))
    part = run.withColumn("part", F.slice("hits", F.col("run.first") + 1, F.col("run.last") - F.col("run.first") + 1))
    others = F.element_at("part", -1)["pos"] - F.get("part", F.lit(0))["pos"] + 1 - F.size("part")
    stretches = part.select("key", _cosine(F.col("part"), others, unknown).alias("similarity"), F.size("part").alias("n_words"), "licence")
    # Licence files as a whole: their other words are those of all the file.
    sizes = said.where("is_file").select(F.col("key").alias("of"), F.size(words_of_text(F.col("text"))).alias("n"))
    whole = listed.join(sizes, F.col("key") == F.col("of")).select("key", _cosine(F.col("hits"), F.col("n") - F.size("hits"), unknown).alias("similarity"), F.size("hits").alias("n_words"), "licence")
    tags = said.select("key", F.lit(1.0).alias("similarity"), F.lit(TAG_WORDS).alias("n_words"), identifier(F.col("text")).alias("licence")).where("licence IS NOT NULL")
    every = stretches.unionByName(whole).unionByName(tags).where(F.col("similarity") >= threshold)
    return every.groupBy("key").agg(F.max(F.struct(F.floor(F.col("similarity") * 10 + 0.5).cast("int").alias("tenths"), "n_words", "similarity", "licence")).alias("own"))


def scan(files: DataFrame, path: Column, text: Column, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """keep, licence, similarity, origin ("header", "file", "directory" or null) and via, the directory inherited from."""
    if clash := {c.lower() for c in keep} & {"licence", "similarity", "origin", "via"}:
        raise ValueError(f"columns {sorted(clash)} have names of results; rename them")
    rows, key, doc = numbered(files)
    at = free_name(files.columns, "key")
    plain = rows.select(F.col(key).alias(at), f"{doc}.*")
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    is_file = F.coalesce(name.rlike(LICENCE_FILE), F.lit(False))
    own = materialize(own_licences(plain.select(F.col(at).alias("key"), text.alias("text"), is_file.alias("is_file")), threshold), "licence-own")
    folder = F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))
    found = plain.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept"), folder.alias("folder"), is_file.alias("is_file"), F.col(at).alias("key"))
    rows = materialize(found.join(own, "key", "left").drop("key"), "licence-rows")
    licensed = materialize(rows.where("is_file AND own IS NOT NULL").groupBy(F.col("folder").alias("via")).agg(F.max("own").alias("given")), "licence-folders")
    lone = rows.where("own IS NULL AND folder IS NOT NULL").select("folder").distinct()
    parts = F.split("folder", "/")
    climbed = lone.select("folder", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("depth", "via"))
    nearest = climbed.join(licensed, "via").groupBy("folder").agg(F.max(F.struct("depth", "via", "given")).alias("near"))
    nearest = materialize(nearest.select(F.col("folder").alias("at"), "near"), "licence-nearest")
    # Rows with an own licence or without a folder meet nothing; their keys are spread.
    key = F.when(F.col("own").isNull() & F.col("folder").isNotNull(), F.col("folder")).otherwise(F.concat(F.lit("\x00"), F.pmod(F.xxhash64("kept"), F.lit(4096)).cast("string")))
    joined = rows.withColumn("at", key).join(nearest, "at", "left")
    origin = F.when(F.col("own").isNotNull(), F.when(F.col("is_file"), F.lit("file")).otherwise(F.lit("header"))).when(F.col("near").isNotNull(), F.lit("directory"))
    return joined.select("kept.*", F.coalesce("own.licence", "near.given.licence").alias("licence"), F.coalesce("own.similarity", "near.given.similarity").alias("similarity"), origin.alias("origin"), F.col("near.via").alias("via"))


def oracle(path: str, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the scan of documents under paths that an expression gives."""
    rows, unknown = terms()
    table = ", ".join(f"({k}, '{name}', '{w}', {g}, {x!r}::DOUBLE, {s!r}::DOUBLE)" for k, name, w, g, x, s in rows)
    words = lambda xs: ", ".join(f"'{x}'" for x in xs)
    named = ", ".join(f"('{n.upper()}', '{n}')" for n in sorted({n for n, _ in TEMPLATES}))
    return f"""
WITH tpl(k, licence, w, gain, weight, share) AS (VALUES {table}), names(u, licence) AS (VALUES {named}),
d AS MATERIALIZED (SELECT *, row_number() OVER () AS id, {path} AS path FROM documents),
f AS MATERIALIZED (SELECT id, doc_id, text, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') WHEN path IS NOT NULL THEN '' END AS folder,
  coalesce(regexp_matches(regexp_extract(path, '([^/]*)$', 1), '{LICENCE_FILE}'), false) AS is_file FROM d),
said AS MATERIALIZED (SELECT id, is_file, text, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND NOT list_contains([{words(STOP)}], w)) AS words FROM f WHERE regexp_matches(text, '{KEYWORD}')),
h AS MATERIALIZED (SELECT id, k, licence, pos, w, gain, weight, share, row_number() OVER (PARTITION BY id, k ORDER BY pos) AS i,
  sum(gain) OVER (PARTITION BY id, k ORDER BY pos) - {OTHER} * (pos - row_number() OVER (PARTITION BY id, k ORDER BY pos)) AS s
  FROM (SELECT id, unnest(words) AS w, generate_subscripts(words, 1) AS pos FROM said) JOIN tpl USING (w)),
m AS (SELECT *, min(s - gain) OVER (PARTITION BY id, k ORDER BY i) AS low FROM h),
b AS (SELECT id, k, arg_min(struct_pack(last := i, low := low), i) AS e FROM (SELECT *, max(s - low) OVER (PARTITION BY id, k) AS best FROM m) WHERE s - low = best GROUP BY id, k),
a AS (SELECT h.id, h.k, max(h.i) AS first, any_value(e.last) AS last FROM h JOIN b ON b.id = h.id AND b.k = h.k WHERE h.i <= e.last AND s - gain = e.low GROUP BY h.id, h.k),
p AS (SELECT h.id, h.k, licence, w, weight, share, pos, false AS whole FROM h JOIN a ON a.id = h.id AND a.k = h.k AND i BETWEEN first AND last
  UNION ALL SELECT h.id, k, licence, w, weight, share, pos, true FROM h JOIN said ON said.id = h.id AND is_file),
t AS (SELECT id, k, whole, any_value(licence) AS licence, w, count(*) AS n, any_value(weight) AS weight, sum(share) AS share, min(pos) AS lo, max(pos) AS hi FROM p GROUP BY id, k, whole, w),
c AS (SELECT t.id, t.k, any_value(t.licence) AS licence, sum(share) AS dot, sum(pow(weight * n, 2)) AS squares, CAST(sum(n) AS BIGINT) AS n_words,
  CASE WHEN whole THEN any_value(len(words)) ELSE max(hi) - min(lo) + 1 END - sum(n) AS others, bool_or(list_contains([{words(sorted(ANCHORS))}], w)) AS anchored FROM t JOIN said USING (id) GROUP BY t.id, t.k, whole),
x AS (SELECT id, round(dot / sqrt(squares + others * {unknown * unknown!r}), 6) AS similarity, n_words, licence FROM c WHERE anchored
  UNION ALL SELECT id, 1.0, {TAG_WORDS}, licence FROM (SELECT id, regexp_replace(upper(unnest(regexp_extract_all(text, '{IDENTIFIER}', 1))), '(-ONLY|-OR-LATER|\\+)$', '') AS u FROM said) JOIN names USING (u)),
own AS MATERIALIZED (SELECT id, max(struct_pack(tenths := floor(similarity * 10 + 0.5), n_words := n_words, similarity := similarity, licence := licence)) AS own FROM x WHERE similarity >= {threshold} GROUP BY id),
r AS MATERIALIZED (SELECT f.id, doc_id, folder, is_file, own FROM f LEFT JOIN own ON own.id = f.id),
g AS (SELECT folder AS via, max(own) AS given FROM r WHERE is_file AND own IS NOT NULL GROUP BY folder),
n AS (SELECT folder, arg_max(struct_pack(via := via, given := given), length(via)) AS near FROM (SELECT DISTINCT folder FROM r WHERE own IS NULL) z JOIN g ON via = '' OR folder = via OR starts_with(folder, via || '/') GROUP BY folder)
SELECT doc_id, coalesce(own.licence, near.given.licence) AS licence, coalesce(own.similarity, near.given.similarity) AS similarity,
  CASE WHEN own IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN near IS NOT NULL THEN 'directory' END AS origin, near.via AS via
FROM r LEFT JOIN n ON n.folder = r.folder AND own IS NULL"""
