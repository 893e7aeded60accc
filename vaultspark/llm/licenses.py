"""Operator 4: licence scans by sparse TF-IDF cosine to templates and inheritance along paths. Native.

Headers are compared to templates as sparse TF-IDF vectors: every line, and every block of consecutive lines that
are not blank, comment marks taken off and copyright lines left out, so that a header wrapped over lines is seen
whole. The whole text of a licence file is compared too, to templates of whole licences among others. Units that
hold none of the anchors are passed over: anchors are the heaviest terms of each template, enough that a unit
without them stays below the threshold whatever else it holds. Nor are units compared whose own terms outweigh those
of all templates so far that no cosine can reach the threshold. Files with no notice of their own take the licence
of the nearest ancestor directory that has a licence file; that is settled once for each directory, and files then
join their own directory only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark.llm.common import cut

#: Short notices, the paragraphs that licences ask to be put into files, and their titles.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("lgpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mpl-2.0", "Mozilla Public License Version 2.0"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("apache-2.0", "mit", "gpl-3.0", "gpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "mpl-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc-by-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc0-1.0")),
    *((name, f"SPDX-License-Identifier: {name}-{tail}") for name in ("gpl-3.0", "gpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0") for tail in ("only", "or-later")),
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
)
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
#: Whole licences, for the whole text of a licence file.
WHOLE = (
    ("mit", f"MIT License Copyright (c) {TEMPLATES[6][1]} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("bsd-2-clause", " ".join(_BSD[:3] + _BSD[4:])),
    ("bsd-3-clause", " ".join(_BSD)),
    ("isc", f"ISC License Copyright (c) {TEMPLATES[26][1]} THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("zlib", f"{TEMPLATES[27][1]} Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("unlicense", f"{TEMPLATES[28][1]} Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS.replace('AUTHORS OR COPYRIGHT HOLDERS', 'AUTHORS')} For more information, please refer to <https://unlicense.org>"),
)
THRESHOLD = 0.8
TOKEN = "[a-z0-9]+"
#: Words that make poor anchors, and words that make the worst.
PLAIN = frozenset("above any be can code copies copy data deal either event except express file files following form found free general had hereby including into june later loss may option other over person persons program provided public published shall source state style subject such terms time under use used version was were which who will without work your".split())
COMMON = frozenset("a all an and are as at but by for from has have he held in is it not of on one or out that the this to with you".split())
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\.(txt|md|rst))?$"
LAST_LINE = "last line"  # instead of names: a file whose last line is a notice is its directory's licence file
#: Comment marks at both ends of a line, and lines that name the holder only.
MARKS = r"^[\s/*#;%!<>.-]+|[\s/*#;%!<>-]+$"
HOLDER = r"(?i)^(copyright\b|\(c\)|©|all rights reserved)"


@cache
def weights() -> tuple[dict[str, float], float, list[tuple[str, str, float]]]:
    """(idf by term, idf of any other term, (template, term, weight) with each template's vector of length one).

    A template is named by its licence, its number, and w for a whole licence or u for any unit.
    """
    named = [(f"{name}#{k}#u", text) for k, (name, text) in enumerate(TEMPLATES)] + [(f"{name}#{k}#w", text) for k, (name, text) in enumerate(WHOLE)]
    counts = [Counter(re.findall(TOKEN, text.lower())) for _, text in named]
    used = Counter(term for c in counts for term in c)
    idf = {t: round(math.log((len(counts) + 1) / (n + 1)) + 1, 9) for t, n in used.items()}
    rows = []
    for (name, _), c in zip(named, counts):
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(name, t, round(n * idf[t] / norm, 9)) for t, n in sorted(c.items())]
    return idf, round(math.log(len(counts) + 1) + 1, 9), rows


@cache
def anchors(threshold: float = THRESHOLD) -> list[str]:
    """Terms without which no line or block reaches the threshold: by Cauchy-Schwarz, what is left of a template is too short.

    Templates of whole licences need none, as the few whole texts of licence files are not filtered.
    """
    chosen: set[str] = set()
    idf, _, rows = weights()
    spread = Counter(t for _, t, _ in rows)
    for name in sorted({r[0] for r in rows if r[0].endswith("u")}):
        mine = sorted((r for r in rows if r[0] == name), key=lambda r: (2 * (r[1] in COMMON) + (r[1] in PLAIN) + 1.5 * (len(r[1]) < 3 and r[1] not in COMMON and r[1] != "cc"), -r[2] * r[2] * spread[r[1]] ** 0.5, r[1]))
        rest = sum(w * w for _, t, w in mine if t not in chosen)
        for _, t, w in mine:
            if rest < threshold * threshold - 1e-6:
                break
            if t not in chosen:
                chosen.add(t)
                rest -= w * w
    return sorted(chosen)


def _scored(units: DataFrame, threshold: float) -> DataFrame:
    """(id, unit, no, last, licence, score) of (id, unit, no, last, body) at the threshold or above."""
    spark = units.sparkSession
    idf, other, terms = weights()
    by = ["id", "unit", "no", "last"]
    tokens = units.select(*by, F.explode(F.regexp_extract_all(F.lower("body"), F.lit(f"({TOKEN})"), 1)).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("tf"))
    known = spark.createDataFrame(sorted(idf.items()), "term string, idf double")  # the templates' own terms
    heavy = cut(tokens.join(F.broadcast(known), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other))))
    vectors = spark.createDataFrame(terms, "template string, vterm string, weight double")
    norms = heavy.groupBy(*by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = heavy.join(F.broadcast(vectors), F.col("term") == F.col("vterm")).filter((F.col("unit") == 2) | ~F.col("template").endswith("w"))
    dots = dots.groupBy(*by, "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, by).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= threshold)
    return scored.select(*by, F.substring_index("template", "#", 1).alias("licence"), "score")


#: A term and its repeats in sorted terms joined by spaces; possessive, so that any number of repeats needs no stack.
RUN = r"([^ ]+)(?: \1(?![^ ]))*+"


def may_reach(body: Column, threshold: float) -> Column:
    """False only for texts that reach the threshold with no template: a cosine is at most the share of a text's length that lies in terms of templates.

    Told within the row, so that what is left out is neither exploded nor shuffled.
    """
    idf, other, _ = weights()
    known = sorted(idf)
    terms = F.sort_array(F.regexp_extract_all(F.lower(body), F.lit(f"({TOKEN})"), 1))
    runs = F.regexp_extract_all(F.array_join(terms, " "), F.lit(RUN), 0)

    def surplus(total: Column, run: Column) -> Column:
        """Squares of known terms, times what they lack, less those of others."""
        term = F.substring_index(run, " ", 1)
        tf = (F.length(run) + 1) / (F.length(term) + 1)
        own = F.element_at(F.array(*map(F.lit, (idf[t] for t in known))), F.array_position(F.array(*map(F.lit, known)), term).cast("int"))
        least = threshold * threshold - 1e-6
        return total + tf * tf * F.when(term.isin(known), own * own * (1 - least)).otherwise(-other * other * least)

    return F.aggregate(runs, F.lit(0.0), surplus) >= 0


def _units(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, unit, no, last, body) of (id, body, is_file): lines (unit 0) and blocks of several lines (1) that hold an anchor, whole texts of licence files (2).

    Texts without an anchor are passed over before they are split, and units that may not reach the threshold after.
    """
    some = rf"(^|[^a-z0-9])({'|'.join(anchors(threshold))})($|[^a-z0-9])"
    held = lambda c: F.lower(c).rlike(some)
    split = F.split("body", "\n")
    line = lambda x, i: F.struct(F.lit(0).alias("unit"), i.alias("no"), (i == F.size(split) - 1).alias("last"), x.alias("body"))
    lines = F.filter(F.transform(split, line), lambda u: held(u["body"]))
    bare = F.filter(F.transform(split, lambda x: F.regexp_replace(x, MARKS, "")), lambda x: ~x.rlike(HOLDER))
    blocks = F.filter(F.split(F.array_join(bare, "\n"), r"\n\n+"), lambda x: x.contains("\n"))
    block = lambda x, i: F.struct(F.lit(1).alias("unit"), i.alias("no"), F.lit(False).alias("last"), x.alias("body"))
    whole = F.when(F.col("is_file"), F.array(F.struct(F.lit(2).alias("unit"), F.lit(0).alias("no"), F.lit(False).alias("last"), F.col("body").alias("body"))))
    found = F.when(held(F.col("body")), F.concat(lines, F.filter(F.transform(blocks, block), lambda u: held(u["body"]))))
    both = F.coalesce(F.concat(found, whole), found, whole)
    return rows.select("id", F.explode(both).alias("u")).select("id", "u.unit", "u.no", "u.last", "u.body").filter("body <> ''").filter(may_reach(F.col("body"), threshold))


def _dir(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, path: str = "path", text: str = "text", licence_file: Column | str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(path, own_licence, own_score, own_unit, own_line, licence, inherited_from): one row for each path.

    `own_unit` is line, block or whole, and `own_line` its number from 0 among its kind. Of a file's units the
    highest score counts, then lines before blocks before the whole, the first one, and the licence's name.
    `licence_file` tells licence files (by name, if it is not given; LAST_LINE: those whose last line is a notice,
    for which the whole text is no unit). `inherited_from` is the directory whose licence file decides, null for
    files with a notice of their own; of several licence files in a directory the one with the smallest path
    counts. Null texts are empty; rows with a null path are left out; rows that repeat a path are one file, with
    the units of all; texts of any length are scanned whole; an empty table gives no rows; extra columns, whatever
    their names, are ignored.
    """
    by_line = isinstance(licence_file, str)
    is_file = F.lit(False) if by_line else F.regexp_extract(F.col(path), "[^/]*$", 0).rlike(LICENCE_FILE) if licence_file is None else licence_file
    rows = files.filter(F.col(path).isNotNull()).select(F.col(path).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"), F.coalesce(is_file, F.lit(False)).alias("is_file"))
    scored = cut(_scored(_units(rows, threshold), threshold))
    top = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "unit", "no", "licence")).alias("x"), F.max("last").alias("last"))
    own = top.select("id", F.col("x.licence").alias("own_licence"), (-F.col("x.s")).alias("own_score"), F.element_at(F.array(*map(F.lit, ("line", "block", "whole"))), F.col("x.unit") + 1).alias("own_unit"), F.col("x.no").alias("own_line"), "last")
    marked = rows.groupBy("id").agg(F.max("is_file").alias("is_file")).join(own, "id", "left").withColumn("dir", _dir(F.col("id")))
    marked = marked.withColumn("is_file", F.coalesce(F.col("last"), F.lit(False)) if by_line else F.col("is_file"))
    by_dir = marked.filter("is_file and own_licence is not null").groupBy("dir").agg(F.min_by("own_licence", "id").alias("licence"))
    steps = F.split("dir", "/")
    up = marked.select("dir").distinct().withColumn("depth", F.explode(F.sequence(F.lit(0), F.size(steps)))).select("dir", "depth", F.array_join(F.slice(steps, 1, F.col("depth")), "/").alias("up"))
    nearest = up.join(by_dir.select(F.col("dir").alias("up"), "licence"), "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "licence")).alias("n"))
    joined = marked.join(nearest, "dir", "left")
    return joined.select(
        F.col("id").alias(path), "own_licence", "own_score", "own_unit", "own_line", F.coalesce("own_licence", "n.licence").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("n.up")).alias("inherited_from")
    )


def oracle() -> str:
    """DuckDB SQL for the scan of documents under source/lang/doc_id, whose licence files end in a notice."""
    idf, other, terms = weights()
    known = ", ".join(f"('{t}', {v!r}::double)" for t, v in sorted(idf.items()))
    vectors = ", ".join(f"('{n}', '{t}', {w!r}::double)" for n, t, w in terms if n.endswith("u"))
    return f"""
WITH idf(term, idf) AS (VALUES {known}), vec(template, vterm, weight) AS (VALUES {vectors}),
f AS (SELECT doc_id, source || '/' || lang AS dir, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, 0 AS unit, unnest(range(len(ls))) AS no, unnest(ls) AS body, len(ls) AS n_lines FROM f),
bare AS (SELECT doc_id, regexp_split_to_array(array_to_string(list_filter(list_transform(ls, lambda x: regexp_replace(x, '{MARKS}', '', 'g')), lambda x: NOT regexp_matches(x, '{HOLDER}')), chr(10)), '\\n\\n+') AS bs FROM f),
b AS (SELECT * FROM (SELECT doc_id, 1 AS unit, unnest(range(len(bs))) AS no, unnest(bs) AS body, 0 AS n_lines FROM (SELECT doc_id, list_filter(bs, lambda x: contains(x, chr(10))) AS bs FROM bare))),
tok AS (SELECT doc_id, unit, no, n_lines, term, count(*) AS tf FROM (SELECT doc_id, unit, no, n_lines, unnest(regexp_extract_all(lower(body), '{TOKEN}')) AS term FROM (SELECT * FROM l UNION ALL SELECT * FROM b)) GROUP BY ALL),
heavy AS (SELECT tok.*, tf * coalesce(idf, {other!r}::double) AS w FROM tok LEFT JOIN idf USING (term)),
norm AS (SELECT doc_id, unit, no, n_lines, sqrt(sum(w * w)) AS norm FROM heavy GROUP BY ALL),
dot AS (SELECT doc_id, unit, no, template, sum(w * weight) AS dot FROM heavy JOIN vec ON term = vterm GROUP BY ALL),
s AS (SELECT doc_id, unit, no, n_lines, split_part(template, '#', 1) AS licence, round(dot / norm, 6) AS score FROM dot JOIN norm USING (doc_id, unit, no) WHERE round(dot / norm, 6) >= {THRESHOLD}),
own AS (SELECT doc_id, licence AS own_licence, score AS own_score, ['line', 'block'][unit + 1] AS own_unit, no AS own_line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, unit, no, licence) AS r FROM s) WHERE r = 1),
ends AS (SELECT DISTINCT doc_id FROM s WHERE no = n_lines - 1 AND unit = 0),
per AS (SELECT dir, arg_min(own_licence, doc_id) AS licence FROM f JOIN own USING (doc_id) JOIN ends USING (doc_id) GROUP BY dir)
SELECT f.doc_id, own_licence, own_score, own_unit, own_line::integer AS own_line, coalesce(own_licence, per.licence) AS licence,
  CASE WHEN own_licence IS NULL AND per.licence IS NOT NULL THEN f.dir END AS inherited_from
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN per ON per.dir = f.dir"""
