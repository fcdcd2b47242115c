"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from
the nearest directory above that holds a licence file, in DataFrame functions only.

A header is a line of a text, anywhere in it, that holds a cue, or as many words as a template has,
aligned with it at a cue, over line ends and within long lines. An SPDX identifier is read as it
stands. A licence file is one by name or one whose whole text is close to a template. Document frequencies of the templates' terms are
counted over all texts; other terms of a header weigh as terms that no text has.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import bind, spread_join, written

# Notices and opening words of well-known licences.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file is strictly prohibited."],
}
# Complete texts, compared with whole texts only.
FULL = {
    "MIT": """MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
}
FULL |= {
    "BSD-2-Clause": FULL["BSD-3-Clause"].replace(FULL["BSD-3-Clause"][FULL["BSD-3-Clause"].index(" 3. Neither") : FULL["BSD-3-Clause"].index(" THIS SOFTWARE")], ""),
    "ISC": """ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to unlicense.org""",
}
#: Words that name a licence: words amid others count as a template's notice only with those of them that it has.
NAMING = {"mit", "apache", "gnu", "mozilla", "cc", "nc", "creative", "noncommercial", "reserved"}
CUE_TERM = r"^(?:licen[cs]e[ds]?|copyright|rights|permission|redistribut[a-z]*)$"
SPDX = r"(?i)spdx-license-identifier:[ \t]*\(?([a-z0-9.+-]+(?:[ \t]+(?:or|and|with)[ \t]+[a-z0-9.+-]+)*)"
#: Identifiers by their licence here; others stand for themselves.
SPDX_NAMES = {x.lower(): x for x in TEMPLATES if x != "proprietary"} | {f"gpl-3.0{x}": "GPL-3.0" for x in ("+", "-only", "-or-later")}
CUE = r"(?i)licen[cs]e|copyright|rights reserved|permission is|redistribut|spdx-"
FILE_NAME = r"(?i)^(?:licen[cs]e|copying|copyright|unlicense)(?:[.-][a-z0-9.-]*)?$"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _template_terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def _idf(df: int, n: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def document_frequencies(texts: DataFrame) -> tuple[dict[str, int], int]:
    """Over all rows of ``_text``: how many hold each template term, and the number of rows."""
    vocabulary = sorted({t for lines in [*TEMPLATES.values(), list(FULL.values())] for x in lines for t in _template_terms(x)})
    held = F.array_intersect(_terms(F.col("_text")), F.array(*map(F.lit, vocabulary)))
    counted = texts.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("term")).groupBy("term").count().collect()  # a row a term
    found = {r.term: r["count"] for r in counted}
    n = found.pop("", 0)
    return found, n


def _template_weights(line: str, idf: dict[str, float], rare: float) -> dict[str, float]:
    own: dict[str, float] = {}
    for t in _template_terms(line):
        own[t] = own.get(t, 0.0) + idf.get(t, rare)
    norm = math.sqrt(sum(w * w for w in own.values()))
    return {t: w / norm for t, w in sorted(own.items())}


def _map(weights: dict[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for t in sorted(weights) for x in (t, weights[t]))) if weights else F.expr("cast(map() AS map<string,double>)")


def _norm(ts: Column, idf: Column, rare: float, vocabulary: list[str]) -> Column:
    """The length of the text's vector. Equal terms are neighbours once sorted, so their counts
    come from one pass: the square of a count grows by 2 n + 1 with the next of the same."""
    weight = lambda t: F.when(t.isin(vocabulary), F.coalesce(F.try_element_at(idf, t), F.lit(rare))).otherwise(F.lit(rare))

    def step(a: Column, t: Column) -> Column:
        n = F.when(a["t"] == t, a["n"] + 1).otherwise(F.lit(0))
        w = weight(t)
        return F.struct(t.alias("t"), n.alias("n"), (a["s"] + w * w * (2 * n + 1)).alias("s"))

    zero = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(0.0).alias("s"))
    return F.sqrt(F.aggregate(F.sort_array(ts), zero, step, lambda a: a["s"]))


def _best(text: Column, found: dict[str, int], n: int, full: bool = False) -> Column:
    """(similarity, license) of the nearest template; of equal ones the last by name. Terms are
    sorted once; only those that a template has are looked up."""
    rare = _idf(0, n)
    lines = [(name, x) for name, xs in TEMPLATES.items() for x in xs] + (list(FULL.items()) if full else [])
    idf = {t: _idf(df, n) for t, df in found.items()}
    vocabulary = sorted({t for _, x in lines for t in _template_terms(x)} | set(idf))
    weights = _map(idf)
    options = [(name, _map(_template_weights(x, idf, rare))) for name, x in lines]

    def scored(ts: Column) -> Column:
        # one entry an occurrence: a term's weight in the text grows by its idf with each
        known = F.transform(F.filter(ts, lambda t: t.isin(vocabulary)), lambda t: F.struct(t.alias("t"), F.coalesce(F.try_element_at(weights, t), F.lit(rare)).alias("i")))
        dot = lambda ks, m: F.aggregate(ks, F.lit(0.0), lambda a, x: a + x["i"] * F.coalesce(F.try_element_at(m, x["t"]), F.lit(0.0)))
        best = lambda ks, length: F.array_max(F.array(*(F.struct(F.when(length > 0, F.round(dot(ks, m) / length, 6)).otherwise(F.lit(0.0)).alias("similarity"), F.lit(name).alias("license")) for name, m in options)))
        return bind(F.struct(known.alias("known"), _norm(ts, weights, rare, vocabulary).alias("length")), lambda x: best(x["known"], x["length"]))

    return bind(_terms(text), scored)


def _best_window(text: Column, found: dict[str, int], n: int, names: list[str]) -> Column:
    """(similarity, license) of the nearest template of ``names`` to as many words of the text,
    which begin where a cue of the text meets the same cue of the template."""
    idf, rare = {t: _idf(df, n) for t, df in found.items()}, _idf(0, n)
    weights = _map(idf)
    total = lambda xs, of: F.aggregate(xs, F.lit(0.0), lambda a, x: a + of(x))

    def nearest(ts: Column, cues: Column, name: str, line: str) -> Column:
        own, m = _template_terms(line), _map(_template_weights(line, idf, rare))
        anchors = {t: own.index(t) for t in own if re.match(CUE_TERM, t)}
        needed = sorted(NAMING & set(own))
        begins = lambda t, c: F.transform(F.filter(cues, lambda x: x["t"] == t), lambda x: F.greatest(x["at"] - c, F.lit(0)))
        starts = F.array_distinct(F.concat(*(begins(t, c) for t, c in anchors.items())))

        def cosine(w: Column) -> Column:
            norm = F.sqrt(total(w, lambda x: x["i"] * x["i"] * F.size(F.filter(w, lambda y: y["t"] == x["t"]))))
            near = F.round(total(w, lambda x: x["i"] * F.coalesce(F.try_element_at(m, x["t"]), F.lit(0.0))) / norm, 6)
            if not needed:
                return near
            held = F.size(F.array_intersect(F.array(*map(F.lit, needed)), F.transform(w, lambda x: x["t"]))) == len(needed)
            return F.when(held, near).otherwise(F.lit(0.0))

        best = F.array_max(F.transform(starts, lambda s: bind(F.slice(ts, s + 1, len(own)), cosine)))
        return F.struct(F.coalesce(best, F.lit(0.0)).alias("similarity"), F.lit(name).alias("license"))

    def scored(ts: Column) -> Column:
        cues = F.filter(F.transform(ts, lambda x, i: F.struct(x["t"].alias("t"), i.alias("at"))), lambda x: F.rlike(x["t"], F.lit(CUE_TERM)))
        return bind(cues, lambda cs: F.array_max(F.array(*(nearest(ts, cs, name, line) for name in names for line in TEMPLATES[name]))))

    return bind(F.transform(_terms(text), lambda t: F.struct(t.alias("t"), F.coalesce(F.try_element_at(weights, t), F.lit(rare)).alias("i"))), scored)


def _identified(text: Column) -> Column:
    """The licence of the first SPDX identifier, or null."""
    said = F.regexp_extract(text, SPDX, 1)
    names = F.create_map(*(F.lit(x) for kv in sorted(SPDX_NAMES.items()) for x in kv))
    return F.when(said != "", F.coalesce(F.try_element_at(names, F.lower(said)), said))


def scan_licenses(df: DataFrame, path: Column, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, path, license, origin ('header', 'file', 'inherited', 'none') and similarity: a row
    for each row, ``path`` being a column expression with '/' between directories.

    An SPDX identifier counts before a text's other headers, and "all rights reserved" amid other
    words only where there is no other licence. Of texts of any length each term is read once, sorted,
    whatever the number of distinct ones. A text's own header or licence file counts before a directory's. In a directory the licence
    of most files counts, of equal ones the first by name. Null and empty texts have no header
    but inherit; a null path is a file in no directory. Repeated rows stay; an empty table
    gives an empty one; other columns aren't read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found, n = document_frequencies(docs)
    name, folder = F.regexp_extract("path", r"([^/]*)$", 1), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    none = F.struct(F.lit(0.0).alias("similarity"), F.lit(None).cast("string").alias("license"))
    cued = F.rlike("_text", F.lit(CUE))
    headers = F.filter(F.split("_text", r"\r?\n"), lambda x: F.rlike(x, F.lit(CUE)))
    line = F.when(cued, F.array_max(F.transform(headers, lambda x: _best(x, found, n))))
    marked = docs.withColumns({"folder": folder, "line": F.coalesce(line, none), "whole": F.coalesce(F.when(cued, _best(F.col("_text"), found, n, full=True)), none), "named": F.rlike(name, F.lit(FILE_NAME))})
    free = [x for x in TEMPLATES if x != "proprietary"]
    within = lambda names: F.coalesce(F.when(cued, _best_window(F.col("_text"), found, n, names)), none)
    marked = marked.withColumns({"free": within(free), "closed": within(["proprietary"]), "spdx": F.when(cued, _identified(F.col("_text")))})
    own = F.when(F.col("whole.similarity") >= F.col("line.similarity"), F.col("whole")).otherwise(F.col("line"))
    better = lambda one, two: F.when(two["similarity"] > one["similarity"], two).otherwise(one)
    closed = (own["similarity"] < threshold) | (own["license"] == "proprietary")
    own = F.when(closed & (F.col("free.similarity") >= threshold), F.col("free")).when(closed, better(better(own, F.col("free")), F.col("closed"))).otherwise(better(own, F.col("free")))
    own = F.when(F.col("spdx").isNotNull(), F.struct(F.lit(1.0).alias("similarity"), F.col("spdx").alias("license"))).otherwise(own)
    is_file = (F.col("whole.similarity") >= threshold) | (F.col("named") & (own["similarity"] >= threshold))
    # written once: it is read as files, as folders and as rows, none of which should scan texts
    marked = written(marked.select("doc_id", "path", "folder", is_file.alias("is_file"), own.alias("own")), "licenses")
    ranked = marked.where("is_file").groupBy("folder", F.col("own.license").alias("license")).count()
    of_folder = ranked.groupBy("folder").agg(F.min(F.struct((-F.col("count")).alias("c"), "license")).alias("m")).select(F.col("folder").alias("above"), F.col("m.license").alias("of_above"))
    # each folder once, with those above it: nearest first
    folders = marked.select("folder").distinct().withColumn("parts", F.split("folder", "/"))
    above = folders.select("folder", F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("k"), "parts").select("folder", "k", F.array_join(F.slice("parts", 1, F.col("k")), "/").alias("above"))
    nearest = above.join(of_folder, "above").groupBy("folder").agg(F.max(F.struct("k", "of_above")).alias("m")).select("folder", F.col("m.of_above").alias("inherited"))
    joined = spread_join(marked, nearest, "folder", "path", "left")
    has = F.col("own.similarity") >= threshold
    return joined.select(
        "doc_id",
        "path",
        F.when(has, F.col("own.license")).otherwise(F.col("inherited")).alias("license"),
        F.when(F.col("is_file"), "file").when(has, "header").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.col("own.similarity").alias("similarity"),
    )
