"""Operator 9 [native]: licence scans. Dice coefficient over sets of word bigrams, by DataFrame functions only.

Each line of a text is normalised (lower case, runs of anything but ASCII letters and digits become one space) and
compared to the templates. With a and b bigrams a Dice coefficient of t needs t / (2 - t) * b <= a <= (2 - t) / t * b,
so the number of words alone rules out most lines before any bigram is made, and most templates of the rest.

The templates are a short fixed list, part of the plan as a literal. Lines are rows, so no group of documents or lines
ever meets in one task; only the best line of each document and licence is gathered.

A notice that is not a line of its own (a full licence text, a notice wrapped over lines or inside a longer line) is
found by windows of the text's words, whatever its lines: windows begin and end with a bigram of the template and have
2/3 to 3/2 of its number of bigrams. Windows that touch a line which matches by itself do not count again, and of
windows that overlap one counts. Lines and windows are made only of texts with one of a few words of the templates,
without which no template can reach the threshold. The SQL twin has all templates and compares all windows of all texts.

Licences that differ by a word or a number (GPL and LGPL, versions 2 and 3) are each reported where they reach the
threshold; dice tells which is nearest. Not built in: the full texts of Apache, GPL, LGPL, AGPL, MPL and Creative Commons
licences (their notices and the usual file headers are).

Defined results: a null text is an empty text, which matches nothing, like lines of fewer than two words; repeated
rows are counted together by doc_id (n_lines counts all matching lines and windows; line_no is a window's first line); ties of lines go to the earlier line; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: The usual one-line notices of common licences.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": ["Released under the ISC License."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
#: Full texts, file headers, and notices of the other Creative Commons families.
MORE = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS],
    "BSD-2-Clause": [f"{_BSD_2} {_BSD_END}"],
    "BSD-3-Clause": [f"{_BSD_2} {_BSD_3} {_BSD_END}"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
} | {
    f"CC-{kind}-4.0": [f"Licensed under CC {kind.replace('-', ' ', 1)} 4.0.", f"This work is licensed under a Creative Commons {name} 4.0 International License."]
    for kind, name in {"BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items()
} | {
    f"{short}-{version}.0": [f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."]
    for short, version, what, name in (("GPL", 2, "program", "General Public License"), ("GPL", 3, "program", "General Public License"), ("LGPL", 3, "library", "Lesser General Public License"), ("AGPL", 3, "program", "Affero General Public License"))
} | {"CC-BY-4.0": ["Licensed under CC BY 4.0."], "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."], "Zlib": [_ZLIB]}


def bigrams(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


#: Words that most English texts hold; ``needed`` takes them last.
USUAL = ("a", "and", "any", "by", "for", "from", "in", "is", "it", "of", "or", "that", "the", "this", "to", "under", "with", "you")


def needed(known: list[tuple[str, list[str]]], threshold: float) -> list[str]:
    """Words of which a text must hold one to reach the threshold with any template: without them too few bigrams are left."""
    out: set[str] = set()
    for _, b in known:
        least = len(b) * threshold / (2 - threshold)
        for word in sorted({x for g in b for x in g.split()}, key=lambda x: (x not in out, x in USUAL, -len(x), x)):
            if sum(out.isdisjoint(g.split()) for g in b) < least - 1e-9:
                break
            out.add(word)
    return sorted(out)


def holding(words: list[str]) -> str:
    """Pattern of a lower-case text that holds one of the words, by first letters, so that most words of a text fail at once."""
    ends: dict[str, list[str]] = {}
    for w in words:
        ends.setdefault(w[0], []).append(w[1:])
    return "(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(e)})" for c, e in ends.items()) + ")(?![a-z0-9])"


def windows(docs: DataFrame, table, threshold: float) -> DataFrame:
    """doc_id, license, s and e (first and last bigram), line_no, last (line), dice: the best window from each start."""
    only = lambda c: F.explode(F.array(c))
    split = lambda x: F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: w != "")
    placed = F.flatten(F.transform(F.split("text", "\n"), lambda x, n: F.transform(split(x), lambda w: F.struct(w.alias("w"), n.alias("n")))))
    some = docs.select("doc_id", only(placed).alias("w")).where(F.size("w") > 1)
    pair = lambda x, y: F.struct(F.concat_ws(" ", x["w"], y["w"]).alias("g"), x["n"].alias("first"), y["n"].alias("last"))
    some = some.select("doc_id", only(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), pair)).alias("x"))
    some = some.select("doc_id", "x", only(F.col("x.g")).alias("g"))
    low, high = F.size("t.b") * (threshold / (2 - threshold)) - 1e-9, F.size("t.b") * ((2 - threshold) / threshold) + 1e-9
    some = some.select("doc_id", "x", "g", F.explode(table).alias("t")).where(F.size(F.array_intersect("g", "t.b")) >= low)
    at = F.filter(F.transform("g", lambda g, i: F.when(F.array_contains("t.b", g), i)), lambda i: i.isNotNull())
    some = some.select("doc_id", "x", "g", "t", only(at).alias("at"))
    starts = some.select("doc_id", "x", "g", "t", "at", F.explode("at").alias("s"))
    fits = lambda e: (e - F.col("s") + 1 >= low) & (e - F.col("s") + 1 <= high)
    own = lambda e: F.array_distinct(F.slice("g", F.col("s") + 1, e - F.col("s") + 1))
    dice = lambda e: F.round(2.0 * F.size(F.array_intersect(own(e), "t.b")) / (F.size(own(e)) + F.size("t.b")), 6)
    best = F.array_max(F.transform(F.filter("at", fits), lambda e: F.struct(dice(e).alias("dice"), (-e).alias("e"))))
    found = starts.select("doc_id", F.col("t.license").alias("license"), "x", "s", only(best).alias("m")).where(F.col("m.dice") >= threshold)
    return found.select("doc_id", "license", "s", (-F.col("m.e")).alias("e"), F.col("x")[F.col("s")]["first"].alias("line_no"), F.col("x")[-F.col("m.e")]["last"].alias("last"), F.col("m.dice").alias("dice"))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, n_lines (matching), line_no (of the best, from 0), dice (of the best, 6 decimals)."""
    given = [TEMPLATES, MORE] if templates is None else [templates]
    known = [(name, bigrams(t)) for d in given for name, texts in d.items() for t in texts]
    known = [(name, b) for name, b in known if b]
    low, high = min(len(b) for _, b in known) * threshold / (2 - threshold), max(len(b) for _, b in known) * (2 - threshold) / threshold
    table = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, b)).alias("b")) for name, b in known])
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.lower("text").rlike(holding(needed(known, threshold))))
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # explode(array(x)) keeps x as a column of its own: else the optimiser would copy its expression into the lambdas below
    # and compute it again for each element.
    only = lambda c: F.explode(F.array(c))
    lines = lines.select("doc_id", "line_no", only(F.trim(F.regexp_replace(F.lower("line"), "[^a-z0-9]+", " "))).alias("line"))
    # A line of w words has at most w - 1 bigrams; lines of too few words need no split into words.
    spaces = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    words = lines.where(spaces >= low - 1e-9).select("doc_id", "line_no", only(F.split("line", " ")).alias("w"))
    made = F.array_distinct(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda x, y: F.concat_ws(" ", x, y)))
    # Repeated words may keep a long line's set small, so the upper bound is on distinct words, of which b bigrams have at most b + 1.
    few = words.where(F.size(F.array_distinct("w")) <= high + 1).select("doc_id", "line_no", only(made).alias("b")).where(F.size("b").between(low - 1e-9, high + 1e-9))
    fits = lambda t: (F.size("b") >= F.size(t["b"]) * (threshold / (2 - threshold)) - 1e-9) & (F.size("b") <= F.size(t["b"]) * ((2 - threshold) / threshold) + 1e-9)
    dice = lambda t: F.round(2.0 * F.size(F.array_intersect("b", t["b"])) / (F.size("b") + F.size(t["b"])), 6)
    near = few.select("doc_id", "line_no", "b", F.explode(F.filter(table, fits)).alias("t"))
    hits = near.select("doc_id", "line_no", F.struct(F.col("t.license").alias("license"), dice(F.col("t")).alias("dice")).alias("s")).where(F.col("s.dice") >= threshold)
    best = hits.groupBy("doc_id", F.col("s.license").alias("license"), "line_no").agg(F.max("s.dice").alias("dice"), F.count("*").alias("n"))
    inside = windows(texts, table, threshold)
    line = F.struct(F.col("dice"), (-F.col("line_no")).alias("at"))
    window = F.struct("e", "s", "line_no", "last", "dice")
    none = F.lit(None)
    rows = best.select("doc_id", "license", "line_no", line.alias("m"), none.cast("struct<e:int,s:int,line_no:int,last:int,dice:double>").alias("v")).unionByName(
        inside.select("doc_id", "license", none.cast("int").alias("line_no"), none.cast("struct<dice:double,at:int>").alias("m"), window.alias("v"))
    )
    # Bounded by a document's own matches.
    both = rows.groupBy("doc_id", "license").agg(F.count("line_no").alias("n"), F.collect_set("line_no").alias("own"), F.max("m").alias("m"), F.sort_array(F.collect_set("v")).alias("v"))
    both = both.withColumn("v", F.filter("v", lambda v: ~F.exists("own", lambda n: n.between(v["line_no"], v["last"]))))
    # Windows apart from each other, by their ends: as many as there are passages.
    apart = F.aggregate("v", F.expr("named_struct('n', 0L, 'end', -1)"), lambda acc, v: F.when(v["s"] > acc["end"], F.struct((acc["n"] + 1).alias("n"), v["e"].alias("end"))).otherwise(acc), lambda acc: acc["n"])
    top = F.greatest("m", F.array_max(F.transform("v", lambda v: F.struct(v["dice"].alias("dice"), (-v["line_no"]).alias("at")))))
    both = both.select("doc_id", "license", (F.col("n") + apart).alias("n_lines"), top.alias("m"))
    return both.select("doc_id", "license", "n_lines", (-F.col("m.at")).cast("long").alias("line_no"), F.col("m.dice").alias("dice"))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(templates: dict[str, list[str]] | None = None) -> str:
    """The same by brute force: every line, and every window between two bigrams of a template, in every text."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = [(n, t) for d in ([TEMPLATES, MORE] if templates is None else [templates]) for n, ts in d.items() for t in ts]
    rows = ", ".join(f"({i}, {quote(name)}, {quote(t)})" for i, (name, t) in enumerate(known))
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    least, most = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD
    return f"""
WITH RECURSIVE template AS (SELECT t, license, string_split(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM (VALUES {rows}) v(t, license, x)),
tb AS MATERIALIZED (SELECT t, license, {grams} AS b FROM template),
tg AS MATERIALIZED (SELECT t, license, len(b) AS m, unnest(b) AS g FROM tb),
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents),
lw AS MATERIALIZED (SELECT doc_id, line_no, string_split(trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM line),
lb AS MATERIALIZED (SELECT doc_id, line_no, {grams} AS b FROM lw WHERE len(w) >= 2),
lg AS (SELECT doc_id, line_no, len(b) AS n, unnest(b) AS g FROM lb),
pair AS (SELECT doc_id, line_no, license, t, round(2.0 * count(*) / (any_value(n) + any_value(m)), 6) AS dice FROM lg JOIN tg USING (g) GROUP BY doc_id, line_no, license, t),
hit AS MATERIALIZED (SELECT doc_id, license, line_no, max(dice) AS dice FROM pair WHERE dice >= {THRESHOLD} GROUP BY ALL),
lword AS (SELECT doc_id, line_no, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM lw),
word AS (SELECT doc_id, x, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, k) - 1 AS i FROM lword WHERE x <> ''),
gram AS MATERIALIZED (SELECT doc_id, i, x || ' ' || lead(x) OVER d AS g, line_no, lead(line_no) OVER d AS last FROM word WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
place AS MATERIALIZED (SELECT doc_id, t, license, m, i, g, line_no, last FROM gram JOIN tg USING (g)),
kept AS (SELECT doc_id, t FROM place GROUP BY doc_id, t HAVING count(DISTINCT g) >= any_value(m) * {least} - 1e-9),
cand AS MATERIALIZED (SELECT * FROM place SEMI JOIN kept USING (doc_id, t)),
spans AS MATERIALIZED (SELECT a.doc_id, a.t, a.license, a.m, a.i AS s, b.i AS e, a.line_no, b.last FROM cand a JOIN cand b ON a.doc_id = b.doc_id AND a.t = b.t AND b.i - a.i + 1 BETWEEN a.m * {least} - 1e-9 AND a.m * {most} + 1e-9),
whole AS MATERIALIZED (SELECT doc_id, list(g ORDER BY i) AS g FROM gram SEMI JOIN kept USING (doc_id) WHERE g IS NOT NULL GROUP BY doc_id),
scored AS (SELECT doc_id, t, license, s, e, line_no, last, round(2.0 * len(list_intersect(list_distinct(g[s + 1 : e + 1]), b)) / (len(list_distinct(g[s + 1 : e + 1])) + m), 6) AS dice FROM spans JOIN whole USING (doc_id) JOIN tb USING (t, license)),
best AS MATERIALIZED (SELECT * FROM scored WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, t, s ORDER BY dice DESC, e) = 1),
loose AS MATERIALIZED (SELECT DISTINCT doc_id, license, s, e, line_no, dice FROM best WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.doc_id = best.doc_id AND hit.license = best.license AND hit.line_no BETWEEN best.line_no AND best.last)),
apart(doc_id, license, e) AS (
  SELECT doc_id, license, min(e) FROM loose GROUP BY doc_id, license
  UNION ALL
  SELECT loose.doc_id, loose.license, min(loose.e) FROM apart JOIN loose ON loose.doc_id = apart.doc_id AND loose.license = apart.license AND loose.s > apart.e GROUP BY loose.doc_id, loose.license
),
found AS (SELECT doc_id, license, line_no, dice FROM hit UNION ALL SELECT doc_id, license, line_no, dice FROM loose),
number AS (SELECT doc_id, license, count(*) AS n_lines FROM (SELECT doc_id, license FROM hit UNION ALL SELECT doc_id, license FROM apart) GROUP BY doc_id, license)
SELECT doc_id, license, any_value(n_lines) AS n_lines, arg_max(line_no, dice * 1e9 - line_no * 1e-3) AS line_no, max(dice) AS dice FROM found JOIN number USING (doc_id, license) GROUP BY doc_id, license"""
