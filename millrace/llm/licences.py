"""Licence scans by Dice coefficient over word bigrams. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, table

# Public licence notices and texts, as templates.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "rights-reserved": "All rights reserved.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: Least Dice coefficient of a match.
THRESHOLD = 0.8


def tokens(text: str) -> list[str]:
    """Letters and digits of ASCII in lower case, other ASCII characters as gaps."""
    return [w for w in re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", text.translate({c: c + 32 for c in range(65, 91)})).split(" ") if w]


def bigrams(text: str) -> list[str]:
    w = tokens(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])}) or w[:1]


def _normalised(text: Column) -> Column:
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.btrim(F.regexp_replace(low, r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " "), F.lit(" "))


def _once(x: Column, name: str) -> Column:
    """A column that is computed once: a generator of one row, which later filters and projections are not merged into."""
    return F.explode(F.array(x)).alias(name)


def _bigrams(w: Column) -> Column:
    pairs = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.when(F.size(w) < 2, w).otherwise(F.array_distinct(F.filter(pairs, lambda x: x.isNotNull())))


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in words])


def _candidates(docs: DataFrame, grams: dict[str, list[str]], threshold: float) -> DataFrame:
    """(doc_id, text, licences): the rows that can match a template, with the names of those.

    A unit that matches holds all but (1 - threshold / (2 - threshold)) of the template's bigrams. A word that begins some of them
    and is missing in the text costs a bigram at least, so no more of these words may be missing than bigrams.
    """
    low = threshold / (2 - threshold)
    first = {k: sorted({x.split(" ")[0] for x in g}) for k, g in grams.items()}
    least = {k: len(first[k]) - int(len(g) * (1 - low) + 1e-9) for k, g in grams.items()}
    text = F.coalesce(F.col("text"), F.lit(""))
    every = _literals(sorted({w for words in first.values() for w in words}))
    rows = docs.select("doc_id", text.alias("text"), _once(F.array_intersect(F.split(_normalised(text), " "), every), "held")).filter(F.size("held") >= min(least.values()))
    names = F.array(*[F.when(F.size(F.array_intersect("held", _literals(first[k]))) >= least[k], F.lit(k)) for k in sorted(grams)])
    return rows.select("doc_id", "text", _once(F.array_compact(names), "licences")).filter(F.size("licences") > 0)


def _templates(grams: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, g in sorted(grams.items()) for x in (F.lit(k), _literals(g))])


def _units(rows: DataFrame, grams: dict[str, list[str]], threshold: float) -> DataFrame:
    """(doc_id, licence, dice, units, runs): lines, and the whole of a text of several, that are like a template."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0)
    units = F.concat(lines, F.when(F.size(lines) > 1, F.array("text")).otherwise(F.array().cast("array<string>")))
    norm = rows.select("doc_id", "licences", F.explode(units).alias("unit")).select("doc_id", "licences", _once(_normalised(F.col("unit")), "norm")).filter(F.col("norm") != "")
    # distinct bigrams never outnumber words less one
    words = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    sized = norm.filter(words - 1 >= int(min(map(len, grams.values())) * low)).select("doc_id", "licences", _once(F.split("norm", " "), "w")).select("doc_id", "licences", _once(_bigrams(F.col("w")), "grams"))
    pairs = sized.select("doc_id", "grams", F.explode("licences").alias("licence")).withColumn("t", F.element_at(_templates(grams), F.col("licence")))
    n, k = F.size("grams"), F.size("t")
    fits = pairs.filter((n >= low * k - 1e-9) & (n <= high * k + 1e-9))
    found = fits.select("doc_id", "licence", (2.0 * F.size(F.array_intersect("grams", "t")) / (n + k)).alias("dice")).filter(F.col("dice") >= threshold)
    return found.select("doc_id", "licence", "dice", F.lit(1).cast("long").alias("units"), F.lit(0).cast("long").alias("runs"))


def _runs(rows: DataFrame, grams: dict[str, list[str]], threshold: float) -> DataFrame:
    """(doc_id, licence, dice, units, runs): runs of two or more lines that are like a template; runs counts disjoint ones of each row.

    A match holds at least threshold / (2 - threshold) of the template's bigrams and gains by dropping outer lines that hold none, so only
    runs between lines that hold some, and hold enough together, are compared. Lines without words are passed over. A run has, by
    definition, at most twice the words that the largest matching unit has bigrams. Every line is a row: running sums over a text's
    lines are windows, and a start that has enough bigrams ahead meets the lines ahead by an equal join on ranges of that many
    words, so the work is in proportion to the lines of a text.
    """
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    span = {k: -(-2 * len(g) * high // 1) for k, g in grams.items()}
    width = int(max(span.values()))
    words = F.split("norm", " ")
    each = rows.filter(F.contains("text", F.lit("\n"))).select("rid", "doc_id", "licences", F.posexplode(F.split("text", "\n")).alias("li", "line"))
    each = each.select("rid", "doc_id", "licences", "li", _once(_normalised(F.col("line")), "norm")).filter("norm <> ''").select("rid", "doc_id", "licences", "li", _once(words, "w"))
    text = Window.partitionBy("rid").orderBy("li")
    lines = each.withColumns({"i": F.row_number().over(text), "upto": F.sum(F.size("w")).over(text.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "first": F.lead(F.get("w", F.lit(0))).over(text)})
    held = _bigrams(F.concat("w", F.when(F.col("first").isNotNull(), F.array("first")).otherwise(F.array().cast("array<string>"))))
    lines = lines.select("rid", "doc_id", "licences", "i", "upto", "w", _once(held, "grams")).select("rid", "doc_id", "i", "upto", "w", "grams", F.explode("licences").alias("licence"))
    counted = lines.select("rid", "doc_id", "licence", "i", "upto", "w", F.size(F.array_intersect("grams", F.element_at(_templates(grams), F.col("licence")))).alias("h"))
    one = Window.partitionBy("rid", "licence").orderBy("i")
    counted = durable(counted.withColumns({"sums": F.sum("h").over(one.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "ends": (F.col("h") > 0) | (F.coalesce(F.lag("h").over(one), F.lit(0)) > 0)}))
    of = lambda values: F.element_at(F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(v))]), F.col("licence"))
    need = of({k: len(g) * low - 1e-9 for k, g in grams.items()})
    ahead = Window.partitionBy("rid", "licence").orderBy("upto").rangeBetween(Window.currentRow, width)
    starts = counted.filter("h > 0").withColumn("_most", F.max("sums").over(ahead)).filter(F.col("_most") - F.col("sums") + F.col("h") >= need)
    bucket = lambda c: F.call_function("div", F.col(c), F.lit(width).cast("long"))
    starts = starts.select(F.col("rid").alias("_rid"), F.col("licence").alias("_licence"), F.col("i").alias("start"), (F.col("upto") - F.size("w")).alias("_words"), (F.col("sums") - F.col("h")).alias("_sums"), F.explode(F.array(bucket("upto"), bucket("upto") + 1)).alias("_bucket"))
    near = (F.col("i") >= F.col("start")) & (F.col("upto") - F.col("_words") <= of(span))
    met = counted.withColumn("bucket", bucket("upto")).join(starts, (F.col("rid") == F.col("_rid")) & (F.col("licence") == F.col("_licence")) & (F.col("bucket") == F.col("_bucket"))).filter(near)
    line = F.struct("i", "w", (F.col("ends") & (F.col("sums") - F.col("_sums") >= need)).alias("ends"))
    found = met.groupBy("rid", "doc_id", "licence", "start").agg(F.array_sort(F.collect_list(line), lambda x, y: x["i"] - y["i"]).alias("ls")).withColumn("t", F.element_at(_templates(grams), F.col("licence")))

    def compared(k: Column) -> Column:
        b = _bigrams(F.flatten(F.transform(F.slice("ls", F.lit(1), k), lambda x: x["w"])))
        return F.struct((F.col("start") + k - 1).alias("end"), F.col("start").alias("start"), (2.0 * F.size(F.array_intersect(b, F.col("t"))) / (F.size(b) + F.size("t"))).alias("dice"))

    places = F.filter(F.sequence(F.lit(1), F.size("ls")), lambda k: (k > 1) & F.element_at("ls", k)["ends"])
    runs = found.select("rid", "doc_id", "licence", F.explode(F.filter(F.transform(places, compared), lambda r: r["dice"] >= threshold)).alias("r"))
    runs = runs.groupBy("rid", "doc_id", "licence").agg(F.max("r.dice").alias("dice"), F.array_sort(F.collect_list("r")).alias("runs"))
    zero = F.struct(F.lit(-1).alias("end"), F.lit(0).alias("n"))
    disjoint = F.aggregate("runs", zero, lambda a, r: F.when(r["start"] > a["end"], F.struct(r["end"].alias("end"), (a["n"] + 1).alias("n"))).otherwise(a), lambda a: a["n"])
    return runs.select("doc_id", "licence", "dice", F.lit(0).cast("long").alias("units"), disjoint.cast("long").alias("runs"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licence, dice, matches): templates that a line, a run of lines, or the whole text, of a document is like.

    Each whole text is normalised once to find the templates whose words it holds; the few rows that hold enough of any are written to the
    shared folder, and only they are looked at closer. Their units are the lines of a text and, if it has several, the whole text. Units of fewer words than any
    template can match are dropped before bigrams are made; the others are compared with the templates whose bigram count lies within
    threshold / (2 - threshold) of theirs, both ways. Runs of lines are found by ``_runs``. dice is the largest over all,
    matches the number of units or, if larger, of disjoint runs.
    Null and empty texts match nothing; repeated rows of a doc_id add up. Templates are a fixed, small list inside the plan,
    so nothing is joined; one aggregate by doc_id and licence follows.
    """
    grams = {k: bigrams(v) for k, v in templates.items()}
    rows = durable(_candidates(docs, grams, threshold).withColumn("rid", F.monotonically_increasing_id()))
    found = _units(rows, grams, threshold).unionByName(_runs(rows, grams, threshold))
    return found.groupBy("doc_id", "licence").agg(F.max("dice").alias("dice"), F.greatest(F.sum("units"), F.sum("runs")).alias("matches"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    grams = {k: bigrams(v) for k, v in TEMPLATES.items()}
    low, high = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(k)}, {quoted(g)})" for k, gs in sorted(grams.items()) for g in gs)
    norm = r"trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+', ' ', 'g'), ' ')"
    return f"""
with recursive tpl as (select * from (values {rows}) t(licence, g)),
tn as (select licence, count(*) as k, count(*) * {low!r}::double - 1e-9 as need, ceil(count(*) * 2 * {high!r}::double) as span from tpl group by licence),
d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
l as (select rid, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as li from d),
full_lines as (select * from l where length(line) > 0),
u as (select row_number() over () as uid, doc_id, {norm.format(x="x")} as norm from (select doc_id, line as x from full_lines union all select d.doc_id, d.text from d join (select rid from full_lines group by rid having count(*) > 1) using (rid))),
uw as (select uid, unnest(string_split(norm, ' ')) as w, generate_subscripts(string_split(norm, ' '), 1) as p from u where norm <> ''),
ug as (select distinct uid, g from (select uid, case when nw is not null then w || ' ' || nw when p = 1 then w end as g from (select *, lead(w) over (partition by uid order by p) as nw from uw)) where g is not null),
un as (select uid, count(*) as n from ug group by uid),
unit_hits as (select u.doc_id, licence, 2.0::double * count(*) / (any_value(un.n) + any_value(tn.k)) as dice from ug join tpl using (g) join tn using (licence) join un using (uid) join u using (uid) group by u.uid, u.doc_id, licence having 2.0::double * count(*) / (any_value(un.n) + any_value(tn.k)) >= {THRESHOLD}),
nl as (select rid, doc_id, row_number() over (partition by rid order by li) as i, norm, len(string_split(norm, ' ')) as words from (select rid, doc_id, li, {norm.format(x="line")} as norm from l) where norm <> ''),
lw as (select rid, i, unnest(string_split(norm, ' ')) as w, generate_subscripts(string_split(norm, ' '), 1) as p from nl),
lg as (select rid, i, coalesce(ni, i) as ni, w || ' ' || nw as g from (select *, lead(w) over o as nw, lead(i) over o as ni from lw window o as (partition by rid order by i, p)) where nw is not null),
cand as (select rid, licence from (select distinct rid, g from lg) join tpl using (g) join tn using (licence) group by rid, licence, need having count(*) >= need),
cum as (select rid, doc_id, i, words, sum(words) over (partition by rid order by i) as upto from nl where rid in (select rid from cand)),
spans as (select distinct a.rid, a.i as s, b.i as e from cum a join cum b on a.rid = b.rid and a.i < b.i and b.upto - a.upto + a.words <= (select max(span) from tn)),
rg as (select distinct s.rid, s.s, s.e, lg.g from spans s join lg on lg.rid = s.rid and lg.i >= s.s and lg.ni <= s.e),
rn as (select rid, s, e, count(*) as n from rg group by all),
hl as (select distinct rid, licence, i from lg join tpl using (g)),
runs as (select r.rid, tpl.licence, r.s, r.e, 2.0::double * count(*) / (any_value(rn.n) + any_value(tn.k)) as dice from rg r join tpl using (g) join tn using (licence) join rn on (rn.rid, rn.s, rn.e) = (r.rid, r.s, r.e) join cum a on a.rid = r.rid and a.i = r.s join cum b on b.rid = r.rid and b.i = r.e
         where (r.rid, tpl.licence, r.s) in (select (rid, licence, i) from hl) and (r.rid, tpl.licence, r.e) in (select (rid, licence, i) from hl union all select (rid, licence, i + 1) from hl)
         group by r.rid, tpl.licence, r.s, r.e having 2.0::double * count(*) / (any_value(rn.n) + any_value(tn.k)) >= {THRESHOLD} and any_value(b.upto - a.upto + a.words) <= any_value(tn.span)),
taken as (select rid, licence, min(e) as e, 1 as n from runs group by rid, licence union all select t.rid, t.licence, min(r.e), t.n + 1 from taken t join runs r on r.rid = t.rid and r.licence = t.licence and r.s > t.e group by t.rid, t.licence, t.n),
both_ as (select doc_id, licence, dice, 1 as units, 0 as runs from unit_hits union all select d.doc_id, r.licence, r.dice, 0, t.n from (select rid, licence, max(dice) as dice from runs group by rid, licence) r join (select rid, licence, max(n) as n from taken group by rid, licence) t using (rid, licence) join d using (rid))
select doc_id, licence, max(dice) as dice, greatest(sum(units), sum(runs))::bigint as matches from both_ group by doc_id, licence
"""


ORACLE = _oracle()
