"""Licence scan: sparse TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory.

DataFrame functions only. A file is seen in several views: its lines that carry
a cue, its header block, the whole text of a licence file, windows as long as a
template around each cue, and its SPDX tags. Equal views are compared once.
Terms are weighted by their document frequency over all notice lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import small, written
from folioflow.session import table

#: Notice templates (fixed values): licence id and its usual notice.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
#: Names of licences; as all templates of few terms, they are met in windows word by word.
NAMES = [
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("GPL-2.0", "GNU General Public License version 2"),
    ("GPL-3.0", "GNU General Public License version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License version 3"),
    ("AGPL-3.0", "GNU Affero General Public License version 3"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "Mozilla Public License v. 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
]
#: Texts of licences, or the notice that a long licence has put into files.
TEXTS = [
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
]
#: Templates of up to so many terms are met in windows word by word: one other word can be another licence.
FEW_TERMS = 12
#: A template of more distinct terms than this is a text: half of them must occur, or the words of any prose would do where few notices are known.
TEXT_TERMS = 30
#: What makes a line a notice, in lower case.
CUES = ("licens", "licenc", "copyright", "spdx")
#: Phrases of licence texts that can stand without a cue, and the terms around which windows are laid.
PHRASES = ("permission is hereby granted", "redistribution and use in source")
ANCHOR = r"^(licens|licenc|copyright|spdx|hereby$|redistribution$)"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying)(\..*)?$"
LEAST_COSINE = 0.6


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, with inner dots of numbers kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]+|[0-9]+(?:\.[0-9]+)*)"), 1)


def has_cue(text: Column) -> Column:
    low = F.lower(text)
    out = low.contains(CUES[0])
    for cue in CUES[1:]:
        out = out | low.contains(cue)
    return out


def notice_matches(lines: DataFrame, templates: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(notice, license, cosine): the best template of every distinct notice that reaches `least`.

    lines: (notice, n, terms) with a key, how many notice lines have it (0 for other
    views) and the token string; templates: (license, text). Ties go to the smaller licence id.
    A licence may have several templates.
    """
    counts = lines.select("notice", "n", F.explode(F.split("terms", " ")).alias("term")).groupBy("notice", "n", "term").agg(F.count("*").alias("tf"))
    df = counts.groupBy("term").agg(F.sum("n").alias("df"))
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    idf = F.log((F.lit(1.0) + F.lit(total)) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1.0
    marked = written(templates.select("license", F.md5("text").alias("t"), F.explode(tokens(F.col("text"))).alias("term")).groupBy("license", "t", "term").agg(F.count("*").alias("tf")), "templates")
    n_marks = marked.count()
    known = marked.select("term").distinct().join(df, "term", "left")
    known = written(known.select("term", idf.alias("idf")), "idf")
    weight = marked.join(small(known, n_marks), "term").select("license", "t", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = weight.groupBy("license", "t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"), F.count("*").alias("t_terms"))
    weight = weight.join(norm, ["license", "t"])
    own = counts.join(df, "term").select("notice", "term", (F.col("tf") * idf).alias("x"))
    norms = own.groupBy("notice").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = own.join(small(weight, n_marks), "term").groupBy("notice", "license", "t", "t_norm", "t_terms").agg(F.sum(F.col("x") * F.col("w")).alias("dot"), F.count("*").alias("shared"))
    dots = dots.where((F.col("t_terms") <= TEXT_TERMS) | (2 * F.col("shared") >= F.col("t_terms")))
    scored = dots.join(norms, "notice").select("notice", "license", F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6).alias("cosine"))
    best = scored.where(F.col("cosine") >= least).groupBy("notice").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select("notice", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def shapes(templates: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """(terms before the first anchor, terms in all) of every template that has an anchor."""
    found = set()
    for _, text in templates:
        terms = re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", text.lower())
        at = [i for i, x in enumerate(terms) if re.search(ANCHOR, x)]
        found |= {(at[0], len(terms))} if at else set()
    return sorted(found)


def wide_views(rows: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, path, h, few, terms): header blocks, whole licence files and windows around anchors, of files with a cue or phrase.

    few marks windows of short templates. Every licence text has a cue or phrase, so other files have no view.
    """
    low = F.lower("text")
    cued = has_cue(F.col("text"))
    for phrase in PHRASES:
        cued = cued | low.contains(phrase)
    whole = F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENSE_FILE)
    head = F.split("text", r"\n[ \t\r]*\n", 2)[0]
    seen = rows.where(cued).select("doc_id", "path", "h", whole.alias("whole"), tokens(F.col("text")).alias("t"), tokens(head).alias("head"))
    spots = F.filter(F.transform("t", lambda x, i: F.when(x.rlike(ANCHOR), i + 1)), lambda i: i.isNotNull())
    seen = seen.withColumn("spots", spots)
    view = lambda few, terms: F.struct(F.lit(few).alias("few"), F.array_join(terms, " ").alias("terms"))
    around = [lambda p, c=c, n=n: view(n <= FEW_TERMS, F.slice("t", F.greatest(p - c, F.lit(1)), F.lit(n))) for c, n in shapes(templates)]
    windows = F.flatten(F.transform("spots", lambda p: F.array(*[w(p) for w in around])))
    blocks = F.filter(F.array(view(False, F.col("head")), F.when(F.col("whole"), view(False, F.col("t")))), lambda v: v.isNotNull())
    out = seen.select("doc_id", "path", "h", F.explode(F.concat(blocks, windows) if around else blocks).alias("v"))
    return out.select("doc_id", "path", "h", "v.few", "v.terms").where("terms <> ''")


def spdx_matches(rows: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, path, h, license, cosine): known licences named by SPDX tags, each term of an expression by itself."""
    tags = F.regexp_extract_all(F.lower("text"), F.lit(r"spdx-license-identifier:[ \t]*([^\r\n]*)"), 1)
    ids = rows.where(F.lower("text").contains("spdx-license-identifier")).select("doc_id", "path", "h", F.explode(tags).alias("tag"))
    ids = ids.select("doc_id", "path", "h", F.explode(F.split("tag", r"[^a-z0-9.+-]+")).alias("id"))
    ids = ids.withColumn("id", F.regexp_replace("id", r"(-only|-or-later|\+)$", ""))
    known = sorted({x for x, _ in templates})
    name = F.create_map(*[F.lit(y) for x in known for y in (x.lower(), x)]) if known else F.lit(None).cast("map<string,string>")
    return ids.select("doc_id", "path", "h", F.try_element_at(name, F.col("id")).alias("license"), F.lit(1.0).alias("cosine")).where("license is not null")


def scan(files: DataFrame, templates: DataFrame, least: float = LEAST_COSINE, names: list[tuple[str, str]] = ()) -> DataFrame:
    """(doc_id, path, license, cosine, origin) for every row of files: (doc_id, path, text).

    origin is "own" where a view of the file itself matches (names are further short
    templates, for windows only), else "inherited"
    where the nearest directory at or above it holds a licence file (LICENSE,
    LICENCE or COPYING, any ending) whose notice matches, else "none". Among
    several notices or licence files the highest cosine wins, then the smaller
    licence id. Null and empty texts have no notice; a null path inherits
    nothing; repeated rows each get a row; other columns are not read.
    """
    rows = files.select("doc_id", "path", F.xxhash64("doc_id", "path", "text").alias("h"), "text")
    given = [(r.license, r.text) for r in templates.collect()]
    noted = rows.where(has_cue(F.col("text"))).select("doc_id", "path", "h", F.explode(F.split("text", "\n")).alias("line")).where(has_cue(F.col("line")))
    noted = noted.select("doc_id", "path", "h", F.lit(1).alias("n"), F.array_join(tokens(F.col("line")), " ").alias("terms"))
    wide = written(wide_views(rows, [*given, *names]), "views")
    noted = noted.union(wide.where("not few").select("doc_id", "path", "h", F.lit(0).alias("n"), "terms"))
    noted = written(noted.withColumn("notice", F.md5("terms")), "notices")
    lines = written(noted.groupBy("notice").agg(F.sum("n").alias("n"), F.first("terms").alias("terms")), "distinct")
    matches = written(notice_matches(lines, templates, least), "matches")
    found = noted.select("doc_id", "path", "h", "notice").distinct().join(small(matches, matches.count()), "notice").select("doc_id", "path", "h", "license", "cosine")
    marks = rows.sparkSession.createDataFrame([*given, *names], "license string, text string")
    marks = marks.select(F.col("license"), F.array_join(tokens(F.col("text")), " ").alias("terms")).distinct()
    exact = wide.where("few").join(F.broadcast(marks), "terms").select("doc_id", "path", "h", "license", F.lit(1.0).alias("cosine"))
    hit = found.union(exact).union(spdx_matches(rows, [*given, *names]))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), "license"))
    own = hit.groupBy("doc_id", "path", "h").agg(best.alias("b")).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("path").alias("p"), F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))
    own = written(own, "own")
    parent = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    listing = own.where(F.regexp_extract("p", r"([^/]*)$", 1).rlike(LICENSE_FILE))
    dirs = listing.select(parent(F.col("p")).alias("dir"), "cosine", "license").groupBy("dir").agg(best.alias("b")).select("dir", F.col("b.license").alias("dir_license"), (-F.col("b.c")).alias("dir_cosine"))
    dirs = written(dirs, "dirs")
    # Ancestors of each distinct directory, so a directory with many files is one row of the path join.
    places = rows.select(parent(F.col("path")).alias("place")).where("place is not null").distinct()
    split = F.split("place", "/")
    up = places.select("place", F.explode(F.transform(F.sequence(F.lit(0), F.size(split)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(split, 1, i), "/").alias("dir")))).alias("a"))
    near = up.select("place", "a.depth", "a.dir").join(small(dirs, dirs.count()), "dir").groupBy("place").agg(F.max(F.struct("depth", "dir_license", "dir_cosine")).alias("z"))
    near = written(near.select("place", F.col("z.dir_license").alias("dir_license"), F.col("z.dir_cosine").alias("dir_cosine")), "near")
    out = rows.select("doc_id", "path", "h").join(small(own.drop("p"), own.count()), (F.col("h") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    out = out.join(small(near, near.count()), parent(F.col("path")) == F.col("place"), "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("license", "dir_license").alias("license"), F.coalesce("cosine", "dir_cosine").alias("cosine"), origin.alias("origin"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths: source is the top folder, thousands and tens of doc_id the folders below, every fifth file is LICENSE."""
    docs = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 5 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    tens = F.floor(F.col("doc_id") / 10).cast("string")
    path = F.concat_ws("/", F.col("source"), F.floor(F.col("doc_id") / 1000).cast("string"), F.when(F.col("doc_id") % 3 == 0, tens), name)
    files = docs.select("doc_id", path.alias("path"), "text")
    return scan(files, spark.createDataFrame(TEMPLATES + TEXTS, "license string, text string"), names=NAMES)


ORACLE = (
    "WITH tpl(license, text) AS (VALUES "
    + ", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES)
    + r"""),
f AS (SELECT doc_id, text, concat_ws('/', source, CAST(doc_id // 1000 AS VARCHAR), CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id // 10 AS VARCHAR) END,
             CASE WHEN doc_id % 5 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END) AS path FROM documents),
nl AS (SELECT doc_id, path, array_to_string(regexp_extract_all(lower(l), '[a-z]+|[0-9]+(?:\.[0-9]+)*'), ' ') AS notice
       FROM (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS l FROM f) WHERE regexp_matches(lower(l), 'licens|licenc|copyright|spdx')),
dn AS (SELECT notice, count(*) AS n FROM nl GROUP BY notice),
ct AS (SELECT notice, n, term, count(*) AS tf FROM (SELECT notice, n, unnest(string_split(notice, ' ')) AS term FROM dn) GROUP BY ALL),
d AS (SELECT term, sum(n) AS df FROM ct GROUP BY term),
tot AS (SELECT coalesce(sum(n), 0) AS total FROM dn),
tt AS (SELECT license, term, count(*) AS tf FROM (SELECT license, unnest(regexp_extract_all(lower(text), '[a-z]+|[0-9]+(?:\.[0-9]+)*')) AS term FROM tpl) GROUP BY ALL),
tw AS (SELECT license, term, tf * (ln((1.0 + total) / (1.0 + coalesce(df, 0))) + 1.0) AS w FROM tt LEFT JOIN d USING (term), tot),
tn AS (SELECT license, sqrt(sum(w * w)) AS t_norm FROM tw GROUP BY license),
ow AS (SELECT notice, term, tf * (ln((1.0 + total) / (1.0 + df)) + 1.0) AS x FROM ct JOIN d USING (term), tot),
on_ AS (SELECT notice, sqrt(sum(x * x)) AS norm FROM ow GROUP BY notice),
sc AS (SELECT notice, license, round(sum(x * w) / (max(norm) * max(t_norm)), 6) AS cosine FROM ow JOIN tw USING (term) JOIN tn USING (license) JOIN on_ USING (notice) GROUP BY notice, license),
own AS (SELECT doc_id, path, license, cosine FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) AS r FROM nl JOIN sc USING (notice) WHERE cosine >= 0.6) WHERE r = 1),
dirs AS (SELECT dir, license, cosine FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, license, cosine,
         row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY cosine DESC, license) AS r FROM own WHERE ends_with(path, '/LICENSE')) WHERE r = 1),
inh AS (SELECT doc_id, dirs.license, dirs.cosine, row_number() OVER (PARTITION BY doc_id ORDER BY length(dir) DESC) AS r
        FROM f JOIN dirs ON starts_with(regexp_extract(path, '^(.*)/[^/]*$', 1) || '/', dir || '/'))
SELECT f.doc_id, f.path, coalesce(own.license, inh.license) AS license, coalesce(own.cosine, inh.cosine) AS cosine,
       CASE WHEN own.license IS NOT NULL THEN 'own' WHEN inh.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin
FROM f LEFT JOIN own USING (doc_id) LEFT JOIN inh ON inh.doc_id = f.doc_id AND inh.r = 1
"""
)
