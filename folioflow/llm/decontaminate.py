"""Benchmark decontamination over a distributed positional inverted index (DataFrame functions only).

The forward table holds the words of every document, split once. Its postings
are stored for the rarest terms of the test phrases; the lists, shifted by each
term's offset in the phrase, are intersected from the rarest term on, and the
places that are left are confirmed on the postings of every term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.llm.common import dropped, small, written
from folioflow.session import table

WINDOW = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z is lower-cased: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DOC = ["doc_id", "h"]


def words_of(text: Column) -> Column:
    """The words of a whole text; a null text has none."""
    parts = F.split(F.translate(text, UPPER, LOWER), BETWEEN)
    return F.coalesce(F.filter(parts, lambda w: w != ""), F.array().cast("array<string>"))


def forward_table(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, words), written to the shared folder; h tells apart rows of one doc_id with other texts."""
    split = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words"))
    return written(split.select("doc_id", "h", F.size("words").cast("long").alias("n_words"), "words"), "forward")


def postings(forward: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(doc_id, h, pos, term) of the given terms, a DataFrame with one column `term` without repeats."""
    every = forward.select(*DOC, F.posexplode("words").alias("pos", "term"))
    return every.join(small(terms, n_terms), "term").select(*DOC, "pos", "term")


def phrase_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, wid, len, win): every `size` consecutive words of an item; a shorter item is one window, an empty one none."""
    w = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (size - 1)))
    win = w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, size))).alias("win"))
    return win.select("item_id", F.xxhash64(F.array_join("win", " ")).alias("wid"), F.size("win").alias("len"), "win").distinct()


def occurrences(forward: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, h, wid, start, len): every exact occurrence of a window, by intersecting shifted posting lists."""
    phrases = written(windows.select("wid", "len", F.posexplode("win").alias("off", "term")).distinct(), "phrases")
    terms = written(phrases.select("term").distinct(), "terms")
    n_rows, n_terms = phrases.count(), terms.count()
    counts = written(postings(forward, terms, n_terms).groupBy("term").agg(F.count("*").alias("n")), "counts")
    # Rarest terms first; a window with a term that no document has cannot occur.
    ranked = phrases.join(small(counts, n_terms), "term", "left").select(
        "*", F.row_number().over(W.partitionBy("wid").orderBy("n", "off")).alias("r"), F.count("n").over(W.partitionBy("wid")).alias("known")
    )
    rare = written(ranked.where((F.col("r") <= 2) & (F.col("known") == F.col("len"))).select("term", "wid", "off", "len"), "rare")
    n_rare = rare.count()
    stored = written(postings(forward, rare.select("term").distinct(), n_terms), "postings")
    shifted = stored.join(small(rare, n_rare), "term").select(*DOC, "wid", "len", "off", (F.col("pos") - F.col("off")).alias("start")).where("start >= 0")
    left = shifted.groupBy(*DOC, "wid", "len", "start").agg(F.size(F.collect_set("off")).alias("n")).where(F.col("n") == F.least(F.lit(2), "len"))
    left = written(left.drop("n"), "places")
    dropped(counts, rare, stored)
    # The places that both rarest lists allow are confirmed on the lists of all their terms.
    where = left.select(*DOC).distinct()
    some = forward.join(small(where, where.count()).withColumnsRenamed({"doc_id": "d", "h": "g"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left_semi")
    found = postings(some, terms, n_terms).withColumnsRenamed({"doc_id": "d", "h": "g", "pos": "p", "term": "t"})
    needed = left.join(small(phrases.drop("len"), n_rows), "wid").withColumn("at", F.col("start") + F.col("off"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("at") == F.col("p")) & (F.col("term") == F.col("t"))
    met = needed.join(found.distinct(), same).groupBy(*DOC, "wid", "len", "start").agg(F.count("*").alias("n"))
    return met.where(F.col("n") == F.col("len")).drop("n")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """For each document row: how many of its words lie in occurrences of windows of test items, and of which items.

    Words are those of words_of(); a window is `size` consecutive words of an
    item. Null and empty texts have no words and hit nothing; items without
    words have no window; items with equal windows all count; an item
    without item_id is looked for but not named; repeated document
    rows each get the same row; null doc_ids are kept; other columns are not
    read. An empty documents table gives an empty result, an empty items table hits nothing.
    """
    forward = forward_table(docs)
    windows = written(phrase_windows(items, size), "windows")
    hits = written(occurrences(forward, windows.select("wid", "len", "win").distinct()), "hits")
    covered = F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("len") - 1))))
    n_hit = hits.select(*DOC, "start", "len").distinct().groupBy(*DOC).agg(F.size(covered).cast("long").alias("n_hit"))
    of = windows.select("wid", F.col("item_id").cast("string").alias("item")).distinct()
    names = hits.select(*DOC, "wid").distinct().join(small(of, of.count()), "wid").groupBy(*DOC).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = n_hit.alias("a").join(names.alias("b"), F.expr("a.doc_id <=> b.doc_id AND a.h = b.h")).select(F.col("a.doc_id").alias("d"), F.col("a.h").alias("g"), "n_hit", "items")
    found = written(found, "found")
    dropped(hits, windows)
    out = forward.select(*DOC, "n_words").join(small(found, found.count()), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        "h",
    )


def proximity(forward: DataFrame, phrases: DataFrame, within: int = 20) -> DataFrame:
    """(doc_id, h, phrase_id, pos): places where all distinct terms of a phrase lie at most `within` words from its rarest term.

    phrases: (phrase_id, text). Phrases without words, and those with a term
    that no document has, match nowhere. One row for each posting of the rarest term.
    """
    terms = written(phrases.select("phrase_id", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")).distinct(), "near")
    n = terms.count()
    lists = written(postings(forward, terms.select("term").distinct(), n), "postings")
    counts = lists.groupBy("term").agg(F.count("*").alias("n"))
    order = W.partitionBy("phrase_id")
    ranked = terms.join(counts, "term", "left").select("*", F.row_number().over(order.orderBy("n", "term")).alias("r"), F.count("*").over(order).alias("size"), F.count("n").over(order).alias("known"))
    ranked = written(ranked.where("size = known"), "near")
    first = lists.join(small(ranked.where("r = 1").select("term", "phrase_id", "size"), n), "term").select(*DOC, "phrase_id", "size", "pos")
    rest = lists.join(small(ranked.select("term", "phrase_id"), n), "term").select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("phrase_id").alias("q"), F.col("pos").alias("p"), "term")
    near = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")) & (F.col("phrase_id") == F.col("q")) & (F.abs(F.col("pos") - F.col("p")) <= within)
    return first.join(rest, near).groupBy(*DOC, "phrase_id", "size", "pos").agg(F.count_distinct("term").alias("n")).where("n = size").select(*DOC, "phrase_id", "pos")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` against the windows of all `benchmark` items; see contamination() for null, empty and repeated rows."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


ORACLE = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + 9], ' ') AS g FROM b, unnest(range(1, greatest(2, len(w) - 8))) u(s) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM t, lens, unnest(range(1, len(w) - n + 2)) u(s)),
hit AS (SELECT DISTINCT doc_id, s, dw.n AS n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + n)) u(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS d FROM hit GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(d, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM t LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
