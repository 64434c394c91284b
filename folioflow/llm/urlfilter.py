"""Temporal URL filter: dated list entries become validity intervals and captures join what was in force at fetch time.

DataFrame functions only. A target is a host ("example.org", which covers its
subdomains) or a host with leading path segments ("example.org/ads"). An entry
holds from its date until the next entry of the same target; the action
"remove" ends a target's listing. The most specific target in force decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.llm.common import small, written
from folioflow.session import table

#: The dated list of op3's query (fixed values): target, category, action, date.
ENTRIES = [
    ("spam-farm.example.org", "spam", "block", "2023-06-01"),
    ("spam-farm.example.org", "spam", "remove", "2024-09-15"),
    ("casino-win.example.net", "gambling", "block", "2024-02-10"),
    ("casino-win.example.net/en", "gambling", "allow", "2024-05-01"),
    ("casino-win.example.net/en", "gambling", "remove", "2024-08-01"),
    ("free-bets.example.net", "gambling", "block", "2024-01-20"),
    ("free-bets.example.net", "gambling", "allow", "2024-07-04"),
    ("free-bets.example.net", "gambling", "block", "2024-10-01"),
    ("adult-x.example.com", "adult", "block", "2023-01-01"),
    ("cheap-pills.example.net", "pharma", "block", "2024-03-03"),
    ("cheap-pills.example.net", "scam", "block", "2024-06-06"),
    ("ads-track.example.com", "ads", "block", "2023-11-11"),
    ("ads-track.example.com/de", "ads", "remove", "2024-01-01"),
    ("tionsh.example.net/es", "copied", "block", "2024-04-01"),
    ("tionsh.example.net/es", "copied", "remove", "2024-04-30"),
    ("tionsh.example.net/fr", "copied", "block", "2024-11-01"),
]


def host_of(url: Column) -> Column:
    """The lower-case host without user, port and final dot; null for a null url, '' where there is none."""
    authority = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(:[0-9]*)?$", ""))


def segments_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def intervals(entries: DataFrame) -> DataFrame:
    """(target, category, action, since, until, depth) of (target, category, action, listed_on).

    Entries of one date follow each other by action and category, so that the
    last of these holds; "remove" leaves a gap. Entries without target or date are void.
    """
    clean = entries.select(F.lower(F.trim("target")).alias("target"), "category", "action", F.col("listed_on").cast("date").alias("since")).where("target <> '' and since is not null")
    order = W.partitionBy("target").orderBy("since", "action", "category")
    spans = clean.distinct().withColumn("until", F.coalesce(F.lead("since").over(order), F.lit("9999-12-31").cast("date")))
    return spans.where("since < until and action <> 'remove'").withColumn("depth", F.size(F.split("target", "/")) - 1)


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds host, verdict ('keep' or 'drop'), category and target to captures that have `url` and `fetched_on` (date).

    Target keys of a capture are its host, the host's parent domains and these
    with as many path segments as the deepest listed target has. Keys meet
    intervals by equality and fetched_on in [since, until); the key with most
    path segments, then the longest, wins. Null and odd urls and null dates
    match nothing and are kept. Captures are joined once for each distinct (url,
    fetched_on), so repeated captures move one row. Columns of captures named
    host, verdict, category or target are replaced, all others go along under
    any names. Empty captures give no rows, an empty list keeps all.
    """
    spans = written(intervals(entries), "intervals")
    told = spans.agg(F.count("*"), F.max("depth")).first()
    n, depth = told[0], told[1] or 0
    # Columns go by place, so that none of them can be taken for one of the join's.
    own = captures.toDF(*[f"c{i}" for i in range(len(captures.columns))])
    url, day = (F.col(f"c{captures.columns.index(c)}") for c in ("url", "fetched_on"))
    seen = own.select(url.alias("url"), day.alias("fetched_on")).where("url is not null and fetched_on is not null").distinct()
    parts = seen.withColumn("labels", F.split(host_of(F.col("url")), r"\.")).withColumn("seg", F.slice(segments_of(F.col("url")), 1, max(depth, 1)))
    hosts = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    keys = hosts
    for d in range(1, depth + 1):
        leading = F.array_join(F.slice("seg", 1, d), "/")
        deeper = F.transform(hosts, lambda h: F.concat_ws("/", h, leading))  # noqa: B023
        keys = F.when(F.size("seg") >= d, F.concat(keys, deeper)).otherwise(keys)
    probe = parts.select("url", "fetched_on", F.explode(keys).alias("key"))
    met = probe.join(small(spans, n), (F.col("key") == F.col("target")) & (F.col("fetched_on") >= F.col("since")) & (F.col("fetched_on") < F.col("until")))
    best = met.groupBy("url", "fetched_on").agg(F.max(F.struct("depth", F.length("target").alias("size"), "target", "category", "action")).alias("b"))
    best = best.select(F.col("url").alias("u"), F.col("fetched_on").alias("f"), F.col("b.target").alias("target"), F.col("b.category").alias("category"), F.col("b.action").alias("action"))
    out = own.join(best, (url == F.col("u")) & (day == F.col("f")), "left")
    verdict = F.when(F.col("action") == "block", "drop").otherwise("keep")
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(captures.columns) if c not in ("host", "verdict", "category", "target")]
    return out.select(*kept, host_of(url).alias("host"), verdict.alias("verdict"), "category", "target")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages has no fetch time: page_id stands for it, as a day of 2024."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("fetched_on"))
    entries = spark.createDataFrame(ENTRIES, "target string, category string, action string, listed_on string")
    return verdicts(pages, entries).select("page_id", "host", F.col("fetched_on").cast("string").alias("fetched_on"), "verdict", "category", "target")


ORACLE = (
    "WITH e(target, category, action, since) AS (VALUES "
    + ", ".join(f"('{t}', '{c}', '{a}', DATE '{d}')" for t, c, a, d in ENTRIES)
    + r"""),
iv AS (SELECT * FROM (SELECT *, coalesce(lead(since) OVER (PARTITION BY target ORDER BY since, action, category), DATE '9999-12-31') AS until FROM e)
       WHERE since < until AND action <> 'remove'),
p AS (SELECT page_id, url, lower(split_part(split_part(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '@', -1), ':', 1)) AS host,
             regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS f FROM pages),
m AS (SELECT p.page_id, iv.*, row_number() OVER (PARTITION BY p.page_id ORDER BY (contains(target, '/')) DESC, length(target) DESC) AS r
      FROM p JOIN iv ON f >= since AND f < until
       AND (host = split_part(target, '/', 1) OR ends_with(host, '.' || split_part(target, '/', 1)))
       AND (NOT contains(target, '/') OR split_part(path, '/', 2) = split_part(target, '/', 2)))
SELECT p.page_id, p.host, CAST(f AS VARCHAR) AS fetched_on, CASE WHEN action = 'block' THEN 'drop' ELSE 'keep' END AS verdict, category, target
FROM p LEFT JOIN m ON p.page_id = m.page_id AND r = 1
"""
)
