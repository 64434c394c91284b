"""Catalog, audit and ordered queries over the driver's tables (part: catalog, lineitem: ordered items, orders: pages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.operators import audit, catalog, ordered, reports
from folioflow.plans.registry import register
from folioflow.session import table

#: l_linenumber is not unique within an order; all columns together are.
ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
ITEMS = f"items AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ITEM_ORDER)}) AS ord FROM lineitem)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("ord", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ITEM_ORDER)))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


LINES = "lines AS (SELECT doc_id, lang, source, unnest(range(len(l))) AS ord, unnest(l) AS line FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents))"


#: Names of parts with marks on their letters, or in capitals, by number.
SHOWN_NAME = "CASE p_partkey % 4 WHEN 0 THEN translate(p_name, 'aeorsc', 'āěőřšç') WHEN 1 THEN upper(p_name) WHEN 2 THEN translate(p_name, 'aeiou', 'ạẽïǫŭ') ELSE p_name END"


@register("catalog_sort_natural", f"SELECT p_partkey, {SHOWN_NAME} AS name, p_brand, p_size, row_number() OVER (ORDER BY p_size DESC, lower(strip_accents({SHOWN_NAME})) DESC, p_partkey) AS pos FROM part")
def catalog_sort_natural(spark, sf_dir):
    """Every part, by size and then by name, both descending; names differ in marks and case."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.expr(SHOWN_NAME).alias("name"), "p_brand", "p_size")
    return ordered.positions(part, [F.desc("p_size"), F.desc(X.natural_key(F.col("name"))), F.asc("p_partkey")], "pos")


@register("catalog_facets", "SELECT DISTINCT trim(p_brand) AS value FROM part WHERE trim(p_brand) <> ''")
def catalog_facets(spark, sf_dir):
    return catalog.facet_values(table(spark, sf_dir, "part"), "p_brand")


@register(
    "catalog_counts",
    """SELECT o_custkey AS book, count(DISTINCT o_orderkey) AS n_pages, count(l_orderkey) AS n_items
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""",
)
def catalog_counts(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("page"))
    return catalog.counts(pages, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page")), "book", "page")


@register(
    "catalog_metadata",
    """SELECT p_partkey, coalesce(nullif(trim(p_name), ''), p_brand) AS title, trim(p_type) AS category,
       list_filter(list_transform(string_split(p_type, ' '), lambda x: trim(x)), lambda x: x <> '') AS tags FROM part""",
)
def catalog_metadata(spark, sf_dir):
    none = F.lit("")
    library = F.struct(none.alias("discipline"), none.alias("level"), F.col("p_type").alias("category"), none.alias("status"), F.split("p_type", " ").alias("tags"))
    books = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("folder"), F.struct(F.col("p_name").alias("title"), library.alias("library")).alias("meta"))
    return catalog.metadata(books, "p_partkey").select("p_partkey", "title", "category", "tags")


@register(
    "status_bucket",
    """SELECT CASE WHEN contains(k, 'ready') THEN 'ready' WHEN contains(k, 'archive') THEN 'archived' WHEN contains(k, 'draft') THEN 'draft' ELSE '' END AS bucket, count(*) AS n
       FROM (SELECT lower(CASE o_orderstatus WHEN 'F' THEN 'Ready' WHEN 'O' THEN 'DRAFT 2' ELSE 'Archive' END) AS k FROM orders) GROUP BY 1""",
)
def status_bucket(spark, sf_dir):
    name = F.when(F.col("o_orderstatus") == "F", "Ready").when(F.col("o_orderstatus") == "O", "DRAFT 2").otherwise("Archive")
    return table(spark, sf_dir, "orders").groupBy(X.status_class(name).alias("bucket")).agg(F.count("*").alias("n"))


@register(
    "hier_search",
    """WITH hit AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE contains(lower(concat_ws(' ', l_returnflag, l_linestatus, l_partkey)), '77'))
       SELECT o_orderkey, o_orderpriority FROM orders LEFT JOIN hit ON l_orderkey = o_orderkey
       WHERE contains(lower(concat_ws(' ', o_orderkey, o_orderpriority)), '77') OR l_orderkey IS NOT NULL""",
)
def hier_search(spark, sf_dir):
    pages = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    kids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus", "l_partkey")
    return catalog.hierarchical_search(pages, kids, ["o_orderkey"], ["o_orderkey", "o_orderpriority"], ["l_returnflag", "l_linestatus", "l_partkey"], "77")[0]


@register("stats_by_type", "SELECT l_linestatus AS status, l_returnflag AS type, count(*) AS n FROM lineitem GROUP BY ALL")
def stats_by_type(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("type"))
    return audit.stats_by_type(li, ["status"])


@register(
    "compat_stats",
    """SELECT count(*) AS docs, count(*) FILTER (WHERE contains(text, ' | ')) AS with_rows, count(*) FILTER (WHERE contains(text, '!!')) AS shouting,
       count(*) FILTER (WHERE coalesce(trim(source), '') <> '') AS with_source, count(*) FILTER (WHERE n_chars > 1000) AS long FROM documents""",
)
def compat_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    named = F.coalesce(F.trim("source"), F.lit("")) != ""
    return d.agg(F.count("*").alias("docs"), F.count_if(F.col("text").contains(" | ")).alias("with_rows"), F.count_if(F.col("text").contains("!!")).alias("shouting"), F.count_if(named).alias("with_source"), F.count_if(F.col("n_chars") > 1000).alias("long"))


@register("dup_ids", "SELECT l_orderkey, l_linenumber, count(*) - 1 AS repeats FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_ids(spark, sf_dir):
    return audit.duplicate_ids(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("broken_refs", "SELECT event_id, user_id FROM events WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal > 0)")
def broken_refs(spark, sf_dir):
    refs = table(spark, sf_dir, "events").select("event_id", "user_id")
    return audit.broken_references(refs, table(spark, sf_dir, "customer").where("c_acctbal > 0"), "user_id", "c_custkey").select("event_id", "user_id")


REF_ITEMS = """i AS (SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'figure' WHEN 'click' THEN 'scene' ELSE 'paragraph' END AS type,
         CASE WHEN user_id % 2 = 0 THEN 's' || user_id ELSE '' END AS src, CASE event_id % 3 WHEN 0 THEN '#c' || user_id WHEN 1 THEN 'https://x.org/#' || event_id END AS href, '#c' || (event_id % 50) AS deep FROM events),
       e AS (SELECT event_id, CASE WHEN starts_with(coalesce(h, ''), '#') THEN 'internal-link' ELSE 'external-link' END AS kind, CASE WHEN starts_with(coalesce(h, ''), '#') THEN substr(h, 2) ELSE coalesce(h, '') END AS target
             FROM (SELECT event_id, href AS h FROM i UNION ALL SELECT event_id, deep FROM i WHERE event_id % 5 = 0)
             UNION ALL SELECT event_id, CASE type WHEN 'scene' THEN 'scene' ELSE 'asset' END, src FROM i WHERE type <> 'paragraph' AND src <> ''
             UNION ALL SELECT event_id, 'nav-target', 'c' || t FROM (SELECT event_id, user_id + 1 AS t FROM i WHERE event_id % 4 = 0 UNION ALL SELECT event_id, event_id FROM i WHERE event_id % 7 = 0))"""


def all_edges(spark, sf_dir):
    """References of items made of events: links, links in links, sources, and navigation with entries."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    link = lambda href: [F.lit("link").alias("type"), href.alias("href"), F.lit("_blank").alias("target")]
    href = F.when(F.col("event_id") % 3 == 0, text("#c", F.col("user_id"))).when(F.col("event_id") % 3 == 1, text("https://x.org/#", F.col("event_id")))
    deep = F.when(F.col("event_id") % 5 == 0, F.array(F.struct(*link(text("#c", F.col("event_id") % 50)))))
    plain = F.struct(F.lit("text_run").alias("type"), F.lit("#c1").alias("href"), F.lit(None).cast("string").alias("target"), deep.alias("children"))
    nodes = F.array(F.struct(*link(href), F.lit(None).cast(DEEP).alias("children")), plain)
    kind = F.when(F.col("event_type") == "view", "figure").when(F.col("event_type") == "click", "scene").otherwise("paragraph")
    rows = e.select("event_id", kind.alias("type"), F.when(F.col("user_id") % 2 == 0, text("s", F.col("user_id"))).otherwise("").alias("src"), F.struct(nodes.alias("nodes")).alias("body"))
    entries = F.array(F.struct(F.when(F.col("event_id") % 7 == 0, text("c", F.col("event_id"))).otherwise("").alias("target")))
    groups = e.select("event_id", F.when(F.col("event_id") % 4 == 0, text("#c", F.col("user_id") + 1)).alias("target"), entries.alias("entries"))
    return audit.reference_edges(rows, ["event_id"]).unionByName(audit.nav_edges(groups, ["event_id"]))


DEEP = "array<struct<type:string,href:string,target:string>>"


@register("reference_edges", f"WITH {REF_ITEMS} SELECT * FROM e")
def reference_edges(spark, sf_dir):
    return all_edges(spark, sf_dir)


@register("broken_links", f"WITH {REF_ITEMS} SELECT * FROM e WHERE kind IN ('internal-link', 'nav-target') AND target NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal > 0)")
def broken_links(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"))
    return audit.broken_references(all_edges(spark, sf_dir), ids).select("event_id", "kind", "target")


@register("incoming_refs", "SELECT l_partkey AS target, count(*) AS incoming FROM lineitem GROUP BY 1")
def incoming_refs(spark, sf_dir):
    return audit.incoming_references(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("target")))


@register("missing_assets", "SELECT DISTINCT l_suppkey AS target FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def missing_assets(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target")).distinct()
    return audit.broken_references(refs, table(spark, sf_dir, "supplier").where("s_acctbal > 0"), "target", "s_suppkey")


@register("id_counts", "SELECT count(*) AS items, count(DISTINCT o_custkey) AS books, count(DISTINCT o_orderkey) AS ids FROM orders")
def id_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("items"), F.count_distinct("o_custkey").alias("books"), F.count_distinct("o_orderkey").alias("ids"))


@register(
    "source_range",
    "SELECT l_orderkey, CASE WHEN min(l_linenumber) = max(l_linenumber) THEN CAST(min(l_linenumber) AS VARCHAR) ELSE min(l_linenumber) || '-' || max(l_linenumber) END AS source_range FROM lineitem GROUP BY 1",
)
def source_range(spark, sf_dir):
    return audit.source_range(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@register(
    "validation_messages",
    """WITH i AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS id, CASE event_type WHEN 'view' THEN 'figure' WHEN 'click' THEN 'scene' ELSE event_type END AS type,
         CASE WHEN value > 50 THEN 'a' ELSE '' END AS alt, CASE WHEN user_id % 2 = 0 THEN 's' END AS src FROM events)
       SELECT event_id, 'error' AS severity, 'missing-id' AS code FROM i WHERE id = '' UNION ALL
       SELECT event_id, 'error', 'unknown-type' FROM i WHERE type NOT IN ('figure', 'scene', 'paragraph') UNION ALL
       SELECT event_id, 'warning', 'figure-without-alt' FROM i WHERE type = 'figure' AND alt = '' UNION ALL
       SELECT event_id, 'warning', 'media-without-source' FROM i WHERE type IN ('figure', 'scene') AND src IS NULL""",
)
def validation_messages(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "figure").when(F.col("event_type") == "click", "scene").otherwise(F.col("event_type"))
    rows = e.select("event_id", F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_id").cast("string")).alias("id"), kind.alias("type"), F.when(F.col("value") > 50, "a").otherwise("").alias("alt"), F.when(F.col("user_id") % 2 == 0, "s").alias("src"))
    return audit.messages(rows, ["event_id"], ["figure", "scene", "paragraph"])


LEVEL = "l_linenumber % 3"


@register(
    "list_numbering",
    f"""WITH {ITEMS}, e AS (SELECT *, {LEVEL} AS level,
         sum(CASE WHEN {LEVEL} < 1 THEN 1 ELSE 0 END) OVER w AS e1, sum(CASE WHEN {LEVEL} < 2 THEN 1 ELSE 0 END) OVER w AS e2
         FROM items WINDOW w AS (PARTITION BY l_orderkey ORDER BY ord ROWS UNBOUNDED PRECEDING))
       SELECT l_orderkey, ord, level, CAST(row_number() OVER (PARTITION BY l_orderkey, level, CASE level WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE 0 END ORDER BY ord) AS INTEGER) AS value FROM e""",
)
def list_numbering(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", (F.col("l_linenumber") % 3).alias("level"))
    return ordered.list_numbering(rows, ["l_orderkey"], ["ord"], "level", levels=3)


@register("page_from_breaks", f"WITH {ITEMS} SELECT l_orderkey, ord, 1 + sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY ord ROWS UNBOUNDED PRECEDING) AS page FROM items")
def page_from_breaks(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", "l_returnflag")
    return ordered.pages_from_breaks(rows, ["l_orderkey"], ["ord"], F.col("l_returnflag") == "R").drop("l_returnflag")


@register(
    "list_islands",
    f"""WITH {ITEMS}, f AS (SELECT *, CASE WHEN l_linestatus = 'O' AND lag(l_linestatus) OVER w = 'O' AND lag(l_returnflag) OVER w = l_returnflag THEN 0 ELSE 1 END AS new FROM items WINDOW w AS (PARTITION BY l_orderkey ORDER BY ord)),
         g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY ord ROWS UNBOUNDED PRECEDING) AS island FROM f)
       SELECT l_orderkey, island, l_returnflag, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY ord) AS text FROM g GROUP BY l_orderkey, island, l_returnflag""",
)
def list_islands(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string").alias("t"))
    return ordered.merge_islands(rows, ["l_orderkey"], ["ord"], ["l_returnflag"], F.col("l_linestatus") == "O", "t", " ")


@register(
    "caption_lookahead",
    f"""WITH {ITEMS}, m AS (SELECT *, l_returnflag = 'A' AND coalesce(lead(l_returnflag) OVER w = 'N', false) AS got, l_returnflag = 'N' AND coalesce(lag(l_returnflag) OVER w = 'A', false) AS gone, lead(l_partkey) OVER w AS nx
         FROM items WINDOW w AS (PARTITION BY l_orderkey ORDER BY ord))
       SELECT l_orderkey, ord, l_returnflag, CASE WHEN got THEN nx END AS caption FROM m WHERE NOT gone""",
)
def caption_lookahead(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", "l_returnflag", "l_partkey")
    return ordered.lookahead(rows, ["l_orderkey"], ["ord"], F.col("l_returnflag") == "A", F.col("l_returnflag") == "N", "l_partkey", "caption").drop("l_partkey")


@register(
    "contextual_spacing",
    f"""WITH {ITEMS} SELECT l_orderkey, ord, CASE WHEN lead(l_returnflag) OVER w = l_returnflag AND l_linestatus = 'O' AND lead(l_linestatus) OVER w = 'O' THEN 0 ELSE l_quantity END AS margin_bottom
       FROM items WINDOW w AS (PARTITION BY l_orderkey ORDER BY ord)""",
)
def contextual_spacing(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", "l_returnflag", (F.col("l_linestatus") == "O").alias("f"), "l_quantity")
    return ordered.contextual_spacing(rows, ["l_orderkey"], ["ord"], "l_returnflag", "f", "l_quantity").select("l_orderkey", "ord", "margin_bottom")


@register(
    "heading_ids",
    """WITH b AS (SELECT p_partkey, replace(lower(p_name), ' ', '-') AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM b)
       SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS stable_id FROM n""",
)
def heading_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", X.slugify(F.col("p_name"), 64, "heading").alias("base"))
    return ordered.stable_ids(rows, [], ["p_partkey"], "base").drop("base")


@register(
    "nav_groups",
    f"""WITH {ITEMS}, o AS (SELECT *, CASE WHEN l_returnflag = 'A' OR ord = 1 THEN 1 ELSE 0 END AS op FROM items), g AS (SELECT *, sum(op) OVER (PARTITION BY l_orderkey ORDER BY ord ROWS UNBOUNDED PRECEDING) AS group_ord FROM o)
       SELECT l_orderkey, ord, group_ord, row_number() OVER (PARTITION BY l_orderkey, group_ord ORDER BY ord) - 1 AS entry_ord FROM g""",
)
def nav_groups(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", "l_returnflag")
    return ordered.nav_groups(rows, ["l_orderkey"], ["ord"], F.col("l_returnflag") == "A").drop("l_returnflag")


@register(
    "toc_rows",
    f"""WITH {ITEMS}, h AS (SELECT l_orderkey, ord, 1 + l_linenumber % 4 AS level, CAST(l_partkey AS VARCHAR) AS title FROM items), m AS (SELECT *, min(level) OVER (PARTITION BY l_orderkey) AS least FROM h)
       SELECT l_orderkey, ord, repeat(' ', (level - least) * 4) || title AS toc_text, level = least AS bold FROM m""",
)
def toc_rows(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", (1 + F.col("l_linenumber") % 4).alias("level"), F.col("l_partkey").cast("string").alias("title"))
    return ordered.toc_rows(rows, ["l_orderkey"], "level", "title").drop("level", "title")


@register(
    "section_range",
    f"""WITH {ITEMS}, h AS (SELECT l_orderkey, ord, CASE WHEN l_returnflag <> 'N' THEN 1 + l_linenumber % 4 END AS level FROM items)
       SELECT l_orderkey, ord, level, CASE WHEN level IS NOT NULL THEN e END AS section_end FROM (SELECT a.l_orderkey, a.ord, a.level, coalesce(min(b.ord) - 1, max(c.m)) AS e
       FROM h a JOIN (SELECT l_orderkey, max(ord) AS m FROM h GROUP BY 1) c ON c.l_orderkey = a.l_orderkey LEFT JOIN h b ON b.l_orderkey = a.l_orderkey AND b.ord > a.ord AND b.level <= a.level GROUP BY a.l_orderkey, a.ord, a.level)""",
)
def section_range(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", F.when(F.col("l_returnflag") != "N", 1 + F.col("l_linenumber") % 4).alias("level"))
    return ordered.section_ends(rows, ["l_orderkey"], "ord", "level", 4)


@register(
    "range_select",
    f"""WITH {ITEMS}, k AS (SELECT *, min(CASE WHEN l_linenumber = 4 THEN ord END) OVER (PARTITION BY l_orderkey) AS a, min(CASE WHEN l_linenumber = 2 THEN ord END) OVER (PARTITION BY l_orderkey) AS b FROM items)
       SELECT l_orderkey, ord FROM k WHERE ord BETWEEN least(coalesce(a, 1), coalesce(b, a, 1)) AND greatest(coalesce(a, 1), coalesce(b, a, 1))""",
)
def range_select(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", F.col("l_linenumber").cast("string").alias("key"))
    return ordered.entries_in_range(rows, ["l_orderkey"], "ord", "key", "4", "2").drop("key")


@register(
    "estimated_heights",
    f"WITH {ITEMS} SELECT l_orderkey, ord, greatest(1.0, coalesce(lead(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY ord) - l_extendedprice, 0.0), l_quantity) AS height FROM items",
)
def estimated_heights(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", "l_extendedprice", "l_quantity")
    return ordered.estimated_heights(rows, ["l_orderkey"], ["ord"], "l_extendedprice", "l_quantity").select("l_orderkey", "ord", "height")


@register(
    "pair_units",
    f"""WITH {ITEMS}, j AS (SELECT *, CASE WHEN l_returnflag = 'R' AND coalesce(lag(l_returnflag) OVER w = 'A', false) THEN 0 ELSE 1 END AS new FROM items WINDOW w AS (PARTITION BY l_orderkey ORDER BY ord)),
         u AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY ord ROWS UNBOUNDED PRECEDING) AS unit FROM j)
       SELECT l_orderkey, ord, unit, count(*) OVER (PARTITION BY l_orderkey, unit) > 1 AS paired FROM u""",
)
def pair_units(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", "l_returnflag")
    return ordered.pair_adjacent(rows, ["l_orderkey"], ["ord"], F.col("l_returnflag") == "A", F.col("l_returnflag") == "R").drop("l_returnflag")


@register(
    "positional_zip",
    f"""WITH {ITEMS}, a AS (SELECT l_orderkey, ord, row_number() OVER (PARTITION BY l_orderkey ORDER BY ord) AS k FROM items WHERE l_returnflag = 'A'), b AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY ord) AS k FROM items WHERE l_returnflag = 'N')
       SELECT a.l_orderkey, ord, b.l_partkey AS caption FROM a LEFT JOIN b ON a.l_orderkey = b.l_orderkey AND a.k = b.k""",
)
def positional_zip(spark, sf_dir):
    rows = items(spark, sf_dir)
    left, right = rows.where("l_returnflag = 'A'").select("l_orderkey", "ord"), rows.where("l_returnflag = 'N'").select("l_orderkey", "ord", "l_partkey")
    return ordered.positional_zip(left, right, ["l_orderkey"], ["ord"], "l_partkey", "caption")


@register("history_last_n", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def history_last_n(spark, sf_dir):
    return ordered.keep_last(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], 5).drop("ts")


@register(
    "image_dedup",
    f"""WITH {ITEMS}, s AS (SELECT *, CASE WHEN l_tax > 0.04 THEN 'c' || l_partkey ELSE '' END AS cap FROM items),
         r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_quantity DESC, ord) AS n, min(ord) OVER (PARTITION BY l_orderkey, l_returnflag) AS place,
               first_value(nullif(cap, '') IGNORE NULLS) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS any_cap FROM s)
       SELECT l_orderkey, l_returnflag, ord, place, coalesce(nullif(cap, ''), any_cap) AS filled_caption FROM r WHERE n = 1""",
)
def image_dedup(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "l_returnflag", "ord", "l_quantity", F.when(F.col("l_tax") > 0.04, F.concat(F.lit("c"), F.col("l_partkey"))).otherwise("").alias("cap"))
    return ordered.best_per_group(rows, ["l_orderkey", "l_returnflag"], F.col("l_quantity"), ["ord"], "cap").drop("cap", "l_quantity")


@register("first_style_per_level", f"WITH {ITEMS} SELECT l_orderkey, l_linenumber, arg_min(l_partkey, ord) AS l_partkey FROM items GROUP BY ALL")
def first_style_per_level(spark, sf_dir):
    return ordered.first_per_key(items(spark, sf_dir), ["l_orderkey", "l_linenumber"], "l_partkey", ["ord"])


@register("distinct_in_order", f"WITH {ITEMS} SELECT l_orderkey, l_returnflag, min(ord) AS ord FROM items GROUP BY ALL")
def distinct_in_order(spark, sf_dir):
    return ordered.distinct_in_order(items(spark, sf_dir).select("l_orderkey", "l_returnflag", "ord"), ["l_orderkey", "l_returnflag"], ["ord"])


@register(
    "heading_semi_join",
    f"""WITH {ITEMS} SELECT l_orderkey, ord FROM items h WHERE l_linenumber % 4 <= 2 AND (
         EXISTS (SELECT 1 FROM items e WHERE e.l_orderkey = h.l_orderkey AND e.ord = h.ord AND e.l_returnflag = 'R') OR EXISTS (SELECT 1 FROM items e WHERE e.l_orderkey = h.l_orderkey AND e.l_linenumber = h.l_linenumber AND e.l_returnflag = 'R'))""",
)
def heading_semi_join(spark, sf_dir):
    rows = items(spark, sf_dir).select(F.col("l_orderkey").alias("page"), F.col("ord").alias("id"), F.col("l_linenumber").alias("source_paragraph"), (F.col("l_linenumber") % 4).alias("level"), "l_returnflag")
    found = audit.headings_for_entries(rows.drop("l_returnflag"), rows.where("l_returnflag = 'R'"), 2)
    return found.select(F.col("page").alias("l_orderkey"), F.col("id").alias("ord"))


@register(
    "dup_evidence",
    f"""WITH {LINES}, k AS (SELECT line FROM lines GROUP BY line HAVING count(DISTINCT doc_id) > 1), e AS (SELECT doc_id, count(*) AS n, count(k.line) AS hits FROM lines LEFT JOIN k USING (line) GROUP BY doc_id)
       SELECT *, hits >= greatest(2, ceil(n * 0.7)) AS duplicate FROM e""",
)
def dup_evidence(spark, sf_dir):
    """Every document against the lines of all others."""
    rows = doc_lines(spark, sf_dir).select("doc_id", "line")
    shared = rows.groupBy("line").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    return audit.duplicate_evidence(rows, shared, ["doc_id"], ["line"])


@register("import_metrics", f"WITH {LINES} SELECT lang, count(*) AS paragraphs, count(*) FILTER (WHERE contains(line, ' | ')) AS tables, count(*) FILTER (WHERE trim(line) = '') AS blanks, count(DISTINCT doc_id) AS docs FROM lines GROUP BY lang")
def import_metrics(spark, sf_dir):
    x = doc_lines(spark, sf_dir)
    return x.groupBy("lang").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("line").contains(" | ")).alias("tables"), F.count_if(F.trim("line") == "").alias("blanks"), F.count_distinct("doc_id").alias("docs"))


@register("row_width", "SELECT o_custkey, max(w) AS columns FROM (SELECT o_custkey, o_orderkey, sum(l_linenumber) AS w FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY 1")
def row_width(spark, sf_dir):
    """A customer's line items as the cells of a table, an order a row; line numbers are spans."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    cells = cells.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return reports.widest_row(cells, ["o_custkey"], ["o_orderkey"], "l_linenumber")


@register("header_run", f"WITH {ITEMS} SELECT l_orderkey, coalesce(min(CASE WHEN l_returnflag <> 'N' THEN ord END) - 1, max(ord)) AS header_rows FROM items GROUP BY 1")
def header_run(spark, sf_dir):
    return ordered.leading_run(items(spark, sf_dir), ["l_orderkey"], "ord", F.col("l_returnflag") == "N", "header_rows")


@register(
    "range_summary",
    f"""WITH {ITEMS} SELECT l_orderkey, count(*) AS blocks, count(*) FILTER (WHERE l_returnflag = 'A') AS headings, count(*) FILTER (WHERE l_linestatus = 'O') AS figures,
       arg_min(l_suppkey, ord) AS first_page, arg_max(l_suppkey, ord) AS last_page FROM items GROUP BY 1""",
)
def range_summary(spark, sf_dir):
    return reports.range_summary(items(spark, sf_dir), ["l_orderkey"], "ord", "l_suppkey", F.col("l_returnflag") == "A", F.col("l_linestatus") == "O")


@register("name_union", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS names FROM events GROUP BY 1")
def name_union(spark, sf_dir):
    return reports.name_union(table(spark, sf_dir, "events"), ["user_id"], "event_type").select("user_id", F.array_join("names", ",").alias("names"))


@register(
    "entries_to_book",
    f"""WITH {ITEMS}, e AS (SELECT l_orderkey, ord, CASE WHEN l_returnflag <> 'N' THEN 1 + l_linenumber % 4 END AS level, CAST(l_partkey AS VARCHAR) AS title FROM items)
       SELECT l_orderkey, 1 AS page_ord, 'document-flow' AS section, ord - 1 AS ord, CASE WHEN level IS NULL THEN 'paragraph' ELSE 'section_heading' END AS kind, title, level FROM e
       UNION ALL SELECT l_orderkey, 0, 'toc', row_number() OVER (PARTITION BY l_orderkey ORDER BY ord), 'paragraph', title, level FROM e WHERE level <= 3
       UNION ALL SELECT DISTINCT l_orderkey, 0, 'toc', 0, 'part_title', 'Περιεχόμενα', CAST(NULL AS INTEGER) FROM e""",
)
def entries_to_book(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", F.when(F.col("l_returnflag") != "N", 1 + F.col("l_linenumber") % 4).cast("int").alias("level"), F.col("l_partkey").cast("string").alias("title"))
    return reports.book_of_entries(rows, ["l_orderkey"], "ord", "level", "title")


@register(
    "list_parents",
    f"""WITH {ITEMS}, e AS (SELECT l_orderkey, ord, l_linenumber % 4 AS level FROM items)
       SELECT l_orderkey, ord, level, (SELECT max(b.ord) FROM e b WHERE b.l_orderkey = a.l_orderkey AND b.ord < a.ord AND b.level < a.level) AS parent FROM e a""",
)
def list_parents(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", (F.col("l_linenumber") % 4).alias("level"))
    return reports.nested_parents(rows, ["l_orderkey"], "ord", "level")
