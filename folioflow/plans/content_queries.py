"""Sequence, set, scalar and ingest queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions import mathexpr, richtext
from folioflow.functions import text as X
from folioflow.operators import identity, paginate, reflow, sequence, setops
from folioflow.plans.catalog_queries import ITEMS, LINES, doc_lines, items
from folioflow.plans.registry import register
from folioflow.session import table
from folioflow.sources.html_blocks import block_rows

# --- visibility and sequences ------------------------------------------------------------------


@register(
    "mode_filter",
    f"""WITH {ITEMS}, s AS (SELECT l_orderkey, ord FROM items JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'P' AND l_returnflag <> 'R')
       SELECT o_orderkey, (SELECT count(*) FROM s WHERE l_orderkey = o_orderkey) AS shown FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey IN (SELECT l_orderkey FROM s)""",
)
def mode_filter(spark, sf_dir):
    rows = sum(table(spark, sf_dir, name).count() for name in ("orders", "lineitem"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    page_shown = sequence.visible_in_mode("print", F.lit(False), F.col("o_orderstatus") == "P", F.lit(None).cast("boolean"))
    item_shown = sequence.visible_in_mode("print", F.lit(None).cast("boolean"), F.lit(False), F.col("l_returnflag") != "R")
    shown_pages, shown = sequence.filter_for_print(pages, items(spark, sf_dir).select("l_orderkey", "ord", "l_returnflag"), ["l_orderkey"], page_shown, item_shown, rows=rows)
    counts = shown.groupBy("l_orderkey").agg(F.count("*").alias("shown")).hint("merge")
    return shown_pages.join(counts, "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"), "shown")


@register(
    "mode_counts",
    """SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS pages_shown, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS pages_hidden,
              (SELECT count(*) FROM lineitem WHERE l_returnflag <> 'R') AS items_shown, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS items_hidden""",
)
def mode_counts(spark, sf_dir):
    return sequence.mode_counts(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), F.col("o_orderstatus") != "P", F.col("l_returnflag") != "R")


@register(
    "print_expand",
    f"""WITH {ITEMS}, i AS (SELECT l_orderkey, ord, l_partkey AS id, CASE WHEN l_returnflag = 'A' THEN l_linenumber % 3 + 1 ELSE 0 END AS n,
         CASE WHEN l_returnflag = 'A' THEN lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY ord) END AS ref FROM items),
       sc AS (SELECT l_orderkey, id, max(ord) AS s_ord FROM i GROUP BY ALL),
       f AS (SELECT i.*, s_ord FROM i JOIN sc ON sc.l_orderkey = i.l_orderkey AND sc.id = i.ref WHERE n > 0),
       gone AS (SELECT l_orderkey, ord FROM f UNION SELECT l_orderkey, s_ord FROM f WHERE s_ord >= ord - 1),
       o AS (SELECT i.l_orderkey, i.ord AS k, -1 AS step_ord, 0 AS part, i.id FROM i LEFT JOIN gone g ON g.l_orderkey = i.l_orderkey AND g.ord = i.ord WHERE g.ord IS NULL
             UNION ALL SELECT l_orderkey, ord, s, 0, id FROM f, unnest(range(n)) u(s) UNION ALL SELECT l_orderkey, ord, s, 1, ref FROM f, unnest(range(n)) u(s))
       SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY k, step_ord, part) - 1 AS ord, id, CASE WHEN step_ord < 0 THEN NULL ELSE step_ord END AS step_ord, part FROM o""",
)
def print_expand(spark, sf_dir):
    rows = items(spark, sf_dir)
    nxt = F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("ord"))
    call = F.col("l_returnflag") == "A"
    steps = F.when(call, F.sequence(F.lit(0).cast("bigint"), (F.col("l_linenumber") % 3).cast("bigint")))
    rows = rows.select("l_orderkey", F.lit(0).alias("page"), "ord", F.col("l_partkey").alias("id"), F.when(call, nxt).alias("scene_id"), steps.alias("steps"))
    return sequence.expand_print(rows, ["l_orderkey"], "page", "ord").select("l_orderkey", "ord", "id", "step_ord", "part")


@register(
    "screen_flags",
    f"WITH {ITEMS} SELECT l_orderkey, ord, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY ord ROWS UNBOUNDED PRECEDING) = 1 AS expanded FROM items",
)
def screen_flags(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", "l_returnflag")
    return sequence.screen_flags(rows, ["l_orderkey"], "ord", F.col("l_returnflag") == "A").drop("l_returnflag")


@register(
    "continuation_order",
    f"""WITH {ITEMS}, p AS (SELECT l_orderkey, ord, CASE WHEN l_returnflag = 'R' THEN 'p' || (l_linenumber % 3) || '-r' || (2 + l_partkey % 5) ELSE 'p' || l_linenumber END AS id, l_returnflag = 'R' AS po FROM items),
       b AS (SELECT *, CASE WHEN po THEN regexp_extract(id, '^(.*)-r(\\d+)$', 1) END AS base, TRY_CAST(regexp_extract(id, '^(.*)-r(\\d+)$', 2) AS INTEGER) AS part FROM p),
       j AS (SELECT b.*, x.place FROM b LEFT JOIN (SELECT l_orderkey, id, min(ord) AS place FROM p GROUP BY ALL) x ON x.l_orderkey = b.l_orderkey AND x.id = b.base)
       SELECT l_orderkey, ord, id, row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(place, ord), CASE WHEN place IS NULL THEN 0 ELSE part END, ord) - 1 AS new_ord FROM j""",
)
def continuation_order(spark, sf_dir):
    more = F.col("l_returnflag") == "R"
    name = F.when(more, F.concat(F.lit("p"), F.col("l_linenumber") % 3, F.lit("-r"), 2 + F.col("l_partkey") % 5)).otherwise(F.concat(F.lit("p"), F.col("l_linenumber")))
    rows = items(spark, sf_dir).select("l_orderkey", "ord", name.alias("id"), more.alias("print_only"))
    return sequence.continuation_order(rows, ["l_orderkey"], "ord").drop("print_only")


@register(
    "frame_numbers",
    """WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx, o_orderpriority AS footer FROM orders)
       SELECT o_orderkey, 1 + idx AS number, CASE WHEN contains(footer, '1') THEN 'page ' || (1 + idx) ELSE footer || ' ' || (1 + idx) END AS footer_text FROM p""",
)
def frame_numbers(spark, sf_dir):
    idx = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", idx.alias("number"))
    template = F.when(F.col("o_orderpriority").contains("1"), "page {page}").otherwise(F.concat(F.col("o_orderpriority"), F.lit(" {page}")))
    return rows.select("o_orderkey", "number", X.frame_text(template, F.col("number")).alias("footer_text"))


# --- lookups, maps and sets --------------------------------------------------------------------


@register("scene_lookup_last", "SELECT o_orderkey, arg_max(l_partkey, (l_shipdate, l_partkey)) AS scene FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def scene_lookup_last(spark, sf_dir):
    scenes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("scene"), F.struct("l_shipdate", "l_partkey").alias("o"))
    return setops.last_match(table(spark, sf_dir, "orders").select("o_orderkey"), scenes, ["o_orderkey"], "o").drop("o")


@register("lab_lookup_first", "SELECT page_id, origin, min(page_id) OVER (PARTITION BY origin) AS first FROM (SELECT page_id, regexp_extract(lower(url), '^([a-z]+://[^/?#]*)', 1) AS origin FROM pages)")
def lab_lookup_first(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", setops.url_origin(F.col("url")).alias("origin"))
    labs = rows.select("origin", F.col("page_id").alias("first"))
    return setops.first_match(rows, labs, ["origin"], "first")


@register(
    "registry_default",
    """SELECT event_id, coalesce(c.c_custkey, d.k) AS customer FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') c ON c.c_custkey = user_id
       CROSS JOIN (SELECT min(c_custkey) AS k FROM customer WHERE c_mktsegment = 'BUILDING') d""",
)
def registry_default(spark, sf_dir):
    labs = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return setops.with_default(table(spark, sf_dir, "events").select("event_id", "user_id"), labs, "user_id", "c_custkey", "customer").drop("user_id")


@register(
    "three_way_numbering",
    "SELECT s_suppkey, coalesce(n_name, 'default') AS n, coalesce(r_name, 'default') AS r FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
)
def three_way_numbering(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0")
    met = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(nation, F.col("n_nationkey") == F.col("s_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return met.select("s_suppkey", F.coalesce("n_name", F.lit("default")).alias("n"), F.coalesce("r_name", F.lit("default")).alias("r"))


PARAMS = "from_json(props, 'map<string,string>')"


@register(
    "map_diff",
    """WITH p AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
       SELECT event_id, CASE WHEN k % 5 = 0 THEN '' WHEN k % 2 = 0 THEN 'k' ELSE 'k,z' END AS changed_keys, CASE WHEN k % 5 = 0 THEN 'k' ELSE '' END AS removed_keys FROM p""",
)
def map_diff(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr(PARAMS).alias("base"))
    k = F.col("base")["k"].cast("int")
    changed = F.concat(F.col("base")["k"], F.lit("x"))
    applied = F.when(k % 5 == 0, F.create_map(F.lit("k"), F.lit(""))).when(k % 2 == 0, F.create_map(F.lit("k"), changed)).otherwise(F.create_map(F.lit("k"), changed, F.lit("z"), F.lit("1")))
    keys = lambda m: F.array_join(F.array_sort(F.map_keys(m)), ",")
    return e.select("event_id", keys(setops.map_changed(F.col("base"), applied)).alias("changed_keys"), F.array_join(setops.map_removed(F.col("base"), applied), ",").alias("removed_keys"))


@register("param_keys", "SELECT event_type, 'k' AS param, min(event_id) AS first_event FROM events GROUP BY 1")
def param_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.expr(PARAMS).alias("params"))
    return setops.parameter_keys(e, ["event_type"], ["event_id"], "params").select("event_type", "param", F.col("first.event_id").alias("first_event"))


@register("param_values", "SELECT DISTINCT json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') <> ''")
def param_values(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("value")).where("value <> ''").distinct()


@register(
    "param_summary_top6",
    """SELECT p_partkey, array_to_string(list_transform(list_sort([{'r': 1, 'k': 'preset', 'v': p_brand}, {'r': 0, 'k': 'scene', 'v': p_type}, {'r': 999, 'k': 'name', 'v': p_name}, {'r': 999, 'k': 'size', 'v': CAST(p_size AS VARCHAR)}]), lambda e: e.k || ': ' || e.v), ' · ') AS summary FROM part""",
)
def param_summary_top6(spark, sf_dir):
    m = F.create_map(F.lit("preset"), F.col("p_brand"), F.lit("scene"), F.col("p_type"), F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", setops.priority_top(m, ["scene", "preset"]).alias("summary"))


@register(
    "preset_dedup",
    """WITH RECURSIVE p AS (SELECT s_suppkey, s_nationkey, [s_suppkey % 3, 100 + s_suppkey % 5, 200 + s_suppkey % 7] AS ks, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier),
       r AS (SELECT s_nationkey, n, s_suppkey, ks AS seen, true AS kept FROM p WHERE n = 1
         UNION ALL SELECT p.s_nationkey, p.n, p.s_suppkey, CASE WHEN list_has_any(r.seen, p.ks) THEN r.seen ELSE list_concat(r.seen, p.ks) END, NOT list_has_any(r.seen, p.ks)
         FROM r JOIN p ON p.s_nationkey = r.s_nationkey AND p.n = r.n + 1)
       SELECT s_suppkey FROM r WHERE kept""",
)
def preset_dedup(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.array(k % 3, 100 + k % 5, 200 + k % 7).alias("keys"))
    return setops.suppress_overlaps(rows, ["s_nationkey"], "keys", ["s_suppkey"]).select("s_suppkey")


@register(
    "object_diff",
    """WITH p AS (SELECT p_partkey, p_size % 3 AS a, p_size % 2 AS b FROM part)
       SELECT p_partkey, array_to_string(list_filter([CASE WHEN a <> b THEN 'same' END, CASE WHEN a = 1 THEN 'new' END], lambda x: x IS NOT NULL), ',') AS changed FROM p""",
)
def object_diff(spark, sf_dir):
    a, b = (F.col("p_size") % 3).cast("string"), (F.col("p_size") % 2).cast("string")
    base = F.create_map(F.lit("same"), a, F.lit("gone"), a)
    applied = F.when(a == "1", F.create_map(F.lit("same"), b, F.lit("new"), F.lit(None).cast("string"))).otherwise(F.create_map(F.lit("same"), b))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.map_keys(setops.object_diff(base, applied)), ",").alias("changed"))


@register("value_labels", "SELECT event_id, CASE WHEN event_id % 4 IN (0, 2) THEN CASE event_id % 4 WHEN 0 THEN 'όχι' ELSE 'ναι' END WHEN event_id % 4 = 1 THEN 'ναι' ELSE event_type END AS label FROM events")
def value_labels(spark, sf_dir):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, "0").when(k == 1, "1").when(k == 2, "true").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", X.display_label(raw, X.YES_NO).alias("label"))


@register(
    "earliest_mark",
    f"""WITH {LINES}, f AS (SELECT doc_id, ord, list_sort(list_filter([{{'p': strpos(line, ', '), 'm': 0}}, {{'p': strpos(line, '. '), 'm': 1}}, {{'p': strpos(line, 'the '), 'm': 2}}], lambda x: x.p > 0)) AS f FROM lines)
       SELECT doc_id, ord, f[1].p AS place, [', ', '. ', 'the '][f[1].m + 1] AS mark FROM f""",
)
def earliest_mark(spark, sf_dir):
    found = doc_lines(spark, sf_dir).select("doc_id", "ord", X.earliest(F.col("line"), [", ", ". ", "the "]).alias("e"))
    return found.select("doc_id", "ord", F.col("e.place").alias("place"), F.col("e.mark").alias("mark"))


@register(
    "math_spans",
    """SELECT p_partkey, unnest(range(1, 5)) AS pos, unnest([p_name || ' ', 'x_' || p_size, ' and ', CAST(p_partkey AS VARCHAR)]) AS text, unnest([NULL, 'inline', NULL, 'block']) AS display FROM part WHERE p_partkey % 3 = 0
       UNION ALL SELECT p_partkey, 1, p_name || ' ', NULL FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 2, '\\[open \\(x\\)', NULL FROM part WHERE p_partkey % 3 = 1
       UNION ALL SELECT p_partkey, 1, 'a' || chr(10) || 'b', 'block' FROM part WHERE p_partkey % 3 = 2""",
)
def math_spans(spark, sf_dir):
    k = F.col("p_partkey") % 3
    whole = F.concat(F.col("p_name"), F.lit(r" \(x_"), F.col("p_size"), F.lit(r"\) and $$"), F.col("p_partkey"), F.lit("$$"))
    src = F.when(k == 0, whole).when(k == 1, F.concat(F.col("p_name"), F.lit(r" \[open \(x\)"))).otherwise("\\[a\nb\\]")
    spans = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(X.math_spans(src)).alias("pos", "s"))
    return spans.select("p_partkey", (F.col("pos") + 1).alias("pos"), "s.text", "s.display")


@register("asset_names", "SELECT p_partkey, replace(lower(p_name), ' ', '-') || CASE WHEN p_partkey % 2 = 0 THEN '.jpeg' ELSE '.png' END AS name FROM part")
def asset_names(spark, sf_dir):
    file = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, ".JPEG").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", X.asset_name(file).alias("name"))


@register("print_materialized", f"WITH {ITEMS} SELECT l_orderkey, ord FROM items WHERE l_returnflag <> 'R'")
def print_materialized(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", (F.col("l_returnflag") == "R").alias("screenOnly"))
    shown = rows.where(sequence.visible_in_mode("print", F.lit(None).cast("boolean"), F.col("screenOnly"), F.lit(None).cast("boolean")))
    return sequence.materialized(shown, "print")


@register(
    "locate_items",
    f"""WITH {ITEMS}, r AS (SELECT o_orderkey AS l_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 9 AS VARCHAR) ELSE 'i' || (o_orderkey % 8 + 1) END AS ref FROM orders),
       x AS (SELECT r.*, CASE WHEN starts_with(ref, 'i') THEN (SELECT min(ord) - 1 FROM items i WHERE i.l_orderkey = r.l_orderkey AND 'i' || l_linenumber = ref)
             ELSE (SELECT CASE WHEN TRY_CAST(ref AS BIGINT) <= max(ord) - 1 THEN TRY_CAST(ref AS BIGINT) END FROM items i WHERE i.l_orderkey = r.l_orderkey) END AS found FROM r)
       SELECT l_orderkey, ref, found, CASE WHEN found IS NULL THEN 'nothing found for ' || ref END AS error FROM x""",
)
def locate_items(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", (F.col("ord") - 1).alias("ord"), F.concat(F.lit("i"), F.col("l_linenumber")).alias("id"))
    k = F.col("o_orderkey")
    refs = table(spark, sf_dir, "orders").select(k.alias("l_orderkey"), F.when(k % 2 == 0, (k % 9).cast("string")).otherwise(F.concat(F.lit("i"), k % 8 + 1)).alias("ref"))
    return sequence.located(rows, refs, ["l_orderkey"], "ord", "id", "ref")


@register("flow_coalesce", f"WITH {ITEMS} SELECT l_orderkey, l_returnflag = 'A' AS toc, row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'A' ORDER BY ord) - 1 AS new_ord, ord FROM items")
def flow_coalesce(spark, sf_dir):
    """Every line item is a page of its own; those flagged are contents."""
    rows = items(spark, sf_dir).select("l_orderkey", "ord", (F.col("l_returnflag") == "A").alias("flag"))
    flow = reflow.coalesced(rows.withColumn("page", F.col("ord")), ["l_orderkey"], "page", "ord", F.col("flag"))
    return flow.select("l_orderkey", (F.col("section") == reflow.CONTENTS).alias("toc"), F.col("place").alias("new_ord"), "ord")


@register("union_keys", "SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders")
def union_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).union(table(spark, sf_dir, "orders").select("o_custkey")).distinct()


# --- scalars -----------------------------------------------------------------------------------


@register(
    "slug",
    f"""WITH {LINES} SELECT doc_id, ord AS line_no, coalesce(nullif(substr(trim(regexp_replace(lower(translate(line, 'áàâäãåéèêëíìîïóòôöõúùûüýÿñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÝÑÇ', 'aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNC')), '[^a-z0-9Ͱ-Ͽ]+', '-', 'g'), '-'), 1, 60), ''), 'item') AS slug FROM lines""",
)
def slug(spark, sf_dir):
    """Every line of every document."""
    return doc_lines(spark, sf_dir).select("doc_id", F.col("ord").alias("line_no"), X.slugify(F.col("line")).alias("slug"))


@register(
    "normalize_id",
    """WITH t AS (SELECT p_partkey, trim(regexp_replace(trim(p_brand || ' ' || p_size), '[^A-Za-z0-9_:.-]+', '-', 'g'), '-') AS s, trim(regexp_replace(p_size || ' ' || p_name, '[^A-Za-z0-9_:.-]+', '-', 'g'), '-') AS u FROM part)
       SELECT p_partkey, s AS named, 'id-' || u AS numbered FROM t""",
)
def normalize_id(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.normalize_id(F.concat_ws(" ", "p_brand", "p_size")).alias("named"), X.normalize_id(F.concat_ws(" ", "p_size", "p_name")).alias("numbered"))


@register(
    "html_text",
    """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<br\\s*/?\\s*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'),
         '&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi'), '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '&quot;', '"', 'gi'), '&#39;', '''', 'gi'), '\\s+', ' ', 'g')) AS body FROM pages""",
)
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("body"))


@register("escape_html", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.escape_html(F.col("html")).alias("escaped"))


@register(
    "url_query_map",
    """WITH q AS (SELECT page_id, unnest(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: p <> '')) AS p FROM pages)
       SELECT page_id, regexp_extract(p, '^([^=]*)', 1) AS key, CASE WHEN contains(p, '=') THEN regexp_extract(p, '^[^=]*=(.*)$', 1) ELSE '1' END AS value FROM q""",
)
def url_query_map(spark, sf_dir):
    m = setops.query_map(F.regexp_extract("url", r"\?([^#]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(m).alias("key", "value"))


@register(
    "url_canonical",
    """SELECT page_id, CASE WHEN contains(b, '?') THEN split_part(b, '?', 1) || '?' || array_to_string(list_sort(string_split(split_part(b, '?', 2), '&')), '&') ELSE b END AS canonical
       FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS b FROM pages)""",
)
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", setops.canonical_url(F.col("url")).alias("canonical"))


@register(
    "aspect",
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size / CAST(1 + p_partkey % 9 AS DOUBLE) WHEN 1 THEN p_retailprice WHEN 2 THEN NULL ELSE NULL END AS aspect FROM part",
)
def aspect(spark, sf_dir):
    k = F.col("p_partkey")
    s = F.when(k % 4 == 0, F.concat_ws("/", F.col("p_size").cast("string"), (1 + k % 9).cast("string"))).when(k % 4 == 1, F.col("p_retailprice").cast("string")).when(k % 4 == 2, "natural").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", X.parse_aspect(s).alias("aspect"))


@register(
    "dialogue_parse",
    """WITH l AS (SELECT conv_id, turn, role, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT *, string_split_regex(text, '\\r?\\n') AS a FROM conversations)),
       p AS (SELECT conv_id, turn, line_no, string_split_regex(trim(concat_ws(' | ', role, line)), '\\s+\\|\\s+') AS a FROM l WHERE regexp_matches(line, '\\S'))
       SELECT conv_id, turn, line_no, CASE WHEN len(a) >= 2 THEN a[1] ELSE '' END AS speaker, CASE WHEN len(a) >= 3 THEN array_to_string(a[2:len(a) - 1], ' | ') WHEN len(a) = 2 THEN a[2] ELSE a[1] END AS "left", CASE WHEN len(a) >= 3 THEN a[-1] ELSE '' END AS "right" FROM p""",
)
def dialogue_parse(spark, sf_dir):
    """Every line of every turn that is not blank."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    parsed = lines.where(F.col("line").rlike(r"\S")).select("conv_id", "turn", "line_no", X.dialogue_row(F.concat_ws(" | ", "role", "line")).alias("d"))
    return parsed.select("conv_id", "turn", "line_no", "d.*")


@register("atoms", f"WITH {LINES} SELECT doc_id, ord, len(regexp_extract_all(line, '\\S+\\s*|\\s+')) AS n_atoms, regexp_extract(line, '\\S+\\s*|\\s+') AS first_atom FROM lines WHERE line <> ''")
def atoms(spark, sf_dir):
    found = doc_lines(spark, sf_dir).where("line <> ''").select("doc_id", "ord", X.atoms(F.col("line")).alias("a"))
    return found.select("doc_id", "ord", F.size("a").alias("n_atoms"), F.col("a")[0].alias("first_atom"))


@register(
    "split_units",
    """WITH a AS (SELECT doc_id, regexp_extract_all(text, '\\S+\\s*|\\s+') AS a FROM documents)
       SELECT doc_id, regexp_replace(array_to_string(a[1:20], ''), '\\s+$', '') AS first, len(a) - least(20, len(a)) AS rest_units FROM a""",
)
def split_units(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", X.atoms(F.col("text")).alias("a"))
    return found.select("doc_id", F.regexp_replace(F.array_join(F.slice("a", 1, 20), ""), r"\s+$", "").alias("first"), (F.size("a") - F.least(F.lit(20), F.size("a"))).alias("rest_units"))


@register("summary", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size > 25 THEN ' ' ELSE p_name END), ''), nullif(trim(p_brand), ''), p_type) AS summary FROM part")
def summary(spark, sf_dir):
    title = F.when(F.col("p_size") > 25, " ").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", X.first_nonblank(title, F.col("p_brand"), F.col("p_type")).alias("summary"))


@register("unit_conversions", "SELECT p_partkey, p_size / 15.0 AS px, p_size * 2.0 / 3.0 AS pt_px, p_partkey / 9525.0 AS emu_px FROM part")
def unit_conversions(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", X.twips_to_px(size).alias("px"), X.half_points_to_px(size).alias("pt_px"), X.emu_to_px(F.col("p_partkey")).alias("emu_px"))


@register("content_hash", "SELECT page_id, sha256(html) AS digest FROM pages")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"))


@register("safe_name", "SELECT page_id, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g') AS name FROM pages")
def safe_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.safe_name(F.col("url")).alias("name"))


@register("stamp", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events")
def stamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"))


# --- ingest, math, pagination ------------------------------------------------------------------


@register("html_blocks")
def html_blocks(spark, sf_dir):
    """Typed blocks of every page: needs a parser, so there is no SQL; tests hold it against hand-made pages."""
    return block_rows(table(spark, sf_dir, "pages"), "page_id")


@register("math_parse")
def math_parse(spark, sf_dir):
    """MathML of an expression made of each part's numbers."""
    src = F.format_string("\\frac{x_{%d}}{%d} + \\alpha^{%d}", "p_partkey", "p_size", F.length("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", src.alias("source")).select("*", mathexpr.parse_math(F.col("source")).alias("m")).select("p_partkey", "source", "m.ok", "m.mathml")


@register(
    "bracket_repair",
    "SELECT p_partkey, '(' || p_name || CASE p_partkey % 3 WHEN 0 THEN ')' WHEN 1 THEN ')' ELSE '[x])' END AS repaired FROM part",
)
def bracket_repair(spark, sf_dir):
    k = F.col("p_partkey")
    src = F.concat(F.lit("("), F.col("p_name"), F.when(k % 3 == 0, "").when(k % 3 == 1, "))").otherwise("[x}])"))
    return table(spark, sf_dir, "part").select("p_partkey", mathexpr.repair_brackets(src).alias("repaired"))


LIMIT = 120.0


@register(
    "paginate_greedy",
    f"""WITH RECURSIVE {ITEMS}, u AS (SELECT l_orderkey, ord, greatest(1.0, l_quantity) AS h, l_returnflag = 'A' AS hd, l_linenumber = 7 AS brk FROM items),
       r AS (SELECT l_orderkey, ord, h, hd, 0 AS page, h AS used, 1 AS n, false AS moved FROM u WHERE ord = 1
         UNION ALL SELECT l_orderkey, ord, h, hd, page + CASE WHEN act > 0 THEN 1 ELSE 0 END, CASE act WHEN 0 THEN used + h WHEN 1 THEN h ELSE ph + h END, CASE act WHEN 0 THEN n + 1 WHEN 1 THEN 1 ELSE 2 END, act = 2
         FROM (SELECT u.l_orderkey, u.ord, u.h, u.hd, r.page, r.used, r.n, r.h AS ph,
               CASE WHEN u.brk THEN 1 WHEN r.used + u.h <= {LIMIT} THEN 0 WHEN r.hd AND r.n = 1 THEN 0 WHEN r.hd THEN 2 ELSE 1 END AS act
               FROM r JOIN u ON u.l_orderkey = r.l_orderkey AND u.ord = r.ord + 1))
       SELECT l_orderkey, ord, CAST(page + CASE WHEN coalesce(lead(moved) OVER (PARTITION BY l_orderkey ORDER BY ord), false) THEN 1 ELSE 0 END AS INTEGER) AS page FROM r""",
)
def paginate_greedy(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", F.col("l_quantity").alias("height"), (F.col("l_returnflag") == "A").alias("heading"), (F.col("l_linenumber") == 7).alias("brk"))
    return paginate.paginate(rows, ["l_orderkey"], ["ord"], "height", "heading", "brk", LIMIT).select("l_orderkey", "ord", "page")


@register(
    "overflow_pages",
    f"SELECT l_orderkey, l_linenumber AS page, sum(greatest(1.0, l_quantity)) AS used, sum(greatest(1.0, l_quantity)) - {LIMIT} AS overflow FROM lineitem GROUP BY ALL HAVING sum(greatest(1.0, l_quantity)) - {LIMIT} > 1",
)
def overflow_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("page"), "l_quantity")
    return paginate.overflow_pages(rows, ["l_orderkey"], "l_quantity", LIMIT)


def inherited_styles(part):
    k = F.col("p_partkey")
    props = F.create_map(F.lit("font"), F.when(k % 3 == 0, F.col("p_brand")), F.lit("size"), F.when(k % 5 == 0, F.col("p_type")))
    styles = part.select(k.cast("string").alias("style_id"), F.floor(k / 2).cast("string").alias("based_on"), props.alias("props"))
    out = setops.resolve_styles(styles)
    return out.select(F.col("style_id").cast("long"), F.col("props")["font"].alias("font"), F.col("props")["size"].alias("size"))


@register(
    "style_inherit",
    """WITH RECURSIVE s AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN -1 ELSE p_partkey // 2 END AS up, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS font, CASE WHEN p_partkey % 5 = 0 THEN p_type END AS size FROM part),
       r AS (SELECT id, up, font, size FROM s UNION ALL SELECT r.id, s.up, coalesce(r.font, s.font), coalesce(r.size, s.size) FROM r JOIN s ON s.id = r.up WHERE r.up >= 0)
       SELECT id AS style_id, max(font) AS font, max(size) AS size FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY up) AS n FROM r) WHERE n = 1 GROUP BY id""",
)
def style_inherit(spark, sf_dir):
    return inherited_styles(table(spark, sf_dir, "part"))


#: Ids of line items, of which two in three look like what a repeat would be called.
PROBED_ID = "concat('i', l_returnflag, CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '-2' ELSE '-3' END)"


@register(
    "unique_ids",
    f"""WITH RECURSIVE {ITEMS}, b AS (SELECT l_orderkey, ord, {PROBED_ID} AS base FROM items),
       r AS (SELECT l_orderkey, CAST(0 AS BIGINT) AS ord, '' AS unique_id, CAST([] AS VARCHAR[]) AS used FROM b WHERE ord = 1
         UNION ALL SELECT l_orderkey, ord, name, list_append(used, name)
         FROM (SELECT b.l_orderkey, b.ord, r.used, list_filter(list_prepend(b.base, list_transform(range(2, 100), lambda k: b.base || '-' || k)), lambda c: NOT list_contains(r.used, c))[1] AS name
               FROM r JOIN b ON b.l_orderkey = r.l_orderkey AND b.ord = r.ord + 1))
       SELECT l_orderkey, ord, unique_id FROM r WHERE ord > 0""",
)
def unique_ids(spark, sf_dir):
    """Ids made unique by probing: a literal 'x-2' that stands earlier is respected, one that stands later is renamed."""
    rows = items(spark, sf_dir).select("l_orderkey", "ord", F.expr(PROBED_ID).alias("id"))
    return identity.ensure_unique(rows, ["l_orderkey"], ["ord"], "id").drop("id")


@register("rich_plain", "SELECT p_partkey, p_name || ' ' || p_brand AS plain, '<strong>' || p_name || '</strong> ' || p_brand AS html FROM part")
def rich_plain(spark, sf_dir):
    src = F.concat(F.lit("<b>"), F.col("p_name"), F.lit("</b> "), F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", richtext.from_html(src).alias("n"))
    return rows.select("p_partkey", richtext.plain_text(F.col("n")).alias("plain"), richtext.to_html(F.col("n")).alias("html"))


@register("clean_html")
def clean_html(spark, sf_dir):
    """Pages without active content; a parser's work, held against hand-made cases in the tests."""
    return table(spark, sf_dir, "pages").select("page_id", richtext.clean_html(F.col("html")).alias("cleaned"))


@register(
    "pagination_report",
    """WITH u AS (SELECT l_orderkey, l_suppkey, min(l_returnflag) AS t, count(*) AS n, max(l_linenumber = 1) AS hard FROM lineitem GROUP BY ALL),
       t AS (SELECT l_orderkey, t, sum(n - 1) AS n, count(*) AS units FROM u WHERE n > 1 GROUP BY ALL)
       SELECT l_orderkey, (SELECT count(DISTINCT l_linenumber) FROM lineitem x WHERE x.l_orderkey = u.l_orderkey) AS pages, count(*) FILTER (WHERE hard) AS hard_breaks,
              coalesce((SELECT sum(units) FROM t WHERE t.l_orderkey = u.l_orderkey), 0) AS split_units, coalesce((SELECT string_agg(t || '=' || n, ',' ORDER BY t) FROM t WHERE t.l_orderkey = u.l_orderkey), '') AS splits
       FROM u GROUP BY l_orderkey""",
)
def pagination_report(spark, sf_dir):
    placed = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_linenumber").alias("page"), F.min("l_returnflag").over(W.partitionBy("l_orderkey", "l_suppkey")).alias("type"))
    out = paginate.pagination_report(placed, ["l_orderkey"], ["l_suppkey"], "type", F.col("page") == 1)
    pairs = F.transform(F.map_entries("splits_by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return out.select("l_orderkey", "pages", "hard_breaks", "split_units", F.array_join(pairs, ",").alias("splits"))
