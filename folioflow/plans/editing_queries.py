"""Queries of pagination with feedback, validation, migration, edits by path, and histories."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions import jsonpath as J
from folioflow.operators import cascade, extent, history, insertion, ordered, provenance, reflow, repair, reports
from folioflow.plans.catalog_queries import ITEMS, LINES, doc_lines, items
from folioflow.plans.registry import register
from folioflow.session import table
from folioflow.sources import listing

#: Height of a page, gap between its units, and width of its text.
ROOM, GAP, CONTENT = 400.0, 10.0, 600.0

#: A customer's orders make four books.
VOLUME = "o_custkey * 4 + o_orderkey % 4"
# Line items as units of their book: types by number, flowing units of as many parts as their quantity.
KIND = "CASE WHEN k = 0 THEN 'section_heading' WHEN k <= 2 THEN 'figure' WHEN k = 3 THEN 'dialogue' WHEN k = 4 THEN 'list' WHEN k = 5 THEN 'table' WHEN k = 6 THEN 'note' ELSE 'paragraph' END"
CAPTION = "(l_suppkey % 9) * 60"
IMAGE = "40 + (l_partkey % 5) * 80"
WIDTH = "80.0 + l_linenumber * 20"
HEIGHT = "CASE WHEN k = 0 THEN 30 WHEN k <= 2 THEN {image} + 18 * ceil({caption} * 7 / ({width})) WHEN k = 3 THEN l_quantity * 12 ELSE 10 + l_linenumber END".format(image=IMAGE, caption=CAPTION, width=WIDTH)


def units(spark, sf_dir, *more):
    """Line items as units of their books, with columns `more` of theirs."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.expr(VOLUME).alias("book"))
    rows = items(spark, sf_dir).join(orders, "l_orderkey").withColumn("k", (F.col("l_partkey") * 7 + F.col("l_suppkey") + F.col("l_linenumber")) % 10)
    height, n = F.expr(HEIGHT).cast("double"), F.when(F.col("k") > 3, F.col("l_quantity").cast("int")).otherwise(1)
    caption = F.expr(CAPTION)
    wider = F.transform(repair.figure_widths(F.expr(WIDTH).cast("double"), F.lit(CONTENT)), lambda w: F.struct(w.alias("width"), (F.expr(IMAGE) + 18 * F.ceil(caption * 7 / w)).cast("double").alias("height")))
    return rows.select(
        "book", "l_orderkey", "ord", F.expr(KIND).alias("type"), (F.col("k") == 0).alias("heading"), (F.col("l_partkey") % 37 == 0).alias("hard_break"), (F.col("k") == 3).alias("pair"),
        F.array_repeat(height, n).alias("parts"), F.when(F.col("k").between(1, 2) & (caption > 0), wider).alias("widths"), *more,
    )


def _height(p: str) -> str:
    return f"CASE WHEN {p}[4] > 0 THEN us[{p}[1]].alts[{p}[4]].h ELSE list_sum(us[{p}[1]].parts[{p}[2] + 1 : {p}[3]]) END"


def _mended(book: str) -> str:
    """Units of books, and where the repair loop puts them (placed); book is SQL over orders and line items."""
    return f"""{ITEMS}, li AS (SELECT *, (l_partkey * 7 + l_suppkey + l_linenumber) % 10 AS k FROM items JOIN orders ON o_orderkey = l_orderkey),
  u AS (SELECT {book} AS book, row_number() OVER (PARTITION BY {book} ORDER BY l_orderkey, ord) AS n, l_orderkey, ord, {KIND} AS type, k = 0 AS hd, l_partkey % 37 = 0 AS brk, k = 3 AS pair,
        list_transform(range(CASE WHEN k > 3 THEN CAST(l_quantity AS INTEGER) ELSE 1 END), lambda i: CAST({HEIGHT} AS DOUBLE)) AS parts,
        CASE WHEN k BETWEEN 1 AND 2 AND {CAPTION} > 0 THEN list_transform([w FOR w IN list_transform([1.2, 1.4, 1.65, 2.0], lambda f: least({CONTENT}, floor(({WIDTH}) * CAST(f AS DOUBLE) + 0.5)))], lambda w: {{'w': w, 'h': CAST({IMAGE} + 18 * ceil({CAPTION} * 7 / w) AS DOUBLE)}}) ELSE [] END AS alts FROM li),
  g AS (SELECT book, n, list_sum(parts) AS h, hd, 0 AS page, list_sum(parts) AS used, 1 AS c, false AS moved FROM u WHERE n = 1
    UNION ALL SELECT book, n, h, hd, page + CASE WHEN act > 0 THEN 1 ELSE 0 END, CASE act WHEN 0 THEN used + h WHEN 1 THEN h ELSE ph + h END, CASE act WHEN 0 THEN c + 1 WHEN 1 THEN 1 ELSE 2 END, act = 2
    FROM (SELECT u.book, u.n, list_sum(u.parts) AS h, u.hd, g.page, g.used, g.c, g.h AS ph,
          CASE WHEN u.brk THEN 1 WHEN g.used + list_sum(u.parts) <= {ROOM} THEN 0 WHEN g.hd AND g.c = 1 THEN 0 WHEN g.hd THEN 2 ELSE 1 END AS act FROM g JOIN u ON u.book = g.book AND u.n = g.n + 1)),
  packed AS (SELECT book, n, page + CASE WHEN coalesce(lead(moved) OVER (PARTITION BY book ORDER BY n), false) THEN 1 ELSE 0 END AS page FROM g),
  chunks AS (SELECT book, list(c ORDER BY page) AS chunks FROM (SELECT book, page, list([n, 0, len(parts), 0] ORDER BY n) AS c FROM packed JOIN u USING (book, n) GROUP BY ALL) GROUP BY book),
  books AS (SELECT book, list({{'type': type, 'hd': hd, 'pair': pair, 'parts': parts, 'alts': alts}} ORDER BY n) AS us FROM u GROUP BY book),
  walk AS (SELECT book, chunks[1] AS cur, chunks[2:] AS waiting, 0 AS page, CAST(NULL AS BIGINT[][]) AS fin, CAST(NULL AS DOUBLE) AS high FROM chunks
    UNION ALL SELECT book,
      CASE act WHEN 0 THEN waiting[1] WHEN 1 THEN [[last[1], last[2], last[3], alt]] WHEN 2 THEN list_concat(cur[:-2], [[last[1], last[2], last[2] + fits, 0]]) ELSE cur[: -(m + 1)] END,
      CASE act WHEN 0 THEN waiting[2:] WHEN 1 THEN waiting WHEN 2 THEN list_concat([list_concat([[last[1], last[2] + fits, last[3], 0]], coalesce(waiting[1], []))], waiting[2:])
        ELSE list_concat([list_concat(cur[-m:], coalesce(waiting[1], []))], waiting[2:]) END,
      page + CASE act WHEN 0 THEN 1 ELSE 0 END, CASE WHEN act = 0 THEN cur END, CASE WHEN act = 0 AND used > {ROOM + 1} THEN used - {ROOM} END
    FROM (SELECT *, CASE WHEN used <= {ROOM + 1} THEN 0 WHEN alt > 0 THEN 1 WHEN fits >= CASE WHEN us[last[1]].type IN ('paragraph', 'note') THEN least(3, last[3] - last[2] - 1) ELSE 1 END AND fits > 0 THEN 2 WHEN single OR led THEN 0 ELSE 3 END AS act,
          CASE WHEN us[prev[1]].hd THEN 2 ELSE 1 END AS m
      FROM (SELECT *, CASE WHEN single AND last[4] = 0 THEN coalesce(list_position(list_transform(us[last[1]].alts, lambda a: a.h <= {ROOM + 1}), true), 0) ELSE 0 END AS alt,
            CASE WHEN (single OR led) AND NOT us[last[1]].pair AND last[3] - last[2] >= 2 THEN len(list_filter(range(1, last[3] - last[2]), lambda k: CASE WHEN led THEN {_height("prev")} + {GAP} ELSE 0 END + list_sum(us[last[1]].parts[last[2] + 1 : last[2] + k]) <= {ROOM + 1})) ELSE 0 END AS fits
        FROM (SELECT *, len(cur) = 1 AS single, len(cur) = 2 AND us[prev[1]].hd AS led, list_sum(list_transform(cur, lambda p: {_height("p")})) + {GAP} * (len(cur) - 1) AS used
          FROM (SELECT w.book, w.cur, w.waiting, w.page, b.us, w.cur[-1] AS last, w.cur[-2] AS prev FROM walk w JOIN books b USING (book) WHERE w.cur IS NOT NULL))))),
  mended AS (SELECT book, page - 1 AS page, high, unnest(fin) AS p FROM walk WHERE fin IS NOT NULL),
  placed AS (SELECT m.book, l_orderkey, ord, type, m.page, p[2] AS from_part, p[3] AS to_part, CASE WHEN p[4] > 0 THEN alts[p[4]].w END AS width, high FROM mended m JOIN u ON u.book = m.book AND u.n = m.p[1])"""


MENDED = _mended(VOLUME)


@register("paginate_repair", f"WITH RECURSIVE {MENDED} SELECT book, l_orderkey, ord, CAST(page AS INTEGER) AS page, CAST(from_part AS INTEGER) AS from_part, CAST(to_part AS INTEGER) AS to_part, width, high AS overflow FROM placed")
def paginate_repair(spark, sf_dir):
    placed = repair.paginate_repaired(units(spark, sf_dir), ["book"], ["l_orderkey", "ord"], ROOM, GAP)
    return placed.select("book", "l_orderkey", "ord", "page", "from_part", "to_part", "width", "overflow")


@register(
    "repair_report",
    f"""WITH RECURSIVE {MENDED}, cuts AS (SELECT book, l_orderkey, ord, type, count(*) - 1 AS n, count(width) AS wide, max(page) AS page FROM placed GROUP BY ALL),
       high AS (SELECT book, count(DISTINCT page) AS n FROM placed WHERE high IS NOT NULL GROUP BY book)
       SELECT c.book, max(page) + 1 AS pages, sum(c.n) AS split_items, sum(wide) AS resized_figures, coalesce(max(high.n), 0) AS oversize_items,
              coalesce((SELECT string_agg(type || ':' || n, ',' ORDER BY type) FROM (SELECT type, sum(n) AS n FROM cuts d WHERE d.book = c.book GROUP BY type) WHERE n > 0), '') AS splits
       FROM cuts c LEFT JOIN high USING (book) GROUP BY c.book""",
)
def repair_report(spark, sf_dir):
    placed = repair.paginate_repaired(units(spark, sf_dir), ["book"], ["l_orderkey", "ord"], ROOM, GAP)
    out = repair.repair_report(placed, ["book"], ["l_orderkey", "ord"])
    splits = F.array_join(F.transform("splits_by_type", lambda s: F.concat(s["type"], F.lit(":"), s["cuts"].cast("string"))), ",")
    return out.withColumn("splits", splits).drop("splits_by_type")


@register(
    "nested_list_html",
    f"""WITH RECURSIVE {ITEMS}, e AS (SELECT l_orderkey, ord, l_linenumber % 4 - min(l_linenumber % 4) OVER (PARTITION BY l_orderkey) AS l, 'p' || l_partkey AS t, count(*) OVER (PARTITION BY l_orderkey) AS n FROM items),
       w AS (SELECT l_orderkey, CAST(0 AS BIGINT) AS ord, CAST([] AS BIGINT[]) AS stack, '<ul class="callout-list">' AS html, n FROM e WHERE ord = 1
         UNION ALL SELECT w.l_orderkey, e.ord, list_concat(list_filter(w.stack, lambda s: s < e.l), [CAST(e.l AS BIGINT)]),
           w.html || repeat('</li></ul>', len(list_filter(w.stack, lambda s: s > e.l))) || CASE WHEN list_contains(w.stack, e.l) THEN '</li>' WHEN e.l > 0 THEN '<ul class="callout-list">' ELSE '' END || '<li>' || e.t, w.n
         FROM w JOIN e ON e.l_orderkey = w.l_orderkey AND e.ord = w.ord + 1)
       SELECT l_orderkey, html || repeat('</li></ul>', len(list_filter(stack, lambda s: s > 0))) || CASE WHEN list_contains(stack, 0) THEN '</li>' ELSE '' END || '</ul>' AS html FROM w WHERE ord = n""",
)
def nested_list_html(spark, sf_dir):
    rows = items(spark, sf_dir).select("l_orderkey", "ord", (F.col("l_linenumber") % 4).alias("level"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"))
    return reports.nested_list_html(rows, ["l_orderkey"], "ord", "level", "text")


BOX_PARENT = "CASE WHEN l_linenumber % 3 = 0 OR ord = 1 THEN NULL ELSE ord - 1 - (l_partkey % greatest(ord - 1, 1)) END"


@register(
    "visual_extent",
    f"""WITH RECURSIVE {ITEMS}, b AS (SELECT l_orderkey, ord, {BOX_PARENT} AS parent, l_quantity AS top, CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE l_quantity * 3 END AS height, CASE WHEN l_partkey % 7 = 0 THEN 0.0 ELSE 100.0 END AS width,
           CAST(l_linenumber AS DOUBLE) AS margin, CASE WHEN l_returnflag = 'R' THEN 'left' ELSE 'none' END AS float, l_tax * 5000 AS flow FROM items),
       a AS (SELECT l_orderkey, ord, top AS down FROM b WHERE parent IS NULL UNION ALL SELECT b.l_orderkey, b.ord, b.top + a.down FROM a JOIN b ON b.l_orderkey = a.l_orderkey AND b.parent = a.ord),
       c AS (SELECT l_orderkey, ord, float, down + height + margin AS bottom FROM a JOIN b USING (l_orderkey, ord) WHERE width <> 0 OR height <> 0),
       d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY bottom DESC, ord) = 1),
       p AS (SELECT l_orderkey, greatest(max(flow), coalesce(max(bottom), max(flow))) AS used, max(d.ord) AS culprit, max(bottom) AS culprit_bottom, max(d.float) AS f FROM b LEFT JOIN d USING (l_orderkey) GROUP BY l_orderkey)
       SELECT l_orderkey, used, 300.0 AS available, greatest(0.0, used - 300) AS overflow, used - 300 <= 1 AS fits, CASE WHEN f <> 'none' THEN 'float-bottom' ELSE 'document-flow' END AS overflow_kind, culprit, culprit_bottom FROM p""",
)
def visual_extent(spark, sf_dir):
    """Line items as boxes of their order's page: each third and the first lie on the page, the others in an earlier box."""
    empty = F.col("l_partkey") % 7 == 0
    boxes = items(spark, sf_dir).select(
        "l_orderkey", F.col("ord").alias("box"), F.expr(BOX_PARENT).alias("parent"), F.col("l_quantity").alias("top"), F.when(empty, 0.0).otherwise(F.col("l_quantity") * 3).alias("height"),
        F.when(empty, 0.0).otherwise(100.0).alias("width"), F.col("l_linenumber").cast("double").alias("margin"), F.when(F.col("l_returnflag") == "R", "left").otherwise("none").alias("float"), (F.col("l_tax") * 5000).alias("flow_height"),
    )
    return extent.visual_extent(extent.absolute_tops(boxes, ["l_orderkey"]), ["l_orderkey"], "box", 300.0)


#: The user's event log as commands: errors undo, signups redo, one view in eleven clears.
LOG_KIND = "CASE WHEN event_type = 'error' THEN 'undo' WHEN event_type = 'signup' THEN 'redo' WHEN event_type = 'view' AND event_id % 11 = 0 THEN 'clear' ELSE 'command' END"
REACH = 10
REPLAY = f"""log AS (SELECT user_id, event_id, {LOG_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  r AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS reaches, CAST([] AS BIGINT[]) AS done, CAST([] AS BIGINT[]) AS undone FROM log WHERE n = 1
    UNION ALL SELECT r.user_id, log.n, log.event_id, log.kind, CASE log.kind WHEN 'command' THEN log.event_id WHEN 'undo' THEN r.done[-1] WHEN 'redo' THEN r.undone[-1] END,
      CASE log.kind WHEN 'command' THEN list_concat(r.done, [log.event_id])[-{REACH}:] WHEN 'undo' THEN r.done[:-2] WHEN 'redo' THEN CASE WHEN len(r.undone) > 0 THEN list_concat(r.done, [r.undone[-1]])[-{REACH}:] ELSE r.done END ELSE [] END,
      CASE log.kind WHEN 'undo' THEN CASE WHEN len(r.done) > 0 THEN list_concat(r.undone, [r.done[-1]]) ELSE r.undone END WHEN 'redo' THEN r.undone[:-2] ELSE [] END
    FROM r JOIN log ON log.user_id = r.user_id AND log.n = r.n + 1)"""


def replayed(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.expr(LOG_KIND).alias("kind"))
    return history.replayed(log, ["user_id"], ["ts", "event_id"], "kind", "event_id", REACH)


@register("undo_redo", f"WITH RECURSIVE {REPLAY} SELECT user_id, event_id, kind, reaches, CAST(len(done) AS INTEGER) AS depth, CAST(len(undone) AS INTEGER) AS ahead FROM r WHERE n > 0")
def undo_redo(spark, sf_dir):
    return replayed(spark, sf_dir).drop("ts")


@register(
    "live_commands",
    f"WITH RECURSIVE {REPLAY}, l AS (SELECT user_id, reaches AS command, arg_max(kind, n) AS last FROM r WHERE reaches IS NOT NULL GROUP BY ALL) SELECT user_id, command FROM l WHERE last <> 'undo'",
)
def live_commands(spark, sf_dir):
    return history.live_commands(replayed(spark, sf_dir), ["user_id"], ["ts", "event_id"], "kind")


@register(
    "json_path_edit",
    """WITH p AS (SELECT event_id, event_type, json_extract(props, '$.k') AS k FROM events)
       SELECT event_id, CAST(k AS BIGINT) AS got, '{"k":' || k || ',"meta":{"tags":[null,null,{"name":"' || event_type || '"}]}}' AS made, event_type AS got_back,
              '{"k":"' || event_type || '"}' AS replaced, '{}' AS removed, CAST(NULL AS VARCHAR) AS blocked, true AS equal_values, event_id % 2 = 0 AS equal_changed FROM p""",
)
def json_path_edit(spark, sf_dir):
    """Values set in every event's props: with missing parents, over a value, out of it, through a number; and props compared."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    word = F.to_json(F.struct("event_type"))
    quoted = F.regexp_extract(word, r'^\{"event_type":(.*)\}$', 1)
    rows = rows.withColumn("made", J.set_at_path(F.col("props"), ["meta", "tags", 2, "name"], quoted))
    turned = F.concat(F.lit('{ "meta": {"tags": [null, null, {"name": '), quoted, F.lit("}]}, "), F.expr("substring(props, 2)"))
    other = F.when(F.col("event_id") % 2 == 0, F.col("made")).otherwise(J.set_at_path(F.col("made"), ["meta", "tags", 0], F.lit("0")))
    return rows.select(
        "event_id", J.get_at(F.col("props"), ["k"], "bigint").alias("got"), "made", J.get_at(F.col("made"), ["meta", "tags", 2, "name"]).alias("got_back"), J.set_at_path(F.col("props"), ["k"], quoted).alias("replaced"),
        J.set_at_path(F.col("props"), ["k"], F.lit(None).cast("string")).alias("removed"), J.set_at_path(F.col("props"), ["k", "deep"], quoted).alias("blocked"), J.equal(F.col("made"), turned).alias("equal_values"), J.equal(F.col("made"), other).alias("equal_changed"),
    )


#: Queries of a preset (base), of its scene (applied) and after local edits: parameters that stay, change, go, come and are blank, by event.
QUERIES = {
    "base": {"mode": "event_type", "k": "CAST(event_id % 5 AS STRING)", "gone": "CASE WHEN event_id % 3 = 0 THEN 'x' ELSE '' END"},
    "applied": {"mode": "CASE WHEN event_id % 4 = 0 THEN 'own' ELSE event_type END", "k": "CAST(event_id % 7 AS STRING)", "gone": "CASE WHEN event_id % 6 = 0 THEN 'x' ELSE ' ' END", "new": "CASE WHEN event_id % 5 = 0 THEN 'n' END"},
    "local": {"mode": "CASE WHEN event_id % 8 < 3 THEN 'mine' ELSE event_type END", "k": "CAST(event_id % 5 AS STRING)", "gone": "CASE WHEN event_id % 3 = 0 AND event_id % 9 <> 0 THEN 'x' ELSE '' END", "new": "CASE WHEN event_id % 10 = 0 THEN 'n' WHEN event_id % 15 = 0 THEN 'm' END"},
}


def queries_of(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return rows.withColumns({n: F.create_map(*[c for k, v in q.items() for c in (F.lit(k), F.expr(v))]) for n, q in QUERIES.items()})


def _sides() -> str:
    rows = [f"SELECT event_id, '{k}' AS key, " + ", ".join(f"nullif({QUERIES[s].get(k, 'NULL')}, '') AS {s}" for s in QUERIES) + " FROM events" for k in ("gone", "k", "mode", "new")]
    return " UNION ALL ".join(rows).replace("AS STRING", "AS VARCHAR")


@register(
    "query_merge",
    f"""WITH s AS ({_sides()}), m AS (SELECT *, local IS NOT DISTINCT FROM base AS l, applied IS NOT DISTINCT FROM base AS a FROM s WHERE base IS NOT NULL OR applied IS NOT NULL OR local IS NOT NULL)
       SELECT event_id, key, CASE WHEN l THEN applied ELSE local END AS value, CASE WHEN l AND a THEN 'base' WHEN l THEN 'applied' WHEN a THEN 'local' WHEN applied IS NOT DISTINCT FROM local THEN 'both' ELSE 'conflict' END AS origin FROM m""",
)
def query_merge(spark, sf_dir):
    """Every parameter of every event's three queries, and which of them it comes from."""
    rows = queries_of(spark, sf_dir)
    return rows.select("event_id", F.inline(provenance.three_way(F.col("base"), F.col("applied"), F.col("local"))))


@register(
    "scene_insert",
    """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events),
       i AS (SELECT user_id, ord, 'e' || event_id AS id, CASE event_type WHEN 'click' THEN 'interactive_callout' WHEN 'view' THEN 'figure' ELSE 'paragraph' END AS type, CASE WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'held' END AS scene_id FROM e WHERE event_type <> 'signup'),
       s AS (SELECT user_id, 's' || event_id AS id, CASE WHEN event_id % 4 = 0 THEN 'nowhere' ELSE 'e' || lag(event_id) OVER (PARTITION BY user_id ORDER BY ord) END AS anchor, event_type, CASE WHEN event_id % 5 = 0 THEN 'before' ELSE 'after' END AS placement, event_id FROM e),
       n AS (SELECT s.*, i.ord AS held_at FROM s LEFT JOIN i ON i.user_id = s.user_id AND i.id = s.anchor WHERE s.event_type = 'signup'),
       z AS (SELECT user_id, max(ord) AS last FROM i GROUP BY 1),
       b AS (SELECT i.user_id, i.id, i.type, CASE WHEN i.type = 'interactive_callout' AND i.scene_id IS NULL THEN n.id ELSE i.scene_id END AS scene_id, CAST(i.ord AS DOUBLE) AS place, 0 AS side FROM i LEFT JOIN n ON n.user_id = i.user_id AND n.anchor = i.id AND n.placement = 'after'
         UNION ALL SELECT n.user_id, n.id, 'scene', NULL, coalesce(held_at, CASE placement WHEN 'before' THEN -1 ELSE last + 1 END), CASE placement WHEN 'before' THEN -1 ELSE 1 END FROM n JOIN z USING (user_id))
       SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY place, side, id) - 1 AS ord, id, type, scene_id FROM b""",
)
def scene_insert(spark, sf_dir):
    """A scene for every signup, next to the user's event before it; clicks are callouts, and those without a scene are linked."""
    place = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = queries_of(spark, sf_dir).withColumn("ord", F.row_number().over(place) - 1).withColumn("before", F.lag("event_id").over(place))
    kind = F.when(F.col("event_type") == "click", "interactive_callout").when(F.col("event_type") == "view", "figure").otherwise("paragraph")
    named = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    held = F.when((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0), "held")
    shown = rows.where("event_type <> 'signup'").select("user_id", F.col("ord").cast("long").alias("ord"), named("event_id", "e").alias("id"), kind.alias("type"), held.alias("scene_id"))
    anchor = F.when(F.col("event_id") % 4 == 0, "nowhere").otherwise(named("before", "e"))
    scenes = rows.where("event_type = 'signup'").select("user_id", named("event_id", "s").alias("id"), anchor.alias("anchor"), F.when(F.col("event_id") % 5 == 0, "before").otherwise("after").alias("placement"), "base", "applied")
    return provenance.insert_scenes(shown, scenes, ["user_id"], "ord").select("user_id", "ord", "id", "type", "scene_id")


#: Raw attributes of parts as styles, of line items as direct formatting, and of the document (SQL of both engines).
STYLE_RAW = {
    "asciiTheme": "CASE WHEN p_partkey % 11 = 0 THEN 'majorHAnsi' WHEN p_partkey % 13 = 0 THEN 'minorAscii' END", "ascii": "CASE WHEN p_partkey % 9 = 0 THEN p_brand END", "sz": "CASE WHEN p_partkey % 4 = 1 THEN CAST(p_size AS {t}) END",
    "color": "CASE WHEN p_partkey % 17 = 0 THEN 'auto' WHEN p_partkey % 5 = 2 THEN '12ab3f' WHEN p_partkey % 5 = 3 THEN 'red' END", "before": "CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size * 15 AS {t}) END", "line": "CASE WHEN p_partkey % 7 = 3 THEN CAST(120 * (1 + p_size % 5) AS {t}) END",
    "lineRule": "CASE WHEN p_partkey % 14 = 3 THEN 'exact' END", "jc": "CASE WHEN p_partkey % 3 = 1 THEN 'both' END",
}
DIRECT_RAW = {"hanging": "CASE WHEN l_linenumber = 2 THEN '360' END", "jc": "CASE WHEN l_returnflag = 'R' THEN 'center' WHEN l_returnflag = 'A' THEN '' END", "sz": "CASE WHEN l_linenumber = 5 THEN '27' END"}
DEFAULTS = {"fontFamily": "Calibri", "fontSizePx": "16", "lineHeight": "1.15"}


def _raw(of: dict[str, str]):
    return F.create_map(*[c for n, e in of.items() for c in (F.lit(n), F.expr(e.replace("{t}", "STRING")))])


def _px(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


def _said(of: dict[str, str], key: str) -> str:
    """SQL of (key, name, value) rows: what raw attributes come to."""
    raw = {n: f"nullif({e.replace('{t}', 'VARCHAR')}, '')" for n, e in of.items()}
    none = "CAST(NULL AS VARCHAR)"
    g = lambda n: raw.get(n, none)
    rows = {
        "fontFamily": f"coalesce({g('ascii')}, CASE WHEN contains({g('asciiTheme')}, 'major') THEN 'Georgia' WHEN contains({g('asciiTheme')}, 'minor') THEN 'Calibri' END)",
        "fontSizePx": _px(f"CAST({g('sz')} AS DOUBLE) * 2.0 / 3.0"), "textColor": f"CASE {g('color')} WHEN 'auto' THEN '#000000' WHEN '12ab3f' THEN '#12AB3F' END", "marginTopPx": _px(f"CAST({g('before')} AS DOUBLE) / 15.0"),
        "lineHeight": f"CASE WHEN coalesce({g('lineRule')}, 'auto') = 'auto' THEN {_px(f'CAST({g("line")} AS DOUBLE) / 240')} END", "lineHeightPx": f"CASE WHEN {g('lineRule')} = 'exact' THEN {_px(f'CAST({g("line")} AS DOUBLE) / 15.0')} END",
        "textIndentPx": _px(f"-(CAST({g('hanging')} AS DOUBLE) / 15.0)"), "align": g("jc"),
    }
    table_ = "part" if "p_" in key else "items"
    return " UNION ALL ".join(f"SELECT {key}, '{n}' AS name, {v} AS value FROM {table_}" for n, v in rows.items())


CASCADE = f"""{ITEMS}, own AS (SELECT * FROM ({_said(STYLE_RAW, "p_partkey AS style")}) WHERE value IS NOT NULL),
  chain AS (SELECT p_partkey AS style, p_partkey AS up, 0 AS depth FROM part UNION ALL SELECT style, up // 2, depth + 1 FROM chain WHERE up > 0 AND up // 2 <> up),
  best AS (SELECT c.style, o.name, arg_min(o.value, c.depth) AS value, 'style:' || arg_min(c.up, c.depth) AS layer FROM chain c JOIN own o ON o.style = c.up GROUP BY ALL),
  direct AS (SELECT * FROM ({_said(DIRECT_RAW, "l_orderkey, ord")}) WHERE value IS NOT NULL),
  every AS (SELECT l_orderkey, ord, name, value, 'direct' AS layer, 0 AS rank FROM direct
    UNION ALL SELECT l_orderkey, ord, name, value, layer, 1 FROM items JOIN best ON style = l_partkey
    UNION ALL SELECT l_orderkey, ord, name, value, 'default', 2 FROM items, (VALUES {", ".join(f"('{k}', '{v}')" for k, v in DEFAULTS.items())}) d(name, value)),
  won AS (SELECT l_orderkey, ord, name, arg_min(value, rank) AS value, arg_min(layer, rank) AS layer FROM every GROUP BY ALL)"""


def formatted(spark, sf_dir):
    """Line items as paragraphs with parts as their styles, each part based on the one of half its number."""
    themes = F.create_map(F.lit("major"), F.lit("Georgia"))
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    styles = part.select(k.cast("string").alias("style_id"), F.floor(k / 2).cast("string").alias("based_on"), cascade.visual(_raw(STYLE_RAW), themes).alias("props"))
    rows = items(spark, sf_dir).select("l_orderkey", "ord", F.col("l_partkey").cast("string").alias("style_id"), cascade.visual(_raw(DIRECT_RAW), themes).alias("direct"))
    return cascade.cascade(rows, styles, DEFAULTS)


@register("style_cascade", f"WITH RECURSIVE {CASCADE} SELECT * FROM won")
def style_cascade(spark, sf_dir):
    """Every property of every paragraph, its value and the layer that won."""
    # The outer form: for the inner one Spark filters by the size of the map, and so resolves every paragraph twice.
    return formatted(spark, sf_dir).select("l_orderkey", "ord", F.explode_outer("resolved").alias("name", "_v")).where("name IS NOT NULL").select("l_orderkey", "ord", "name", "_v.value", "_v.layer")


@register(
    "style_css",
    f"""WITH RECURSIVE {CASCADE}, w AS (SELECT l_orderkey, ord, map_from_entries(list({{'k': name, 'v': value}})) AS m FROM won GROUP BY ALL)
       SELECT l_orderkey, ord, concat_ws(';', 'text-align:' || CASE m['align'] WHEN 'both' THEN 'justify' WHEN 'center' THEN 'center' ELSE 'left' END, CASE WHEN m['align'] = 'both' THEN 'text-justify:inter-word' END,
         'hyphens:auto', '-webkit-hyphens:auto', 'overflow-wrap:break-word', 'word-break:normal', 'color:' || coalesce(m['textColor'], '#000000'), 'font-family:"' || m['fontFamily'] || '"', CASE WHEN m['fontSizePx'] <> '0' THEN 'font-size:' || m['fontSizePx'] || 'px' END,
         'line-height:' || m['lineHeight'], 'margin-top:' || m['marginTopPx'] || 'px', 'text-indent:' || m['textIndentPx'] || 'px') AS css FROM w""",
)
def style_css(spark, sf_dir):
    # A column of their own, or each of the rules of CSS would resolve the paragraph again.
    rows = formatted(spark, sf_dir).select("l_orderkey", "ord", cascade.values(F.col("resolved")).alias("_values"))
    return rows.select("l_orderkey", "ord", cascade.css(F.col("_values")).alias("css"))


#: Orders whose first line item is flagged hold the contents of their customer's book.
IN_CONTENTS = "(SELECT count(*) FROM lineitem c WHERE c.l_orderkey = o_orderkey AND c.l_returnflag = 'A' AND c.l_linenumber = 1) > 0"


@register(
    "reflow_book",
    f"""WITH RECURSIVE {_mended(f"({VOLUME}) * 2 + CASE WHEN {IN_CONTENTS} THEN 0 ELSE 1 END")}, s AS (SELECT book // 2 AS book, book % 2 AS body, * EXCLUDE (book) FROM placed), a AS (SELECT book, max(page) + 1 AS ahead FROM s WHERE body = 0 GROUP BY 1)
       SELECT book, l_orderkey, ord, CASE body WHEN 0 THEN 'contents-flow' ELSE 'document-flow' END AS section, CAST(page + CASE body WHEN 1 THEN coalesce(ahead, 0) ELSE 0 END AS INTEGER) AS new_page, CAST(from_part AS INTEGER) AS from_part, CAST(to_part AS INTEGER) AS to_part FROM s LEFT JOIN a USING (book)""",
)
def reflow_book(spark, sf_dir):
    """Customers' books reflowed: orders with a flagged first line item are contents."""
    rows = units(spark, sf_dir, ((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1)).alias("toc"))
    return reflow.reflow(rows, ["book"], "l_orderkey", "ord", F.col("toc"), ROOM, GAP).select("book", "l_orderkey", "ord", "section", "new_page", "from_part", "to_part")


@register(
    "listed_books",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' AS root, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
       h AS (SELECT page_id, root, unnest(range(len(hrefs))) AS ord, unnest(hrefs) || '/' AS href FROM p)
       SELECT page_id, CAST(ord AS INTEGER) AS ord, url_decode(replace(regexp_extract(f, '([^/]*)/$', 1), '+', '%2B')) AS name, f AS folder_url, f || 'book.json' AS book_url
       FROM (SELECT *, regexp_replace(CASE WHEN starts_with(href, '/') THEN left(root, len(root) - 1) || href WHEN href ~ '^[a-z]+:.*' THEN href ELSE root || href END, '[?#].*$', '') AS f FROM h WHERE href <> '/' AND NOT starts_with(href, '?') AND NOT starts_with(href, '#') AND NOT contains(href, '..'))
       WHERE starts_with(f, root) AND ends_with(f, '/')""",
)
def listed_books(spark, sf_dir):
    """The web pages read as listings of their site's root: every link with a slash behind it is a folder."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.lit("/")).alias("url"), F.regexp_replace("html", '<a href="([^"]*)"', '<a href="$1/"').alias("html"))
    return listing.listed_books(pages, ["page_id"])


@register(
    "import_evidence",
    f"""WITH {LINES}, e AS (SELECT doc_id, source AS file, min(ord) AS first, max(ord) AS last FROM lines GROUP BY ALL), i AS (SELECT 'i' || doc_id AS insertion_id, upper(source) AS source_file, 0 AS first, length(text) - length(replace(text, chr(10), '')) AS last FROM documents WHERE doc_id % 3 = 0),
       m AS (SELECT e.doc_id, min(insertion_id) AS insertion_id FROM e JOIN i ON lower(i.source_file) = lower(e.file) AND i.first = e.first AND i.last = e.last GROUP BY 1),
       k AS (SELECT line FROM lines GROUP BY line HAVING count(DISTINCT doc_id) > 1), h AS (SELECT doc_id, count(*) AS n, count(k.line) AS hits FROM lines LEFT JOIN k USING (line) GROUP BY doc_id)
       SELECT doc_id, CASE WHEN insertion_id IS NOT NULL THEN 'manifest' ELSE 'sourceRef' END AS kind, insertion_id, hits, n FROM h LEFT JOIN m USING (doc_id) WHERE insertion_id IS NOT NULL OR hits >= greatest(2, ceil(n * 0.7))""",
)
def import_evidence(spark, sf_dir):
    """Documents as imports of their lines: every third was inserted before under its source's name; lines of two documents are known."""
    rows = doc_lines(spark, sf_dir).select("doc_id", "ord", F.col("ord").cast("string").alias("key"), F.col("source").alias("file"), "line")
    docs = table(spark, sf_dir, "documents").where("doc_id % 3 = 0")
    last = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    done = docs.select(F.concat(F.lit("i"), F.col("doc_id").cast("string")).alias("insertion_id"), F.upper("source").alias("source_file"), F.lit("0").alias("start_key"), last.cast("string").alias("end_key"))
    known = rows.groupBy("line").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("line")
    return insertion.import_evidence(rows, done, known, ["doc_id"], "ord", "key", "file", ["line"])


@register(
    "list_formats",
    f"""WITH {ITEMS}, l AS (SELECT n_nationkey AS abstract_id, v AS level, CASE (n_nationkey + v) % 3 WHEN 0 THEN 'lowerLetter' WHEN 1 THEN 'bullet' ELSE 'decimal' END AS num_fmt, 1 + (n_nationkey + v) % 4 AS start FROM nation, range(2) r(v)),
       o AS (SELECT s_suppkey AS num_id, 0 AS level, 10 + s_suppkey % 7 AS start FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT s_suppkey, 2, 5 FROM supplier WHERE s_suppkey % 9 = 0),
       p AS (SELECT l_orderkey, ord, CASE WHEN l_returnflag <> 'N' THEN l_suppkey END AS num_id, l_linenumber % 3 AS level FROM items)
       SELECT l_orderkey, ord, p.num_id, p.level, CASE WHEN p.num_id IS NOT NULL THEN coalesce(l.num_fmt, 'decimal') END AS num_fmt, CASE WHEN p.num_id IS NOT NULL THEN coalesce(o.start, l.start, 1) END AS start
       FROM p LEFT JOIN supplier ON s_suppkey = p.num_id AND s_suppkey % 5 <> 0 LEFT JOIN l ON l.abstract_id = s_nationkey AND l.level = p.level LEFT JOIN o ON o.num_id = p.num_id AND o.level = p.level""",
)
def list_formats(spark, sf_dir):
    """Line items as list paragraphs: suppliers are numbering instances, every fifth without a definition; nations define two of three levels."""
    nation, supplier, k = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"), F.col("n_nationkey") + F.col("level")
    levels = nation.select("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("level"))
    levels = levels.select(F.col("n_nationkey").cast("long").alias("abstract_id"), "level", F.when(k % 3 == 0, "lowerLetter").when(k % 3 == 1, "bullet").otherwise("decimal").alias("num_fmt"), (1 + k % 4).cast("long").alias("start"))
    nums = supplier.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("num_id"), F.col("s_nationkey").cast("long").alias("abstract_id"))
    first = supplier.where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("num_id"), F.lit(0).alias("level"), (10 + F.col("s_suppkey") % 7).alias("start"))
    third = supplier.where("s_suppkey % 9 = 0").select(F.col("s_suppkey").alias("num_id"), F.lit(2).alias("level"), F.lit(5).cast("long").alias("start"))
    rows = items(spark, sf_dir).select("l_orderkey", "ord", F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")).alias("num_id"), (F.col("l_linenumber") % 3).alias("level"))
    return ordered.list_formats(rows, nums, levels, first.unionByName(third))
