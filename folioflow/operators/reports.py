"""Reports on what was read or chosen: range summaries, unions of names, and books made of chosen entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def range_summary(entries: DataFrame, keys: list[str], order: str, page: str, heading: Column, figure: Column) -> DataFrame:
    """(keys, blocks, headings, figures, first_page, last_page) of the chosen entries: pages are those of the first and the last entry."""
    ends = (F.min_by(page, order).alias("first_page"), F.max_by(page, order).alias("last_page"))
    return entries.groupBy(*keys).agg(F.count("*").alias("blocks"), F.count_if(heading).alias("headings"), F.count_if(figure).alias("figures"), *ends)


def name_union(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, names): the sorted distinct names that are not blank; groups without any have an empty list."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.trim(name) != "", F.col(name)))).alias("names"))


def book_of_entries(entries: DataFrame, keys: list[str], order: str, level: str, title: str, depth: int = 3, with_toc: bool = True) -> DataFrame:
    """Pages of a book made of chosen entries: (keys, page_ord, section, ord, kind, title, level).

    The flow page holds all entries in order, numbered from 0. With a contents
    page, that comes first: a part title, then the headings up to `depth`. A
    heading is an entry with a level; keys without entries make no book.
    """
    place = lambda t: F.row_number().over(W.partitionBy(*keys).orderBy(order)) - (0 if t else 1)
    own = lambda page, section, ord_, kind: [F.lit(page).alias("page_ord"), F.lit(section).alias("section"), ord_.alias("ord"), kind.alias("kind")]
    is_heading = F.col(level).isNotNull()
    flow_kind = F.when(is_heading, "section_heading").otherwise("paragraph")
    flow = entries.select(*keys, *own(1 if with_toc else 0, "document-flow", place(False), flow_kind), title, level)
    if not with_toc:
        return flow
    heads = entries.where(is_heading & (F.col(level) <= depth))
    lines = heads.select(*keys, *own(0, "toc", place(True), F.lit("paragraph")), title, level)
    first = entries.select(*keys).distinct().select(*keys, *own(0, "toc", F.lit(0), F.lit("part_title")), F.lit("Περιεχόμενα").alias(title), F.lit(None).cast("int").alias(level))
    return first.unionByName(lines).unionByName(flow)


def nested_parents(rows: DataFrame, keys: list[str], order: str, level: str) -> DataFrame:
    """Adds parent: the ordinal of the nearest row before with a smaller level, null for the outermost; levels, from 0, may skip.

    One running maximum for each level that occurs, whose latest is taken; lists are a few levels deep.
    """
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    deepest = rows.agg(F.max(level)).first()[0] or 0
    last = [F.max(F.when(F.col(level) == depth, F.col(order))).over(before) for depth in range(int(deepest))]
    parent = F.lit(None).cast("long")
    for depth, at in enumerate(last):
        parent = F.when((F.col(level) > depth) & at.isNotNull(), F.greatest(parent, at)).otherwise(parent)
    return rows.withColumn("parent", parent)


def nested_list_html(rows: DataFrame, keys: list[str], order: str, level: str, text: str, css: str = "callout-list") -> DataFrame:
    """(keys, html) of lists whose rows have levels: an ul for each level that occurs, nested in the item above it.

    Levels may skip: one that lies several deeper opens one list, and one that comes back to a level between opens a list
    beside it. The least level of a list is its outermost; a list that begins deeper begins with a list in the list. text is HTML already; null
    text is empty, null levels are 0. Tags come from windows over the rows: which levels an earlier row has open is the running
    maximum of its places, so nothing is walked. A list, as the HTML that is made of it, is one row.
    """
    place, own = W.partitionBy(*keys).orderBy(order), W.partitionBy(*keys)
    raw = F.coalesce(F.col(level), F.lit(0)).cast("int")
    rows = rows.select(*keys, order, (raw - F.min(raw).over(own)).alias("_l"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = rows.withColumn("_next", F.lead("_l").over(place)).withColumn("_first", F.row_number().over(place) == 1)
    deepest = int(rows.agg(F.max("_l")).first()[0] or 0)
    # A level has an open item when its last row stands behind the last row of every smaller level.
    so_far, before = place.rowsBetween(W.unboundedPreceding, 0), place.rowsBetween(W.unboundedPreceding, -1)

    def open_items(frame) -> list[Column]:
        at = [F.max(F.when(F.col("_l") == d, F.col(order))).over(frame) for d in range(deepest + 1)]
        lower = [F.greatest(*[F.coalesce(x, F.lit(-1)) for x in at[:d]], F.lit(-1)) if d else F.lit(-1) for d in range(deepest + 1)]
        return [F.coalesce(x > low, F.lit(False)) for x, low in zip(at, lower, strict=True)]

    rows = rows.withColumn("_was", F.array(*open_items(before))).withColumn("_open", F.array(*open_items(so_far)))
    begin = F.lit(f'<ul class="{css}">')
    head = F.when(F.col("_first"), begin).otherwise("")
    deeper = F.when((F.col("_l") > 0) & ~F.get("_was", F.col("_l")), begin).otherwise("")
    then = F.coalesce("_next", F.lit(0))
    closed = F.size(F.filter(F.transform("_open", lambda o, d: o & (d > then)), lambda x: x))
    item = F.when(F.get("_open", then) & (F.col("_next").isNull() | (then <= F.col("_l"))), "</li>").otherwise("")
    end = F.when(F.col("_next").isNull(), "</ul>").otherwise("")
    line = F.concat(head, deeper, F.lit("<li>"), F.col("_t"), F.when(then < F.col("_l"), F.repeat(F.lit("</li></ul>"), closed)).otherwise(""), item, end)
    lines = rows.select(*keys, order, line.alias("_h"))
    parts = F.array_sort(F.collect_list(F.struct(order, "_h")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["_h"]), "").alias("html"))


def widest_row(cells: DataFrame, table: list[str], row: list[str], span: str, out: str = "columns") -> DataFrame:
    """(table, out) of tables whose cells span columns: the columns of the widest row; a span that is missing or less is one."""
    own = F.sum(F.greatest(F.lit(1), F.coalesce(span, F.lit(1))))
    return cells.groupBy(*table, *row).agg(own.alias("_w")).groupBy(*table).agg(F.max("_w").alias(out))
