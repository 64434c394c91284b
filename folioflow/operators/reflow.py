"""Reflow: a book's pages are put together to one flow for its contents and one for its body, and paginated anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.operators.audit import source_range
from folioflow.operators.repair import paginate_repaired

CONTENTS, BODY = "contents-flow", "document-flow"


def coalesced(items: DataFrame, keys: list[str], page: str, order: str, contents: Column) -> DataFrame:
    """Adds section and place: items of pages with any item for which `contents` holds go to the contents, others to the body, both in their old order.

    A place, from 0, counts within a section. A null flag is false.
    """
    whose = W.partitionBy(*keys, page)
    marked = F.max(F.coalesce(contents, F.lit(False))).over(whose)
    rows = items.withColumn("section", F.when(marked, CONTENTS).otherwise(BODY))
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys, "section").orderBy(page, order)) - 1)


def opaque_items(items: DataFrame, keys: list[str], page: str, order: str, *html: str) -> DataFrame:
    """(keys, page, order, opaque_type) of the first item of each book whose first non-blank HTML is a table or a list: old imports, which cannot be reflowed."""
    source = F.coalesce(*[F.when(F.trim(h) != "", F.col(h)) for h in html])
    kind = F.lower(F.regexp_extract(source, r"(?i)^\s*<(table|ul|ol)\b", 1))
    found = items.withColumn("opaque_type", kind).where("opaque_type <> ''")
    return found.groupBy(*keys).agg(F.min(F.struct(page, order, "opaque_type")).alias("_o")).select(*keys, "_o.*")


def reflow(items: DataFrame, keys: list[str], page: str, order: str, contents: Column, available: float, gap: float = 0.0, **columns: str) -> DataFrame:
    """The items of coalesced() with the page each part of them is on now: new_page (from 0, contents before body), from_part, to_part, width, overflow.

    columns: names of parts, type_, heading, hard_break, pair and widths, as paginate_repaired() takes them. Both sections are folded each for itself.
    """
    flow = coalesced(items, keys, page, order, contents)
    placed = paginate_repaired(flow.withColumnRenamed(page, "_old_page"), [*keys, "section"], ["place"], available, gap, **columns).withColumnRenamed("page", "_p")
    # Pages of the contents stand first. A window, since a join with their number would fold every book again.
    out = placed.withColumn("_ahead", F.max(F.when(F.col("section") == CONTENTS, F.col("_p") + 1)).over(W.partitionBy(*keys)))
    first = F.when(F.col("section") == BODY, F.coalesce("_ahead", F.lit(0))).otherwise(0)
    return out.withColumn("new_page", (F.col("_p") + first).cast("int")).drop("_p", "_ahead").withColumnRenamed("_old_page", page)


def page_sources(placed: DataFrame, keys: list[str], source: str) -> DataFrame:
    """(keys, new_page, section, source_range): the pages of the source whose items stand on each new page."""
    return source_range(placed, [*keys, "new_page", "section"], source)
