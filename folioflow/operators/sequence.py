"""Visibility by mode, print expansion of step sequences, continuation order, preset discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def visible_in_mode(mode: str, print_only: Column, screen_only: Column, flag: Column) -> Column:
    """printOnly shows in print alone, screenOnly on screen alone, else the mode's own flag, which defaults to true."""
    p, s = F.coalesce(print_only, F.lit(False)), F.coalesce(screen_only, F.lit(False))
    return F.when(p, F.lit(mode == "print")).when(s, F.lit(mode == "screen")).otherwise(F.coalesce(flag, F.lit(True)))


#: Rows that a task joins at most, when keys are even.
PART_ROWS = 2_000_000


def filter_for_print(pages: DataFrame, items: DataFrame, on: list[str], page_shown: Column, item_shown: Column, keep_empty: bool = False, rows: int = 0) -> tuple[DataFrame, DataFrame]:
    """(pages, items) of the print edition: hidden pages and items go, then pages without items unless keep_empty.

    `rows`, the number of pages and items if it is known, sets the number of tasks. Keys in a row compress so well that Spark,
    which counts compressed bytes, would put many millions of them into one task or broadcast them.
    """
    n = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART_ROWS))
    shown_pages = pages.where(page_shown)
    # A join takes the partitions of its right side, and those of a repartition by number are not put together.
    shown = items.where(item_shown).join(shown_pages.select(*on).repartition(n, *on).hint("merge"), on, "left_semi")
    return (shown_pages if keep_empty else shown_pages.join(shown.select(*on).hint("merge"), on, "left_semi")), shown


def materialized(entries: DataFrame, mode: str, flags: tuple[str, ...] = ("visibility", "printOnly", "screenOnly")) -> DataFrame:
    """Entries of a print edition without their visibility flags, which have done their work; those of other modes as they are."""
    return entries.drop(*flags) if mode == "print" else entries


def located(rows: DataFrame, refs: DataFrame, keys: list[str], order: str, id_: str, ref: str) -> DataFrame:
    """Each reference with the ordinal it means: digits are an ordinal from 0, anything else the id of the first row that bears it.

    Adds found (null where there is none) and error, which then says so.
    """
    first = rows.groupBy(*keys, id_).agg(F.min(order).alias("_by_id"))
    size = rows.groupBy(*keys).agg(F.max(order).alias("_last"))
    number = F.when(F.col(ref).rlike("^[0-9]+$"), F.col(ref).try_cast("bigint"))
    met = refs.withColumn("_n", number).withColumn("_id", F.when(number.isNull(), F.col(ref)))
    met = met.join(first.withColumnRenamed(id_, "_id"), [*keys, "_id"], "left").join(size, keys, "left")
    found = F.when(F.col("_n").isNotNull(), F.when(F.col("_n") <= F.col("_last"), F.col("_n"))).otherwise(F.col("_by_id"))
    return met.select(*refs.columns, found.alias("found"), F.when(found.isNull(), F.concat(F.lit("nothing found for "), F.coalesce(ref, F.lit("null")))).alias("error"))


def mode_counts(pages: DataFrame, items: DataFrame, page_shown: Column, item_shown: Column) -> DataFrame:
    """One row: how many pages and items are shown and hidden."""
    p = pages.agg(F.count_if(page_shown).alias("pages_shown"), F.count_if(~page_shown).alias("pages_hidden"))
    i = items.agg(F.count_if(item_shown).alias("items_shown"), F.count_if(~item_shown).alias("items_hidden"))
    return p.join(i)  # two single rows


def expand_print(items: DataFrame, book: list[str], page: str, order: str, id_: str = "id", scene_ref: str = "scene_id", steps: str = "steps", opt_out: Column | None = None) -> DataFrame:
    """Print expansion: a callout with steps and a known scene becomes a (callout, scene) pair for each step, in place.

    The callout goes, and so does its scene if that is on the same page and either
    stands directly before the callout or comes after it; an earlier scene that is
    not adjacent stays. Of scenes with one id the last in the book counts.
    Adds step_ord (null for rows that stay) and part (0 callout, 1 scene); `order` is renumbered from 0. The items are read once and
    moved twice, by the names that connect them and by page; a task holds the rows of one name at a time.
    """
    # Every row stands under its id, and a callout once more under the scene it names: one window over both finds the scenes.
    wants = F.coalesce(F.size(steps) > 0, F.lit(False)) & (~opt_out if opt_out is not None else F.lit(True)) & F.col(scene_ref).isNotNull()
    whole = F.struct(*[F.col(c) for c in items.columns]).alias("_row")
    place = [F.col(page).alias("_page"), F.col(order).alias("_order")]
    under = F.filter(F.array(F.struct(F.lit(False).alias("call"), F.col(id_).cast("string").alias("key")), F.when(wants, F.struct(F.lit(True).alias("call"), F.col(scene_ref).cast("string").alias("key")))), lambda u: u.isNotNull())
    both = items.select(*book, *place, whole, F.explode(under).alias("_u")).select(*book, "_page", "_order", "_row", F.col("_u.call").alias("_call"), F.col("_u.key").alias("_key"))
    named, here = W.partitionBy(*book, "_key"), W.partitionBy(*book, "_key", "_page")
    own = F.struct("_page", "_order")
    scene = F.max_by(F.when(~F.col("_call"), F.col("_row")), F.when(~F.col("_call"), own)).over(named)
    last = F.max(F.when(~F.col("_call"), own)).over(named)
    first_call = F.min(F.when(F.col("_call"), F.col("_order"))).over(here)
    met = both.withColumns({"_scene": scene, "_last": last, "_first": first_call})
    found = F.col("_call") & F.col("_scene").isNotNull() & F.col("_key").isNotNull()
    taken = ~F.col("_call") & F.col("_key").isNotNull() & (F.col("_last") == own) & F.coalesce(F.col("_first") <= F.col("_order") + 1, F.lit(False))
    met = met.select(*book, "_page", "_order", "_row", "_call", F.when(found, F.col("_scene")).alias("_scene"), (found | taken).alias("_gone"))
    # The rest is done page by page, which is also how the rows are numbered.
    gone = F.max("_gone").over(W.partitionBy(*book, "_page", "_order"))
    met = met.repartition(*book, "_page").withColumn("_any", gone).where((~F.col("_call") & ~F.col("_any")) | (F.col("_call") & F.col("_scene").isNotNull()))
    stays = F.array(F.struct(F.col("_row"), F.lit(None).cast("int").alias("step_ord"), F.lit(0).alias("part")))
    pair = lambda k: F.array(F.struct(F.col("_row"), k.cast("int").alias("step_ord"), F.lit(0).alias("part")), F.struct(F.col("_scene").alias("_row"), k.cast("int").alias("step_ord"), F.lit(1).alias("part")))
    pairs = F.flatten(F.transform(F.col(f"_row.{steps}"), lambda _, k: pair(k)))
    each = met.select(*book, "_page", "_order", F.explode(F.when(F.col("_call"), pairs).otherwise(stays)).alias("_e"))
    w = W.partitionBy(*book, "_page").orderBy("_order", "_e.step_ord", "_e.part")
    kept = {page: F.col("_page"), order: (F.row_number().over(w) - 1).cast(items.schema[order].dataType)}
    return each.select(*[F.col(c) if c in book else kept.get(c, F.col(f"_e._row.{c}")).alias(c) for c in items.columns], F.col("_e.step_ord").alias("step_ord"), F.col("_e.part").alias("part"))


def screen_flags(pages: DataFrame, book: list[str], order: str, has_steps: Column) -> DataFrame:
    """expanded: true from the first page with steps on, since the change flag is never cleared."""
    w = W.partitionBy(*book).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return pages.withColumn("expanded", F.max(has_steps).over(w))


def continuation_order(pages: DataFrame, book: list[str], order: str, id_: str = "id", print_only: str = "print_only") -> DataFrame:
    """new_ord: print-only pages named base-rN follow their base by N; one without a base stays where it is."""
    base, part = F.regexp_extract(id_, r"^(.*)-r(\d+)$", 1), F.regexp_extract(id_, r"^(.*)-r(\d+)$", 2).try_cast("int")
    rows = pages.withColumn("_base", F.when(F.col(print_only) & (base != ""), base)).withColumn("_part", part)
    bases = pages.groupBy(*book, F.col(id_).alias("_base")).agg(F.min(order).alias("_at"))
    placed = rows.join(bases, [*book, "_base"], "left")
    at = F.coalesce("_at", order)
    part_of = F.when(F.col("_at").isNotNull(), F.col("_part")).otherwise(0)
    w = W.partitionBy(*book).orderBy("_k1", "_k2", order)
    return placed.withColumn("_k1", at).withColumn("_k2", part_of).withColumn("new_ord", F.row_number().over(w) - 1).drop("_base", "_part", "_at", "_k1", "_k2")
