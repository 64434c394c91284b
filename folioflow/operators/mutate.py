"""Versioned mutations of ordered tables: each returns a new version; ordinals are renumbered from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def renumber(rows: DataFrame, keys: list[str], place: list[Column], order: str) -> DataFrame:
    kind = rows.schema[order].dataType
    return rows.withColumn(order, (F.row_number().over(W.partitionBy(*keys).orderBy(*place)) - 1).cast(kind))


def insert_after(rows: DataFrame, new: DataFrame, keys: list[str], order: str, at: int) -> DataFrame:
    """new's rows, in their own order, behind ordinal `at` of every key (-1: at the front)."""
    both = rows.withColumn("_a", F.col(order)).withColumn("_b", F.lit(-1)).unionByName(new.withColumn("_a", F.lit(at)).withColumn("_b", F.col(order)))
    return renumber(both, keys, [F.col("_a"), F.col("_b")], order).drop("_a", "_b")


def delete_rows(rows: DataFrame, keys: list[str], order: str, where: Column) -> DataFrame:
    return renumber(rows.where(~F.coalesce(where, F.lit(False))), keys, [F.col(order)], order)


def clone_row(rows: DataFrame, keys: list[str], order: str, where: Column, id_: str) -> DataFrame:
    """A copy behind each matching row; its id gets the suffix -copy."""
    copies = rows.where(where).withColumn(id_, F.concat(F.col(id_), F.lit("-copy")))
    both = rows.withColumn("_b", F.lit(0)).unionByName(copies.withColumn("_b", F.lit(1)))
    return renumber(both, keys, [F.col(order), F.col("_b")], order).drop("_b")


def move_row(rows: DataFrame, keys: list[str], order: str, where: Column, by: int) -> DataFrame:
    """Moves the matching row by one or more places, clamped to the ends."""
    n = F.count("*").over(W.partitionBy(*keys))
    target = F.least(F.greatest(F.col(order) + by, F.lit(0)), n - 1)
    half = F.lit(0.5 if by > 0 else -0.5)
    return renumber(rows.withColumn("_k", F.when(where, target + half).otherwise(F.col(order).cast("double"))), keys, [F.col("_k"), F.col(order)], order).drop("_k")


def move_to_page(items: DataFrame, book: list[str], page: str, order: str, where: Column, to: int) -> DataFrame:
    """Moves matching items to the end of page `to`."""
    moved = items.withColumn("_m", F.coalesce(where, F.lit(False))).withColumn(page, F.when(F.col("_m"), F.lit(to)).otherwise(F.col(page)))
    return renumber(moved, [*book, page], [F.col("_m"), F.col(order)], order).drop("_m")


def merge_pages(items: DataFrame, book: list[str], page: str, order: str, at: int) -> DataFrame:
    """Appends page at+1 to page `at`; later pages move up."""
    old = F.col(page)
    merged = items.withColumn("_p", old).withColumn(page, F.when(old > at, old - 1).otherwise(old))
    return renumber(merged, [*book, page], [F.col("_p"), F.col(order)], order).drop("_p")


def split_page(items: DataFrame, book: list[str], page: str, order: str, at: int, item: int) -> DataFrame:
    """Items from ordinal `item` of page `at` on form a new page behind it."""
    old = F.col(page)
    later = (old > at) | ((old == at) & (F.col(order) >= item))
    return renumber(items.withColumn(page, F.when(later, old + 1).otherwise(old)), [*book, page], [F.col(order)], order)


def rename_id(items: DataFrame, old: str, new: str, id_: str = "id", targets: tuple[str, ...] = ("target",)) -> DataFrame:
    """Renames an id and every reference column that names it."""
    for c in (id_, *targets):
        items = items.withColumn(c, F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)))
    return items


def change_type(items: DataFrame, where: Column, type_: str, payload: str = "payload", kept: str = "kept") -> DataFrame:
    """Changes an item's type and keeps its payload by type in a map, from which switching back restores it."""
    stored = F.map_from_entries(F.concat(F.filter(F.map_entries(kept), lambda e: e["key"] != F.col("type")), F.array(F.struct(F.col("type").alias("key"), F.col(payload).alias("value")))))
    restored = F.try_element_at(F.col(kept), F.lit(type_))
    changed = F.coalesce(where, F.lit(False)) & (F.col("type") != type_)
    rows = items.withColumn("_c", changed).withColumn("_k", F.when(changed, stored).otherwise(F.col(kept))).withColumn("_p", F.when(changed, restored).otherwise(F.col(payload)))
    return rows.withColumn("type", F.when(F.col("_c"), F.lit(type_)).otherwise(F.col("type"))).withColumn(kept, F.col("_k")).withColumn(payload, F.col("_p")).drop("_c", "_k", "_p")


def resize_grid(cells: Column, rows: int, columns: int) -> Column:
    """array<array<string>> of the wanted size (at most 30 x 12), padded with ''."""
    r, c = max(1, min(30, rows)), max(1, min(12, columns))
    cell = lambda i, j: F.coalesce(F.get(F.get(cells, i), j), F.lit(""))
    return F.transform(F.sequence(F.lit(0), F.lit(r - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(c - 1)), lambda j: cell(i, j)))


def execute(table: DataFrame, mutation: Callable[[DataFrame], DataFrame], validate: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """The mutated table if validation finds no error, else the table as it was; and whether it changed."""
    new = mutation(table)
    if validate(new).where("severity = 'error'").limit(1).count():
        return table, False
    return new, True


def migrate_v1(items: DataFrame, id_: str = "id") -> DataFrame:
    """Legacy field names to current ones: singleSrc, frameWidth, showInNav, navLabel; `migrated` counts what a row had of them."""
    names = {"singleSrc": "src", "frameWidth": "width_px", "showInNav": "nav_show", "navLabel": "nav_label"}
    have = {old: new for old, new in names.items() if old in items.columns}
    out = items.withColumn("migrated", sum((F.col(c).isNotNull().cast("int") for c in have), F.lit(0)))
    for old, new in have.items():
        out = out.withColumn(new, F.coalesce(F.col(new), F.col(old)) if new in items.columns else F.col(old)).drop(old)
    return out
