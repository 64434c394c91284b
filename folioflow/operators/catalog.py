"""Catalog operators: faceted search, sorting, facets, counts, metadata with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import blank_to_null, natural_key

NUMERIC_KEYS = ("pages", "items", "updated")


def facet_search(entries: DataFrame, text: list[str], query: str = "", facets: dict[str, str] | None = None) -> DataFrame:
    """Rows whose joined text contains the trimmed query, ignoring case, and whose facets are equal; empty means no constraint."""
    out = entries
    q = query.strip().lower()
    if q:
        out = out.where(F.lower(F.concat_ws(" ", *text)).contains(q))
    for name, value in (facets or {}).items():
        if value:
            out = out.where(F.col(name) == value)
    return out


def sort_catalog(entries: DataFrame, key: str, descending: bool = False, title: str = "title", ordinal: str | None = None, numeric: bool | None = None) -> DataFrame:
    """Natural order by key, ties by title; descending turns both around. The ordinal, where given, keeps the input order of equals."""
    numeric = key in NUMERIC_KEYS if numeric is None else numeric
    first: Column = F.coalesce(F.col(key), F.lit(0)) if numeric else natural_key(F.coalesce(F.col(key).cast("string"), F.lit("")))
    second = natural_key(F.coalesce(F.col(title), F.lit("")))
    turn = F.desc if descending else F.asc
    return entries.orderBy(turn(first), turn(second), *([F.asc(ordinal)] if ordinal else []))


def facet_values(entries: DataFrame, name: str) -> DataFrame:
    """Distinct values of a facet without blanks, sorted."""
    return entries.select(blank_to_null(F.col(name)).alias("value")).dropna().distinct().orderBy("value")


def nested_counts(books: DataFrame) -> DataFrame:
    """Pages and items of every book row; a missing array counts 0."""
    pages = F.coalesce("pages", F.array())
    items = F.aggregate(pages, F.lit(0), lambda n, p: n + F.coalesce(F.size(p["items"]), F.lit(0)))
    return books.select("*", F.size(pages).alias("n_pages"), items.alias("n_items"))


def counts(pages: DataFrame, items: DataFrame, book: str, page: str) -> DataFrame:
    """(book, n_pages, n_items) of pages (book, page) and items (page): the counts of nested_counts() for books in rows. Nothing is gathered; books without pages do not show."""
    on_page = items.groupBy(page).agg(F.count("*").alias("_n"))
    return pages.select(book, page).distinct().join(on_page, page, "left").groupBy(book).agg(F.count("*").alias("n_pages"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_items"))


def metadata(books: DataFrame, *keys: str) -> DataFrame:
    """Title with its fallback chain and trimmed library facets; further columns that name a book may go along."""
    lib = lambda n: F.trim(F.coalesce(F.col(f"meta.library.{n}"), F.lit("")))
    title = F.coalesce(blank_to_null(F.col("meta.title")), F.col("folder"))
    tags = F.filter(F.coalesce("meta.library.tags", F.array().cast("array<string>")), lambda t: F.trim(t) != "")
    return books.select(*keys, "folder", title.alias("title"), *[lib(n).alias(n) for n in ("discipline", "level", "category", "status")], tags.alias("tags"))


def hierarchical_search(pages: DataFrame, items: DataFrame, on: list[str], page_text: list[str], item_text: list[str], query: str) -> tuple[DataFrame, DataFrame]:
    """(pages, items): a page shows if its text or that of any of its items contains the query; items show by their own text."""
    q = query.strip().lower()
    shown = items.where(F.lower(F.concat_ws(" ", *item_text)).contains(q))
    with_child = shown.select(*on).distinct().withColumn("child", F.lit(True))
    own = F.lower(F.concat_ws(" ", *page_text)).contains(q)
    return pages.join(with_child, on, "left").where(own | F.coalesce("child", F.lit(False))).drop("child"), shown
