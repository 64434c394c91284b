"""Import: blocks to items, ranges of entries spliced into a book, with duplicate evidence and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.audit import duplicate_evidence
from folioflow.operators.mutate import insert_after


def entry_keys(blocks: DataFrame, page: str = "page", order: str = "block_ord") -> DataFrame:
    """key 'page:index' and a label of at most 105 characters."""
    kind = F.when(F.col("type").isin("part_title", "section_heading"), F.concat(F.lit("H"), F.coalesce("level", F.lit(1)).cast("string"))).otherwise(F.col("type"))
    text = F.coalesce(F.when(F.trim("text") != "", F.col("text")), F.lit("(empty)"))
    label = F.concat_ws(" · ", kind, F.when(F.length(text) > 105, F.concat(F.left(text, F.lit(102)), F.lit("…"))).otherwise(text))
    return blocks.withColumn("key", F.concat_ws(":", F.col(page).cast("string"), F.col(order).cast("string"))).withColumn("label", label)


def blocks_to_items(blocks: DataFrame, keys: list[str], order: str, source: str = "import") -> DataFrame:
    """(keys, item_ord, id, type, title, text, level, src, source_ref) of blocks; a heading's text is its title."""
    heading = F.col("type").isin("part_title", "section_heading")
    return blocks.select(
        *keys,
        F.col(order).alias("item_ord"),
        F.concat_ws("-", F.lit(source), *[F.col(k).cast("string") for k in keys], F.col(order).cast("string")).alias("id"),
        "type",
        F.when(heading, F.col("text")).alias("title"),
        F.when(~heading, F.col("text")).alias("text"),
        "level",
        "src",
        F.struct(F.lit(source).alias("kind"), F.col(order).alias("source_paragraph")).alias("source_ref"),
    )


def insertion_draft(items: DataFrame, new: DataFrame, keys: list[str], order: str, at: int, signature: list[str], insertion_id: str) -> tuple[DataFrame, DataFrame]:
    """(the book with the new items behind ordinal `at`, the manifest: new items, hits among the old ones, whether that is a duplicate import)."""
    marked = new.withColumn("insertion_id", F.lit(insertion_id))
    draft = insert_after(items.withColumn("insertion_id", F.lit(None).cast("string")), marked, keys, order, at)
    evidence = duplicate_evidence(new, items, keys, signature).withColumn("insertion_id", F.lit(insertion_id))
    return draft, evidence


def import_evidence(entries: DataFrame, insertions: DataFrame, existing: DataFrame, keys: list[str], order: str, key: str, file: str, signature: list[str]) -> DataFrame:
    """(keys, kind, insertion_id, hits, n) of imports that are made already; others do not show.

    entries: the rows of each import (keys, order, key, file, signature); insertions: the record of former ones (insertion_id, source_file,
    start_key, end_key); existing: signatures of what the book holds. An import of the same file, whatever its case, from the same
    first to the same last entry is of kind 'manifest' and names the earliest such insertion, whatever else is found. Of the others, one with hits
    for most of its entries (duplicate_evidence()) is of kind 'sourceRef'.
    """
    ends = entries.groupBy(*keys).agg(F.lower(F.first(file)).alias("_file"), F.min_by(key, order).alias("_start"), F.max_by(key, order).alias("_end"))
    known = insertions.groupBy(F.lower("source_file").alias("_file"), F.col("start_key").alias("_start"), F.col("end_key").alias("_end")).agg(F.min("insertion_id").alias("insertion_id"))
    found = ends.join(known, ["_file", "_start", "_end"], "left").select(*keys, "insertion_id")
    hits = duplicate_evidence(entries.select(*keys, *signature), existing, keys, signature)
    kind = F.when(F.col("insertion_id").isNotNull(), "manifest").when(F.col("duplicate"), "sourceRef")
    return hits.join(found, keys).withColumn("kind", kind).where("kind IS NOT NULL").select(*keys, "kind", "insertion_id", "hits", "n")
