"""MinHash near-dedup of documents: word shingles, HyperMinHash sketches, exact links, components."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.nearsets import near_classes, word_shingles
from folioflow.session import table


def near_documents(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, h) for every row of docs; h is xxhash64(text), which tells apart the texts of one doc_id.

    Links join texts whose sets of `size`-word shingles have a Jaccard
    similarity of 0.8 or more, compared on the full sets. component_id is
    the smallest doc_id reachable; kept marks the row that bears it. Null and
    empty texts link with nothing and are kept; repeated rows share a component
    and are all kept if they bear its id; other texts under one doc_id are
    documents of their own; a null doc_id is kept only when no row with an id is
    reached. Other columns are not read. An empty table gives no rows.
    """
    found = near_classes(docs.select(F.col("doc_id").alias("id"), "text"), partial(word_shingles, size=size))
    kept = F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull())
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"), "h")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among the whole `documents` by shingles of two words, as the contract of this query has it; see near_documents() for odd rows."""
    return near_documents(table(spark, sf_dir, "documents"), size=2).drop("h")
