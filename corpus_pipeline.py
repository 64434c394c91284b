"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import bpe, decontaminate, linededup, neardup, quality
from folioflow.llm.common import dropped, written
from folioflow.session import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more), learnt from the labels of these documents.

    Null and empty texts are scored like any other, by statistics that are then zero, and very long ones whole. Every row is judged by its own
    text; rows without doc_id are not learnt from. Without labels every document scores 0.5 and stays; no documents, no rows.
    """
    stats = quality.statistics_table(docs)
    model = quality.fit(stats, table(spark, sf_dir, "labels"))
    dropped(stats)
    return quality.accepted(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that fuzzily repeat an earlier one; a document that loses every line goes."""
    return linededup.dedup_lines(docs)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows that gone names by (doc_id, h); a missing doc_id is a name like any other, h is xxhash64(text)."""
    named = gone.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    return docs.hint("merge").join(named, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_h")), "left_anti")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one with the smallest doc_id.

    Five words are what every stage on word shingles takes; op6's two words are the contract of that query alone.
    Texts that repeat a doc_id are judged each for itself; a row without doc_id goes when it is a copy of one with.
    Null and empty texts link with nothing and stay; very long ones are compared whole; no documents, no rows.
    """
    return without(docs, neardup.near_documents(docs, size=5).where(~F.col("kept")))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs; every row is judged by its own text.

    Null and empty texts have no words and stay; very long ones are read whole. No items, nothing goes; no documents, no rows.
    """
    return without(docs, decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the byte-level BPE ids of every text, and the digest of what they decode to.

    Null texts are empty: no ids, the digest of nothing. Repeated rows each give one; very long texts are encoded whole.
    """
    ranks, pattern = bpe.vocabulary()
    ids = written(bpe.encode(docs, ranks, pattern), "ids")
    back = bpe.decoded_digests(ids, ranks, pattern)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", token_stage),
]

#: SQL cannot state the classifier or the tokenizer; tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage has read goes when its own table stands, the input aside."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        if read is not None:
            dropped(read, kept=True)
        read = docs
    return docs
