"""Token counts through a digest cache.

A count is stored under the digest of the text's normalised content and that of
the tokenizer: its file, its library and that library's version. Digests of all
texts are joined to the stored counts; of each digest that has none one text is
encoded, and its count is appended. A cache that is kept from run to run leaves
only new texts to encode.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import dropped, shared_dir, spread_join, written
from folioflow.session import table

#: Session setting that names a folder for a cache to keep; without it a query starts an empty one and removes it.
CACHE = "folioflow.llm.tokenCache"
STORED = "digest binary, n_tokens long, tokenizer string"
#: Texts go to the library in groups of about so many characters.
GROUP = 1 << 20
#: Split patterns no match of which can hold white space, which goes (fixed values): texts may be encoded in pieces between spaces.
APART = ("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",)
#: Distinct pieces whose counts a task keeps, and the length up to which it keeps one.
PIECES, PIECE = 1 << 19, 64


class Counter:
    """A tokenizer of a file: `tokenizers` for .json, `sentencepiece` for .model. Tasks get the file's content, not its path."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.content = f.read()
        self.kind = os.path.splitext(path)[1]
        if self.kind not in (".json", ".model"):
            raise ValueError(f"no library for {path}")
        import sentencepiece
        import tokenizers

        library = tokenizers if self.kind == ".json" else sentencepiece
        self.version = hashlib.sha256(f"{library.__name__} {library.__version__} {self.kind} ".encode() + self.content).hexdigest()

    def collapses(self) -> bool:
        """Whether every run of white space is one space to this tokenizer, after parts that it never splits were taken out."""
        if self.kind != ".json":
            return False
        told = json.loads(self.content)
        norm = told.get("normalizer") or {}
        steps = norm.get("normalizers", [norm])
        runs = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
        return runs and not any(any(x.isspace() for x in t["content"]) for t in told.get("added_tokens", []))

    def divides(self) -> bool:
        """Whether a text has the tokens of its pieces between spaces: white space is dropped and no token spans it."""
        if not self.collapses():
            return False
        pre = json.loads(self.content).get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        first = steps[0] if steps else {}
        return first.get("type") == "Split" and first.get("pattern", {}).get("Regex") in APART and first.get("behavior") == "Removed" and first.get("invert") is True

    def normalised(self, text: Column) -> Column:
        """The content that a digest names: equal contents have equal counts. Runs of ASCII white space are one space where the tokenizer takes them so; null is empty."""
        text = F.coalesce(text, F.lit(""))
        return F.regexp_replace(text, "[\\t-\\r ]+", " ") if self.collapses() else text

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text as the library counts them."""
        found = library(self.kind, self.content)
        if self.kind == ".model":
            return [len(x) for x in found.encode(texts, num_threads=1)]
        return [len(x) for x in found.encode_batch_fast(texts, add_special_tokens=False)]

    def counts_by_piece(self, texts: list[str], known: dict[str, int]) -> list[int]:
        """counts() of normalised contents of a tokenizer that divides(): every distinct piece between spaces is encoded once."""
        split = [text.split(" ") for text in texts]
        new = list({piece for pieces in split for piece in pieces if piece not in known})
        own = dict(zip(new, self.counts(new), strict=True)) if new else {}
        if len(known) + len(own) > PIECES:
            own = {p: known[p] if p in known else own[p] for pieces in split for p in pieces}
            known.clear()
        known.update(own)
        out = [sum(map(known.__getitem__, pieces)) for pieces in split]
        for piece in new:
            if len(piece) > PIECE:
                del known[piece]
        return out


@lru_cache(maxsize=2)
def library(kind: str, content: bytes):
    """Built once in each Python worker."""
    if kind == ".model":
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=content)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(content.decode())
    found.no_truncation()
    found.no_padding()
    return found


def grouped(rows: Iterator[tuple[bytes, str]]) -> Iterator[list[tuple[bytes, str]]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= GROUP or len(held) == 1024:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(texts: DataFrame, counter: Counter) -> DataFrame:
    """(digest, n_tokens) of (digest, content): each digest of a partition is encoded once, in pieces where the tokenizer divides()."""
    pieces = counter.divides()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        known: dict[str, int] = {}

        def fresh() -> Iterator[tuple[bytes, str]]:
            for batch in it:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for digest, text in zip(part.column("digest").to_pylist(), part.column("content").to_pylist(), strict=True):
                        if digest not in seen:
                            seen.add(digest)
                            yield digest, text

        for group in grouped(fresh()):
            texts = [text for _, text in group]
            n = counter.counts_by_piece(texts, known) if pieces else counter.counts(texts)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in group], pa.binary()), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(run, "digest binary, n_tokens long")


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer; an append that was made twice shows once."""
    rows = spark.read.schema(STORED).parquet(cache).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def append(counts: DataFrame, cache: str, version: str) -> None:
    counts.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)


def token_counts(docs: DataFrame, counter: Counter, cache: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text); counts that `cache` lacks are appended to it.

    Null texts are empty ones, of 0 bytes and tokens. Rows without doc_id, repeated rows and ids are counted each. One row
    of each missing digest is chosen by the smallest doc_id, so copies of a text, however many, send one text to be encoded;
    rows that share doc_id and content meet in a task and are encoded once there. Texts are moved only to be encoded, and
    encoded whole; a group of about GROUP characters, or one text if it is longer, is in a task's memory. The cache may be
    read while it grows: tokens of a digest never change, and a run that ends early leaves counts that are right.
    Further columns are not read.
    """
    spark = docs.sparkSession
    content = counter.normalised(F.col("text"))
    digest = F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest")
    keyed = written(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest), "digests")
    groups = written(keyed.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")), "groups")
    append(spark.createDataFrame([], "digest binary, n_tokens long"), cache, counter.version)
    missing = written(groups.join(stored(spark, cache, counter.version), "digest", "left_anti").select(F.col("digest").alias("missing"), "first_id"), "missing")
    if missing.limit(1).count():
        texts = docs.select("doc_id", content.alias("content"), digest)
        # Small rows are the built side; texts are dealt by digest and doc_id, never sorted.
        wanted = texts.join(missing.hint("shuffle_hash"), (F.col("digest") == F.col("missing")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
        fresh = written(encoded(wanted.select("digest", "content"), counter), "counted")
        append(fresh, cache, counter.version)
        dropped(fresh)
    counts = groups.select("digest", "copies").join(stored(spark, cache, counter.version), "digest")
    out = spread_join(keyed, counts, ["digest"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    out = written(out, "tokens")
    dropped(keyed, groups, missing)
    return out


#: Tokens above which a document is over the limit.
LIMIT = 2048


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the whole `documents` under word_bpe_49k.json; see token_counts() for odd rows.

    The cache is the folder that the setting folioflow.llm.tokenCache names, else an empty one of this call.
    """
    import public_tokenizers

    kept = spark.conf.get(CACHE, None)
    cache = kept or f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"
    counter = Counter(public_tokenizers.path("word_bpe_49k.json"))
    out = token_counts(table(spark, sf_dir, "documents"), counter, cache, LIMIT)
    if not kept:
        dropped(spark.read.schema(STORED).parquet(cache))
    return out
