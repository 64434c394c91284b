"""Byte-level BPE by monoid tree reduction.

A text is halved until its parts are short; each part is encoded alone and
neighbours are joined up the tree. At a join a window around the seam is encoded
again, and grows until the tokens outside are proved to be final. An end of the
window is proved in one of two ways.

1. It is a cut: a character that is not white space before one that is. No
   alternative of the split pattern matches across such a place and none looks
   back, so what stands on one side never depends on the other.
2. It lies inside one run of letters, digits, white space or other characters,
   which is one match of the pattern and longer than any token, and the two
   tokens that meet there encode to themselves. A sequence of tokens is the
   encoding of its bytes if every two neighbours are the encoding of theirs:
   the first merge that crossed a boundary would cross it between those two alone.

A side without a proof at this size doubles. Decoding concatenates the tokens'
bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import slices
from folioflow.session import table

#: Characters of a leaf of the tree, and of each side of a window at first.
LEAF, SIDE = 128, 16
#: The split pattern (fixed value) that the proofs are about.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the split pattern knows it: Python also counts U+001C to U+001F.
CUT = regex.compile(r"[\S\x1c-\x1f](?=[^\S\x1c-\x1f])")
LAST_CUT = regex.compile(r"(?r)[\S\x1c-\x1f](?=[^\S\x1c-\x1f])")
RUN = regex.compile(r"\p{L}+|\p{N}+|[^\S\x1c-\x1f]+|(?:[^\s\p{L}\p{N}]|[\x1c-\x1f])+")
#: Characters of the run that a proof of the second kind wants on either side: more than a contraction has.
AROUND = 8


@lru_cache(maxsize=4)
def load(ranks_path: str, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoding of a rank file and the bytes of each token id; read once by each worker."""
    if pattern != SPLIT:
        raise ValueError("the joins are proved for one split pattern only")
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), pieces


class Tree:
    """Encodes and decodes by halves; `encode_leaf` encodes a short text, `encode_piece` the bytes of one match, `pieces` are the tokens' bytes."""

    def __init__(self, encode_leaf: Callable[[str], list[int]], encode_piece: Callable[[bytes], list[int]], pieces: list[bytes], leaf: int = LEAF):
        self.encode_leaf, self.encode_piece, self.pieces, self.leaf = encode_leaf, encode_piece, pieces, max(1, leaf)
        self.sizes = list(map(len, pieces))
        self.longest = max(self.sizes, default=0)

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.encode_leaf(text)
        mid = len(text) // 2
        left, right = text[:mid], text[mid:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """The tokens of left + right out of those of both; see the module's text."""
        lo_side = hi_side = SIDE
        while True:
            lo, n, lo_sure = self.left_end(left, a, lo_side)
            hi, m, hi_sure = self.right_end(right, b, hi_side)
            if lo is not None and hi is not None:
                window = self.encode_leaf(left[lo:] + right[:hi])
                lo_ok = lo_sure or self.stable(a[n - 1], window[0])
                hi_ok = hi_sure or self.stable(window[-1], b[m])
                if lo_ok and hi_ok:
                    return a[:n] + window + b[m:]
            else:
                lo_ok, hi_ok = lo is not None, hi is not None
            lo_side, hi_side = (lo_side if lo_ok else 2 * lo_side), (hi_side if hi_ok else 2 * hi_side)

    def stable(self, x: int, y: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        return self.encode_piece(self.pieces[x] + self.pieces[y]) == [x, y]

    def left_end(self, text: str, ids: list[int], side: int) -> tuple[int | None, int, bool]:
        """(place in the text, tokens before it, whether it needs no further proof) of the window's start; no place where `side` gives none."""
        if side >= len(text):
            return 0, 0, True
        found = LAST_CUT.search(text, len(text) - side)
        if found:
            size, n = len(text[found.end() :].encode()), len(ids)
            while size > 0:
                n -= 1
                size -= self.sizes[ids[n]]
            return found.end(), n, True
        if side <= 2 * (self.longest + AROUND) or not RUN.fullmatch(text, len(text) - side):
            return None, 0, False
        tail, n, got = text[-side:].encode(), len(ids), 0
        while n and got < len(tail):
            if got > 4 * (self.longest + AROUND) and tail[len(tail) - got] & 0xC0 != 0x80:
                break
            n -= 1
            got += self.sizes[ids[n]]
        at = len(text) - len(tail[len(tail) - got :].decode()) if 0 < got < len(tail) and tail[len(tail) - got] & 0xC0 != 0x80 else 0
        fits = at and n and at - AROUND >= len(text) - side and len(text) - at >= self.longest + AROUND
        return (at, n, False) if fits else (None, 0, False)

    def right_end(self, text: str, ids: list[int], side: int) -> tuple[int | None, int, bool]:
        """The same of the window's end: (place in the text, tokens up to it, whether it needs no further proof)."""
        if side >= len(text):
            return len(text), len(ids), True
        found = CUT.search(text, 0, side + 1)
        if found:
            size, m = len(text[: found.end()].encode()), 0
            while size > 0:
                size -= self.sizes[ids[m]]
                m += 1
            return found.end(), m, True
        if side <= 2 * (self.longest + AROUND) or not RUN.fullmatch(text, 0, side):
            return None, 0, False
        head, m, got = text[:side].encode(), 0, 0
        while m < len(ids) and got < len(head):
            if got > 4 * (self.longest + AROUND) and head[got] & 0xC0 != 0x80:
                break
            got += self.sizes[ids[m]]
            m += 1
        at = len(head[:got].decode()) if 0 < got < len(head) and head[got] & 0xC0 != 0x80 else 0
        fits = at and m < len(ids) and at + AROUND <= side and at >= self.longest + AROUND
        return (at, m, False) if fits else (None, 0, False)

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join([self.pieces[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def tree_of(ranks_path: str, pattern: str, leaf: int) -> tuple[Tree, list[bytes]]:
    enc, pieces = load(ranks_path, pattern)
    return Tree(enc.encode_ordinary, enc._core_bpe.encode_single_piece, pieces, leaf), pieces


def digests(it: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, leaf: int) -> Iterator[pa.RecordBatch]:
    """Adds n_tokens and the digests of ids and decoded bytes to (doc_id, text) batches."""
    tree, pieces = tree_of(ranks_path, pattern, leaf)
    names = [str(i) for i in range(len(pieces))]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for batch in slices(it):
        n, of_ids, of_bytes = [], [], []
        for text in batch.column(1).to_pylist():
            ids = tree.encode(text or "")
            n.append(len(ids))
            of_ids.append(sha(",".join([names[i] for i in ids]).encode()))
            of_bytes.append(sha(tree.decode(ids)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def token_rows(it: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, leaf: int) -> Iterator[pa.RecordBatch]:
    tree, pieces = tree_of(ranks_path, pattern, leaf)
    for batch in slices(it):
        ids = [tree.encode(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def decoded_rows(it: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, leaf: int) -> Iterator[pa.RecordBatch]:
    tree, _ = tree_of(ranks_path, pattern, leaf)
    for batch in slices(it):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tree.decode(i or []) for i in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])


def digest_rows(it: Iterator[pa.RecordBatch], ranks_path: str, pattern: str, leaf: int) -> Iterator[pa.RecordBatch]:
    tree, _ = tree_of(ranks_path, pattern, leaf)
    for batch in slices(it):
        sha = [hashlib.sha256(tree.decode(i or [])).hexdigest() for i in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sha, pa.string())], ["doc_id", "ids", "decoded_sha256"])


def vocabulary() -> tuple[str, str]:
    """The rank file and the split pattern of the multilingual public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id with the token ids of the whole text; a null or empty text has no tokens. Other columns are not read."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: token_rows(it, ranks_path, pattern, leaf), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """doc_id with the bytes of its token ids; null ids decode to no bytes. The inverse of encode()."""
    return tokens.select("doc_id", "ids").mapInArrow(lambda it: decoded_rows(it, ranks_path, pattern, leaf), "doc_id long, bytes binary")


def decoded_digests(tokens: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """(doc_id, ids) with decoded_sha256, the digest of the decoded bytes."""
    return tokens.select("doc_id", "ids").mapInArrow(lambda it: digest_rows(it, ranks_path, pattern, leaf), "doc_id long, ids array<int>, decoded_sha256 string")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, leaf: int = LEAF) -> DataFrame:
    """Encodes every whole text, decodes the ids again and returns the digests of both.

    Null texts count as empty; repeated rows each give a row; null doc_ids are
    kept; further columns of the input are not read. No shuffle: a text is the
    unit of work; the library sees leaves and windows only.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: digests(it, ranks_path, pattern, leaf), schema)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of `documents` encoded and decoded again; see round_trip() for null, empty and very long texts."""
    return round_trip(table(spark, sf_dir, "documents"), *vocabulary())
