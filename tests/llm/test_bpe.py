import hashlib
import random

import pytest

from folioflow.llm import bpe


def library():
    enc, _ = bpe.load(*bpe.vocabulary())
    return enc, bpe.tree_of(*bpe.vocabulary(), 7)[0]


def test_tree_equals_the_library_on_random_texts():
    enc, tree = library()
    rng = random.Random(1)
    parts = ["a", "Ab", "'", "'s", "'re", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "é", "漢字", "12", "!", "!?", "😀", "word", " of", "\r\n", "　"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        ids = tree.encode(text)
        assert ids == enc.encode_ordinary(text), repr(text)
        assert tree.decode(ids) == text.encode()


def test_texts_without_cuts():
    enc, tree = library()
    for text in ("", "x" * 500, " " * 300, "\n" * 99 + "a", "ab" * 200 + " ", "é" * 333):
        assert tree.encode(text) == enc.encode_ordinary(text)


def test_a_long_text_without_spaces_stays_in_small_windows():
    """1 MB of one run of letters, digits, signs, spaces or CJK: the library never sees much of it at once."""
    enc, _ = bpe.load(*bpe.vocabulary())
    rng = random.Random(4)
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 1 << 20), ("0123456789", 60_000), ("=-_#'", 60_000), (" ", 30_000), ("\n ", 30_000), ("漢字仮名交文章例題", 60_000), ("aé", 60_000)):
        tree, _ = bpe.tree_of(*bpe.vocabulary(), bpe.LEAF)
        seen = []
        tree.encode_leaf = lambda t: seen.append(len(t)) or enc.encode_ordinary(t)  # noqa: B023
        text = "".join(rng.choice(letters) for _ in range(n))
        ids = tree.encode(text)
        assert ids == enc.encode_ordinary(text), letters
        assert max(seen) <= 20_000, (letters, max(seen))
        assert tree.decode(ids) == text.encode()


def test_other_patterns_are_refused():
    with pytest.raises(ValueError):
        bpe.load(bpe.vocabulary()[0], r"\w+|\W+")


def test_round_trip_rows(spark):
    rows = [(1, "Hello there. " * 2000), (2, None), (3, ""), (3, ""), (None, "x"), (4, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "text AS ids")
    got = bpe.round_trip(docs, *bpe.vocabulary()).collect()
    enc, _ = library()
    want = sorted(str((i, len(x := enc.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())) for i, t in rows)
    assert sorted(str(tuple(r)) for r in got) == want
    assert bpe.round_trip(docs.limit(0), *bpe.vocabulary()).count() == 0


def test_decode_inverts_encode(spark):
    docs = spark.createDataFrame([(1, "naïve 東京 text\n"), (2, None)], "doc_id long, text string")
    ids = bpe.encode(docs, *bpe.vocabulary())
    assert {r.doc_id: bytes(r.bytes) for r in bpe.decode(ids, *bpe.vocabulary()).collect()} == {1: "naïve 東京 text\n".encode(), 2: b""}
