import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.llm import tokencounts

JSON = public_tokenizers.path("word_bpe_49k.json")
COUNTER = tokencounts.Counter(JSON)
SCHEMA = "doc_id long, text string, digest string, copies int, n_tokens int, content int"
TEXTS = ["", " ", "Plain words, and more.", "Plain  words,\tand\n\nmore.", "a<|endoftext|>b", "a <|ENDOFTEXT|> b", "<|startoftext|>", "é É ΑΣ", "x" * 5000, "a  b\x1c c", None]


def brute(rows, path=JSON):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        count = sentencepiece.SentencePieceProcessor(model_file=path).encode
        count = (lambda f: lambda x: len(f(x)))(count)
    out = [(i, len((x or "").encode()), count(x or "")) for i, x in rows]
    return sorted(((*r, r[2] > 3) for r in out), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, x, "clash", 1, 2, 3) for i, x in rows], SCHEMA).repartition(3)


def rows():
    out = [(i, x) for i, x in enumerate(TEXTS)]
    out += [(100 + i, "the hot text. " * 3) for i in range(60)] + [(7, TEXTS[2]), (7, TEXTS[2]), (None, "lone"), (None, "lone"), (None, None), (5, "lone")]
    return [*out, (900, "Very long text, with words. " * 50_000)]


@pytest.mark.parametrize("path", [JSON, public_tokenizers.path("piece_bpe_32k.model")])
def test_against_the_library_cold_and_warm(spark, tmp_path, path, monkeypatch):
    counter, cache = tokencounts.Counter(path), str(tmp_path / "cache")
    got = sorted(map(tuple, tokencounts.token_counts(frame(spark, rows()), counter, cache, 3).collect()), key=str)
    assert got == brute(rows(), path)
    kept = spark.read.parquet(cache)
    distinct = {x or "" for _, x in rows()}
    assert kept.count() == len({" ".join(x.replace("\t", " ").replace("\n", " ").split("  ")) if counter.collapses() else x for x in distinct})
    more = [*rows(), (1000, "one new text"), (1001, "one new text"), (1002, "one  new text")]
    seen = spark.sparkContext.accumulator(0)
    true = tokencounts.encoded

    def counted(texts, c):
        seen.add(texts.count())
        return true(texts, c)

    monkeypatch.setattr(tokencounts, "encoded", counted)
    again = sorted(map(tuple, tokencounts.token_counts(frame(spark, more), counter, cache, 3).collect()), key=str)
    assert again == brute(more, path)
    assert seen.value == (1 if counter.collapses() else 2)
    tokencounts.token_counts(frame(spark, more), counter, cache, 3)
    assert seen.value == (1 if counter.collapses() else 2)


def test_versions_do_not_share_counts(spark, tmp_path):
    cache, one, other = str(tmp_path / "cache"), tokencounts.Counter(JSON), tokencounts.Counter(JSON)
    other.version = "another"
    docs = frame(spark, [(1, "some words")])
    tokencounts.token_counts(docs, one, cache, 3)
    tokencounts.append(spark.createDataFrame([(bytes(32), 77)], "digest binary, n_tokens long"), cache, "another")
    assert [r.n_tokens for r in tokencounts.token_counts(docs, other, cache, 3).collect()] == [2]
    assert spark.read.parquet(cache).groupBy("tokenizer").count().count() == 2


def test_repeated_append_shows_once(spark, tmp_path):
    cache, counter = str(tmp_path / "cache"), tokencounts.Counter(JSON)
    docs = frame(spark, [(1, "some words"), (2, "some words")])
    tokencounts.token_counts(docs, counter, cache, 3)
    tokencounts.append(tokencounts.stored(spark, cache, counter.version), cache, counter.version)
    assert tokencounts.token_counts(docs, counter, cache, 3).count() == 2


def test_empty_table(spark, tmp_path):
    assert tokencounts.token_counts(frame(spark, []), tokencounts.Counter(JSON), str(tmp_path / "c"), 3).count() == 0


def test_query_reads_the_named_cache(spark, tmp_path):
    spark.conf.set(tokencounts.CACHE, str(tmp_path / "kept"))
    try:
        frame(spark, rows()).write.parquet(str(tmp_path / "documents.parquet"))
        got = tokencounts.op11_token_counts(spark, str(tmp_path))
        assert sorted((r[:3] for r in map(tuple, got.collect())), key=str) == sorted((r[:3] for r in brute(rows())), key=str)
        assert spark.read.parquet(str(tmp_path / "kept")).where(F.col("n_tokens") > 2048).count() == 1
    finally:
        spark.conf.unset(tokencounts.CACHE)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85<|>endoftxsaŕ '"))))
def test_normalised_content_keeps_the_count(text):
    """Every run of ASCII white space is one space to the tokenizer."""
    import re

    bare = re.sub("[\t-\r ]+", " ", text)
    whole, again = COUNTER.counts([text, bare])
    assert whole == again and COUNTER.counts_by_piece([bare, "other words", bare], {}) == [whole, 2, whole]


def test_pieces_of_a_full_memory(monkeypatch):
    monkeypatch.setattr(tokencounts, "PIECES", 5)
    texts, known = ["one two three", "four five six seven", "one eight " + "long" * 40, "", " one  one ", "nine ten eleven one two"], {}
    for at in range(len(texts)):
        group = texts[at : at + 2]
        assert COUNTER.counts_by_piece(group, known) == COUNTER.counts(group)
        assert all(len(p) <= tokencounts.PIECE for p in known)


def test_only_known_patterns_divide():
    assert COUNTER.divides() and not tokencounts.Counter(public_tokenizers.path("byte_bpe_50k.json")).divides() and not tokencounts.Counter(public_tokenizers.path("piece_bpe_32k.model")).divides()
