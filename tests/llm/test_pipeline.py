import random

import corpus_pipeline as p
from folioflow.llm import bpe, quality
from tests.llm.test_decontaminate import words
from tests.llm.test_linededup import brute as gone_lines
from tests.llm.test_neardup import brute as near


def corpus(tmp_path, spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    line = lambda k: " ".join(word() for _ in range(k))
    items = [(i, line(14)) for i in range(3)]
    rows = []
    for d in range(120):
        bad = d % 4 == 0
        lines = [line(rng.randrange(8, 20)) + "." for _ in range(rng.randrange(3, 7))]
        if bad:
            lines = [" ".join(w + "$$$" for w in x.split()) for x in lines]
        if d % 15 == 1:
            lines.append("x " + items[d % 3][1] + " y")
        if d % 10 == 3 and rows:
            lines = rows[-2][1].split("\n")[:1] + lines
        rows.append((d, "\n".join(lines), "en", f"s{d % 3}", 0))
    rows.append((500, rows[5][1].replace(".", "!", 1), "en", "s", 0))
    rows = [(d, t, a, b, len(t)) for d, t, a, b, _ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 0 if d % 4 == 0 else 1, 0) for d in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(quality.statistics_table(docs), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    import numpy as np

    kept = [(d, t) for d, t, *_ in rows if model.score(np.array([quality.statistics(t)]))[0] >= 0.3]
    assert {d for d, _ in kept if d < 120} == {d for d in range(120) if d % 4}
    gone = gone_lines(kept)
    kept = [(d, "\n".join(left)) for d, t in kept if (left := [x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, [])])]
    stays = {d for d, _, _, k in near(kept, size=5) if k}
    kept = [(d, t) for d, t in kept if d in stays]
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [words(t)] for i in range(len(w) - 9)}
    hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [words(t)] for i in range(len(w) - 9))
    assert any(hit(t) for _, t in kept)
    kept = [(d, t) for d, t in kept if not hit(t)]
    enc, _ = bpe.load(*bpe.vocabulary())
    got = {r.doc_id: (r.ids, r.n_tokens) for r in p.run(spark, str(tmp_path)).collect()}
    assert got == {d: (enc.encode_ordinary(t), len(enc.encode_ordinary(t))) for d, t in kept}


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert p.token_stage(spark, docs.limit(0), str(tmp_path)).count() == 0
