import zlib

import numpy as np
import pytest

from folioflow.llm import quality as q
from folioflow.session import table

SF = "/root/testdata/sf0.01"


def test_isotonic():
    x, y = q.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert list(x) == [1, 2, 3, 4] and list(y) == [0, 0.5, 0.5, 1]


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = q.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == got.predicted).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "fine text here. " * 5000), (3, "x"), (None, "y")], "doc_id long, text string").selectExpr("*", "'z' AS stats", "1 AS label", "2 AS score")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, None), (None, 1), (2, 1)], "doc_id long, quality int")
    got = q.classify(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 5
    assert {r.score for r in q.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert q.classify(docs.limit(0), labels).count() == 0
    model = q.fit(q.statistics_table(docs), labels)
    assert q.accepted(docs, model).columns == docs.columns


@pytest.mark.parametrize("text", ["a", " ", "\n", "É" * 9, "|" * 70000])
def test_statistics_have_one_size(text):
    assert len(q.statistics(text)) == len(q.statistics(None)) == q.N_STATS


def test_against_whole_normal_equations(spark):
    """Weights, cross-fitted scores and calibration from one matrix and the max-min form of isotonic regression."""
    import zlib

    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    word = lambda bad: "".join(rng.choice(list("abc$#1")) if bad else rng.choice(list("etaoin")) for _ in range(5))
    rows = [(i, " ".join(word(i % 3 == 0 or rng.random() < 0.2) for _ in range(int(rng.integers(1, 40))))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(300)], "doc_id long, quality int")
    model = q.fit(q.statistics_table(docs), labels)
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("f")).collect()}
    train = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    stats = np.array([q.statistics(rows[i][1]) for i in train])
    y, f = np.array([float(i % 3 != 0) for i in train]), np.array([fold[i] for i in train])
    x = q.features(stats, stats.mean(axis=0), np.sqrt(np.maximum(stats.var(axis=0), 1e-6)))
    ridge = q.RIDGE * len(y) * np.eye(x.shape[1])
    solve = lambda m: np.linalg.solve(x[m].T @ x[m] + ridge, x[m].T @ y[m])
    assert np.allclose(model.weights, solve(f >= 0), atol=1e-6)
    raw = np.where(f == 0, x @ solve(f == 1), x @ solve(f == 0))
    by = np.argsort(raw, kind="stable")
    z = y[by]
    mean = lambda a, b: z[a : b + 1].mean()
    fitted = [max(min(mean(a, b) for b in range(i, len(z))) for a in range(i + 1)) for i in range(0, len(z), 7)]
    assert np.allclose(np.interp(raw[by], *model.steps)[::7], fitted, atol=1e-6)


def test_what_reaches_the_driver_is_bounded_by_rows(spark, monkeypatch):
    """One labelled doc_id with many rows: about `most` of them are learnt from; equal rows count once."""
    rng, seen = np.random.default_rng(1), []
    true = q.isotonic
    monkeypatch.setattr(q, "isotonic", lambda x, y: seen.append(len(x)) or true(x, y))
    rows = [(1, [float(v) for v in rng.normal(size=q.N_STATS)]) for _ in range(500)]
    stats = spark.createDataFrame(rows + [rows[0]] * 300, "doc_id long, stats array<double>")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    q.fit(stats, labels, most=20)
    assert 5 <= seen[-1] <= 60
    q.fit(spark.createDataFrame([rows[0]] * 400 + [rows[1]], "doc_id long, stats array<double>"), labels)
    assert seen[-1] == 2
