import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import topk


def brute(rows, step, k=10):
    vecs = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in vecs:
        if q % step == 0:
            hits = sorted((-sum(a * b for a, b in zip(vecs[q], v)), i) for i, v in vecs.items() if i != q and len(v) == len(vecs[q]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(hits)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(i, [0.5] * 8) for i in range(400, 460)]
    rows += [(500, None), (501, [1.0, None] * 4), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (600, [1.0, 2.0]), (601, [3.0, 1.0]), (700, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS block", "2 AS score")
    v = topk.integer_vectors(df)
    got = topk.exact_top_k(v, F.col("vec_id") % 100 == 0, block=64, pack=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 100)


def test_exact_integers_beyond_doubles():
    w = np.array([[2**40, 3]], dtype=np.int64)
    x = np.array([[2**20, 1], [2**20, 2], [5, 5]], dtype=np.int64)
    rows, scores = topk.no_random_access(w, np.array([9]), x, np.arange(3), np.arange(3), 2)[0]
    assert list(rows) == [1, 0] and list(scores) == [2**60 + 6, 2**60 + 3]
    rows, scores = topk.no_random_access(w << 20, np.array([9]), x, np.arange(3), np.arange(3), 2)[0]
    assert list(scores) == [2**80 + (6 << 20), 2**80 + (3 << 20)]


@pytest.mark.parametrize("size", [8, 2**45])
def test_bounds_lose_nothing(size):
    """Many seeds, both sides of what doubles hold, floors that others reach, and ties."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        n, d, k = int(rng.integers(1, 200)), int(rng.integers(1, 9)), int(rng.integers(1, 12))
        x, w = rng.integers(-size, size, (n, d)), rng.integers(-size, size, (5, d))
        x[rng.random(n) < 0.3] = x[0]
        ids, own = rng.permutation(n), rng.integers(0, n, 5)
        want = [sorted((-sum(int(a) * int(b) for a, b in zip(x[i], w[q])), int(ids[i])) for i in range(n) if i != own[q])[:k] for q in range(5)]
        floor = np.array([-hits[-1][0] if len(hits) == k and seed % 2 else -math.inf for hits in want])
        got = topk.no_random_access(w, own, x, np.arange(n), ids, k, floor)
        assert [[(-s, int(ids[i])) for i, s in zip(rows.tolist(), scores)] for rows, scores in got] == want


def test_lists_are_not_read_to_the_end_where_bounds_decide(monkeypatch):
    """One component decides: reading stops long before the whole lists are read."""
    rng = np.random.default_rng(5)
    x = np.stack([np.arange(4096) ** 2, rng.integers(0, 2, 4096)], axis=1)
    read = []
    true = math.ceil
    monkeypatch.setattr(topk.math, "ceil", lambda v: read.append(v) or true(v))
    rows, _ = topk.no_random_access(np.array([[1000, 1]]), np.array([-1]), x, np.arange(4096), np.arange(4096), 10)[0]
    assert list(rows) == list(range(4095, 4085, -1)) and max(read) <= 4096 / 8


def test_other_rows_of_the_querys_id_are_found(spark):
    df = spark.createDataFrame([(100, [1, 2]), (100, [3, 4]), (7, [1, 1])], "vec_id long, comps array<long>")
    got = sorted(map(tuple, topk.exact_top_k(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == [(100, 1, 100, 11), (100, 1, 100, 11), (100, 2, 7, 3), (100, 2, 7, 7)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    v = topk.integer_vectors(df)
    assert topk.exact_top_k(v, F.col("vec_id") % 100 == 0).count() == 0


def test_huge_components_rank_right(spark):
    """Components beyond longs, and scores beyond them: ranks are exact, such scores are null."""
    huge = 2.0**100
    rows = [(100, [huge, 1.0]), (200, [1.0, 2.0]), (1, [huge, 5.0]), (2, [huge, 6.0]), (3, [-huge, 7.0]), (4, [2.0**50, 1.0]), (5, [1.0, 3.0]), (6, [3.0, 1.0]), (7, [1e30, -1e30])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.exact_top_k(topk.integer_vectors(df), F.col("vec_id") % 100 == 0, k=9, block=3).collect()
    want = [(q, n, i, s if -(2**63) <= s < 2**63 else None) for q, n, i, s in brute(rows, 100, 9)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert any(r.score is None for r in got) and any(r.score is not None for r in got)


def test_digits_order_scores():
    scores = sorted([0, 1, -1, 2**63 - 1, -(2**63), 2**63, -(2**63) - 1, 2**270, -(2**270), 2**60, 2**60 - 1, -(2**60), 2**120 + 5])
    assert [topk.digits(s) for s in scores] == sorted(topk.digits(s) for s in scores)


@pytest.mark.parametrize("score", [0, -1, 2**63 - 1, -(2**63), 2**60, -(2**60) - 1])
def test_scores_of_longs_come_back(spark, score):
    df = spark.createDataFrame([(100, [score, 0]), (1, [1, 0])], "vec_id long, comps array<long>")
    assert [r.score for r in topk.exact_top_k(df, F.col("vec_id") % 100 == 0).collect()] == [score]
