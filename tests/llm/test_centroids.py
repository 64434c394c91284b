import hashlib
import math

import duckdb
import numpy as np
import pytest

from folioflow.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, owner string, comps int, distance int, cluster int"


def brute(rows, k=16, rounds=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * float(np.float32(x))) if abs(x) < 1e6 else int(float(np.float32(x))) * 64 for x in v]))
    drawn = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), c) for i, c in kept if i is not None)
    cs = [c for _, c in drawn[:k]]
    for turn in range(rounds + 1):
        owner = [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs)) for _, v in kept]
        if turn < rounds:
            for n in range(len(cs)):
                own = [v for (_, v), (_, o) in zip(kept, owner) if o == n]
                if own:
                    cs[n] = [sum(x) // len(own) for x in zip(*own)]
    by = {n: sum(d for d, o in owner if o == n) for n in range(len(cs))}
    fits = lambda x: x if x < 2**63 else None
    return sorted(((i, o, fits(d), fits(by[o]), fits(sum(by.values())), hashlib.sha256(",".join(map(str, cs[o])).encode()).hexdigest()) for (i, _), (d, o) in zip(kept, owner)), key=str)


def table(n=300, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, 64)) * 3
    rows = [(i, [float(x) for x in np.float32(middles[i % 5] + rng.normal(size=64) * (i % 7 > 2))]) for i in range(n)]
    rows += [(i % 50, rows[i % 3][1]) for i in range(150)]  # repeated ids and a third of equal vectors
    return rows + [(900, None), (901, [1.0] * 63), (902, [None] + [1.0] * 63), (903, [float("nan")] * 64), (904, [float("inf")] + [0.0] * 63), (905, []), (None, [0.5] * 64)]


def run(spark, rows, tmp_path, parts=4):
    spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA).repartition(parts).write.parquet(str(tmp_path / "embeddings.parquet"))
    return sorted(map(tuple, centroids.op12_delta_lloyd(spark, str(tmp_path)).collect()), key=str)


def test_against_brute_force_and_sql(spark, tmp_path):
    rows = table()
    got = run(spark, rows, tmp_path)
    assert got == brute(rows)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(duck.execute(centroids.ORACLE).fetchall(), key=str) == got


@pytest.mark.parametrize("large", [3e4, 1e12, 3e38])
def test_large_components_are_exact(spark, tmp_path, large):
    rows = [*table(60), *((1000 + j, [large * (j + 1) / 40] * 32 + [1.5 - j] * 32) for j in range(40))]
    got = run(spark, rows, tmp_path)
    assert got == brute(rows)
    assert any(r[2] is None for r in got) == (large > 1e9)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_clusters(spark, tmp_path, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_only_what_moved_is_compared():
    rng = np.random.default_rng(1)
    block = rng.integers(-9, 9, (200, 4)).astype(float)
    before = [[-5] * 4, [5] * 4, [0] * 4, [9, -9, 9, -9]]
    owner, distance, made = centroids.reassigned(block, np.full(200, -1), np.full(200, None), before, [0, 1, 2, 3])
    assert made == 200 * 4
    after = [[-4] * 4, *before[1:]]
    own = int((owner == 0).sum())
    new, far, made = centroids.reassigned(block, owner, distance, after, [0])
    assert made == own * 4 + (200 - own)
    whole = centroids.distances(block, after)
    assert (new == whole.argmin(axis=1)).all() and (far == whole.min(axis=1)).all()
    assert centroids.reassigned(block, owner, distance, before, [])[2] == 0


def test_random_rounds_equal_whole_comparison():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        block = rng.integers(-3, 4, (80, 3)).astype(float)
        cs = rng.integers(-3, 4, (6, 3)).tolist()
        owner, distance = np.full(80, -1), np.full(80, None)
        changed = list(range(6))
        for _ in range(4):
            owner, distance, _ = centroids.reassigned(block, owner, distance, cs, changed)
            whole = centroids.distances(block, cs)
            assert (owner == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
            changed = sorted(rng.choice(6, int(rng.integers(0, 4)), replace=False).tolist())
            cs = [rng.integers(-3, 4, 3).tolist() if k in changed else c for k, c in enumerate(cs)]


def test_transfers_are_signed_sums_of_what_moved(spark):
    rows = [(1, [1.0, 2.0], 1, 0, True, 0), (2, [2.0**100, -3.0], 1, None, True, -1), (3, [7.0, 7.0], 0, 0, False, 0)]
    state = spark.createDataFrame(rows, centroids.STATE)
    sums = {}
    for r in centroids.transfers(state, 2).collect():
        sums[r.owner, r.place] = sums.get((r.owner, r.place), 0) + (r.amount << 30 * r.digit)
    assert sums == {(1, 0): 2**100 + 1, (1, 1): -1, (1, 2): 2, (0, 0): -1, (0, 1): -2, (0, 2): -1}
