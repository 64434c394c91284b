import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioflow.llm import nearsets as ns
from folioflow.llm.neardup import near_documents


def sets_of(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size=2, num=80, den=100):  # rows may repeat ids
    sets = [sets_of(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(s), least.get(top(i)), least.get(top(i)) in (None, d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def corpus(seed, n=220):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for f in range(n // 8):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 4, 6, 11, 40, 90, 600, 650, 900]))]
        for _ in range(rng.choice([1, 2, 5, 20])):
            t = list(base)
            for _ in range(rng.randrange(1 + len(t) // 9)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows) * 3, " ".join(t)))
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    rows = corpus(1) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "One"), (9004, "one"), (9005, "one two"), (9006, "ONE\ttwo"), (9006, "ONE\ttwo")]
    rows += [(9006, "other words here"), (9007, "other words here"), (None, "one two"), (None, "all alone here"), (9008, "four five six"), (None, "four five six")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "3 AS component", "4 AS bits")
    assert sorted(map(tuple, near_documents(df, size=2).drop("h").collect()), key=str) == brute(rows)


def test_split_buckets_and_cells_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(ns, "BUCKET", 8)
    monkeypatch.setattr(ns, "CELL", 8)
    monkeypatch.setattr(ns, "WEIGHT", 900)
    rows = corpus(2, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_documents(df, size=2).drop("h").collect()), key=str) == brute(rows)


def test_empty(spark):
    assert near_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles_and_estimates():
    a = ns.word_shingles("The quick  BROWN fox", 2)
    assert len(a) == 3 and (a == ns.word_shingles("the quick\nbrown\tfox ", 2)).all()
    assert len(ns.word_shingles("É é", 2)) == 1 and (ns.word_shingles("É é", 2) != ns.word_shingles("é é", 2)).all()
    assert len(ns.char_shingles("aaaaaaaa", 5)) == 1 and len(ns.char_shingles("abc", 5)) == 1
    assert len(ns.char_shingles("éé漢漢é漢", 5)) == 2 and len(ns.char_shingles("漢漢漢漢漢漢", 5)) == 1
    rng = np.random.default_rng(0)
    x = np.sort(rng.integers(0, 2**64, 2000, dtype=np.uint64))
    for large in (True, False):
        full, part = ns.registers(x, large), ns.registers(np.sort(x[:1600]), large) if not large else ns.registers(np.sort(rng.permutation(x)[:1600]), large)
        assert abs(ns.estimate(full, part[None])[0] - 0.8) < 0.15
        far = ns.registers(np.sort(rng.integers(0, 2**64, 2000, dtype=np.uint64)), large)
        assert ns.estimate(full, far[None])[0] < 0.05


def test_links_without_estimates_span_the_same_components():
    rng = np.random.default_rng(5)
    for trial in range(30):
        bases = [rng.integers(0, 2**64, int(rng.integers(1, 60)), dtype=np.uint64) for _ in range(6)]
        sets = [ns.distinct(np.where(rng.random(len(b)) < 0.08, rng.integers(0, 2**64, len(b), dtype=np.uint64), b)) for b in bases for _ in range(int(rng.integers(1, 9)))]
        sets = sets[: 2 if trial % 5 == 0 else None]
        left = rng.random(len(sets)) < 0.5 if trial % 2 else None
        want = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and (left is None or left[i] or left[j]):
                    want[want == want[i]] = want[j]
        got = np.arange(len(sets))
        for i, j in ns.compared(sets, left):
            assert got[i] != got[j]
            got[got == got[i]] = got[j]
        same = lambda x: (x[:, None] == x[None, :]).tolist()
        assert same(got) == same(want)


def test_buckets_move_as_packed_parts():
    """Rows of a part come back whole, sorted by key, with and without y; they are far fewer than one for each key."""
    rng = np.random.default_rng(3)
    for wide in (0, 7):
        rows = [(i, [{"keys": rng.integers(-(2**63), 2**63, 10).tolist(), "x": i * 3, "y": i * wide} for _ in range(i % 3)]) for i in range(300)]
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], ns.LISTS)], ["id", "sketches"])
        moved = list(ns.packed(iter([batch.slice(0, 7), batch.slice(7)]), 5))
        assert sum(b.num_rows for b in moved) <= 5
        got = []
        for cols in ns.unpacked(iter(moved)):
            assert (np.diff(cols[0]) >= 0).all()
            got += list(zip(*(c.tolist() for c in cols), strict=True))
        assert sorted(got) == sorted((k, i, s["x"], s["y"]) for i, own in rows for s in own for k in s["keys"])


def test_packed_rows_do_not_multiply_with_parts(spark, monkeypatch):
    """A task packs a row for each task that reads, more only where parts would grow too large; a part is whole in one of as many tasks."""
    rng = random.Random(4)
    n = ns.shuffle_partitions(spark)
    sets = [(i, [{"keys": [rng.randrange(-(2**63), 2**63) for _ in range(10)], "x": i, "y": 0}]) for i in range(2000)]
    df = spark.createDataFrame(sets, f"id long, sketches {ns.SKETCHES}").repartition(8).localCheckpoint()

    def moved():
        rows = ns.dealt(df, 20_000).select("part", (F.length("rows") / 8 / F.col("width")).alias("held"), F.spark_partition_id().alias("task")).collect()
        places, held = {(r.part, r.task) for r in rows}, Counter()
        for r in rows:
            held[r.part] += int(r.held)
        assert held.total() == 20_000 and len(places) == len(held) and len({task for _, task in places}) == n
        return len(rows), held

    count, held = moved()
    assert len(held) == n and count <= 8 * n
    monkeypatch.setattr(ns, "PART", 1000)
    count, held = moved()
    assert len(held) == 5 * n == 20 and count <= 8 * 20 and max(held.values()) < 1300


def test_shingles_of_plain_and_other_text_agree():
    assert set(ns.char_shingles("abcdefgh", 5)) <= set(ns.char_shingles("é abcdefgh", 5))


def test_an_id_is_packed_once():
    """Copies of a line each bring the sketch of their class; a task moves one of them."""
    lists = pa.array([[{"keys": [5, 6], "x": 1, "y": 0}], None, [{"keys": [5, 6], "x": 1, "y": 0}], [{"keys": [5, 7], "x": 2, "y": 0}]], ns.LISTS)
    batch = pa.RecordBatch.from_arrays([pa.array([9, 8, 9, 8]), lists], ["id", "sketches"])
    got = [cols[:2] for cols in ns.unpacked(iter(list(ns.packed(iter([batch, batch]), 1))))]
    assert sorted(zip(*(c.tolist() for c in got[0]), strict=True)) == [(5, 8), (5, 9), (6, 9), (7, 8)]
    waves = [[cols[:2] for cols in ns.unpacked(iter(list(ns.packed(iter([batch]), 1, w, 2))))][0] for w in range(2)]
    assert [sorted(zip(*(c.tolist() for c in x), strict=True)) for x in waves] == [[(5, 8), (5, 9)], [(6, 9), (7, 8)]]
