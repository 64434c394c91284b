import random
import time

import pytest

from folioflow.llm import common


def brute(edges):
    low = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {x: m for x, m in low.items() if x != m}


@pytest.mark.parametrize("at_once", [0, 10**6])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(common, "CONTRACT", at_once)
    rng = random.Random(at_once)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (200, 300), (300, 200)]
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long").repartition(3)
    assert {r.node: r.component for r in common.components(df).collect()} == brute(edges)
    assert common.components(df.limit(0)).count() == 0


def test_own_folder_only_in_local_mode():
    assert common.own_dir("local[4]", "app-1") == common.own_dir("local[4]", "app-1").rstrip("/")
    with pytest.raises(ValueError):
        common.own_dir("spark://host:7077", "app-2")


def test_spread_join_keeps_every_row(spark):
    rows = spark.createDataFrame([(k % 5, k) for k in range(50)], "k long, v long")
    groups = spark.createDataFrame([(0, 2_000_000, "hot"), (1, 3, "light")], "k long, copies long, name string")
    got = {(r.v, r.name) for r in common.spread_join(rows, groups, ["k"]).collect()}
    assert got == {(v, {0: "hot", 1: "light"}.get(v % 5)) for v in range(50)}


def test_written_leaves_no_shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()

    def shuffle_files():
        files = env.blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    before, setting = shuffle_files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    told = common.written(spark.range(10_000).selectExpr("id", "id % 97 AS k").repartition(5, "k").groupBy("k").count(), "told")
    deadline = time.time() + 5
    while (left := shuffle_files() - before) and time.time() < deadline:
        time.sleep(0.2)
    assert not left and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    assert told.count() == 97
    common.dropped(told)
