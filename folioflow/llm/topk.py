"""Exact top-k inner-product search by no-random-access aggregation over sorted lists.

Every component of the vectors of a block is a list sorted by value. A query
reads each list from the end that its weight favours, all lists to the same
depth. What is read adds to a candidate's sum; what is not yet read lies between
the last value read and the far end of the list, which bounds every score from
above and below. Candidates whose upper bound falls under the k-th lower bound,
or under the k-th score that the first block gave, leave. A query stops reading
when no more than FINALISTS times k are left, none of the others being able to
qualify, and the scores of those are resolved in exact integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioflow.llm.common import dropped, written
from folioflow.session import table

#: Shares of a sorted list after which bounds are compared.
DEPTHS = (1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4, 7 / 8, 1.0)
#: A query stops reading at this many times k candidates.
FINALISTS = 4
#: Scores cross the shuffle as digits to this power of two, the first one signed, so that any size has its place in the order.
DIGIT, DIGITS = 60, 5
RESULT = "query_id long, qpack int, qrow long, vec_id long, digits array<long>, near double"


def no_random_access(weights: np.ndarray, own: np.ndarray, values: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[np.ndarray, list[int]]]:
    """The k best candidates of each query, as (indexes, exact scores); ties to the smaller id.

    weights: queries x dims, values: candidates x dims, both integers; own: the
    queries' rows, which are no candidates of theirs; floor: scores that k other
    candidates reach. Bounds are doubles, widened by what rounding can add.
    """
    nq, (n, d) = len(weights), values.shape
    done: list[tuple[np.ndarray, list[int]]] = [(np.zeros(0, dtype=np.int64), [])] * nq
    if not n:
        return done
    order = np.argsort(values, axis=0, kind="stable")
    rank = np.empty((n, d), dtype=np.int32)
    np.put_along_axis(rank, order, np.arange(n, dtype=np.int32)[:, None], axis=0)
    lists = np.take_along_axis(values, order, axis=0).astype(np.float64)
    x, w = values.astype(np.float64), weights.astype(np.float64)
    up, down = np.maximum(w, 0), np.minimum(w, 0)  # read from the top, from the bottom
    slack = (d + 2) * 2.0**-50 * (np.abs(w) @ np.abs(x).max(axis=0, initial=0.0))
    least = np.full(nq, -np.inf) if floor is None else floor.astype(np.float64)
    alive, asking = np.arange(n), np.arange(nq)
    open_ = rows[None, :] != own[:, None]
    for share in DEPTHS:
        at = n if share == 1.0 else min(n, math.ceil(share * n))
        own_rank, own_x = rank[alive], x[alive]
        top, low = own_rank >= n - at, own_rank < at
        upper = up[asking] @ np.where(top, own_x, lists[n - at]).T + down[asking] @ np.where(low, own_x, lists[at - 1]).T
        lower = up[asking] @ np.where(top, own_x, lists[0]).T + down[asking] @ np.where(low, own_x, lists[-1]).T
        lower[~open_] = -np.inf
        reach = least[asking]
        if len(alive) > k:
            reach = np.maximum(reach, np.partition(lower, len(alive) - k, axis=1)[:, len(alive) - k])
        open_ &= upper >= (reach - 2 * slack[asking])[:, None]
        stop = (open_.sum(axis=1) <= FINALISTS * k) | (at == n)
        for q in np.flatnonzero(stop).tolist():
            left = alive[open_[q]]
            done[asking[q]] = best(left, exact(weights[asking[q]], values[left]), ids, k)
        asking, open_ = asking[~stop], open_[~stop]
        if not len(asking):
            break
        keep = open_.any(axis=0)
        alive, open_ = alive[keep], open_[:, keep]
    return done


def exact(weight: np.ndarray, values: np.ndarray) -> list[int]:
    """Inner products in integers of any size."""
    if len(weight) * int(np.abs(weight).max(initial=0)) * int(np.abs(values).max(initial=0)) < 2**63:
        return (values @ weight).tolist()
    return [sum(a * b for a, b in zip(row, weight.tolist(), strict=True)) for row in values.tolist()]


def best(rows: np.ndarray, scores: list[int], ids: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    first = sorted(range(len(rows)), key=lambda i: (-scores[i], ids[rows[i]]))[:k]
    return rows[first], [scores[i] for i in first]


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """Whole numbers of any size: 64-bit integers where all fit, else Python's."""
    flat = np.asarray(column.combine_chunks().flatten()).reshape(rows, -1)
    if flat.dtype != np.float64 or np.abs(flat).max(initial=0) < 2.0**62:
        return flat.astype(np.int64)
    return np.array([[int(x) for x in row] for row in flat.tolist()], dtype=object).reshape(flat.shape)


def digits(score: int) -> list[int]:
    """A score as DIGITS digits whose order is that of the scores."""
    low = [score >> DIGIT * n & (1 << DIGIT) - 1 for n in range(DIGITS - 1)]
    return [score >> DIGIT * (DIGITS - 1), *reversed(low)]


def exact_top_k(vectors: DataFrame, asks: Column, k: int = 10, block: int = 4096, pack: int = 512) -> DataFrame:
    """The k rows of `vectors` with the highest integer inner product for each of its rows that `asks` holds for.

    vectors has vec_id long and comps array<long>, or array<double> of whole numbers below 2**138. Candidates are dealt into
    blocks of about `block` rows, queries into packs of about `pack`; every
    pack meets every block once, in a task of its own, and the winners of the
    blocks are merged. The first block goes ahead: the k-th score that a query
    finds there is a bound in all others. A query never finds its own row, but
    other rows of its vec_id; vectors of another length than the query's take no
    part in its search. Rows with a null id or null comps are ignored; repeated
    query rows are searched each for itself; repeated candidate rows each count.
    A score beyond a long has its right rank and is null. Further columns are not read.
    Returns (query_id, rank, vec_id, score); rank breaks ties by vec_id.
    """
    clean = vectors.select("vec_id", "comps", F.size("comps").alias("dim"), F.coalesce(asks, F.lit(False)).alias("asks")).where("vec_id is not null and comps is not null")
    rows = written(clean.withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = rows.where("asks").drop("asks")
    blocks = max(1, math.ceil(rows.count() / block))
    packs = max(1, math.ceil(queries.count() / pack))
    place = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = rows.select("row", "vec_id", "comps", "dim", place(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("qpack"))
    keys = ["block", "qpack", "dim"]

    def meet(key, cands: pa.Table, qs: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("query_id", "qpack", "qrow", "vec_id", "digits", "near")}
        if cands.num_rows and qs.num_rows:
            own, name, ids = np.asarray(qs["row"]), qs["vec_id"].to_pylist(), np.asarray(cands["vec_id"])
            floor = np.array([-math.inf if f is None else f for f in qs["floor"].to_pylist()])
            found = no_random_access(matrix(qs["comps"], len(own)), own, matrix(cands["comps"], len(ids)), np.asarray(cands["row"]), ids, k, floor)
            for q, (at, scores) in enumerate(found):
                out["query_id"] += [name[q]] * len(at)
                out["qpack"] += [key[1].as_py()] * len(at)
                out["qrow"] += [int(own[q])] * len(at)
                out["vec_id"] += ids[at].tolist()
                out["digits"] += map(digits, scores)
                out["near"] += map(float, scores)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64()]
        return pa.table({c: pa.array(v, kind) for (c, v), kind in zip(out.items(), kinds, strict=True)})

    def met(block_ids: Column, cands: DataFrame, floors: Column) -> DataFrame:
        right = asking.select(*[F.col(c).alias(c) for c in ("row", "vec_id", "comps", "dim")], place(packs).alias("qpack"), F.explode(block_ids).alias("block"), floors.cast("double").alias("floor"))
        return written(cands.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, RESULT), "met")

    asking = queries
    first = met(F.array(F.lit(0)), left.where("block = 0"), F.lit(None))
    found = [first]
    if blocks > 1:
        floors = first.groupBy("qrow").agg(F.min("near").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
        asking = queries.join(floors.select(F.col("qrow").alias("row"), "kth"), "row", "left")
        found.append(met(F.sequence(F.lit(1), F.lit(blocks - 1)), left.where("block > 0"), F.col("kth")))
    ranked = W.partitionBy("query_id", "qpack", "qrow").orderBy(F.desc("digits"), F.asc("vec_id"))
    # In a long are those whose digits but the last two are all sign, and whose last but one is a few bits.
    high, mid = F.slice("digits", 1, DIGITS - 2), F.element_at("digits", -2)
    sign = F.when(F.element_at("digits", 1) < 0, F.array(F.lit(-1).cast("long"), *[F.lit((1 << DIGIT) - 1)] * (DIGITS - 3))).otherwise(F.array(*[F.lit(0).cast("long")] * (DIGITS - 2)))
    top = F.when(F.element_at("digits", 1) < 0, mid - (1 << DIGIT)).otherwise(mid)
    score = F.when((high == sign) & top.between(-8, 7), top * (1 << DIGIT) + F.element_at("digits", -1))
    every = found[0] if len(found) == 1 else found[0].union(found[1])
    out = every.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
    out = written(out, "top")
    dropped(rows, *found)
    return out


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id with floor(1024 * x) of every component; vectors that are null or hold null or non-finite components go."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = embeddings.select("vec_id", "embedding").where(x.isNotNull() & ~bad)
    # Spark's floor() gives longs and would cut off what is larger; such components have no fraction.
    scaled = lambda v: v.cast("double") * 1024
    return whole.select("vec_id", F.transform(x, lambda v: F.when(F.abs(scaled(v)) < 2.0**52, F.floor(scaled(v)).cast("double")).otherwise(scaled(v))).alias("comps"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best rows of the whole `embeddings` for each whose vec_id is divisible by 100; see exact_top_k() and integer_vectors() for odd rows."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.c, c.c), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
