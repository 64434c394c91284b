"""Exact k-means by delta Lloyd: only what moved is compared and added up.

Assignments are a table that every round writes anew, with each vector's owner
and distance; the sums and counts of the clusters are kept beside it. After an
update, a vector whose own centroid stayed is compared with the changed centroids
alone: all others are as far as they were when they lost. A vector whose own
centroid moved is compared with every one. Vectors that change their owner are
taken from the old owner's sums and given to the new one's as signed integers,
added up in each task before anything is shuffled. Components are integers, so
sums, centroids and distances are exact and do not depend on any order.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import dropped, small, written
from folioflow.session import table

#: Below this size squared distances of up to 128 components fit a double's 53 bits exactly; beyond it Python's integers take over.
PLAIN = 2**22
LONG = 2**63
#: Sums cross the shuffle in digits of so many bits, so that no total of a digit leaves a long.
DIGIT = 30
STATE = "vec_id long, comps array<double>, owner int, distance long, moved boolean, previous int"


def distances(block: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of the rows of block (integers held in doubles) to the centroids, exact: doubles, or objects where they are large."""
    most = max(np.abs(block).max(initial=0), max((abs(x) for c in centroids for x in c), default=0))
    if most < PLAIN and block.shape[1] <= 128:
        far = np.array(centroids, dtype=np.float64).reshape(len(centroids), block.shape[1])
        return (block * block).sum(axis=1)[:, None] - 2 * (block @ far.T) + (far * far).sum(axis=1)[None, :]
    rows = [[int(x) for x in row] for row in block.tolist()]
    out = np.empty((len(rows), len(centroids)), dtype=object)
    for i, row in enumerate(rows):
        for k, c in enumerate(centroids):
            out[i, k] = sum((a - b) ** 2 for a, b in zip(row, c, strict=True))
    return out


def reassigned(block: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: list[list[int]], changed: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(owner, distance, comparisons made) after the centroids in `changed` moved; ties go to the smaller number.

    owner is -1 and distance anything for vectors without one. distance holds Python's integers.
    """
    owner, distance, made = owner.copy(), distance.copy(), 0
    own_moved = (owner < 0) | np.isin(owner, changed)
    for rows, numbers in ((np.flatnonzero(own_moved), list(range(len(centroids)))), (np.flatnonzero(~own_moved), sorted(changed))):
        if not len(rows) or not numbers:
            continue
        found = distances(block[rows], [centroids[k] for k in numbers])
        made += found.size
        at = found.argmin(axis=1)
        best, number = found[np.arange(len(rows)), at], np.array(numbers)[at]
        if rows is not None and numbers != list(range(len(centroids))):
            # What stayed still holds its distance; equal distances go to the smaller number.
            held, kept = distance[rows], owner[rows]
            wins = np.array([b < h or b == h and n < k for b, h, n, k in zip(best.tolist(), held.tolist(), number.tolist(), kept.tolist(), strict=True)])
            rows, best, number = rows[wins], best[wins], number[wins]
        owner[rows] = number
        distance[rows] = [int(b) for b in best.tolist()]
    return owner, distance, made


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dims)


def assigned(state: DataFrame, dims: int, centroids: list[list[int]], changed: list[int]) -> DataFrame:
    """The next state: owner and distance of every vector, whether it moved, and from where. Distances beyond a long are null."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                block = matrix(part.column("comps"), dims)
                owner = np.array([-1 if x is None else x for x in part.column("owner").to_pylist()])
                held = part.column("distance").to_pylist()
                for i in (i for i, d in enumerate(held) if d is None and owner[i] >= 0):
                    held[i] = int(distances(block[i : i + 1], [centroids[owner[i]]])[0, 0])
                new, distance, _ = reassigned(block, owner, np.array(held, dtype=object), centroids, changed)
                fits = [d if d < LONG else None for d in distance.tolist()]
                columns = [part.column("vec_id"), part.column("comps"), pa.array(new, pa.int32()), pa.array(fits, pa.int64()), pa.array(new != owner), pa.array(owner, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "comps", "owner", "distance", "moved", "previous"])

    return state.mapInArrow(run, STATE)


def transfers(state: DataFrame, dims: int) -> DataFrame:
    """(owner, place, digit, amount) of the vectors that moved: what their components add to each cluster's sums, and minus what they leave.

    place counts components; `dims` itself holds the number of vectors. A task gives one row for each cluster, place and digit.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = defaultdict(int)
        for batch in it:
            if not batch.num_rows:
                continue
            block = matrix(batch.column("comps"), dims)
            plain = np.abs(block).max(initial=0) < PLAIN
            for sign, name in ((1, "owner"), (-1, "previous")):
                owner = np.asarray(batch.column(name))
                for k in np.unique(owner[owner >= 0]).tolist():
                    rows = block[owner == k]
                    total = rows.sum(axis=0).tolist() if plain else [sum(int(x) for x in c) for c in rows.T.tolist()]
                    for place, x in enumerate([*total, len(rows)]):
                        sums[k, place] += sign * int(x)
        out = []
        for (k, place), x in sums.items():
            sign, x, digit = (1 if x > 0 else -1), abs(x), 0
            while x:
                out.append((k, place, digit, sign * (x & (1 << DIGIT) - 1)))
                x, digit = x >> DIGIT, digit + 1
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["owner", "place", "digit", "amount"])

    moved = state.where("moved").select("comps", "owner", "previous")
    return moved.mapInArrow(run, "owner int, place int, digit int, amount long").groupBy("owner", "place", "digit").agg(F.sum("amount").alias("amount"))


def clusters(vectors: DataFrame, starts: list[list[int]], rounds: int) -> tuple[DataFrame, list[list[int]]]:
    """(state, centroids) after `rounds` rounds of assignment and update, and one more assignment.

    vectors: (vec_id, comps array<double>) with integers as components, all of the length of the starts. Returns the written
    state (vec_id, comps, owner, distance, moved, previous) and the last centroids. What the driver holds are the starts' numbers
    and sums. Rows are told apart by nothing: repeated ids and vectors each count. Equal starts leave the later ones empty;
    an empty cluster's centroid stays. Rounds after one without a change would repeat it and are not run.
    Without starts, owners and distances are null.
    """
    nothing = F.lit(None)
    state = vectors.select("vec_id", "comps", nothing.cast("int").alias("owner"), nothing.cast("long").alias("distance"), F.lit(False).alias("moved"), nothing.cast("int").alias("previous"))
    if not starts:
        return written(state, "state"), starts
    dims, centroids, changed = len(starts[0]), [list(c) for c in starts], list(range(len(starts)))
    sums = defaultdict(int)
    for turn in range(rounds + 1):
        old, state = state, written(assigned(state, dims, centroids, changed), "state")
        if turn:
            dropped(old)
        if turn == rounds:
            break
        # At most clusters x (components + 1) x digits rows.
        for owner, place, digit, amount in transfers(state, dims).collect():
            sums[owner, place] += amount << (DIGIT * digit) if amount >= 0 else -(-amount << (DIGIT * digit))
        new = [[sums[k, i] // n for i in range(dims)] if (n := sums[k, dims]) else c for k, c in enumerate(centroids)]
        changed = [k for k, c in enumerate(new) if c != centroids[k]]
        centroids = new
        if not changed:
            break
    return state, centroids


def first_by_hash(vectors: DataFrame, k: int, salt: str = "1") -> list[list[int]]:
    """The comps of the k vectors whose SHA-256 of `salt:<vec_id>` is least, in that order; ids that repeat stand by their comps. Null ids start nothing."""
    drawn = vectors.where("vec_id IS NOT NULL").withColumn("drawn", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256))
    return [[int(x) for x in r.comps] for r in drawn.orderBy("drawn", "comps").limit(k).collect()]


def integer_vectors(embeddings: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """(vec_id, comps) with floor(scale * x) of every component; vectors with other lengths, null or non-finite components go.

    Components stay doubles, which hold such integers exactly for every finite float.
    """
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = embeddings.select("vec_id", "embedding").where((F.size(x) == dims) & ~bad)
    # floor() of Spark gives longs; components without a fraction are left alone.
    scaled = lambda v: v.cast("double") * scale
    down = lambda v: F.when(F.abs(scaled(v)) < 2.0**52, F.floor(scaled(v)).cast("double")).otherwise(scaled(v))
    return whole.select("vec_id", F.transform(x, down).alias("comps"))


def report(state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of a final state.

    Sums are exact; a sum that leaves a long, or holds a distance that does, is null.
    """
    spark = state.sparkSession
    whole = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.sum(F.col(c).cast("decimal(19,0)")))
    by = state.groupBy(F.col("owner").alias("cluster")).agg(whole("distance").alias("sum"))
    total = by.agg(F.when(F.count("sum") == F.count(F.lit(1)), F.sum(F.col("sum").cast("decimal(38,0)"))).alias("all"))
    fits = lambda c: F.when(F.col(c) <= LONG - 1, F.col(c).cast("long"))
    named = spark.createDataFrame([(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    # A row for each centroid.
    sums = small(by.join(named, "cluster", "left").crossJoin(total), len(centroids))
    out = state.select("vec_id", F.col("owner").alias("cluster"), "distance").join(sums, "cluster", "left")
    return out.select("vec_id", "cluster", "distance", fits("sum").alias("cluster_inertia"), fits("all").alias("inertia"), "centroid_sha256")


#: Clusters, rounds, components and their scale of the query.
CLUSTERS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the whole `embeddings`, from 16 starts drawn by hash, after three rounds. See clusters() and integer_vectors() for odd rows."""
    vectors = written(integer_vectors(table(spark, sf_dir, "embeddings"), DIMS, SCALE), "vectors")
    state, centroids = clusters(vectors, first_by_hash(vectors, CLUSTERS), ROUNDS)
    out = written(report(state, centroids), "clusters")
    dropped(vectors, state)
    return out


def _assignment(n: int) -> str:
    return f"""
a{n} AS (SELECT vec_id, row, c, unnest(list_sort(list_transform(cs, lambda k: [CAST(list_sum(list_transform(list_zip(c, k.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), k.n]))[1:1]) AS best
        FROM v, (SELECT list({{'n': n, 'c': c}} ORDER BY n) AS cs FROM c{n}) s)"""


def _update(n: int) -> str:
    return f"""
s{n} AS (SELECT best[2] AS n, i, CAST(floor(sum(c[i]) / count(*)) AS BIGINT) AS x FROM a{n}, range(1, {DIMS + 1}) r(i) GROUP BY ALL),
c{n + 1} AS (SELECT n, coalesce(l.c, o.c) AS c FROM c{n} o LEFT JOIN (SELECT n, list(x ORDER BY i) AS c FROM s{n} GROUP BY n) l USING (n))"""


ORACLE = f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, c) - 1 AS n, c FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, c FROM v WHERE vec_id IS NOT NULL ORDER BY h, c LIMIT {CLUSTERS})),
{",".join([x for n in range(ROUNDS) for x in (_assignment(n), _update(n))] + [_assignment(ROUNDS)])}
SELECT vec_id, CAST(a.best[2] AS INTEGER) AS cluster, a.best[1] AS distance, CAST(sum(a.best[1]) OVER (PARTITION BY a.best[2]) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.c, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} k ON k.n = a.best[2]
"""
