"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of whole texts are standardised and mapped to random cosine features,
whose inner products approximate a Gaussian kernel (Rahimi and Recht, 2007).
Every partition sums its part of the normal equations; the driver adds a bounded
number of such sums and solves them. Each of two folds is scored by the
other's weights, and those scores are calibrated by pooling adjacent violators.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import dropped, slices, written
from folioflow.session import table

#: Labelled rows that are learnt from at most; above it a hash of doc_id picks the same share everywhere.
MOST_LABELLED = 100_000
#: Random features, the kernel's width in standard deviations, the ridge's weight for each row.
FEATURES, WIDTH, RIDGE = 192, 4.0, 1e-4
#: Tasks that sum the normal equations, and so the sums that reach the driver.
SUMS = 16
SEED = 20240101

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r\f\v",
    "line": b"\n",
    "stop": b".?",
    "pause": b",;:",
    "bang": b"!",
    "bar": b"|",
    "quote": b"'\"()[]-",
    "sign": b"#$%&*+<=>@\\^_`{}~/",
}
_MEMBER = np.zeros((256, len(CLASSES) + 1))
for _k, _v in enumerate(CLASSES.values()):
    _MEMBER[list(_v), _k] = 1
_MEMBER[128:, len(CLASSES)] = 1
N_STATS = len(CLASSES) + 1 + 13


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text; a null or empty text has zeros."""
    if not text:
        return [0.0] * N_STATS
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    count = np.bincount(raw, minlength=256)
    shares = count @ _MEMBER / len(raw)
    p = count[count > 0] / len(raw)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    distinct = set(words)
    plain = sum(map(str.isalpha, words))
    return [
        *np.sqrt(shares),
        float(-(p * np.log2(p)).sum()),
        math.log1p(len(text)),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        float(sizes.mean()),
        float(sizes.std()),
        math.log1p(float(sizes.max())),
        len(distinct) / n,
        len({w.lower() for w in distinct}) / n,
        len(set(lines)) / len(lines),
        plain / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
    ]


def statistics_table(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row, written to the shared folder: texts are read once, for learning and scoring."""

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            stats = pa.array([statistics(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats], ["doc_id", "stats"])

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(measure, "doc_id long, stats array<double>"), "stats")


@dataclass
class Model:
    """What scores a statistics vector; `steps` holds the calibration's places and heights."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def score(self, stats: np.ndarray) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        raw = features(stats, self.mean, self.scale) @ self.weights
        return np.clip(np.interp(raw, *self.steps), 0.0, 1.0)


def features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(N_STATS, FEATURES)) / (WIDTH * math.sqrt(N_STATS) / 4)
    b = rng.uniform(0, 2 * math.pi, FEATURES)
    z = np.clip((stats - mean) / scale, -8, 8)
    return np.hstack([np.ones((len(z), 1)), z / 8, math.sqrt(2 / FEATURES) * np.cos(z @ w + b)])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit of y over x by pooling adjacent violators, as places and heights to interpolate."""
    order = np.argsort(x, kind="stable")
    places, start = np.unique(x[order], return_index=True)
    weight = np.diff(np.append(start, len(x))).astype(float)
    height = np.add.reduceat(y[order].astype(float), start) / weight
    blocks: list[list[float]] = []  # height, weight, first, last
    for i, (h, w) in enumerate(zip(height, weight, strict=True)):
        blocks.append([h, w, i, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            h2, w2, _, last = blocks.pop()
            h1, w1, first, _ = blocks.pop()
            blocks.append([(h1 * w1 + h2 * w2) / (w1 + w2), w1 + w2, first, last])
    px, py = [], []
    for h, _, first, last in blocks:
        for i in dict.fromkeys((int(first), int(last))):
            px.append(places[i])
            py.append(h)
    return np.array(px), np.array(py)


def summed(train: DataFrame, part: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple]) -> list[tuple]:
    """part(stats, label, fold) of each of SUMS partitions; every part is a few arrays whose sizes do not depend on the rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in it:
            if batch.num_rows:
                stats = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                got = part(stats, np.asarray(batch.column(1), dtype=float), np.asarray(batch.column(2)))
                total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": [pickle.dumps(total)]})

    rows = train.select("stats", "label", "fold").mapInArrow(run, "part binary").collect()
    return [pickle.loads(bytes(r.part)) for r in rows]


def fit(stats: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    stats: (doc_id, stats); labels: (doc_id, quality). A doc_id with several
    labels counts as 1 only if all are; null labels and ids are left out. Rows with equal doc_id and statistics
    count once. If more than `most` labels or labelled rows are there, hashes keep about that many,
    so what reaches the driver is bounded however often a doc_id repeats.
    Without labels every score is 0.5; with one class every score is that class.
    """
    marks = labels.select(F.col("doc_id").cast("long"), "quality").dropna().groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    marks = written(marks.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0), "marks")
    share = min(1.0, most / max(1, marks.count()))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = stats.join(chosen, "doc_id").select("doc_id", "stats", "label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("fold"))
    joined = written(rows.dropDuplicates(["doc_id", "stats"]), "train")
    kept = min(1.0, most / max(1, joined.count()))
    train = joined.where(F.pmod(F.xxhash64("doc_id", "stats"), F.lit(1 << 30)) < int(kept * (1 << 30))).coalesce(SUMS)

    moments = summed(train, lambda s, y, f: (np.array([len(y), y.sum()]), s.sum(axis=0), (s * s).sum(axis=0)))
    if not moments:
        return Model(np.zeros(N_STATS), np.ones(N_STATS), np.zeros(1 + N_STATS + FEATURES), (np.array([0.0]), np.array([0.5])))
    (n, _), total, squares = (sum(x) for x in zip(*moments, strict=True))
    mean = total / n
    scale = np.sqrt(np.maximum(squares / n - mean**2, 1e-6))

    def normal(s: np.ndarray, y: np.ndarray, f: np.ndarray) -> tuple:
        x = features(s, mean, scale)
        return tuple(z for k in (0, 1) for z in (x[f == k].T @ x[f == k], x[f == k].T @ y[f == k]))

    a0, b0, a1, b1 = (sum(x) for x in zip(*summed(train, normal), strict=True))
    solve = lambda a, b: np.linalg.solve(a + RIDGE * max(1.0, n) * np.eye(len(b)), b)
    both, by = solve(a0 + a1, b0 + b1), (solve(a1, b1), solve(a0, b0))

    def crossed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                x = features(np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1), mean, scale)
                f = np.asarray(batch.column(2))
                yield pa.RecordBatch.from_arrays([pa.array(np.where(f == 0, x @ by[0], x @ by[1])), batch.column(1)], ["x", "y"])

    pairs = train.select("stats", "label", "fold").mapInArrow(crossed, "x double, y double").toPandas()  # at most about `most` rows
    dropped(marks, joined)
    return Model(mean, scale, both, isotonic(pairs["x"].to_numpy(), pairs["y"].to_numpy()))


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score(stats: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of statistics_table(). A null doc_id counts as held out."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            s = model.score(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros(0)
            held = [i is None or zlib.crc32(str(i).encode()) % 5 == 0 for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held), pa.array(s), pa.array((s >= least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return stats.select("doc_id", "stats").mapInArrow(run, SCORED)


def accepted(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least `least`; texts do not move."""
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(it):
            stats = np.array([statistics(t) for t in batch.column(at).to_pylist()]).reshape(batch.num_rows, N_STATS)
            yield batch.filter(pa.array(model.score(stats) >= least))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores every row of docs; see fit() and score(). Only doc_id and text are read; an empty table gives no rows."""
    stats = statistics_table(docs)
    return score(stats, fit(stats, labels))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of every whole text of `documents`, learnt from `labels`; see classify(), fit() and score() for null, empty and repeated rows."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
