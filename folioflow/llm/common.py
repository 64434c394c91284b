"""What the corpus operators share: tables written to the shared folder, bounded broadcasts, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A relation is broadcast only when its measured rows stay below this bound.
BROADCAST_ROWS = 20_000


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one of our own in local mode (tests).

    A cluster without the setting is refused, since its machines share no temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or own_dir(spark.sparkContext.master, spark.sparkContext.applicationId)).rstrip("/")


def own_dir(master: str, app: str) -> str:
    if not master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="folioflow-")
    return _own[app]


KEPT = "kept-"
#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files at their end; else these stay until the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here and a lost executor costs nothing.

    The shuffle files of the write go with its end, so the disk holds those of one query at a time. dropped() deletes such tables, but not those that are written to keep.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{KEPT if keep else ''}{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame, kept: bool = False) -> None:
    """Deletes tables of written() that nothing reads any more; the shared folder holds only what is still needed.

    Those that were written to keep go only where `kept` says so.
    """
    root = None
    for df in tables:
        spark = df.sparkSession
        root = root or shared_dir(spark).split(":", 1)[-1].lstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if root in path and (kept or not path.rsplit("/", 1)[-1].startswith(KEPT)):
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)


def slices(it: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of a few rows, so that few texts at a time become Python objects."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast when its counted rows allow it, else unmarked (a shuffled join)."""
    return F.broadcast(df) if rows <= limit else df


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows left-joined with groups: (keys, copies, ...), of which `copies` says how many rows have the key.

    Keys that hold more than a thousandth of all copies are at most a thousand;
    they are broadcast, so no task gets all rows of a hot key.
    """
    total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.col("copies") * 1000 > max(total, 1_000_000)
    heavy, light = F.broadcast(groups.where(hot).drop("copies")), groups.where(~hot).drop("copies")
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(*keys), keys, "left_anti").join(light, keys, "left"))


#: Edges that a partition contracts together.
CONTRACT = 2_000_000


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of an edge list, by hooking to smaller labels and pointer jumping."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def contracted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the nodes of a partition's edges: the smallest node that these edges reach."""

    def star() -> pa.RecordBatch:
        node, label = labels(*(np.concatenate([h[i] for h in held]) for i in range(2)))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], ["node", "root"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in it:
        held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
        if sum(len(h[0]) for h in held) > CONTRACT:
            yield star()
            held = []
    if held:
        yield star()


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Connected components of an undirected edge list by distributed union-find, at every size the same way.

    Every partition joins its own edges by union-find. A node that several
    partitions know unites their roots; these unions are the edges of the next,
    smaller graph, and so on until no node has two roots. The labels of the
    levels are then put together from the last one back. Every level is written
    to the shared folder; a node has at most a root for each partition. The
    largest node of a level is a root in no partition, so levels come to an end.
    Repeated edges need no removal before.
    Returns (node, component) with the smallest node of each component, for
    nodes that are not that themselves. Null ends and self loops are ignored; an
    empty list gives an empty table.
    """
    cur = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    levels: list[DataFrame] = []
    while True:
        roots = cur.mapInArrow(contracted, "node long, root long").groupBy("node").agg(F.collect_set("root").alias("roots"))
        levels.append(written(roots.select("node", F.array_min("roots").alias("component"), "roots"), "cc"))
        # Repeated unions do no harm: partitions contract them before anything is shuffled.
        unions = levels[-1].where(F.size("roots") > 1).select(F.explode("roots").alias("u"), F.col("component").alias("v"))
        cur = unions.where("u <> v")
        if not cur.limit(1).count():
            break
    out = levels[-1].select("node", "component")
    for level in reversed(levels[:-1]):
        up = out.select(F.col("node").alias("component"), F.col("component").alias("top"))
        out = level.select("node", "component").join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    out = written(out.where("node <> component"), "cc")
    dropped(*levels)
    return out
