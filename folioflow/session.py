"""Session and table access shared by every query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "folioflow") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The folder of checkpoints, which is set if the context has none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="folioflow-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder as Parquet: computed once, and who reads it takes the columns that it needs. For wide rows; see checkpointed()."""
    path = f"{_shared(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder of the session, so its lineage ends here.

    The folder is the context's, else the one of spark.checkpoint.dir, else in local mode (tests) a temporary one; a cluster
    without the setting is refused, since its machines share no temporary folder.
    """
    _shared(df.sparkSession)
    return df.checkpoint()
