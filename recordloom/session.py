"""Session set-up for local runs, and lineage cutting for iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "recordloom", **conf) -> SparkSession:
    """A session for tests and benches. On a cluster, pass your own session."""
    parallelism = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", parallelism)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _shared(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local master may fall back to a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="recordloom-shared-")
    return shared


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder that all executors share, for a table that several jobs read."""
    return f"{_shared(spark)}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` reliably, so that a lost executor costs no long recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and of known size, unlike a checkpoint.

    The folder stays until its owner clears it.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition into the session's number of shuffle partitions.

    For rows that are small now but costly later: adaptive execution sizes partitions by
    bytes and would leave the work to a few tasks.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *columns)


def merged(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join by sorting both sides.

    For sides that task functions or explodes have made larger: Spark takes them for as small as
    their source and would broadcast them.
    """
    return left.hint("merge").join(right, on, how)
