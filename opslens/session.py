"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folder of the run that is under way, below the checkpoint folder; one for each process unless a run names its own.
_RUN: ContextVar[str] = ContextVar("run", default=f"session-{uuid.uuid4().hex}")
#: Applications and folders that are removed when the session's JVM ends.
_MARKED: set[tuple[str, str]] = set()

PARTITION_BYTES = 128 * 1024**2


def shuffle_partitions_for(input_bytes: int) -> int:
    return max(200, -(-input_bytes // PARTITION_BYTES))


def build_session(
    app: str = "opslens", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """Session with the settings the jobs rely on.

    ``input_bytes`` sizes the shuffles so that a full shuffle of the input gives partitions of 128 MB; adaptive
    execution merges them where less data arrives, but never splits them further. Otherwise the cluster's
    setting stands.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    if input_bytes:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions_for(input_bytes)))
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def local_session(cores: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """Session for tests and the benchmark."""
    return build_session(
        master=f"local[{cores}]",
        spark__sql__shuffle__partitions=str(cores),
        spark__driver__memory=memory,
        spark__driver__host="127.0.0.1",
        **conf,
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Reliable checkpoint folder: the one the cluster names, and a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="opslens-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def run_name() -> str:
    """Name of the run that is under way."""
    return _RUN.get()


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for the tables that a run stores, removed when the run ends or fails."""
    name = f"run-{uuid.uuid4().hex}"
    token = _RUN.set(name)
    path = run_path(spark)
    try:
        yield path
    finally:
        _RUN.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run_path(spark: SparkSession) -> str:
    """Folder for what the run under way stores."""
    return f"{ensure_checkpoint_dir(spark)}/{_RUN.get()}"


def drop_at_end(spark: SparkSession) -> None:
    """Has the run's folder removed when the session's JVM ends, whoever uses the tables in it until then. Call it when the
    folder is there."""
    folder = run_path(spark)
    if (spark.sparkContext.applicationId, folder) not in _MARKED:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place):
            _MARKED.add((spark.sparkContext.applicationId, folder))


def input_size(df: DataFrame) -> int:
    """Bytes that the planner expects a frame's scans to read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def stored(df: DataFrame) -> DataFrame:
    """Parquet copy in the checkpoint folder: evaluated once, and still there when executors are lost.

    Unlike checkpointed rows, the copy is scanned by column and its size is known to the planner.
    """
    path = f"{run_path(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_end(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Stored copy for work that passes over the rows many times, with a partition for every core."""
    copy = stored(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return copy.repartition(cores) if copy.rdd.getNumPartitions() < cores else copy
