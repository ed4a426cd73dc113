"""Session factory, and written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
_scratch: ContextVar[list[str] | None] = ContextVar("paceline_scratch", default=None)


def get_spark(
    app: str = "paceline", master: str | None = None, shuffle_partitions: int | None = None, checkpoint_dir: str | None = None
) -> SparkSession:
    """A session with the settings the operators rely on.

    UTC keeps lenient timestamp parsing exact; AQE re-plans joins, coalesces
    small shuffle partitions and splits skewed ones. ``checkpoint_dir`` names a folder all executors share.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it knows it."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that is no longer needed."""
    fs, hadoop_path = file_system(spark, path)
    fs.delete(hadoop_path, True)


def own_place(spark: SparkSession, name: str) -> str:
    """A new path ``name`` in a folder of its own below the shared one, which goes away with the session."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, hadoop_path = file_system(spark, folder)
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return f"{folder}/{name}"


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that ``cut`` made and nobody reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    Cuts the lineage so that a lost executor costs no recomputation, and, being a
    columnar table, later passes read only the columns they use. The table goes away
    with the ``scratch`` scope it was made in, else with the session.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/paceline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, hadoop_path = file_system(spark, path)
    fs.deleteOnExit(hadoop_path)
    if (made := _scratch.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving all tables that ``cut`` made inside; a result is handed out with ``keep``."""
    made: list[str] = []
    token = _scratch.set(made)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in made:
            remove(spark, path)


def side_by_side(jobs: Sequence[Callable[[], T]], parallel: int = 8) -> list[T]:
    """Results of independent jobs that share the cluster, in order; they stay in the present ``scratch`` scope."""
    with ThreadPoolExecutor(parallel) as pool:
        running = [pool.submit(copy_context().run, job) for job in jobs]
        return [r.result() for r in running]


def keep(df: DataFrame) -> DataFrame:
    """``cut`` whose table outlives the present scope: it lasts as long as the session."""
    token = _scratch.set(None)
    try:
        return cut(df)
    finally:
        _scratch.reset(token)
