"""Session defaults and the shared work folder."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lumenary")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to executors that don't share the driver's folders; `--py-files` does the same."""
    root = os.path.dirname(os.path.abspath(__file__))
    held = tempfile.mkdtemp(prefix="spark-")
    archive = shutil.make_archive(os.path.join(held, "lumenary"), "zip", os.path.dirname(root), os.path.basename(root))
    spark.sparkContext.addPyFile(archive)


_shipped: set[str] = set()


def shipped(fn: Callable) -> Callable:
    """The query, with the package sent to the workers of its session first, once for each application."""

    @functools.wraps(fn)
    def run(spark: SparkSession, *args):
        if spark.sparkContext.applicationId not in _shipped:
            ship_package(spark)
            _shipped.add(spark.sparkContext.applicationId)
        return fn(spark, *args)

    return run


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`.

    Only a session whose executors are this process may leave it unset, as tests do: it gets a folder of its
    own. On a cluster a missing folder is an error, since files of one machine are not seen by the others.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not is_single_process(sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def is_single_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def work_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; survives executor loss, unlike a cached block."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back column by column.

    For results that several branches of a plan read, so that wide text behind them is read once.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the group keys with the configured number of partitions.

    Groups that are small in bytes but heavy in arithmetic must not be merged into few tasks, which
    is what the size-driven coalescing would do.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)
