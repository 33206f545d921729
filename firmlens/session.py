"""Session settings and the shared folder for checkpoints and staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own_folders: dict[str, str] = {}


def local_session(cores: str = "8", app: str = "firmlens", folder: str | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own. ``folder`` becomes spark.checkpoint.dir."""
    builder = SparkSession.builder.config("spark.checkpoint.dir", folder) if folder else SparkSession.builder
    return (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session (tests, bench) without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="firmlens-")
    return _own_folders[app]


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one staged table of this application."""
    return f"{staging_root(spark)}/{uuid.uuid4().hex}/{name}"


def staging_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/staged/{spark.sparkContext.applicationId}"


def drop_staged(spark: SparkSession) -> None:
    """Remove what this application has staged; only when no result of it will be read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(staging_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and go on from that table.

    Unlike ``checkpoint`` this does not compute the rows a second time, and the
    result survives the loss of any executor.
    """
    path = staging_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
