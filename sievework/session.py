"""Session helpers: table access and lineage cuts that survive executor loss."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that Python tasks can import it there."""
    context = spark.sparkContext
    if getattr(context, "_sievework_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="sievework-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = Path(__file__).parent
    context.addPyFile(shutil.make_archive(f"{folder}/sievework", "zip", package.parent, package.name))
    context._sievework_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the directory ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, where that setting is unset (tests), a temporary folder is made and entered as the checkpoint
    folder of this session; it is removed when the process ends. On a cluster an unset folder raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="sievework-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage and keep partitions and row order: a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_PATHS: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the tables this session wrote into the shared folder; results that read them must be done with."""
    while _PATHS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_PATHS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage through a written Parquet table in the shared folder (compact; partitions may change).

    The shuffle files of the write are deleted at its end; else they stay until the driver collects its garbage.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _PATHS.remove(df._written)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table an operator persists itself."""
    _PATHS.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def task_count(spark: SparkSession) -> int:
    """Tasks of a shuffle as the session is set."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
