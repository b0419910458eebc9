"""Session helpers: the shared folder, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.config import ConfigurationError

#: A side is broadcast only if it was counted and its rows times width stay below this.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder of
    its own (tests); a cluster is refused, since its executors share no such folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ConfigurationError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="groundline-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return bool(files.exists(at))


def home(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared folder; it is deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/groundline/{spark.sparkContext.applicationId}"
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a table written to the shared folder; survives the loss of executors.

    The tables of an application lie in one folder, which is deleted when the application ends.
    """
    spark = df.sparkSession
    path = f"{home(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds, if it is there."""
    files, at = _files(spark, path)
    files.delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and nothing reads any more."""
    delete(df.sparkSession, df.written_to)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of what has ended: Spark keeps them until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only where the counted size has a proven bound; else leave the join to shuffle."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def table(spark: SparkSession, folder: str, name: str, *columns: str, busy: bool = False) -> DataFrame:
    """A table of a folder, or some of its columns.

    ``busy``: what follows is bound by the CPU, so an input of fewer splits than there are cores (a few small files) is
    dealt out to all of them; a larger input is left in its own splits and is not shuffled.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if busy and df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once a session, for those that don't have it on their path."""
    import os
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_groundline_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="groundline-pkg-"), "groundline.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "groundline")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(target)
    context._groundline_shipped = True
