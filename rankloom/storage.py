"""Tables in the folder that all executors share, to cut the lineage of loops."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; set here only where it is unset: a temporary folder on a local master, else below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_rankloom_tables", None)
    if not root:
        local = spark.sparkContext.master.startswith("local")
        root = "file://" + tempfile.mkdtemp(prefix="rankloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_rankloom"
        spark._rankloom_tables = root
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a path and all below it, in whatever store it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def length(spark: SparkSession, path: str) -> int:
    """Bytes of a file, in whatever store it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).getLen()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_remove)
    _MADE.append((spark, path))
    return path


def _remove() -> None:
    for spark, path in _MADE:
        if spark.sparkContext._jsc is not None:
            delete(spark, path)
        elif path.startswith("file:"):  # the session ended first
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows of ``df``, written and read again, and where they lie. A lost executor loses none of them; the end of the driver removes them."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
