"""Scratch tables below ``spark.checkpoint.dir``, which driver and executors share.

Only where that setting is missing in local mode, as in unit tests, a folder of our own
is made; on a cluster its lack is an error."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()

#: Folders of the scratch tables written so far and not yet deleted.
written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The application's scratch folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/eventloom-{spark.sparkContext.applicationId}"
    if path not in _made:
        _made.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    """Delete the application's scratch folder when Python ends."""
    try:
        _delete(spark, path)
    except Exception:  # the JVM may have gone before us; the folder is scratch
        pass


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the scratch folder that is not in use."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: lineage is cut, row ids stay
    fixed, and a lost executor costs a read, not a recomputation."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in folders:
        _delete(spark, path)
        written.remove(path)
