"""The stored events as Parquet by uid bucket: a write replaces only the buckets it touches.

A version of the table lists the folders that hold it: one for each bucket that has rows,
one for the curators' overrides.  It is published whole, by renaming a file to the next
number, which one of several writers can do; the others apply their rows to the version
that won.  Folders of a write that was lost stay unread."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize
from .store import apply_overrides, reattach_overrides, upsert

KEY = "source_uid"
Version = dict[str, str]


class LostRace(Exception):
    """Other writers were first as often as allowed."""


def bucket(buckets: int) -> Column:
    """The bucket of a row by its uid; rows without one are spread by their id."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(KEY), F.col("id").cast("string"))), F.lit(buckets)).cast("int")


def version(spark: SparkSession, table: str) -> tuple[int, Version]:
    """Number and folders of the current version; (0, {}) before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    last = max((n for n in names if n.isdigit()), default=None)
    if last is None:
        return 0, {}
    return int(last), json.loads(spark.read.text(f"{table}/versions/{last}", wholetext=True).first()[0])


def publish(spark: SparkSession, table: str, number: int, folders: Version) -> bool:
    """Make ``folders`` version ``number``, unless another writer has."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    draft, name = hadoop.Path(f"{table}/versions/draft-{uuid.uuid4().hex}"), hadoop.Path(f"{table}/versions/{number:012d}")
    fs = name.getFileSystem(conf)
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(folders).encode()))
    out.close()
    keep = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    keep[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(name.toUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(name), keep)
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if not error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise
        return False
    return True


def events(spark: SparkSession, table: str) -> DataFrame:
    return _rows(spark, version(spark, table)[1])


def overrides(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(version(spark, table)[1]["overrides"])


def _rows(spark: SparkSession, folders: Version, only: set[str] | None = None) -> DataFrame:
    schema = spark.read.parquet(folders["schema"]).schema
    paths = [p for b, p in folders.items() if b.isdigit() and (only is None or b in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write(rows: DataFrame, table: str, buckets: int) -> Version:
    """Write rows by bucket into a new folder; the folders of the buckets that have rows."""
    path, spark = f"{table}/data/{uuid.uuid4().hex}", rows.sparkSession
    rows.withColumn("bucket", bucket(buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    made = [f.getPath().getName() for f in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    return {n.removeprefix("bucket="): f"{path}/{n}" for n in made if n.startswith("bucket=")}


def _single(df: DataFrame, table: str, kind: str) -> Version:
    path = f"{table}/{kind}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return {kind: path}


def create(rows: DataFrame, curated: DataFrame, table: str, buckets: int = 256) -> None:
    """The first version: ``rows`` with the overrides applied, the overrides on their events."""
    folders = _write(apply_overrides(rows, curated).select(rows.columns), table, buckets)
    folders |= _single(rows.limit(0), table, "schema") | _single(reattach_overrides(curated, rows).select(curated.columns), table, "overrides")
    if not publish(rows.sparkSession, table, 1, folders | {"buckets": str(buckets)}):
        raise LostRace(f"{table} exists")


def write(incoming: DataFrame, table: str, attempts: int = 5) -> int:
    """Upsert full rows by uid, the number of the version that has them.

    Rows without uid are dropped, the first of a repeated uid wins (start, then id).  In the
    same version the curators' categories are applied to the buckets written, and the
    overrides follow their uid to its new event.  Only touched buckets are read and
    written; without rows nothing is published."""
    spark = incoming.sparkSession
    number, folders = version(spark, table)
    buckets, names = int(folders["buckets"]), _rows(spark, folders).columns
    rows = incoming.filter(F.trim(F.col(KEY)) != "").select(names)
    rows = materialize(upsert(rows.limit(0), rows).select(names), "upsert")
    touched = {str(r[0]) for r in rows.select(bucket(buckets)).distinct().collect()}  # at most one a bucket
    for _ in range(attempts if touched else 0):
        before = _rows(spark, folders, touched)
        kept = before.join(rows.select(KEY), KEY, "left_anti").select(names)
        curated = spark.read.parquet(folders["overrides"])
        after = apply_overrides(kept.unionByName(rows), curated).select(names)
        new = {b: p for b, p in folders.items() if b not in touched} | _write(after, table, buckets)
        if not curated.join(rows.select(KEY), KEY, "left_semi").isEmpty():
            new |= _single(reattach_overrides(curated, rows).select(curated.columns), table, "overrides")
        if publish(spark, table, number + 1, new):
            return number + 1
        number, folders = version(spark, table)
    if touched:
        raise LostRace(f"{attempts} versions of {table} came first")
    return number
