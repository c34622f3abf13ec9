"""Structured Streaming variants of the incremental steps.

Each runs with ``availableNow`` for the daily build, or continuously."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import upsert
from ..operators.windows import recent_history


def generations(stream: DataFrame, table: str, checkpoint: str, step: Callable[[DataFrame, DataFrame], DataFrame]) -> StreamingQuery:
    """Carry a Parquet table through micro-batches: ``step(current, batch)`` is the full next
    state, written to a new folder and then published by a row of the pointer.  A batch
    that this checkpoint has published already is skipped, so that a retry changes nothing;
    another checkpoint goes on from the current generation."""

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if not _published(spark, table).filter((F.col("writer") == checkpoint) & (F.col("epoch") == epoch)).count():
            current = read_current(spark, table) if latest(spark, table) else batch.limit(0)
            _publish(step(current, batch), table, checkpoint, epoch)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, key: str = "source_uid") -> StreamingQuery:
    """Upsert each micro-batch into a table of generations."""
    return generations(stream, table, checkpoint, lambda current, batch: upsert(current, batch, key))


def history_stream(stream: DataFrame, table: str, checkpoint: str, keep: int = 90) -> StreamingQuery:
    """Append feed counts to a history: a later entry of a day overwrites, and each feed's
    last ``keep`` days are retained."""
    return generations(stream, table, checkpoint, lambda current, batch: recent_history(current.unionByName(batch), keep))


def refresh(df: DataFrame, table: str) -> DataFrame:
    """Replace a derived table: the next generation is written whole, then published."""
    _publish(df, table, "refresh", -1)
    return read_current(df.sparkSession, table)


def _publish(df: DataFrame, table: str, writer: str, epoch: int) -> None:
    spark, now, gen = df.sparkSession, latest(df.sparkSession, table), f"gen-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{gen}")
    row = [((now[0] if now else 0) + 1, gen, writer, epoch)]
    spark.createDataFrame(row, _POINTER).coalesce(1).write.mode("append").json(f"{table}/pointer")


_POINTER = "seq long, gen string, writer string, epoch long"


def _published(spark: SparkSession, table: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/pointer")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _POINTER)
    return spark.read.schema(_POINTER).json(f"{table}/pointer")


def latest(spark: SparkSession, table: str) -> tuple[int, str] | None:
    """Number and folder of the generation that is current, None before the first."""
    row = _published(spark, table).agg(F.max(F.struct("seq", "gen")).alias("m")).first()["m"]
    return (row["seq"], row["gen"]) if row else None


def read_current(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(f"{table}/{latest(spark, table)[1]}")


def first_seen(stream: DataFrame, delay: str = "24 hours") -> DataFrame:
    """The first row of each uid, late rows up to ``delay`` included; state is dropped after it."""
    return stream.withWatermark("start_time", delay).dropDuplicatesWithinWatermark(["source_uid"])


def hourly_counts(stream: DataFrame, delay: str = "24 hours") -> DataFrame:
    """Events by hour and city, final once the watermark has passed."""
    return (
        stream.withWatermark("start_time", delay)
        .groupBy(F.window("start_time", "1 hour").alias("w"), "city").agg(F.count("*").alias("events"))
        .select(F.col("w.start").alias("hour"), "city", "events")
    )


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is available into Parquet files and read them back."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is available into an in-memory table (for tests and small reports)."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
