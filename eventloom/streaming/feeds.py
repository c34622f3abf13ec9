"""Memory that feeds carry from build to build: anomalies against the last good count, their
log with its retention, and the dates of the items that a city's feed lists as new."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.windows import top_per_group
from ..scratch import materialize
from .jobs import generations

#: Days for which an anomaly stays in the log, items of a feed of new items, least count and share of a drop.
ANOMALY_DAYS, LATEST_ITEMS, MIN_EVENTS, DROP = 180, 100, 5, 0.5

ANOMALY = "city string, feed string, date date, previous int, count int, anomaly string"
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LastGood(StatefulProcessor):
    """Per feed: its newest day (date, count, whether it had no error), the last good count
    before that day, and the kinds of anomaly that the day has given already."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("good", "date date, n int, ok boolean, before int, kinds string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        day, n, ok, before, kinds = self.state.get() or (None, None, False, None, "")
        for r in sorted((r for r in rows if r["date"] is not None), key=lambda r: (r["date"], -1 if r["seq"] is None else r["seq"])):
            if day is not None and r["date"] < day:
                continue
            previous = n if ok else before
            if r["date"] != day:
                before, kinds = previous, ""
            kind = _kind(previous, r["count"])
            if kind and kind not in kinds.split(","):
                kinds = f"{kinds},{kind}"
                yield Row(city=key[0], feed=key[1], date=r["date"], previous=previous, count=r["count"], anomaly=kind)
            day, n, ok = r["date"], r["count"], r["error"] is None and r["count"] is not None
        if day is not None:
            self.state.update((day, n, ok, before, kinds))

    def close(self) -> None:
        pass


def _kind(previous: int | None, count: int | None) -> str | None:
    if not previous or count is None:
        return None
    if count == 0:
        return "zero_events"
    return "significant_drop" if previous >= MIN_EVENTS and previous - count >= DROP * previous else None


def anomalies(history: DataFrame) -> DataFrame:
    """Anomalies of a stream of feed counts (city, feed, date, count, error, seq), each once a
    day, feed and kind.  A later entry of a day (by ``seq``) is compared with the day's entry
    before it and replaces it; entries of a day before the feed's newest are ignored, as are
    those without a date.  State is one row a feed."""
    by_feed = history.select("city", "feed", "date", F.col("count").cast("int").alias("count"), "error", "seq").groupBy("city", "feed")
    return by_feed.transformWithState(LastGood(), ANOMALY, "Append", "None")


def pruned_log(log: DataFrame, new: DataFrame, today: Column, keep: int = ANOMALY_DAYS) -> DataFrame:
    """The log with new anomalies, without repeated ones and those of over ``keep`` days ago."""
    rows = log.unionByName(new).filter(F.col("date") >= F.date_sub(today, keep))
    return rows.dropDuplicates(["city", "feed", "date", "anomaly"])


def anomaly_log(history: DataFrame, table: str, checkpoint: str, today: Column, keep: int = ANOMALY_DAYS, partitions: int = 16) -> StreamingQuery:
    """Carry the log of anomalies in a table of generations.  ``partitions`` holds for the
    feeds' state, from the first run on; each is a store of its own, and a feed is one row."""
    conf, settings = history.sparkSession.conf, {_STORE[0]: _STORE[1], "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: conf.get(k) for k in settings}
    try:  # a query takes the settings when it starts
        for k, v in settings.items():
            conf.set(k, v)
        return generations(anomalies(history), table, checkpoint, lambda log, new: pruned_log(log, new, today, keep))
    finally:
        for k, v in before.items():
            conf.set(k, v)


def latest_items(memory: DataFrame, build: DataFrame, limit: int = LATEST_ITEMS) -> DataFrame:
    """The memory (city, guid, start_time, pub_date) after a build (city, guid, start_time,
    built): all items of the build; ``pub_date`` is null where the feed does not list them.

    A listed item keeps its date; one that was not in the city's build before is dated now,
    as are all of a city without memory; the newest ``limit`` of a city stay listed, equal
    dates by start and guid.  An item that is cut is known and does not come back while its
    builds go on; one that was missing in a build is new again.  Repeated guids count once
    (earliest start), rows without city or guid go, cities without rows keep their memory."""
    items = build.filter("city is not null and guid is not null").groupBy("city", "guid").agg(F.min("start_time").alias("start_time"), F.max("built").alias("__built"))
    known = memory.select("city", "guid", F.col("pub_date").alias("__pub"), F.lit(True).alias("__known"))
    cities = memory.select("city").distinct().withColumn("__seen", F.lit(True))
    rows = items.join(known, ["city", "guid"], "left").join(cities, "city", "left")
    new = F.col("__seen").isNull() | F.col("__known").isNull()
    dated = rows.select("city", "guid", "start_time", F.coalesce("__pub", F.when(new, F.col("__built"))).alias("pub_date"))
    listed = top_per_group(dated.filter("pub_date is not null"), ["city"], [F.desc("pub_date"), F.col("start_time"), F.col("guid")], limit)
    after = items.select("city", "guid", "start_time").join(listed.select("city", "guid", "pub_date"), ["city", "guid"], "left")
    others = memory.join(items.select("city").distinct(), "city", "left_anti")
    return after.unionByName(others.select("city", "guid", "start_time", "pub_date"))


def latest_stream(builds: DataFrame, table: str, checkpoint: str, limit: int = LATEST_ITEMS) -> StreamingQuery:
    """Carry the memory of new items through builds.  All rows of a build (one value of
    ``built``) come in one micro-batch; several builds of one batch are applied in order."""

    def step(current: DataFrame, batch: DataFrame) -> DataFrame:
        memory = current if "pub_date" in current.columns else current.select("city", "guid", "start_time", F.col("built").alias("pub_date"))
        rows = materialize(batch, "builds")
        stamps = [r["built"] for r in rows.filter("built is not null").select("built").distinct().sort("built").collect()]  # one a build
        for i, stamp in enumerate(stamps):
            memory = latest_items(memory if not i else materialize(memory, "memory"), rows.filter(F.col("built") == F.lit(stamp)), limit)
        return memory

    return generations(builds, table, checkpoint, step)
