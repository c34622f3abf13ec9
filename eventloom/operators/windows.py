"""Order-dependent reports over feed histories, and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FEED = ("city", "feed")


def feed_anomalies(history: DataFrame, min_events: int = 5, drop: float = 0.5) -> DataFrame:
    """(city, feed, date, previous, count, anomaly): against the last observation without
    an error, zero days included."""
    before = Window.partitionBy(*_FEED).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("error").isNull(), F.col("count")), ignorenulls=True).over(before)
    rows = history.withColumn("previous", prev)
    lost = (F.col("previous") - F.col("count")) / F.col("previous")
    kind = F.when((F.col("count") == 0) & (F.col("previous") > 0), "zero_events").when(
        (F.col("previous") >= min_events) & (F.col("count") < F.col("previous")) & (lost >= drop), "significant_drop"
    )
    return rows.withColumn("anomaly", kind).filter("anomaly is not null").select(*_FEED, "date", "previous", "count", "anomaly")


def silent_feeds(history: DataFrame) -> DataFrame:
    """(city, feed, was, was_date, silent_since): feeds whose last entry is an error-free
    zero; since when, and their last count above zero.  One aggregate, no window."""
    zero = (F.col("count") == 0) & (F.coalesce(F.col("error"), F.lit("")) == "")
    whole = history.groupBy(*_FEED).agg(
        F.max("date").alias("last"), F.max(F.when(zero, F.col("date"))).alias("last_zero"),
        F.max(F.when(~zero, F.col("date"))).alias("broken"),
        F.max_by(F.when(F.col("count") > 0, F.col("count")), F.when(F.col("count") > 0, F.col("date"))).alias("was"),
        F.max(F.when(F.col("count") > 0, F.col("date"))).alias("was_date"),
    )
    quiet = whole.filter("last = last_zero")
    since = (
        history.join(quiet.select(*_FEED, "broken"), list(_FEED)).filter("broken is null or date > broken")
        .groupBy(*_FEED).agg(F.min("date").alias("silent_since"))
    )
    return quiet.select(*_FEED, "was", "was_date").join(since, list(_FEED))


def recent_history(history: DataFrame, keep: int = 90) -> DataFrame:
    """The last entries of each feed; the latest entry of a day overwrites earlier ones."""
    day = Window.partitionBy(*_FEED, "date").orderBy(F.desc("seq"))
    once = history.withColumn("__n", F.row_number().over(day)).filter("__n = 1")
    latest = Window.partitionBy(*_FEED).orderBy(F.desc("date"))
    return once.withColumn("__n", F.row_number().over(latest)).filter(F.col("__n") <= keep).drop("__n")


def collapse_long_running(events: DataFrame, today: Column, minimum: int = 5, by: tuple[str, ...] = ("city",)) -> DataFrame:
    """Events with the same title, place and time of day at least ``minimum`` times in a city keep
    the first of each 7 days from today, flagged; others stay.  A table of one city without
    that column takes ``by=()``."""
    lower = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    key = {"__t": lower("title"), "__l": lower("location"), "__h": F.coalesce(F.date_format("start_time", "HH:mm"), F.lit(""))}
    key |= {f"__{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by}
    rows = events.withColumns(key).withColumn("__w", F.floor(F.datediff("start_time", today) / 7))
    # both aggregates combine on the map side, so that an event repeated for ever is no hot window; only
    # ids go through the second one, and the rows come back by their id
    counts = rows.groupBy(*key).agg((F.count("*") >= minimum).alias("is_recurring"))
    marked = rows.join(counts, list(key))
    first = F.min_by("id", F.struct("start_time", "id")).alias("id")
    weekly = marked.filter("is_recurring").groupBy(*key, "__w").agg(first).select("id")
    every = [*events.columns, "is_recurring"]
    kept = marked.filter("is_recurring").select(every).join(weekly, "id", "left_semi")
    return marked.filter("not is_recurring").select(every).unionByName(kept)


def build_delta(builds: DataFrame) -> DataFrame:
    """(city, generated, total, previous, delta) of successive builds."""
    prev = F.lag("total").over(Window.partitionBy("city").orderBy("generated"))
    return builds.select("city", "generated", "total", prev.alias("previous")).withColumn("delta", F.col("total") - F.col("previous"))


def page(rows: DataFrame, order: list[Column], start: int, size: int = 50) -> DataFrame:
    """One page of a listing; pages overlap by one row (see ``next_start``)."""
    return rows.orderBy(*order).offset(max(0, start)).limit(size)


def next_start(start: int, size: int, total: int) -> int | None:
    return start + max(1, size - 1) if start + size < total else None


def few_shot(overrides: DataFrame, city: str, limit: int = 20) -> DataFrame:
    """Curated examples: the same city first, then the most recent; blank titles skipped."""
    rows = overrides.filter(F.trim(F.coalesce("event_title", F.lit(""))) != "")
    return rows.orderBy((F.col("event_city") == city).desc(), F.desc("created_at"), "event_id").limit(limit)


def new_and_ongoing(now: DataFrame, before: DataFrame, key: list[str]) -> DataFrame:
    """Issues with ``ongoing``: present in the previous build."""
    seen = before.select(*key).distinct().withColumn("__seen", F.lit(True))
    return now.join(seen, key, "left").withColumn("ongoing", F.coalesce("__seen", F.lit(False))).drop("__seen")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    by = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
