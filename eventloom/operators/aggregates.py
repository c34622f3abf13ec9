"""Counts for the client and the health report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CATEGORIES
from ..functions.text import blank, source_list
from ..functions.urls import host
from .filters import visible


def source_names(events: DataFrame) -> DataFrame:
    """(city, name, event_count): distinct events per comma-separated name."""
    name = F.explode(F.transform(F.split("source", ","), lambda s: F.trim(s))).alias("name")
    rows = events.select("city", "id", name).filter("name <> ''")
    return rows.groupBy("city", "name").agg(F.countDistinct("id").alias("event_count"))


def source_counts(events: DataFrame) -> DataFrame:
    """(source, count) over each event's distinct names, ``Unknown`` without any."""
    names = source_list(F.when(blank(F.col("source")) == "", "Unknown").otherwise(F.col("source")))
    return events.select(F.explode(names).alias("source")).groupBy("source").agg(F.count("*").alias("count"))


def visible_source_counts(events: DataFrame, hidden: Column, aggregators: Column) -> DataFrame:
    """(source, count, total, hidden_via_aggregator); hidden sources keep a row."""
    src = F.when(blank(F.col("source")) == "", "Unknown").otherwise(F.col("source"))
    names = source_list(src)
    via = F.exists(names, lambda s: F.array_contains(hidden, s) & F.array_contains(aggregators, s))
    rows = events.select(via.alias("via"), visible(src, hidden, aggregators).alias("seen"), F.explode(names).alias("source"))
    return rows.groupBy("source").agg(
        F.count_if("seen").alias("count"), F.count("*").alias("total"), F.count_if("via").alias("hidden_via_aggregator")
    )


def category_counts(events: DataFrame) -> DataFrame:
    """(place, category, count) of the configured categories that occur, in their order."""
    order = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    return (
        events.filter(F.col("category").isin(*CATEGORIES))
        .groupBy("category").agg(F.count("*").alias("count"))
        .select(order.alias("place"), "category", "count")
    )


def category_breakdown(events: DataFrame) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("category"), F.lit("")), F.lit("(uncategorized)"))
    return events.groupBy(name.alias("category")).agg(F.count("*").alias("count"))


def url_quality(events: DataFrame) -> DataFrame:
    """(city, total_events, total_with_url, unique_urls, http_count, http_domains, generic_count)."""
    rows = events.withColumn("url", blank(F.col("url"))).withColumn("domain", host(F.col("url")))
    have = F.col("url") != ""
    http = F.startswith("url", F.lit("http://"))
    per_domain = (
        rows.filter(have).groupBy("city", "domain").agg(F.count("*").alias("n"), F.countDistinct("url").alias("u"))
        .groupBy("city").agg(F.coalesce(F.sum(F.when((F.col("u") == 1) & (F.col("n") > 5), F.col("n"))), F.lit(0)).alias("generic_count"))
    )
    return (
        rows.groupBy("city").agg(
            F.count("*").alias("total_events"), F.count_if(have).alias("total_with_url"),
            F.countDistinct(F.when(have, F.col("url"))).alias("unique_urls"), F.count_if(http).alias("http_count"),
            F.countDistinct(F.when(http, F.col("domain"))).alias("http_domains"),
        )
        .join(per_domain, "city", "left").withColumn("generic_count", F.coalesce("generic_count", F.lit(0)))
    )


def source_specificity(events: DataFrame, top: int = 15) -> DataFrame:
    """(source, events, unique_urls, specificity_pct) of the sources with most URLs."""
    rows = events.filter(blank(F.col("url")) != "").groupBy(F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("(none)")).alias("source"))
    counted = rows.agg(F.count("*").alias("events"), F.countDistinct("url").alias("unique_urls"))
    pct = F.bround(F.col("unique_urls") / F.col("events") * 100).cast("long").alias("specificity_pct")
    return counted.select("source", "events", "unique_urls", pct).orderBy(F.desc("events"), "source").limit(top)


def image_coverage(events: DataFrame) -> DataFrame:
    """(source, total, with_image) of the sources that have images."""
    name = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("(none)")).alias("source")
    counted = events.groupBy(name).agg(F.count("*").alias("total"), F.count_if(blank(F.col("image_url")) != "").alias("with_image"))
    return counted.filter("with_image > 0")


def future_counts(parsed: DataFrame, now: Column) -> DataFrame:
    """(file, future): unparseable dates count as future."""
    return parsed.groupBy("file").agg(F.count_if(F.coalesce(F.col("dtstart") >= now, F.lit(True))).alias("future"))


def tzid_inventory(vevents: DataFrame, city_zone: Column) -> DataFrame:
    """(city, tzid, count, files, sample_files, matches_city) over raw DTSTART lines."""
    kind = (
        F.when(F.col("tzid") != "", F.col("tzid"))
        .when(F.col("value").rlike(r"^\d{8}T\d{6}Z$"), "UTC (Z suffix)")
        .when(F.col("value").rlike(r"^\d{8}T\d{6}$"), "(bare)")
    )
    rows = vevents.withColumn("kind", kind).filter("kind is not null")
    by_file = rows.groupBy("city", F.col("kind").alias("tzid"), "file").agg(F.count("*").alias("n"))
    first = by_file.withColumn("place", F.row_number().over(Window.partitionBy("city", "tzid").orderBy("file"))).filter("place <= 5")
    samples = first.groupBy("city", "tzid").agg(F.array_sort(F.collect_list("file")).alias("sample_files"))
    made = by_file.groupBy("city", "tzid").agg(F.sum("n").alias("count"), F.count("file").alias("files"))
    made = made.join(samples.select(F.col("city").alias("c"), F.col("tzid").alias("t"), "sample_files"), F.col("city").eqNullSafe(F.col("c")) & (F.col("tzid") == F.col("t")))
    return made.select("city", "tzid", "count", "files", "sample_files", (F.col("tzid") == city_zone).alias("matches_city"))


def status_counts(rows: DataFrame, key: str = "city", statuses: tuple[str, ...] = ("active", "pending", "removed")) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def validation_summary(issues: DataFrame) -> DataFrame:
    return issues.rollup("city").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))


def timezone_anomalies(events: DataFrame, hour: Column, offset_hours: int, top: int = 5) -> DataFrame:
    """(city, source, total, count): sources whose timed events sit in the small hours and
    would sit in the day with the city's offset undone."""
    shifted = F.pmod(hour - offset_hours, F.lit(24))
    odd = (hour >= 0) & (hour < 5)
    stats = events.filter(~F.coalesce(F.col("all_day"), F.lit(False))).groupBy("city", "source").agg(
        F.count("*").alias("total"), F.count_if(odd).alias("count"), F.count_if(odd & shifted.between(8, 18)).alias("daytime")
    )
    return stats.filter("total >= 3 and count >= 2 and daytime >= count * 0.7").select("city", "source", "total", "count")


def platform_summary(feeds: DataFrame) -> DataFrame:
    """(platform, feeds, cities) of feeds with a platform."""
    return feeds.filter("platform <> 'skip'").groupBy("platform").agg(F.count("*").alias("feeds"), F.array_join(F.array_sort(F.collect_set("city")), ", ").alias("cities"))


def snippet_coverage(events: DataFrame, snippet: str = "snippet") -> DataFrame:
    with_ = F.count_if(F.col(snippet).isNotNull())
    return events.groupBy("city").agg(F.count("*").alias("total"), with_.alias("with_snippet"), F.bround(with_ * 100.0 / F.count("*"), 1).alias("pct"))


def day_range(events: DataFrame, base: Column) -> DataFrame:
    """(first, last) day offsets; [0, 90] without events."""
    off = F.datediff("start_time", base)
    return events.agg(F.coalesce(F.min(off), F.lit(0)).alias("first_day"), F.coalesce(F.max(off), F.lit(90)).alias("last_day"))


def cities(events: DataFrame) -> DataFrame:
    return events.select("city").distinct()


def geo_summary(dropped: DataFrame, keep: int = 3) -> DataFrame:
    """(source, source_id, location, count, titles): what the geo filter dropped, with the first titles."""
    key = ["source", "source_id", "location"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("pos", "title"))
    first = dropped.select(*key, "pos", "title", place.alias("place")).filter(F.col("place") <= keep)
    titles = F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"])
    shown = first.groupBy(*[F.col(c).alias(f"k_{c}") for c in key]).agg(titles.alias("titles"))
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in key]
    return dropped.groupBy(*key).agg(F.count("*").alias("count")).join(shown, same).select(*key, "count", "titles")
