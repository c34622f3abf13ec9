"""Total orders of listings.  Text order is by the Unicode collation, ids break ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def client_order() -> list[Column]:
    """Start, clustered before single, cluster, title as people sort it."""
    return [F.col("start_time"), F.col("cluster_id").isNull(), F.col("cluster_id"), F.collate("title", "UNICODE"), F.col("id")]


def legacy_order() -> list[Column]:
    """Whole days first, then by time of day."""
    return [F.to_date("start_time"), (~F.coalesce(F.col("all_day"), F.lit(False))), F.date_format("start_time", "HH:mm"), F.col("id")]


def severity_order(severity: Column, seq: Column) -> list[Column]:
    """high, medium, low, info, others; stable."""
    rank = F.when(severity == "high", 0).when(severity == "medium", 1).when(severity == "low", 2).when(severity == "info", 3).otherwise(4)
    return [rank, seq]


def problems(issues: DataFrame) -> DataFrame:
    return issues.orderBy(*severity_order(F.col("severity"), F.col("seq")))


def prune_anomalies(anomalies: DataFrame, cities: DataFrame, today: Column, days: int = 180) -> DataFrame:
    """Anomalies of known cities within ``days``; one for each city, feed, kind and day."""
    kept = anomalies.join(cities.select("city").distinct(), "city", "left_semi")
    return kept.filter(F.col("date") >= F.date_sub(today, days)).dropDuplicates(["city", "feed", "anomaly", "date"])


def with_enrichments(events: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Feed events and virtual events in one listing; columns that one side lacks are null."""
    return events.unionByName(occurrences, allowMissingColumns=True)


def repro_commands(feeds: DataFrame) -> DataFrame:
    """(city, name, command): how to run one feed again."""
    fetch = F.concat(F.lit("curl -sL '"), F.col("url"), F.lit("'"))
    made = F.when((F.col("feed_type") == "scraper") & (F.trim(F.coalesce("scraper_cmd", F.lit(""))) != ""), F.trim("scraper_cmd")).otherwise(fetch)
    return feeds.select("city", "name", "url", made.alias("command"))
