"""Driver tables in calendar shape, for Spark and, as the same expressions, for DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# (column, Spark expression, DuckDB expression or None if the Spark text is valid there)
_CALENDAR = (
    ("id", "event_id", None),
    ("title", "concat(' ', upper(event_type), ' ')", None),
    ("start_time", "cast(date_trunc('hour', ts) as timestamp_ntz)", "date_trunc('hour', ts)"),
    ("end_time", "case when value > 30 then cast(date_trunc('hour', ts) as timestamp_ntz) + interval 1 hour end", "case when value > 30 then date_trunc('hour', ts) + interval 1 hour end"),
    ("location", "case when value > 50 then concat('loc', cast(user_id % 5 as string)) when value > 40 then 'src2 Hall, 12 Main Street, Davis, CA 95616' when value > 30 then 'Online via Zoom' end", None),
    ("description", "case when event_id % 3 = 0 then concat('Join us for ', event_type, ' by the river.') when event_id % 3 = 1 then '' end", None),
    ("url", "case when value > 20 then concat(case when event_id % 2 = 0 then 'http' else 'https' end, '://site', cast(user_id % 9 as string), '.example/20', cast(23 + event_id % 2 as string), '/0', cast(1 + event_id % 9 as string), '/', case when user_id % 9 = 4 then 'all' else cast(event_id as string) end) else '' end", None),
    ("city", "concat('city', cast(user_id % 3 as string))", None),
    ("source", "case when event_id % 101 = 0 then null when event_id % 97 = 0 then 'poster_capture' when event_id % 11 = 0 then concat('src', cast(user_id % 7 as string), ', src2,  src', cast(event_id % 7 as string)) else concat('src', cast(user_id % 7 as string)) end", None),
    ("source_id", "concat('feed', cast(user_id % 5 as string))", None),
    ("source_uid", "case when event_id % 13 <> 0 then concat('u', cast(event_id % 997 as string)) end", None),
    ("category", "case event_id % 5 when 0 then 'Music / Concerts' when 1 then 'Film / Cinema' when 2 then 'Comedy / Improv' when 3 then '' end", None),
    ("image_url", "case when event_id % 2 = 0 then concat('https://img/', cast(event_id as string)) end", None),
    ("all_day", "event_id % 10 = 0", None),
    ("created_at", "ts", None),
)


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def calendar_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(*[f"{e} as {c}" for c, e, _ in _CALENDAR])


CALENDAR_SQL = "SELECT " + ", ".join(f"{(d or e).replace('as string', 'as varchar')} AS {c}" for c, e, d in _CALENDAR) + " FROM events"

_HISTORY = (
    "SELECT concat('city', cast(user_id % 3 as {s})) AS city, concat('feed', cast(user_id % 5 as {s})) AS feed, "
    "cast(ts as date) AS date, cast(CASE WHEN extract(day from min(ts)) % 7 < 2 THEN 0 ELSE count(*) % 13 END as int) AS count, "
    "CASE WHEN extract(day from min(ts)) % 11 = 0 THEN 'timeout' END AS error, max(event_id) AS seq FROM {t} "
    "GROUP BY concat('city', cast(user_id % 3 as {s})), concat('feed', cast(user_id % 5 as {s})), cast(ts as date)"
)


def feed_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_HISTORY.format(s="string", t="{events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


HISTORY_SQL = _HISTORY.format(s="varchar", t="events")

_FEEDS = (
    "SELECT s_suppkey AS id, concat('city', cast(s_nationkey % 3 as {s})) AS city, "
    "CASE WHEN s_suppkey % 2 = 0 THEN concat('scrapers/s', cast(s_suppkey as {s}), '.py') ELSE concat('https://cal', cast(s_suppkey as {s}), '.example/feed.ics') END AS url, "
    "concat('src', cast(s_suppkey % 7 as {s})) AS name, "
    "CASE WHEN s_suppkey % 5 = 0 THEN 'removed' WHEN s_suppkey % 5 = 1 THEN 'pending' ELSE 'active' END AS status, "
    "CASE WHEN s_suppkey % 2 = 0 THEN 'scraper' ELSE 'ics_url' END AS feed_type, "
    "CASE WHEN s_suppkey % 6 = 0 THEN ' ' WHEN s_suppkey % 6 = 2 THEN 'bash x.sh' WHEN s_suppkey % 2 = 0 THEN concat('python scrapers/s', cast(s_suppkey as {s}), '.py --output out.ics') END AS scraper_cmd "
    "FROM {t}"
)


def feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_FEEDS.format(s="string", t="{supplier}"), supplier=spark.read.parquet(f"{sf_dir}/supplier.parquet"))


FEEDS_SQL = _FEEDS.format(s="varchar", t="supplier")
