"""Registered queries of stored state: carried by streams, written by bucket, asked by SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import procedures
from ..operators import events_table
from ..scratch import materialize, new_folder
from ..streaming import feeds as feed_state
from ..streaming import jobs
from .adapter import calendar, feed_history, feeds
from .queries import _INCOMING, query


@query(
    ", w AS (SELECT *, last_value(CASE WHEN error IS NULL THEN count END IGNORE NULLS) OVER (PARTITION BY city, feed ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM hist), "
    "k AS (SELECT *, CASE WHEN count = 0 AND previous > 0 THEN 'zero_events' WHEN previous >= 5 AND count < previous AND (previous - count) / previous >= 0.5 THEN 'significant_drop' END AS anomaly FROM w) "
    "SELECT city, feed, date, previous, count, anomaly FROM k WHERE anomaly IS NOT NULL AND date >= DATE '2024-01-16'"
)
def i7_anomaly_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over the feeds' days, 14 days of anomalies kept."""
    history = materialize(feed_history(spark, sf_dir), "history")
    src, table, state = (new_folder(spark, f"anomalies-{x}") for x in ("in", "log", "state"))
    for days in ("date < DATE '2024-01-11'", "date >= DATE '2024-01-11' AND date < DATE '2024-01-21'", "date >= DATE '2024-01-21'"):
        history.filter(days).write.mode("append").parquet(src)
        stream = spark.readStream.schema(history.schema).parquet(src)
        feed_state.anomaly_log(stream, table, state, F.expr("DATE '2024-01-30'"), 14, 4).awaitTermination()
    return jobs.read_current(spark, table)


_STAMPS = [f"TIMESTAMP{{}} '2024-01-0{5 + k} 06:00:00'" for k in range(3)]
_ITEMS = "SELECT city, coalesce(source_uid, CAST(id AS {s})) AS guid, min(start_time) AS start_time, min(id) AS n FROM {t} GROUP BY 1, 2"
_build = lambda k: f"n % 3 <> {k} AND start_time >= DATE '2024-01-0{5 + k}'"


def _builds_sql() -> str:
    """The memory after three builds, one after the other."""
    steps = [f", items AS ({_ITEMS.format(s='VARCHAR', t='cal')})"]
    for k, stamp in enumerate(_STAMPS):
        old = f"LEFT JOIN m{k - 1} m USING (city, guid)" if k else ""
        pub = f"CASE WHEN m.pub_date IS NOT NULL THEN m.pub_date WHEN m.n IS NULL THEN {stamp.format('')} END" if k else stamp.format("")
        steps.append(f"d{k} AS (SELECT i.city, i.guid, i.start_time, i.n, {pub} AS pub_date FROM (SELECT * FROM items WHERE {_build(k)}) i {old})")
        place = "row_number() OVER (PARTITION BY city, pub_date IS NULL ORDER BY pub_date DESC, start_time, guid)"
        steps.append(f"m{k} AS (SELECT city, guid, start_time, n, CASE WHEN {place} <= 100 THEN pub_date END AS pub_date FROM d{k})")
    return ", ".join(steps) + " SELECT city, guid, start_time, pub_date FROM m2"


@query(_builds_sql())
def i6_latest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three builds: events come, go, come again, and pass."""
    items = materialize(spark.sql(_ITEMS.format(s="STRING", t="{cal}"), cal=calendar(spark, sf_dir)), "items")
    src, table, state = (new_folder(spark, f"latest-{x}") for x in ("in", "memory", "state"))
    for k, stamp in enumerate(_STAMPS):
        build = items.filter(_build(k)).select("city", "guid", "start_time", F.expr(stamp.format("_NTZ")).alias("built"))
        build.write.mode("append").parquet(src)
        feed_state.latest_stream(spark.readStream.schema(build.schema).parquet(src), table, state).awaitTermination()
    return jobs.read_current(spark, table)


_CURATED = "SELECT source_uid, id AS event_id, concat('c', CAST(id % 7 AS {s})) AS category, id AS created_at FROM {t} WHERE source_uid LIKE 'u1%'"
_FULL = _INCOMING.replace("source_uid FROM", "source_uid, 'new' AS category FROM")
_WRITTEN = (
    f", inc AS (SELECT * FROM ({_FULL}) WHERE coalesce(source_uid, '') <> '' QUALIFY row_number() OVER (PARTITION BY source_uid ORDER BY start_time, id) = 1), "
    f"cur AS ({_CURATED.format(s='VARCHAR', t='cal')}), ov AS (SELECT source_uid, arg_max(category, created_at) AS c FROM cur GROUP BY 1), "
)


@query(
    _WRITTEN + "n AS (SELECT id, title, start_time, city, source_uid, category FROM cal c WHERE NOT EXISTS (SELECT 1 FROM inc WHERE inc.source_uid = c.source_uid) "
    "UNION ALL SELECT id, title, start_time, city, source_uid, category FROM inc) SELECT id, title, start_time, city, n.source_uid, coalesce(c, category) AS category FROM n LEFT JOIN ov ON ov.source_uid = n.source_uid"
)
def i5_overridden_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events written over the table, the curators' last categories on all."""
    return events_table.events(spark, _written(spark, sf_dir))


@query(
    _WRITTEN + "f AS (SELECT source_uid, min(id) AS id FROM cal GROUP BY 1) SELECT cur.source_uid, coalesce(inc.id, f.id) AS event_id, cur.category, cur.created_at "
    "FROM cur LEFT JOIN inc ON inc.source_uid = cur.source_uid LEFT JOIN f ON f.source_uid = cur.source_uid"
)
def i5_reattached_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overrides after the same write, on the events that have their uid now."""
    return events_table.overrides(spark, _written(spark, sf_dir))


def _written(spark: SparkSession, sf_dir: str) -> str:
    table, now = new_folder(spark, "events-table"), calendar(spark, sf_dir).select("id", "title", "start_time", "city", "source_uid", "category")
    events_table.create(now, spark.sql(_CURATED.format(s="STRING", t="{cal}"), cal=now), table, 16)
    events_table.write(spark.sql(_FULL.replace("FROM cal", "FROM {cal}"), cal=now), table)
    return table


def _procedures(spark: SparkSession, sf_dir: str) -> None:
    cal = calendar(spark, sf_dir)
    procedures.register(spark, events=cal, feeds=feeds(spark, sf_dir), overrides=spark.sql(_CURATED.format(s="STRING", t="{cal}"), cal=cal))


_OF_CITY = "SELECT id, city, source, category, concat(city, source_uid) AS source_uid FROM {t}"
_LISTED = "(city = 'city0' AND id % 2 = 0) OR (city = 'city1' AND id % 7 = 0)"


@query(
    f", own AS ({_OF_CITY.format(t='cal').replace('concat(city, source_uid)', 'city || source_uid')}), inc AS (SELECT DISTINCT source_uid FROM own WHERE ({_LISTED}) AND source_uid IS NOT NULL), n AS (SELECT count(*) AS n FROM inc), "
    "g AS (SELECT city, count(*) AS events, count(*) FILTER (WHERE source_uid IS NOT NULL AND source_uid NOT IN (SELECT source_uid FROM inc)) AS gone FROM own GROUP BY city) "
    "SELECT city, events, CASE WHEN n = 0 OR (2 * gone > events AND n < gone) THEN 0 ELSE gone END AS deleted, n > 0 AND 2 * gone > events AND n < gone AS refused FROM g CROSS JOIN n"
)
def p1_delete_stale_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uids of a city's own; half of city 0, a part of city 1 and nothing of city 2 is listed."""
    own = spark.sql(_OF_CITY.format(t="{cal}"), cal=calendar(spark, sf_dir))
    incoming = own.filter(f"({_LISTED}) AND source_uid IS NOT NULL").select("source_uid").distinct()
    procedures.register(spark, events=own, incoming=incoming)
    return spark.sql("SELECT c.city, d.events, d.deleted, d.refused FROM (SELECT DISTINCT city FROM calendar_events) c, LATERAL delete_stale_events(c.city) d")


@query("SELECT 3 AS feed, count(c.id) AS events_deleted, true AS feed_deleted FROM feeds f LEFT JOIN cal c ON c.city = f.city AND c.source = f.name WHERE f.id = 3 GROUP BY f.id")
def p2_remove_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    _procedures(spark, sf_dir)
    return spark.sql("SELECT 3 AS feed, * FROM remove_feed(3)")


@query(
    f", cur AS ({_CURATED.format(s='VARCHAR', t='cal')}), ov AS (SELECT source_uid, arg_max(category, created_at) AS curated FROM cur GROUP BY 1) "
    "SELECT id, cal.source_uid, category, curated FROM cal JOIN ov ON ov.source_uid = cal.source_uid WHERE category IS DISTINCT FROM curated"
)
def p3_overridden_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _procedures(spark, sf_dir)
    return spark.sql("SELECT * FROM overridden_events()")


@query(
    "SELECT id, CASE WHEN feed_type <> 'scraper' OR status = 'removed' THEN NULL WHEN NOT regexp_full_match(url, 'cities/[a-z0-9-]+/[A-Za-z0-9._-]+[.]ics') THEN 'url' "
    "WHEN trim(coalesce(scraper_cmd, '')) = '' THEN 'no command' WHEN NOT regexp_matches(scraper_cmd, '^python (scrapers|scripts)/') THEN 'command' END AS problem FROM "
    "(SELECT id, CASE WHEN id % 4 = 0 THEN url ELSE concat('cities/c/', id, '.ics') END AS url, feed_type, status, scraper_cmd FROM feeds)"
)
def p4_scraper_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _procedures(spark, sf_dir)
    rows = "SELECT id, CASE WHEN id % 4 = 0 THEN url ELSE concat('cities/c/', id, '.ics') END AS url, feed_type, status, scraper_cmd FROM calendar_feeds"
    return spark.sql(f"SELECT id, scraper_row_problem(url, feed_type, status, scraper_cmd) AS problem FROM ({rows})")


@query("SELECT city, name, count(DISTINCT id) AS event_count FROM (SELECT city, id, trim(unnest(string_split(source, ','))) AS name FROM cal) WHERE name <> '' GROUP BY city, name")
def p5_source_name_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _procedures(spark, sf_dir)
    return spark.sql("SELECT * FROM source_name_counts()")
