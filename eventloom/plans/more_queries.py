"""Further registered queries: reports, sorts, sets, scalar functions and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, labels, recurrence, text
from ..operators import aggregates, filters, sorting, windows
from ..operators.runs import ranked
from ..sources import export, registries, web
from .adapter import calendar, feed_history, feeds
from .queries import NOW, _now, _table, _today, query


@query(f"SELECT source_id AS file, count(*) FILTER (WHERE id % 17 = 0 OR start_time >= {NOW}) AS future FROM cal GROUP BY 1")
def a8_future_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar(spark, sf_dir).select(F.col("source_id").alias("file"), F.when(F.col("id") % 17 != 0, F.col("start_time")).alias("dtstart"))
    return aggregates.future_counts(rows, _now())


@query(
    ", r AS (SELECT city, source_id AS file, CASE id % 4 WHEN 0 THEN 'America/New_York' WHEN 1 THEN 'UTC (Z suffix)' WHEN 2 THEN '(bare)' END AS tzid FROM cal) "
    "SELECT city, tzid, count(*) AS count, count(DISTINCT file) AS files, array_to_string(list_sort(list(DISTINCT file))[1:5], ',') AS sample_files, tzid = 'America/New_York' AS matches_city FROM r WHERE tzid IS NOT NULL GROUP BY city, tzid"
)
def a9_tzid_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.date_format("start_time", "yyyyMMdd'T'HHmmss")
    kind = F.col("id") % 4
    rows = calendar(spark, sf_dir).select(
        "city", F.col("source_id").alias("file"), F.when(kind == 0, "America/New_York").otherwise("").alias("tzid"),
        F.when(kind == 1, F.concat(raw, F.lit("Z"))).when(kind == 3, F.date_format("start_time", "yyyyMMdd")).otherwise(raw).alias("value"),
    )
    return aggregates.tzid_inventory(rows, F.lit("America/New_York")).withColumn("sample_files", F.array_join("sample_files", ","))


_PRODID = "CASE id % 4 WHEN 0 THEN '-//tockify.com//x' WHEN 1 THEN '-//Org Name//site.org//' WHEN 2 THEN '-//Google Inc//Google Calendar 70' ELSE '-//who knows' END"


@query(f", p AS (SELECT city, CASE id % 4 WHEN 0 THEN 'Tockify' WHEN 2 THEN 'Google Calendar' ELSE 'unknown' END AS platform FROM feeds WHERE id % 4 <> 1) SELECT platform, count(*) AS feeds, string_agg(DISTINCT city, ', ' ORDER BY city) AS cities FROM p GROUP BY 1")
def a14_platform_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds(spark, sf_dir).withColumn("prodid", F.expr(_PRODID)).withColumn("platform", labels.platform(F.col("prodid")))
    return aggregates.platform_summary(rows)


@query(f"SELECT id FROM cal WHERE start_time >= {NOW} - INTERVAL 24 HOUR AND start_time <= {NOW} + INTERVAL 31 DAY AND trim(title) <> ''")
def f1_upcoming_in_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar(spark, sf_dir).withColumn("dtstart", F.col("start_time"))
    rows = filters.has_title_and_start(filters.upcoming_wall(rows, _now()))
    return rows.filter(F.col("dtstart") <= _now() + F.make_dt_interval(F.lit(31))).select("id")


@query(f"SELECT id FROM cal WHERE start_time BETWEEN {NOW} AND {NOW} + INTERVAL 62 DAY")
def f14_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.within_horizon(calendar(spark, sf_dir), _now(), 2, "start_time").select("id")


@query("SELECT id FROM cal WHERE extract(hour FROM start_time) < 5")
def f17_suspicious_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(spark, sf_dir).filter(filters.suspicious_hour(F.hour("start_time"))).select("id")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE start_time >= {NOW}) AS future, bool_or(id % 9 = 0) AS has_recurrence FROM cal")
def f19_feed_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar(spark, sf_dir).withColumn("rrule", F.when(F.col("id") % 9 == 0, "FREQ=DAILY"))
    return filters.feed_preview_counts(rows, _now())


@query(f"SELECT id, start_time FROM cal WHERE start_time >= {NOW} ORDER BY start_time, CAST(id AS VARCHAR) LIMIT 10")
def f19_feed_preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar(spark, sf_dir).withColumn("uid", F.col("id").cast("string"))
    return filters.feed_preview(rows, _now()).select("id", "start_time")


@query("SELECT id FROM cal WHERE source IS NOT NULL AND list_has_any(list_transform(string_split(source, ','), lambda s: trim(s)), ['src1', 'src4'])")
def f20_id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = text.source_list(F.col("source"))
    return calendar(spark, sf_dir).filter(filters.overlaps_ids(ids, ("src1", "src4"))).select("id")


@query("SELECT id FROM cal WHERE contains(coalesce(source, ''), 'rc6')")
def f21_names_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(spark, sf_dir).filter(filters.any_name_contains(text.source_list(F.col("source")), "RC6")).select("id")


@query(
    ", r AS (SELECT id, start_time, unnest(generate_series(CAST(start_time AS DATE), DATE '2024-03-01', INTERVAL 7 DAY)) AS d FROM cal) "
    f"SELECT id, min(d + (start_time - date_trunc('day', start_time))) AS next_start FROM r WHERE d + (start_time - date_trunc('day', start_time)) >= {NOW} GROUP BY id"
)
def j15_next_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar(spark, sf_dir).select("id", "start_time").withColumn("rrule", F.lit("RRULE:FREQ=WEEKLY"))
    return recurrence.next_occurrence(rows, _now())


@query("SELECT city, name, url, CASE WHEN feed_type = 'scraper' AND trim(coalesce(scraper_cmd, '')) <> '' THEN trim(scraper_cmd) ELSE 'curl -sL ''' || url || '''' END AS command FROM feeds")
def j14_repro_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.repro_commands(feeds(spark, sf_dir))


def _ranked(df: DataFrame, order: list) -> DataFrame:
    return ranked(df, ["city"], order).withColumn("place", F.col("place").cast("int"))


@query("SELECT id, city, CAST(row_number() OVER (PARTITION BY city ORDER BY start_time, CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END, CASE WHEN id % 5 = 0 THEN id % 3 END, title, id) AS INTEGER) AS place FROM cal")
def o4_client_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar(spark, sf_dir).withColumn("cluster_id", F.when(F.col("id") % 5 == 0, F.col("id") % 3))
    return _ranked(rows, sorting.client_order()).select("id", "city", "place")


@query("SELECT city, feed, date, CAST(row_number() OVER (PARTITION BY city ORDER BY CASE WHEN error IS NOT NULL THEN 0 WHEN count = 0 THEN 1 ELSE 3 END, seq) AS INTEGER) AS place FROM hist")
def o6_problem_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("error").isNotNull(), "high").when(F.col("count") == 0, "medium").otherwise("info")
    return _ranked(feed_history(spark, sf_dir), sorting.severity_order(severity, F.col("seq"))).select("city", "feed", "date", "place")


@query("SELECT id, city, CAST(row_number() OVER (PARTITION BY city ORDER BY CAST(start_time AS DATE), NOT all_day, strftime(start_time, '%H:%M'), id) AS INTEGER) AS place FROM cal")
def o7_legacy_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(calendar(spark, sf_dir), sorting.legacy_order()).select("id", "city", "place")


@query(
    ", r AS (SELECT id, start_time, unnest(generate_series(CAST(start_time AS DATE), DATE '2024-01-24', INTERVAL 1 DAY)) AS d FROM cal) "
    "SELECT title, source, start_time FROM cal UNION ALL SELECT c.title, 'Picks: Ann', r.d + (r.start_time - date_trunc('day', r.start_time)) FROM r JOIN cal c ON c.id = r.id WHERE r.d >= DATE '2024-01-10'"
)
def x1_events_and_enrichments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = calendar(spark, sf_dir).select("id", "title", "source", "start_time")
    rules = cal.select("id", "title", "start_time", F.lit("FREQ=DAILY").alias("rrule"), F.lit("Ann").alias("curator_name"))
    virtual = recurrence.expand_enrichments(rules, _today(), F.expr("DATE '2024-01-24'")).select("title", "source", F.col("occurrence").alias("start_time"))
    return sorting.with_enrichments(cal.drop("id"), virtual)


@query("SELECT DISTINCT city, feed, CASE WHEN count = 0 THEN 'zero' ELSE 'other' END AS anomaly, date FROM hist WHERE city <> 'city2' AND date >= DATE '2024-01-10' - 5")
def x4_prune_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = feed_history(spark, sf_dir)
    rows = hist.select("city", "feed", F.when(F.col("count") == 0, "zero").otherwise("other").alias("anomaly"), "date")
    return sorting.prune_anomalies(rows.union(rows), hist.filter("city <> 'city2'"), _today(), 5)


@query("SELECT DISTINCT feed AS message, city AS command, CASE WHEN error IS NULL THEN 'warning' ELSE 'error' END AS level FROM hist")
def x5_distinct_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feed_history(spark, sf_dir).select(F.col("feed").alias("message"), F.col("city").alias("command"), F.when(F.col("error").isNull(), "warning").otherwise("error").alias("level"))
    return registries.distinct_issues(rows)


@query("SELECT id, strftime(start_time, '%Y-%m-%dT%H:%M:%S') || '-05:00' AS iso, CAST(CAST(start_time AS DATE) AS TIMESTAMP) + INTERVAL 19 HOUR AS evening, start_time + INTERVAL 5 HOUR AS repaired FROM cal")
def u10_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone, ny = F.lit("America/New_York"), ("bad.example",)
    rows = calendar(spark, sf_dir).withColumn("at", F.to_utc_timestamp(F.col("start_time").cast("timestamp"), zone))
    repaired = dates.repair_double_conversion(F.col("start_time").cast("timestamp"), F.lit("bad.example"), ny, zone)
    return rows.select(
        "id", dates.iso_local(F.col("at"), zone).alias("iso"), dates.normalize_captured(F.date_format("start_time", "yyyy-MM-dd")).alias("evening"),
        repaired.cast("timestamp_ntz").alias("repaired"),
    )


#: Title, description, and the rule that they state.
_SAID = (
    ("", "Meets every Monday!", "FREQ=WEEKLY;BYDAY=MO"),
    ("", "Join us on Thursdays at 7", "FREQ=WEEKLY;BYDAY=TH"),
    ("", "Only on Monday, Jan 5", None),
    ("", "This weekly walk sets out early, Sunday mornings", "FREQ=WEEKLY;BYDAY=SU"),
    ("Weekly swim", "The pool opens at six, Tuesday to Friday", "FREQ=WEEKLY;BYDAY=TU"),
    ("", "Potluck 2nd and 4th Friday", "FREQ=MONTHLY;BYDAY=2FR"),
    ("", "Book club, first Wednesday, or the third Friday", "FREQ=MONTHLY;BYDAY=1WE"),
    ("Monthly potluck", "every Saturday", "FREQ=MONTHLY"),
    ("", "It happens every week", "FREQ=WEEKLY"),
    ("", "every other Tuesday, or daily", None),
    (None, None, None),
)


@query(f"SELECT id, CASE id % {len(_SAID)} {' '.join(f"WHEN {i} THEN '{r}'" for i, (_, _, r) in enumerate(_SAID) if r)} END AS rule FROM cal")
def u17_recurrence_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lambda at: F.element_at(F.array(*[F.lit(s[at]) for s in _SAID]), (F.col("id") % len(_SAID) + 1).cast("int"))
    return calendar(spark, sf_dir).select("id", labels.recurrence_in_text(told(0), told(1)).alias("rule"))


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'http://' || CAST(id AS VARCHAR) END AS url, CASE WHEN source IS NOT NULL AND len(list_filter(list_transform(string_split(source, ','), lambda s: trim(s)), lambda s: s <> '')) > 0 THEN array_to_string(list_filter(list_transform(string_split(source, ','), lambda s: trim(s)), lambda s: s <> ''), '|') END AS cats, regexp_replace(lower(coalesce(source, '')), '[^a-z0-9]', '', 'g') AS key FROM cal")
def u23_maps_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("id") % 2 == 0, F.concat(F.lit('{"a":"http://'), F.col("id").cast("string"), F.lit('"}'))).otherwise("not json")
    return calendar(spark, sf_dir).select(
        "id", F.try_element_at(text.url_map(raw), F.lit("a")).alias("url"), F.array_join(text.categories_list(F.col("source")), "|").alias("cats"), text.norm_key(F.col("source")).alias("key")
    )


@query(f"SELECT id, coalesce(end_time, start_time) AS end_time FROM cal WHERE start_time BETWEEN {NOW} AND {NOW} + INTERVAL 186 DAY")
def k11_connector_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.connector_calendar(calendar(spark, sf_dir), _now()).select("id", "end_time")


@query("SELECT 0 AS part, '| city | n |' AS line UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT 2, '| ' || city || ' | ' || CAST(count(*) AS VARCHAR) || ' |' FROM cal GROUP BY city")
def k10_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.markdown_rows(calendar(spark, sf_dir).groupBy("city").agg(F.count("*").alias("n")))


@query(
    ", b AS (SELECT o_custkey % 50 AS user_id, start_time, id, 'BEGIN:VEVENT' || e || 'UID:event-' || CAST(id AS VARCHAR) || '@eventloom' || e || 'DTSTAMP:20240110T120000Z' || e || 'DTSTART:' || strftime(start_time, '%Y%m%dT%H%M%SZ') || coalesce(e || 'DTEND:' || strftime(end_time, '%Y%m%dT%H%M%SZ'), '') "
    "|| e || 'SUMMARY:' || title || CASE WHEN coalesce(location, '') <> '' THEN e || 'LOCATION:' || replace(location, ',', '\\,') ELSE '' END || CASE WHEN coalesce(description, '') <> '' THEN e || 'DESCRIPTION:' || description ELSE '' END || CASE WHEN coalesce(url, '') <> '' THEN e || 'URL:' || url ELSE '' END "
    "|| e || 'END:VEVENT' AS block FROM orders JOIN (SELECT *, chr(13) || chr(10) AS e FROM cal) ON id = o_orderkey), "
    "i AS (SELECT user_id, 'BEGIN:VCALENDAR' || chr(13) || chr(10) || 'VERSION:2.0' || chr(13) || chr(10) || string_agg(block, chr(13) || chr(10) ORDER BY start_time, id) || chr(13) || chr(10) || 'END:VCALENDAR' AS ics FROM b GROUP BY user_id) "
    "SELECT user_id, ics, substr(sha256(ics), 1, 16) AS etag FROM i"
)
def k6_user_calendars(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = _table(spark, sf_dir, "orders").selectExpr("o_custkey % 50 as user_id", "o_orderkey as event_id")
    cal = calendar(spark, sf_dir).withColumnRenamed("id", "event_id").withColumn("rrule", F.lit(None).cast("string"))
    return export.user_calendars(picks.join(cal, "event_id"), _now())


@query("SELECT id, page FROM (SELECT id, (row_number() OVER (ORDER BY start_time, id) - 1) // 49 AS page FROM cal WHERE city = 'city0') WHERE page = 1")
def w9_overlapping_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a city's listing, less the row it shares with the third."""
    rows = calendar(spark, sf_dir).filter("city = 'city0'")
    start = windows.next_start(0, 50, rows.count()) or 0
    return windows.page(rows, [F.col("start_time"), F.col("id")], start, 49).select("id", F.lit(1).cast("bigint").alias("page"))
