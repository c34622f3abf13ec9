"""The store's procedures as SQL functions of a session, over views of its tables.

They are SQL functions, so that a call is planned with the query around it: a call for
every city (``LATERAL``) is a join, not a loop.  They tell what a change does; the tables
without those rows are ``operators/store.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: View of each table: events (id, city, source, source_uid, category), incoming (source_uid), feeds (id, city, name), overrides (source_uid, category, created_at).
VIEWS = {t: f"calendar_{t}" for t in ("events", "incoming", "feeds", "overrides")}

_STALE = "e.source_uid IS NOT NULL AND i.source_uid IS NULL"
_COMING = "LEFT JOIN (SELECT DISTINCT source_uid FROM calendar_incoming) i ON i.source_uid = e.source_uid"
_N = "(SELECT count(*) FROM calendar_incoming)"
_REFUSED = f"{_N} > 0 AND 2 * count_if({_STALE}) > count(*) AND {_N} < count_if({_STALE})"

FUNCTIONS = {
    # the events of a city that an incoming list leaves out; rows without uid are never stale
    "stale_events(of_city STRING)": f"TABLE(id BIGINT, source_uid STRING) RETURN SELECT e.id, e.source_uid FROM calendar_events e {_COMING} WHERE e.city = of_city AND {_STALE}",
    # how many of them go: none of an empty list, none if most of the city would go for fewer rows that come
    "delete_stale_events(of_city STRING)": f"TABLE(events BIGINT, deleted BIGINT, refused BOOLEAN) RETURN SELECT count(*), IF({_N} = 0 OR ({_REFUSED}), 0, count_if({_STALE})), {_REFUSED} FROM calendar_events e {_COMING} WHERE e.city = of_city",
    # how many events go with a feed; no row for an unknown feed
    "remove_feed(of_feed BIGINT)": "TABLE(events_deleted BIGINT, feed_deleted BOOLEAN) RETURN SELECT count(e.id), true FROM calendar_feeds f LEFT JOIN calendar_events e ON e.city = f.city AND e.source = f.name WHERE f.id = of_feed GROUP BY f.id",
    # distinct events by city and trimmed source name
    "source_name_counts()": "TABLE(city STRING, name STRING, event_count BIGINT) RETURN SELECT city, name, count(DISTINCT id) FROM (SELECT city, id, explode(transform(split(source, ','), s -> trim(s))) AS name FROM calendar_events) WHERE name <> '' GROUP BY city, name",
    # events whose category is not the curators' last one
    "overridden_events()": "TABLE(id BIGINT, source_uid STRING, category STRING, curated STRING) RETURN SELECT e.id, e.source_uid, e.category, o.c FROM calendar_events e JOIN (SELECT source_uid, max_by(category, created_at) AS c FROM calendar_overrides GROUP BY source_uid) o ON o.source_uid = e.source_uid WHERE e.category IS DISTINCT FROM o.c",
    # why a scraper's row is rejected, null if it is not
    "scraper_row_problem(url STRING, feed_type STRING, status STRING, scraper_cmd STRING)": (
        "STRING RETURN CASE WHEN coalesce(feed_type, '') <> 'scraper' OR coalesce(status, 'active') = 'removed' THEN NULL "
        "WHEN coalesce(url, '') NOT RLIKE '^cities/[a-z0-9-]+/[A-Za-z0-9._-]+[.]ics$' THEN 'url' "
        "WHEN trim(coalesce(scraper_cmd, '')) = '' THEN 'no command' WHEN scraper_cmd NOT RLIKE '^python (scrapers|scripts)/' THEN 'command' END"
    ),
}


def register(spark: SparkSession, **tables: DataFrame) -> None:
    """Make the views of the given tables and the functions whose views exist."""
    for name, df in tables.items():
        df.createOrReplaceTempView(VIEWS[name])
    for head, body in FUNCTIONS.items():
        if all(spark.catalog.tableExists(v) for v in VIEWS.values() if v in body):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {body}")
