"""Registered queries of the calendar engine, each with DuckDB SQL where SQL can say it.

``now`` and ``today`` are literals, so that reruns agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORIES, COMMAND_CLASSES, LOG_CLASSES, REGIONS, SCHEMA_TYPES, STREETS, VIRTUAL
from ..functions import dates, geo, labels, recurrence, text, urls
from ..functions.snippet import snippet_sql, with_snippet
from ..operators import aggregates, classify, cluster, dedup, filters, similar, store, windows
from ..scratch import new_folder
from ..sources import export, ics, registries
from ..streaming import jobs
from .adapter import CALENDAR_SQL, FEEDS_SQL, HISTORY_SQL, calendar, calendar_of, feed_history, feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = "TIMESTAMP '2024-01-10 12:00:00'"
_now = lambda: F.expr("TIMESTAMP_NTZ '2024-01-10 12:00:00'")
_today = lambda: F.expr("DATE '2024-01-10'")
AGGREGATORS = ("src2", "src5")
HIDDEN = ("src1", "src5")
_list = lambda names: F.array(*[F.lit(n) for n in names])
_WITH = f"WITH cal AS ({CALENDAR_SQL}), hist AS ({HISTORY_SQL}), feeds AS ({FEEDS_SQL})"
_NAMES = "list_distinct(list_filter(list_transform(string_split(coalesce(source, ''), ','), lambda s: trim(s)), lambda s: s <> ''))"
_ORDERED = "list_filter({0}, lambda s, i: list_position({0}, s) = i)".format(
    "list_filter(list_transform(string_split(coalesce(source, ''), ','), lambda s: trim(s)), lambda s: s <> '')"
)
_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_sqlist = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"{_WITH} {sql}"
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_known = lambda c: f"arg_min({c}, id) FILTER (WHERE {c} IS NOT NULL) AS {c}"


@query(
    "SELECT city, start_time, min(id) AS id, arg_min_null(title, id) AS title, arg_min_null(source_uid, id) AS source_uid, "
    f"arg_min_null(source_id, id) AS source_id, {', '.join(map(_known, ('end_time', 'location', 'description', 'category', 'image_url')))}, "
    "arg_min(url, id) FILTER (WHERE coalesce(url, '') <> '') AS url, string_agg(DISTINCT source, ', ' ORDER BY source) AS source, "
    "min(created_at) AS created_at, bool_or(all_day) AS all_day, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS merged_ids "
    "FROM cal WHERE source <> 'poster_capture' GROUP BY city, lower(trim(title)), start_time"
)
def a1_deduplicated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.deduplicated_events(calendar(spark, sf_dir))
    return out.withColumn("merged_ids", F.array_join(F.col("merged_ids").cast("array<string>"), ","))


@query(
    "SELECT city, name, count(DISTINCT id) AS event_count FROM (SELECT city, id, trim(unnest(string_split(source, ','))) AS name FROM cal) "
    "WHERE name <> '' GROUP BY city, name"
)
def a2_source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.source_names(calendar(spark, sf_dir))


@query(f"SELECT source, count(*) AS count FROM (SELECT unnest({_NAMES}) AS source FROM (SELECT coalesce(nullif(source, ''), 'Unknown') AS source FROM cal)) GROUP BY source")
def a3_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.source_counts(calendar(spark, sf_dir))


@query(
    f"SELECT source, CAST(sum(CAST(seen AS INT)) AS BIGINT) AS count, count(*) AS total, CAST(sum(CAST(via AS INT)) AS BIGINT) AS hidden_via_aggregator FROM ("
    f"SELECT unnest(n) AS source, len(list_filter(n, lambda s: s IN {_in(set(HIDDEN) & set(AGGREGATORS))})) > 0 AS via, "
    f"len(list_filter(n, lambda s: s IN {_in(set(HIDDEN) & set(AGGREGATORS))})) = 0 AND len(list_filter(n, lambda s: s NOT IN {_in(HIDDEN)})) > 0 AS seen "
    f"FROM (SELECT {_NAMES} AS n FROM (SELECT coalesce(nullif(source, ''), 'Unknown') AS source FROM cal))) GROUP BY source"
)
def a4_visible_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.visible_source_counts(calendar(spark, sf_dir), _list(HIDDEN), _list(AGGREGATORS))


@query(f"SELECT CAST(list_position({_sqlist(CATEGORIES)}, category) AS BIGINT) AS place, category, count(*) AS count FROM cal WHERE category IN {_in(CATEGORIES)} GROUP BY category")
def a5_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.category_counts(calendar(spark, sf_dir))


@query("SELECT coalesce(nullif(category, ''), '(uncategorized)') AS category, count(*) AS count FROM cal GROUP BY 1")
def a5_category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.category_breakdown(calendar(spark, sf_dir))


@query(
    ", u AS (SELECT city, coalesce(url, '') AS url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain FROM cal), "
    "g AS (SELECT city, sum(n) AS g FROM (SELECT city, domain, count(*) AS n, count(DISTINCT url) AS d FROM u WHERE url <> '' GROUP BY city, domain) WHERE d = 1 AND n > 5 GROUP BY city) "
    "SELECT u.city, count(*) AS total_events, count(*) FILTER (WHERE url <> '') AS total_with_url, count(DISTINCT url) FILTER (WHERE url <> '') AS unique_urls, "
    "count(*) FILTER (WHERE starts_with(url, 'http://')) AS http_count, count(DISTINCT domain) FILTER (WHERE starts_with(url, 'http://')) AS http_domains, "
    "CAST(coalesce(any_value(g.g), 0) AS BIGINT) AS generic_count FROM u LEFT JOIN g ON g.city = u.city GROUP BY u.city"
)
def a6_url_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.url_quality(calendar(spark, sf_dir))


@query(
    "SELECT source, events, unique_urls, CAST(round_even(unique_urls / events * 100, 0) AS BIGINT) AS specificity_pct FROM (SELECT coalesce(nullif(source, ''), '(none)') AS source, "
    "count(*) AS events, count(DISTINCT url) AS unique_urls FROM cal WHERE coalesce(url, '') <> '' GROUP BY 1) ORDER BY events DESC, source LIMIT 15"
)
def a6_source_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.source_specificity(calendar(spark, sf_dir))


@query("SELECT coalesce(nullif(source, ''), '(none)') AS source, count(*) AS total, count(*) FILTER (WHERE coalesce(image_url, '') <> '') AS with_image FROM cal GROUP BY 1 HAVING with_image > 0")
def a7_image_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.image_coverage(calendar(spark, sf_dir))


@query("SELECT city, count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'removed') AS removed FROM feeds GROUP BY city")
def a10_feed_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.status_counts(feeds(spark, sf_dir))


@query(
    "SELECT coalesce(city, '(all)') AS city, count(*) FILTER (WHERE error IS NOT NULL) AS errors, count(*) FILTER (WHERE error IS NULL AND count = 0) AS warnings FROM hist GROUP BY ROLLUP (city)"
)
def a11_validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("error").isNotNull(), "error").when(F.col("count") == 0, "warning")
    out = aggregates.validation_summary(feed_history(spark, sf_dir).withColumn("level", level))
    return out.withColumn("city", F.coalesce("city", F.lit("(all)")))


@query(
    "SELECT city, source, count(*) AS total, count(*) FILTER (WHERE h < 5) AS count FROM (SELECT city, source, extract(hour FROM start_time) AS h FROM cal WHERE NOT all_day) "
    "GROUP BY city, source HAVING count(*) >= 3 AND count(*) FILTER (WHERE h < 5) >= 2 AND count(*) FILTER (WHERE h < 5 AND (h + 7) % 24 BETWEEN 8 AND 18) >= count(*) FILTER (WHERE h < 5) * 0.7"
)
def a12_timezone_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.timezone_anomalies(calendar(spark, sf_dir), F.hour("start_time"), -7)


@query(
    ", b AS (SELECT a.id AS id_a, b.id AS id_b, 1 - levenshtein(lower(a.title), lower(b.title)) / greatest(length(a.title), length(b.title)) AS s FROM cal a JOIN cal b ON a.city = b.city AND a.start_time = b.start_time AND a.id < b.id) "
    "SELECT floor(s * 10) / 10 AS bucket, count(*) AS pairs FROM b WHERE s >= 0.3 GROUP BY 1"
)
def a15_similarity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.similarity_histogram(similar.similar_pairs(calendar(spark, sf_dir), ["city", "start_time"], 0.3))


@query("SELECT CAST(min(date_diff('day', DATE '2024-01-10', CAST(start_time AS DATE))) AS INTEGER) AS first_day, CAST(max(date_diff('day', DATE '2024-01-10', CAST(start_time AS DATE))) AS INTEGER) AS last_day FROM cal")
def a18_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.day_range(calendar(spark, sf_dir), _today())


@query("SELECT DISTINCT city FROM cal")
def a20_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.cities(calendar(spark, sf_dir))


@query(
    f", m AS (SELECT city, lower(trim(title)) AS k, start_time, arg_min(title, id) AS title, min(id) AS id, arg_min(url, id) FILTER (WHERE coalesce(url, '') <> '') AS url, "
    "arg_min(location, id) FILTER (WHERE coalesce(location, '') <> '') AS location, arg_min(description, id) FILTER (WHERE coalesce(description, '') <> '') AS description, "
    f"list_sort(list_distinct(flatten(list({_NAMES})))) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS merged_ids FROM cal GROUP BY 1, 2, 3), "
    f"o AS (SELECT *, list_filter(n, lambda s: s NOT IN {_in(AGGREGATORS)}) AS p, list_filter(n, lambda s: s IN {_in(AGGREGATORS)}) AS a FROM m), "
    "q AS (SELECT *, list_filter(p, lambda s: contains(lower(coalesce(location, '')), s))[1:1] AS lead FROM o) "
    "SELECT city, start_time, title, id, url, location, description, merged_ids, array_to_string(list_concat(list_concat(lead, list_filter(p, lambda s: NOT list_contains(lead, s))), a), ', ') AS source FROM q"
)
def a17_merge_for_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.merge_for_sources(calendar(spark, sf_dir), _list(AGGREGATORS))
    return out.withColumn("merged_ids", F.array_join(F.col("merged_ids").cast("array<string>"), ",")).withColumn("source", F.coalesce("source", F.lit("")))


@query(
    ", w AS (SELECT *, last_value(CASE WHEN error IS NULL THEN count END IGNORE NULLS) OVER (PARTITION BY city, feed ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM hist), "
    "k AS (SELECT *, CASE WHEN count = 0 AND previous > 0 THEN 'zero_events' WHEN previous >= 5 AND count < previous AND (previous - count) / previous >= 0.5 THEN 'significant_drop' END AS anomaly FROM w) "
    "SELECT city, feed, date, previous, count, anomaly FROM k WHERE anomaly IS NOT NULL"
)
def a19_feed_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.feed_anomalies(feed_history(spark, sf_dir))


@query(
    ", l AS (SELECT city, feed, max(date) AS last, max(date) FILTER (WHERE count = 0 AND error IS NULL) AS z, max(date) FILTER (WHERE NOT (count = 0 AND error IS NULL)) AS broken, "
    "arg_max(count, date) FILTER (WHERE count > 0) AS was, max(date) FILTER (WHERE count > 0) AS was_date FROM hist GROUP BY city, feed) "
    "SELECT l.city, l.feed, was, was_date, min(h.date) AS silent_since FROM l JOIN hist h ON h.city = l.city AND h.feed = l.feed AND (broken IS NULL OR h.date > broken) WHERE last = z GROUP BY ALL"
)
def w2_silent_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.silent_feeds(feed_history(spark, sf_dir))


@query("SELECT city, feed, date, count, error, seq FROM hist QUALIFY row_number() OVER (PARTITION BY city, feed ORDER BY date DESC) <= 9")
def w3_recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.recent_history(feed_history(spark, sf_dir), 9)


@query(f"SELECT id, title, start_time FROM cal WHERE start_time >= {NOW} - INTERVAL 24 HOUR")
def f2_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.upcoming_instant(calendar(spark, sf_dir), _now()).select("id", "title", "start_time")


@query(
    "SELECT id, url, coalesce(CAST(nullif(regexp_extract(url, '/(\\d{4})/(\\d{2})/', 1), '') AS INT) * 12 + CAST(nullif(regexp_extract(url, '/(\\d{4})/(\\d{2})/', 2), '') AS INT) < 2024 * 12 + 1, false) AS stale FROM cal"
)
def f3_stale_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(spark, sf_dir).select("id", "url", urls.is_stale(text.blank(F.col("url")), 2024, 1).alias("stale"))


_regions, _streets = "|".join(REGIONS), "|".join(STREETS)


@query(
    "SELECT id, location, CASE WHEN coalesce(location, '') = '' THEN true WHEN "
    + " OR ".join(f"contains(lower(location), '{v}')" for v in VIRTUAL)
    + " THEN true WHEN contains(lower(location), 'loc3') THEN false WHEN NOT ("
    + f"regexp_matches(location, ', (?:{_regions})\\b') OR regexp_matches(location, '\\b\\d{{5}}\\b') OR regexp_matches(location, '[A-Z]\\d[A-Z]\\s?\\d[A-Z]\\d') OR "
    + f"regexp_matches(location, '(?i)\\d+\\s+\\w+\\s+(?:{_streets})\\b')) THEN true ELSE contains(lower(location), 'napa') END AS kept FROM cal"
)
def f4_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(spark, sf_dir).select("id", "location", geo.in_area(F.col("location"), ("napa",), ("loc3",)).alias("kept"))


@query("SELECT id FROM cal WHERE NOT regexp_matches(title, '(?i)\\b(?:click|sign\\-up)\\b') AND (coalesce(location, '') = '' OR regexp_matches(location, '(?i)\\b(?:hall|loc1)\\b'))")
def f5_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar(spark, sf_dir)
    return rows.filter(geo.keyword_filter(F.col("title"), F.col("location"), ("click", "sign-up"), ("hall", "loc1"))).select("id")


@query(
    f"SELECT id, title, start_time, end_time, location, description, url, city, source, source_uid, category, image_url, all_day FROM cal WHERE city = 'city1' AND start_time >= {NOW} - INTERVAL 1 HOUR "
    f"AND start_time <= {NOW} + INTERVAL 90 DAY ORDER BY start_time, id LIMIT 6000"
)
def f7_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = _now() - F.expr("INTERVAL 1 HOUR"), _now() + F.expr("INTERVAL 90 DAYS")
    return filters.listing(calendar(spark, sf_dir), "city1", lo, hi)


@query("SELECT id, title, category FROM (SELECT * FROM cal WHERE source <> 'poster_capture' ORDER BY start_time, id LIMIT 200) WHERE category = 'Film / Cinema' AND (contains(lower(title), 'river') OR contains(lower(coalesce(description, '')), 'river') OR contains(lower(coalesce(location, '')), 'river'))".replace("category = 'Film / Cinema' AND ", ""))
def f8_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.tile(calendar(spark, sf_dir), None, "River").select("id", "title", "category")


@query("SELECT id FROM cal WHERE category = 'Music / Concerts' AND contains(lower(title || ' ' || coalesce(location, '') || ' ' || coalesce(source, '') || ' ' || coalesce(description, '')), 'loc2 src')")
def f9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.search(calendar(spark, sf_dir), "LOC2 src", "Music / Concerts").select("id")


@query(f"SELECT id, source FROM (SELECT id, source, {_NAMES} AS n FROM cal) WHERE coalesce(source, '') = '' OR (len(list_filter(n, lambda s: s = 'src5')) = 0 AND len(list_filter(n, lambda s: s NOT IN {_in(HIDDEN)})) > 0)")
def f10_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(spark, sf_dir).filter(filters.visible(F.col("source"), _list(HIDDEN), _list(AGGREGATORS))).select("id", "source")


@query(f"SELECT id FROM cal WHERE len(list_filter(string_split(coalesce(source, ''), ', '), lambda s: s IN ('src3', 'src4'))) = 0 AND coalesce(category, '') <> 'Film / Cinema' AND coalesce(source_uid, '') NOT IN ('u5', 'u6') AND NOT coalesce(created_at, start_time) > {NOW}")
def f11_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.not_excluded(calendar(spark, sf_dir), _list(("src3", "src4")), _list(("Film / Cinema",)), _list(("u5", "u6")), _now()).select("id")


@query("SELECT id, start_time FROM cal WHERE start_time >= TIMESTAMP '2024-01-12' AND start_time < TIMESTAMP '2024-01-16'")
def f12_day_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.day_window(calendar(spark, sf_dir), F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"), 2, 5).select("id", "start_time")


@query(
    "SELECT id, CASE WHEN NOT regexp_matches(url, '^scrapers/') THEN 'url is not a scraper path' WHEN trim(coalesce(scraper_cmd, '')) = '' THEN 'command is blank' "
    "WHEN NOT regexp_matches(trim(scraper_cmd), '^python (scrapers|scripts)/') THEN 'command has a wrong prefix' END AS violation FROM feeds WHERE feed_type = 'scraper' AND status <> 'removed' AND violation IS NOT NULL"
)
def f13_feed_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.feed_violations(feeds(spark, sf_dir)).select("id", "violation")


def _overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "SELECT id AS event_id, source_uid, 'Games / Trivia' AS category, category AS original_category, title AS event_title, city AS event_city, "
        "concat('c', cast(id % 4 as string)) AS curator_id, created_at FROM {cal} WHERE id % 17 = 0", cal=calendar(spark, sf_dir),
    )


_OVERRIDES = ", ov AS (SELECT id AS event_id, source_uid, 'Games / Trivia' AS category, category AS original_category, title AS event_title, city AS event_city, concat('c', CAST(id % 4 AS VARCHAR)) AS curator_id, created_at FROM cal WHERE id % 17 = 0)"


@query(
    f"{_OVERRIDES} SELECT ov.event_id, c.title, c.city, ov.category, ov.original_category, CASE WHEN curator_id IN ('c0', 'c1') THEN upper(curator_id) END AS curator_name, ov.created_at FROM ov JOIN cal c ON c.id = ov.event_id"
)
def j1_overrides_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.createDataFrame([("c0", "C0"), ("c1", "C1")], "curator_id string, curator_name string")
    return store.overrides_listing(_overrides(spark, sf_dir), calendar(spark, sf_dir), users)


@query(
    ", picks AS (SELECT o_custkey % 50 AS user_id, o_orderkey AS event_id FROM orders), en AS (SELECT o_orderkey AS id, o_custkey % 50 AS curator_id, o_orderkey AS event_id, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'note ' || CAST(o_orderkey AS VARCHAR) ELSE '' END AS description, 'at ' || o_orderstatus AS location, CAST(NULL AS VARCHAR) AS url FROM orders WHERE o_orderkey % 7 = 0), "
    "l AS (SELECT curator_id, event_id, arg_max(description, id) AS d, arg_max(location, id) AS l FROM en GROUP BY 1, 2) "
    "SELECT p.user_id, p.event_id, c.title, coalesce(nullif(l.d, ''), c.description) AS description, coalesce(nullif(l.l, ''), c.location) AS location, c.url FROM picks p JOIN cal c ON c.id = p.event_id "
    "LEFT JOIN l ON l.curator_id = p.user_id AND l.event_id = p.event_id"
)
def j2_picked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    picks = orders.selectExpr("o_custkey % 50 as user_id", "o_orderkey as event_id")
    notes = orders.filter("o_orderkey % 7 = 0").selectExpr(
        "o_orderkey as id", "o_custkey % 50 as curator_id", "o_orderkey as event_id",
        "case when o_orderkey % 3 = 0 then concat('note ', cast(o_orderkey as string)) else '' end as description", "concat('at ', o_orderstatus) as location", "cast(null as string) as url",
    )
    return store.picked_events(picks, calendar(spark, sf_dir), notes).select("user_id", "event_id", "title", "description", "location", "url")


@query("SELECT id, source_uid FROM cal c WHERE city = 'city1' AND source_uid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cal i WHERE i.source_uid = c.source_uid AND i.id % 2 = 0 AND i.source_uid NOT LIKE '%3')")
def j3_stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = calendar(spark, sf_dir)
    return store.stale_rows(cal, "city1", cal.filter("id % 2 = 0 AND source_uid NOT LIKE '%3'")).select("id", "source_uid")


@query(
    "SELECT c.id, coalesce(nullif(c.category, ''), o.category) AS category FROM cal c LEFT JOIN (SELECT source_uid, arg_max(category, id) AS category FROM cal WHERE id % 3 = 0 AND coalesce(category, '') <> '' AND coalesce(source_uid, '') <> '' GROUP BY 1) o ON o.source_uid = c.source_uid"
)
def j4_carry_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = calendar(spark, sf_dir)
    return store.carry_categories(cal, cal.filter("id % 3 = 0")).select("id", "category")


@query(f"{_OVERRIDES} SELECT c.id, coalesce(o.category, c.category) AS category FROM cal c LEFT JOIN (SELECT DISTINCT source_uid, category FROM ov WHERE source_uid IS NOT NULL) o ON o.source_uid = c.source_uid")
def j5_apply_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.apply_overrides(calendar(spark, sf_dir), _overrides(spark, sf_dir)).select("id", "category")


@query(f"{_OVERRIDES} SELECT ov.curator_id, ov.created_at, coalesce(m.id, ov.event_id) AS event_id, ov.source_uid FROM ov LEFT JOIN (SELECT source_uid, min(id) AS id FROM cal WHERE source_uid IS NOT NULL GROUP BY 1) m ON m.source_uid = ov.source_uid")
def j6_reattach_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.reattach_overrides(_overrides(spark, sf_dir), calendar(spark, sf_dir)).select("curator_id", "created_at", "event_id", "source_uid")


_MANIFEST = "SELECT url, CASE WHEN s_suppkey % 3 = 0 THEN 'other' ELSE name END AS name, CASE WHEN s_suppkey % 8 = 4 THEN 'python scrapers/new.py' ELSE scraper_cmd END AS scraper_cmd"


@query(
    ", w AS (SELECT url, CASE WHEN id % 3 = 0 THEN 'other' ELSE name END AS w_name, trim(regexp_replace(regexp_replace(coalesce(CASE WHEN id % 8 = 4 THEN 'python scrapers/new.py' ELSE scraper_cmd END, ''), '(^|\\s)(--output|-o)([ =]\\S+)', ' ', 'g'), '\\s+', ' ', 'g')) AS w_cmd FROM feeds WHERE feed_type = 'scraper' AND id % 10 <> 2 "
    "UNION ALL SELECT 'scrapers/extra.py', 'extra', 'python scrapers/extra.py'), "
    "d AS (SELECT url, name AS d_name, status, trim(regexp_replace(regexp_replace(coalesce(scraper_cmd, ''), '(^|\\s)(--output|-o)([ =]\\S+)', ' ', 'g'), '\\s+', ' ', 'g')) AS d_cmd FROM feeds WHERE feed_type = 'scraper'), "
    "b AS (SELECT coalesce(w.url, d.url) AS url, w.url AS w, d.url AS d, w_name, d_name, w_cmd, d_cmd, status FROM w FULL JOIN d ON w.url = d.url) "
    "SELECT url, 'workflow_scraper_missing_from_db' AS type FROM b WHERE d IS NULL UNION ALL SELECT url, 'removed_db_scraper_still_in_workflow' FROM b WHERE w IS NOT NULL AND status = 'removed' "
    "UNION ALL SELECT url, 'scraper_name_mismatch' FROM b WHERE w IS NOT NULL AND d IS NOT NULL AND w_name <> d_name UNION ALL SELECT url, 'scraper_command_mismatch' FROM b WHERE w IS NOT NULL AND d IS NOT NULL AND w_cmd <> d_cmd "
    "UNION ALL SELECT url, 'db_scraper_missing_from_workflow' FROM b WHERE w IS NULL AND status IN ('active', 'pending')"
)
def j7_scraper_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = feeds(spark, sf_dir)
    manifest = stored.filter("feed_type = 'scraper' and id % 10 <> 2").selectExpr(
        "url", "case when id % 3 = 0 then 'other' else name end as name", "case when id % 8 = 4 then 'python scrapers/new.py' else scraper_cmd end as scraper_cmd"
    )
    extra = spark.createDataFrame([("scrapers/extra.py", "extra", "python scrapers/extra.py")], manifest.schema)
    return store.scraper_drift(manifest.unionByName(extra), stored)


@query(
    ", w AS (SELECT city, url, CASE WHEN id % 4 = 1 THEN 'renamed' ELSE name END AS name FROM feeds WHERE id % 6 <> 0 UNION ALL SELECT 'city9', 'https://new.example/', 'new') "
    "SELECT coalesce(w.city, f.city) AS city, coalesce(w.url, f.url) AS url, CASE WHEN f.url IS NULL THEN 'insert' WHEN w.url IS NULL AND f.status <> 'removed' THEN 'retire' WHEN w.name <> f.name THEN 'update' END AS action "
    "FROM w FULL JOIN feeds f ON w.city = f.city AND w.url = f.url WHERE action IS NOT NULL"
)
def j8_feed_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = feeds(spark, sf_dir)
    wanted = stored.filter("id % 6 <> 0").selectExpr("city", "url", "case when id % 4 = 1 then 'renamed' else name end as name")
    new = spark.createDataFrame([("city9", "https://new.example/", "new")], wanted.schema)
    return store.feed_sync(wanted.unionByName(new), stored)


@query(", p AS (SELECT DISTINCT o_orderkey AS event_id FROM orders), m AS (SELECT min(id) AS id, list(id) AS ids FROM cal WHERE source <> 'poster_capture' GROUP BY city, lower(trim(title)), start_time) SELECT id, len(list_filter(ids, lambda i: i IN (SELECT event_id FROM p))) > 0 AS picked FROM m".replace("len(list_filter(ids, lambda i: i IN (SELECT event_id FROM p))) > 0", "list_has_any(ids, (SELECT list(event_id) FROM p))"))
def j12_stamp_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = _table(spark, sf_dir, "orders").selectExpr("o_orderkey as event_id")
    return store.stamp_picked(dedup.deduplicated_events(calendar(spark, sf_dir)), picks).select("id", "picked")


@query("SELECT source AS name, feed, key_count FROM (SELECT n AS source, CASE WHEN c = 1 THEN f END AS feed, c AS key_count FROM (SELECT regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k, count(*) AS c, min(name) AS f, unnest(list(DISTINCT name)) AS n FROM feeds GROUP BY 1))".replace("SELECT source AS name, feed, key_count FROM", "SELECT source, feed FROM"))
def j13_match_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = feeds(spark, sf_dir)
    return store.match_errors(stored.select(F.col("name").alias("source")).distinct(), stored).select("source", "feed")


@query("SELECT c.id, c.city, c.source FROM cal c WHERE NOT EXISTS (SELECT 1 FROM feeds f WHERE f.id = 3 AND f.city = c.city AND f.name = c.source)")
def j16_remove_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.remove_feed(calendar(spark, sf_dir), feeds(spark, sf_dir), 3)[0].select("id", "city", "source")


@query("SELECT id, source_uid, start_time FROM cal WHERE coalesce(source_uid, '') = '' OR id IN (SELECT id FROM cal WHERE source_uid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_uid ORDER BY start_time, id) = 1)")
def w4_first_by_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.first_by_uid(calendar(spark, sf_dir), [F.col("start_time"), F.col("id")]).select("id", "source_uid", "start_time")


@query(
    ", k AS (SELECT id, start_time, lower(trim(title)) AS t, lower(trim(coalesce(location, ''))) AS l, strftime(start_time, '%H:%M') AS h, floor(date_diff('day', DATE '2024-01-10', CAST(start_time AS DATE)) / 7) AS w, city FROM cal) "
    "SELECT id, start_time, count(*) OVER (PARTITION BY city, t, l, h) >= 5 AS is_recurring FROM k QUALIFY count(*) OVER (PARTITION BY city, t, l, h) < 5 OR row_number() OVER (PARTITION BY city, t, l, h, w ORDER BY start_time, id) = 1"
)
def w5_collapse_long_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.collapse_long_running(calendar(spark, sf_dir), _today()).select("id", "start_time", "is_recurring")


@query(", b AS (SELECT city, date AS generated, CAST(sum(count) AS BIGINT) AS total FROM hist GROUP BY 1, 2) SELECT city, generated, total, lag(total) OVER (PARTITION BY city ORDER BY generated) AS previous, total - lag(total) OVER (PARTITION BY city ORDER BY generated) AS delta FROM b")
def w6_build_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    builds = feed_history(spark, sf_dir).groupBy("city", F.col("date").alias("generated")).agg(F.sum("count").alias("total"))
    return windows.build_delta(builds)


@query("SELECT city, feed, count, EXISTS (SELECT 1 FROM hist p WHERE p.city = h.city AND p.feed = h.feed AND p.date = DATE '2024-01-10' AND p.count = 0) AS ongoing FROM hist h WHERE date = DATE '2024-01-14'")
def w7_new_and_ongoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = feed_history(spark, sf_dir)
    now = hist.filter("date = DATE '2024-01-14'").select("city", "feed", "count")
    return windows.new_and_ongoing(now, hist.filter("date = DATE '2024-01-10' and count = 0"), ["city", "feed"])


@query("SELECT id, city, CAST(rank AS INTEGER) AS rank FROM (SELECT id, city, row_number() OVER (PARTITION BY city ORDER BY start_time, id) AS rank FROM cal) WHERE rank <= 3")
def w8_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top_per_group(calendar(spark, sf_dir), ["city"], [F.col("start_time"), F.col("id")], 3).select("id", "city", "rank")


@query("SELECT id, start_time FROM cal ORDER BY start_time, id LIMIT 50 OFFSET 49")
def w9_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.page(calendar(spark, sf_dir).select("id", "start_time"), [F.col("start_time"), F.col("id")], 49, 50)


@query(f"{_OVERRIDES} SELECT event_id, event_city, created_at FROM ov WHERE trim(coalesce(event_title, '')) <> '' ORDER BY (event_city = 'city2') DESC, created_at DESC, event_id LIMIT 20")
def w10_few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.few_shot(_overrides(spark, sf_dir), "city2").select("event_id", "event_city", "created_at")


@query(
    f"SELECT id, CASE WHEN len(n) <= 1 THEN source ELSE array_to_string(list_concat(list_concat(lead, list_filter(p, lambda s: NOT list_contains(lead, s))), a), ', ') END AS source FROM (SELECT *, list_filter(p, lambda s: contains(lower(coalesce(location, '')), s))[1:1] AS lead FROM ("
    f"SELECT id, source, location, {_NAMES} AS n, list_sort(list_filter({_NAMES}, lambda s: s NOT IN {_in(AGGREGATORS)})) AS p, list_sort(list_filter({_NAMES}, lambda s: s IN {_in(AGGREGATORS)})) AS a FROM cal))"
)
def o5_display_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(spark, sf_dir).select("id", dedup.display_sources(F.col("source"), F.col("location"), _list(AGGREGATORS)).alias("source"))


@query(
    ", i AS (SELECT DISTINCT coalesce(source_uid, CAST(id AS VARCHAR)) AS guid, min(start_time) AS start_time FROM cal WHERE start_time >= TIMESTAMP '2024-01-10' GROUP BY 1), c AS (SELECT i.guid, i.start_time, TIMESTAMP '2024-01-05 00:00:00' AS pub_date FROM i WHERE guid LIKE 'u1%' UNION ALL "
    f"SELECT guid, start_time, {NOW} FROM i WHERE guid NOT LIKE 'u1%' AND guid NOT LIKE 'u2%') SELECT guid, start_time, pub_date FROM c ORDER BY pub_date DESC, start_time, guid LIMIT 100"
)
def x2_rss_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = calendar(spark, sf_dir).filter("start_time >= TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    items = cal.groupBy(F.coalesce("source_uid", F.col("id").cast("string")).alias("guid")).agg(F.min("start_time").alias("start_time"))
    latest = items.filter("guid like 'u1%'").select("guid", F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'").alias("pub_date"))
    return store.rss_latest(items, latest, items.filter("guid like 'u1%' or guid like 'u2%'").select("guid"), _now())


@query("SELECT DISTINCT feed FROM hist WHERE feed NOT IN (SELECT concat('feed', CAST(s_suppkey % 3 AS VARCHAR)) FROM supplier)")
def x3_stale_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_disk = _table(spark, sf_dir, "supplier").selectExpr("concat('feed', cast(s_suppkey % 3 as string)) as feed")
    return store.stale_feeds(feed_history(spark, sf_dir), on_disk)


@query("SELECT doc_id, substr(lower(regexp_replace(regexp_replace(text, '^(the |a |an )', '', 'i'), '[^\\p{L}\\p{N}]', '', 'g')), 1, 40) AS title_key FROM documents")
def e1_normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.normalize_title(F.col("text")).alias("title_key"))


@query(
    f", g AS (SELECT city, CAST(start_time AS DATE) AS day, substr(lower(regexp_replace(trim(title), '[^\\p{{L}}\\p{{N}}]', '', 'g')), 1, 40) AS title_key, id, source, url, coalesce(list_contains({_sqlist(AGGREGATORS)}, source), false) AS agg, {_NAMES} AS n FROM cal WHERE source IS NOT NULL), "
    "s AS (SELECT city, day, title_key, arg_min(id, CAST(agg AS INT) * 1000000000 + id) AS id, arg_min(source, CAST(agg AS INT) * 1000000000 + id) AS src, list_sort(list_distinct(flatten(list(n)))) AS n, count(*) AS members FROM g GROUP BY 1, 2, 3), "
    "m AS (SELECT city, day, title_key, name || '=' || arg_max(url, id) AS pair FROM (SELECT city, day, title_key, id, url, unnest(n) AS name FROM g WHERE coalesce(url, '') <> '') GROUP BY city, day, title_key, name), "
    "u AS (SELECT city, day, title_key, string_agg(pair, ';' ORDER BY pair) AS source_urls FROM m GROUP BY 1, 2, 3) "
    f"SELECT s.city, s.day, s.title_key, s.id, members, CASE WHEN len(n) > 1 THEN array_to_string(list_concat(list_filter(n, lambda x: x NOT IN {_in(AGGREGATORS)}), list_filter(n, lambda x: x IN {_in(AGGREGATORS)})), ', ') ELSE src END AS source, coalesce(source_urls, '') AS source_urls FROM s LEFT JOIN u ON u.city = s.city AND u.day = s.day AND u.title_key = s.title_key"
)
def e5_merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = calendar(spark, sf_dir).filter("source is not null").select(*dedup.combine_key(F.col("city"), F.trim("title"), F.col("start_time")), "id", "source", "url")
    out = dedup.merge_groups(cal, ["city", "day", "title_key"], _list(AGGREGATORS), "id")
    pairs = F.transform(F.map_entries("source_urls"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return out.select("city", "day", "title_key", "id", "members", "source", F.array_join(F.array_sort(pairs), ";").alias("source_urls"))


@query()
def e3_prefix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("lang").alias("city"), (F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 7).cast("int"))).alias("day"), text.normalize_title(F.col("text")).alias("title_key"), (F.col("source") == "src0").alias("agg"))
    keys = docs.groupBy("city", "day", "title_key").agg(F.bool_or("agg").alias("has_agg"))
    return cluster.prefix_groups(keys)


_TITLED = (
    "t AS (SELECT doc_id AS id, regexp_replace(regexp_extract(text, '[^.!?\n]*'), '[^\x20-\x7E]', '_', 'g') AS title, lang, CAST(doc_id % 7 AS INT) AS day, CASE WHEN doc_id % 4 > 0 THEN source END AS location FROM documents), "
    "ev AS (SELECT * FROM t UNION ALL SELECT id + 1000000000, CASE id % 4 WHEN 0 THEN upper(title) || '!' WHEN 1 THEN 'An ' || title WHEN 2 THEN left(title, length(title) - 1) ELSE replace(title, 'en', 'n') END, lang, day, '' FROM t WHERE id % 3 = 0)"
)


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events titled by the first sentence of a document (other letters than ASCII as ``_``, as SQL
    counts an edit of them by bytes), and changed copies of a third of them."""
    docs, n = _table(spark, sf_dir, "documents"), F.col("id")
    rows = docs.select(
        F.col("doc_id").alias("id"), F.regexp_replace(F.regexp_extract("text", r"[^.!?\n]*", 0), r"[^\x20-\x7E]", "_").alias("title"), "lang",
        (F.col("doc_id") % 7).cast("int").alias("day"), F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("location"),
    )
    title = F.col("title")
    changed = (
        F.when(n % 4 == 0, F.concat(F.upper(title), F.lit("!"))).when(n % 4 == 1, F.concat(F.lit("An "), title))
        .when(n % 4 == 2, F.left(title, F.length(title) - 1)).otherwise(F.replace(title, F.lit("en"), F.lit("n")))
    )
    copies = rows.where(n % 3 == 0).select((n + 1000000000).alias("id"), changed.alias("title"), "lang", "day", F.lit("").alias("location"))
    return rows.unionByName(copies)


@query()
def e9_cluster_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_titles(titled(spark, sf_dir), ["lang", "day"])


@query()
def e10_legacy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.legacy_dedupe(titled(spark, sf_dir), ["lang", "day"])


@query(
    f", {_TITLED} SELECT a.id AS id_a, b.id AS id_b, CASE WHEN greatest(length(a.title), length(b.title)) = 0 THEN 1.0 ELSE 1 - levenshtein(lower(a.title), lower(b.title)) / greatest(length(a.title), length(b.title)) END AS similarity "
    "FROM ev a JOIN ev b ON a.lang = b.lang AND a.day = b.day AND a.id < b.id WHERE similarity >= 0.6"
)
def e11_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar_pairs(titled(spark, sf_dir), ["lang", "day"], 0.6)


@query("SELECT id, md5(title || '-' || strftime(start_time, '%Y-%m-%dT%H:%M:%S')) || '@x.org' AS uid, coalesce(nullif(source_uid, ''), md5(title || '|' || strftime(start_time, '%Y-%m-%dT%H:%M:%S'))) AS guid, substr(md5(title), 1, 16) AS short FROM cal")
def e12_event_uids(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss")
    return calendar(spark, sf_dir).select("id", text.event_uid(F.col("title"), iso, "x.org").alias("uid"), text.rss_guid(F.col("source_uid"), F.col("title"), iso).alias("guid"), text.short_uid(F.col("title")).alias("short"))


@query(
    ", u AS (SELECT page_id, string_split(replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', ''), '.')[1] AS d, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '')[1:2] AS p FROM pages) "
    "SELECT page_id, substr(regexp_replace(lower(regexp_replace(CASE WHEN len(p) > 0 THEN d || '_' || array_to_string(p, '_') ELSE d END, '[^a-zA-Z0-9]+', '_', 'g')), '^_+|_+$', '', 'g'), 1, 50) AS slug FROM u"
)
def e13_feed_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", urls.feed_slug(F.col("url")).alias("slug"))


@query(
    "SELECT doc_id, CASE WHEN p > 0 THEN CASE WHEN p > 41 THEN '...' ELSE '' END || substr(t, greatest(p - 40, 1), least(p - 1, 40)) || '**' || substr(t, p, 2) || '**' || substr(t, p + 2, 40) "
    "|| CASE WHEN length(t) > p + 41 THEN '...' ELSE '' END END AS snip FROM (SELECT *, instr(lower(t), 'an') AS p FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), ' {2,}', ' ', 'g') AS t FROM documents))"
)
def u2_term_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.term_snippet(F.col("text"), F.lit("an")).alias("snip"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS short, regexp_replace(text, '<[^>]+>', '', 'g') AS plain FROM documents")
def u3_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text"), 80).alias("short"), text.strip_tags(F.col("text")).alias("plain"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages")
def u4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text.strip_tags_spaced(F.col("html")).alias("plain"))


@query("SELECT doc_id, replace(replace(replace(replace(text, '\\', '\\\\'), ';', '\\;'), ',', '\\,'), chr(10), '\\n') AS escaped FROM documents")
def u5_ics_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", text.ics_escape(F.col("text")).alias("escaped"))


@query(f"SELECT id, array_to_string({_ORDERED}, '|') AS names FROM cal")
def u6_unique_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(spark, sf_dir).select("id", F.array_join(text.source_list(F.col("source")), "|").alias("names"))


@query(f"SELECT id, CASE WHEN coalesce(source, '') = '' THEN '' ELSE 'Source: ' || array_to_string(list_transform({_ORDERED}, lambda s: CASE WHEN s = 'src2' THEN '[src2](https://two/)' ELSE s END), ', ') END AS links FROM cal")
def u7_source_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(spark, sf_dir).select("id", text.source_links(F.col("source"), F.create_map(F.lit("src2"), F.lit("https://two/"))).alias("links"))


@query(
    "SELECT id, strftime(start_time, '%Y%m%dT%H%M%S') AS raw, start_time AS wall, timezone('America/New_York', start_time) AT TIME ZONE 'UTC' AS instant, id % 10 = 0 AS all_day FROM cal".replace("timezone('America/New_York', start_time) AT TIME ZONE 'UTC'", "start_time + INTERVAL 5 HOUR")
)
def u8_ics_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar(spark, sf_dir).withColumn("raw", F.date_format("start_time", "yyyyMMdd'T'HHmmss"))
    rows = rows.withColumn("tzid", F.when(F.col("id") % 2 == 0, "No/Such_Zone").otherwise("America/New_York"))
    rows = dates.with_event_zone(rows, "tzid", F.lit("America/New_York"))
    params = F.when(F.col("all_day"), ";VALUE=DATE").otherwise("")
    return rows.select("id", "raw", dates.wall_clock(F.col("raw")).alias("wall"), dates.instant(F.col("raw"), F.col("zone")).cast("timestamp_ntz").alias("instant"), dates.is_all_day(F.col("raw"), params).alias("all_day"))


@query(
    "SELECT id, d AS d1, d AS d2, d AS d3, d AS d4, make_date(2028, month(d), day(d)) AS d5, CAST(NULL AS DATE) AS d6, strftime(start_time, '%H:00') AS t1, strftime(start_time, '%H:00') AS t2, strftime(start_time, '%H:%M') AS t3, "
    "CAST(NULL AS VARCHAR) AS t4 FROM (SELECT *, CAST(start_time AS DATE) AS d FROM cal)"
)
def u12_parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda before, form, after="": F.concat(F.lit(before), F.date_format("start_time", form), F.lit(after))
    return calendar(spark, sf_dir).select(
        "id", dates.parse_date(said("", "MMMM d, yyyy")).alias("d1"), dates.parse_date(said("", "M/d/yyyy")).alias("d2"), dates.parse_date(said("on ", "yyyy-MM-dd", "!")).alias("d3"),
        dates.parse_date(said("", "MM.dd.yy", " doors 7pm")).alias("d4"), dates.parse_date(said("Sat ", "MMM d"), 2028).alias("d5"), dates.parse_date(said("Sat ", "MMM d")).alias("d6"),
        dates.parse_time(said("", "h:mm a")).alias("t1"), dates.parse_time(said("Doors ", "ha")).alias("t2"), dates.parse_time(said("from ", "HH:mm", " on")).alias("t3"), dates.parse_time(said("", "yyyy-MM-dd")).alias("t4"),
    )


@query("SELECT id, CASE WHEN extract(hour FROM start_time) = 0 THEN '' ELSE strftime(start_time, '%-I:%M %p') END AS label, CAST(ceil(extract(day FROM start_time) / 7) AS INTEGER) AS nth FROM cal")
def u13_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(spark, sf_dir).select("id", dates.time_label(F.col("start_time")).alias("label"), dates.ordinal_weekday(F.col("start_time")).alias("nth"))


@query(
    ", r AS (SELECT id, start_time, unnest(generate_series(CAST(start_time AS DATE), DATE '2024-02-20', INTERVAL 1 DAY)) AS d FROM cal) "
    "SELECT id, d + (start_time - date_trunc('day', start_time)) AS occurrence FROM r WHERE d >= DATE '2024-01-10' AND isodow(d) IN (2, 4) AND (date_diff('day', CAST(date_trunc('week', start_time) AS DATE), CAST(date_trunc('week', d) AS DATE)) // 7) % 2 = 0"
)
def u15_expand_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar(spark, sf_dir).select("id", "start_time").withColumn("rrule", F.lit("FREQ=WEEKLY;INTERVAL=2;BYDAY=TU,TH"))
    return recurrence.expand(rows, "rrule", "start_time", _today(), F.expr("DATE '2024-02-20'")).select("id", "occurrence")


@query(
    ", r AS (SELECT id, start_time, unnest(generate_series(CAST(start_time AS DATE), DATE '2024-06-30', INTERVAL 1 DAY)) AS d FROM cal), "
    "h AS (SELECT id, start_time, d, row_number() OVER (PARTITION BY id ORDER BY d) AS n FROM r WHERE isodow(d) = 5 AND ceil(day(d) / 7) = 2) "
    "SELECT id, d + (start_time - date_trunc('day', start_time)) AS occurrence FROM h WHERE n <= 3"
)
def u15_expand_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar(spark, sf_dir).select("id", "start_time").withColumn("rrule", F.lit("FREQ=MONTHLY;BYDAY=2FR;COUNT=3"))
    return recurrence.expand(rows, "rrule", "start_time", F.expr("DATE '2024-01-01'"), F.expr("DATE '2024-06-30'")).select("id", "occurrence")


#: Rules with, for SQL, the test of a day (d, the start s), and the ranks in a month or year that BYSETPOS asks for.
_RULES = (
    ("FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1", "isodow(d) < 6", "back = 1", "month"),
    ("FREQ=DAILY;BYMONTH=2", "month(d) = 2", "", "day"),
    ("FREQ=MONTHLY;BYMONTHDAY=15,-1", "day(d) = 15 OR day(d + 1) = 1", "", "month"),
    ("FREQ=YEARLY;BYMONTH=3;BYDAY=2SU", "month(d) = 3 AND isodow(d) = 7 AND day(d) BETWEEN 8 AND 14", "", "year"),
    ("FREQ=WEEKLY;INTERVAL=2;WKST=SU;BYDAY=SU,TU", "isodow(d) IN (2, 7) AND ((date_diff('day', DATE '2023-12-31', d) // 7) - (date_diff('day', DATE '2023-12-31', s) // 7)) % 2 = 0", "", "week"),
    ("FREQ=YEARLY;BYYEARDAY=60,-1", "dayofyear(d) = 60 OR (month(d) = 12 AND day(d) = 31)", "", "year"),
    ("FREQ=MONTHLY;BYDAY=FR,SA;BYSETPOS=1,3;COUNT=4", "isodow(d) IN (5, 6)", "rank IN (1, 3)", "month"),
    ("FREQ=WEEKLY;BYDAY=TU;UNTIL=20240206T050000Z", "isodow(d) = 2 AND d + t <= TIMESTAMP '2024-02-06 00:00:00'", "", "week"),
    ("FREQ=YEARLY;BYWEEKNO=20,-1;BYDAY=MO", "isodow(d) = 1 AND (week(d) = 20 OR week(d) = week(make_date(CAST(isoyear(d) AS INTEGER), 12, 28)))", "", "year"),
    ("FREQ=MONTHLY;BYDAY=FR;BYMONTHDAY=13", "isodow(d) = 5 AND day(d) = 13", "", "month"),
    ("FREQ=FORTNIGHTLY", None, "", "day"),
    (None, None, "", "day"),
)
_RANKED = "".join(f" WHEN {i} THEN {place}" for i, (_, _, place, _) in enumerate(_RULES) if place)


@query(
    f", b AS (SELECT id, 'f' || city AS file, id % {len(_RULES)} AS kind, CAST(start_time AS DATE) AS s, start_time - date_trunc('day', start_time) AS t FROM cal), "
    "w AS (SELECT *, unnest(generate_series(date_trunc('year', s), DATE '2024-12-31', INTERVAL 1 DAY)) AS d0 FROM b), g AS (SELECT * EXCLUDE (d0), CAST(d0 AS DATE) AS d FROM w), "
    f"h AS (SELECT *, CASE kind {' '.join(f"WHEN {i} THEN date_trunc('{p}', d)" for i, (_, _, _, p) in enumerate(_RULES))} END AS period FROM g WHERE CASE kind {' '.join(f'WHEN {i} THEN {c or "d = s"}' for i, (_, c, _, _) in enumerate(_RULES))} END), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY id, period ORDER BY d) AS rank, row_number() OVER (PARTITION BY id, period ORDER BY d DESC) AS back FROM h), "
    f"y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS nr FROM k WHERE d >= s AND CASE kind {_RANKED} ELSE true END), "
    "u AS (SELECT id, kind, s + t AS begun, d + t AS ts FROM y WHERE (kind <> 6 OR nr <= 4) AND NOT (id % 3 = 0 AND d = s) UNION SELECT id, kind, s + t, s + INTERVAL 10 DAY + INTERVAL 90 MINUTE FROM b WHERE id % 4 = 0), "
    "e AS (SELECT id, ts, kind < 11 OR id % 4 = 0 AS suffixed FROM u WHERE NOT (id % 5 = 0 AND ts = begun) UNION ALL SELECT id, s + t + INTERVAL 2 DAY, true FROM b WHERE id % 5 = 0) "
    "SELECT id, ts AS start_time, 'uid-' || id || CASE WHEN suffixed THEN '__' || strftime(ts, '%Y%m%d') ELSE '' END AS uid FROM e WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-10-07'"
)
def u15_recurrence_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as ICS text with a rule, dates taken out and added, and moved instances; parsed and expanded."""
    ny, id_ = F.lit("America/New_York"), F.col("id")
    local = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss")
    utc = lambda c: F.concat(local(F.convert_timezone(ny, F.lit("UTC"), c)), F.lit("Z"))
    rule = F.element_at(F.array(*[F.lit(r[0]) for r in _RULES]), (id_ % len(_RULES) + 1).cast("int"))
    start = F.col("start_time")
    more = F.to_date(start).cast("timestamp_ntz") + F.expr("INTERVAL '10 01:30' DAY TO MINUTE")
    head = [F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:uid-"), id_.cast("string"))]
    series = F.concat_ws(
        "\r\n", *head, F.concat(F.lit("DTSTART;TZID=America/New_York:"), local(start)), F.concat(F.lit("RRULE:"), rule),
        F.when(id_ % 3 == 0, F.concat(F.lit("EXDATE:20200101T000000Z,"), utc(start), F.lit("\r\nEXDATE;TZID=America/New_York:20200102T000000"))),
        F.when(id_ % 4 == 0, F.concat(F.lit("RDATE;TZID=America/New_York;VALUE=PERIOD:"), local(more), F.lit("/PT1H"))), F.lit("END:VEVENT"),
    )
    moved = F.concat_ws(
        "\r\n", *head, F.concat(F.lit("RECURRENCE-ID;TZID=America/New_York:"), local(start)),
        F.concat(F.lit("DTSTART;TZID=America/New_York:"), local(start + F.expr("INTERVAL 2 DAYS"))), F.lit("END:VEVENT"),
    )
    body = F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), series, F.when(id_ % 5 == 0, moved), F.lit("END:VCALENDAR"))
    files = calendar(spark, sf_dir).select(F.concat(F.lit("f"), "city").alias("file"), body.alias("content"))
    rows = ics.with_recurrence(dates.with_event_zone(ics.parse(files), "tzid", ny), F.col("zone"))
    rows = rows.select("file", "uid", "zone", "start_time", "rrule", "exdates", "rdates", "recurrence_id")
    made = recurrence.expand_events(rows, _today(), 270, F.col("zone"))
    return made.select(F.regexp_extract("uid", r"^uid-(\d+)", 1).cast("bigint").alias("id"), "start_time", "uid")


@query("SELECT id, 'FREQ=WEEKLY' || CASE WHEN id % 3 > 1 THEN ';INTERVAL=' || CAST(id % 3 AS VARCHAR) ELSE '' END || ';BYDAY=MO' || CASE WHEN id % 2 = 0 THEN ';UNTIL=' || strftime(start_time, '%Y%m%d') ELSE '' END AS rule FROM cal")
def u16_build_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    until = F.when(F.col("id") % 2 == 0, F.col("start_time"))
    return calendar(spark, sf_dir).select("id", recurrence.build_rule(F.lit("weekly"), (F.col("id") % 3), F.lit("mo"), until).alias("rule"))


@query("SELECT s_suppkey, round(2 * 3956.0 * asin(sqrt(pow(sin(radians(s_acctbal / 200 - 38.5) / 2), 2) + cos(radians(38.5)) * cos(radians(s_acctbal / 200)) * pow(sin(radians(s_nationkey - 122.0) / 2), 2))), 4) AS miles FROM supplier")
def u22_miles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = geo.miles(F.lit(38.5), F.lit(122.0), F.col("s_acctbal") / 200, F.col("s_nationkey").cast("double"))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", F.round(at, 4).alias("miles"))


@query("SELECT page_id, CASE WHEN trim(html) = '' THEN 'empty' WHEN starts_with(lower(html), '<!doctype') OR contains(lower(substr(html, 1, 512)), '<html') THEN 'html' WHEN starts_with(html, '{') OR starts_with(html, '[') THEN 'json' ELSE 'unknown' END AS kind FROM pages")
def u25_content_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", labels.content_kind(F.col("html")).alias("kind"))


_case = lambda classes, c: "CASE " + " ".join("WHEN " + " OR ".join(f"contains({c}, '{m}')" for m in marks) + f" THEN '{n}'" for n, marks in classes)


@query(f"SELECT conv_id, turn, {_case(LOG_CLASSES, 'lower(text)')} ELSE 'error' END AS kind, {_case(COMMAND_CLASSES, 'lower(text)')} ELSE 'command_failed' END AS failure FROM conversations")
def u26_log_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", labels.log_issue(F.col("text"), F.lit("error")).alias("kind"), labels.command_failure(F.col("text"), F.lit(None)).alias("failure"))


@query(f"SELECT id, CASE WHEN list_contains({_sqlist(CATEGORIES)}, a) THEN a ELSE list_filter({_sqlist(CATEGORIES)}, lambda c: contains(lower(a), lower(c)))[1] END AS label FROM (SELECT id, trim(CASE WHEN id % 2 = 0 THEN 'I say: ' || upper(coalesce(category, 'none')) ELSE coalesce(category, '') END) AS a FROM cal)")
def u28_category_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("id") % 2 == 0, F.concat(F.lit("I say: "), F.upper(F.coalesce("category", F.lit("none"))))).otherwise(text.blank(F.col("category")))
    return calendar(spark, sf_dir).select("id", labels.category_label(answer).alias("label"))


@query(f"SELECT doc_id, {snippet_sql('text', 'left(text, 30)')} AS snippet FROM documents")
def u1_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("title", F.substring("text", 1, 30))
    return with_snippet(docs, "text").select("doc_id", "snippet")


@query(f"SELECT city, count(*) AS total, count(s) AS with_snippet, round_even(count(s) * 100.0 / count(*), 1) AS pct FROM (SELECT source AS city, {snippet_sql('text')} AS s FROM documents) GROUP BY city")
def a16_snippet_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("title", F.lit(""))
    return aggregates.snippet_coverage(with_snippet(docs, "text").withColumn("city", F.col("source")))


@query("SELECT id, CASE WHEN coalesce(category, '') <> '' THEN category WHEN contains(lower(d), 'story') THEN 'Family / Kids' END AS category FROM (SELECT id, category, description AS d FROM cal) WHERE false OR id IN (SELECT id FROM cal WHERE coalesce(category, '') <> '')")
def c1_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify.classify(calendar(spark, sf_dir))
    return out.filter("category <> ''").select("id", "category")


@query(
    "SELECT id, trim(title) AS title, coalesce(location, '') AS location, trim(coalesce(description, '')) || chr(10) || 'x, y; z\\' AS description, url, 'uid-' || CAST(id AS VARCHAR) AS uid, strftime(start_time, '%Y%m%dT%H%M%SZ') AS dtstart_raw, strftime(start_time, '%Y%m%d') AS dtend_raw, "
    "'' AS tzid, 'Etc/Nowhere' AS end_tzid, '' AS dtstart_params, 'src9' AS x_source, 'a|b c' AS categories, image_url, city || '-' || strftime(start_time, '%Y%m%d%H') AS file, "
    "CAST(row_number() OVER (PARTITION BY city, date_trunc('hour', start_time) ORDER BY CAST(id AS VARCHAR)) - 1 AS INTEGER) AS pos FROM cal"
)
def s2_ics_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as folded ICS text, one file a city and hour, and parsed again."""
    put = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(label), value))
    place = text.ics_escape(F.col("location"))
    told = text.ics_escape(F.concat(F.coalesce("description", F.lit("")), F.lit("\nx, y; z\\")))
    line = F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"), put("UID:uid-", F.col("id").cast("string")), put("DTSTART:", F.date_format("start_time", "yyyyMMdd'T'HHmmss'Z'")),
        put("DTEND;TZID=Etc/Nowhere;VALUE=DATE:", F.date_format("start_time", "yyyyMMdd'Z'")), put("SUMMARY;LANGUAGE=en:", text.ics_escape(F.col("title"))),
        F.concat(F.lit("LOCATION:"), F.substring(place, 1, 5), F.lit("\r\n "), F.substring(place, 6, 1000)), put("DESCRIPTION:", told), put("URL:", F.col("url")),
        F.lit("X-SOURCE:src9"), F.lit("CATEGORIES: a ,b c,"), put("ATTACH;FMTTYPE=image/png:", F.col("image_url")), F.lit("END:VEVENT"),
    )
    block = F.struct(F.col("id").cast("string").alias("id"), line.alias("line"))
    files = calendar(spark, sf_dir).groupBy(F.concat_ws("-", "city", F.date_format("start_time", "yyyyMMddHH")).alias("file")).agg(
        F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda b: b["line"]), "\r\n"), F.lit("\r\nEND:VCALENDAR")).alias("content")
    )
    rows = ics.parse(files).withColumn("categories", F.array_join("ics_categories", "|")).withColumn("id", F.substring("uid", 5, 20).cast("bigint"))
    return rows.select("id", "title", "location", "description", "url", "uid", "dtstart_raw", "dtend_raw", "tzid", "end_tzid", "dtstart_params", "x_source", "categories", "image_url", "file", "pos")


_XML = "replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    f", r AS (SELECT *, coalesce(nullif(source_uid, ''), md5(title || '|' || strftime(start_time, '%Y-%m-%d %H:%M:%S'))) AS guid FROM cal WHERE start_time BETWEEN {NOW} - INTERVAL 12 HOUR AND {NOW} + INTERVAL 90 DAY) "
    f"SELECT guid, start_time, '<item><title>' || {_XML.format('title')} || '</title><link>' || {_XML.format("coalesce(nullif(url, ''), 'https://x.example/')")} || '</link><description>' || {_XML.format('left(description, 300)')} "
    "|| '</description><guid isPermaLink=\"false\">' || guid || '</guid><pubDate>' || strftime(start_time, '%a, %d %b %Y %H:%M:%S') || ' +0000</pubDate></item>' AS item FROM r"
)
def k4_rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.rss_rows(calendar(spark, sf_dir), _now(), "https://x.example/")


@query(
    f"SELECT id, CASE category {' '.join(f"WHEN '{c}' THEN '{t}'" for c, t in SCHEMA_TYPES.items())} ELSE 'Event' END AS kind, title AS name, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start, url, strftime(end_time, '%Y-%m-%d %H:%M:%S') AS until, nullif(description, '') AS description, "
    "trim(split_part(location, ',', 1)) AS place, nullif(trim(regexp_extract(location, '^[^,]*,(.*)$', 1)), '') AS street, nullif(image_url, '') AS image, 'https://schema.org/OfflineEventAttendanceMode' AS mode FROM cal"
)
def k5_jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = {"kind": "['@type']", "name": ".name", "start": ".startDate", "url": ".url", "until": ".endDate", "description": ".description", "place": ".location.name", "street": ".location.address.streetAddress", "image": ".image", "mode": ".eventAttendanceMode"}
    doc = calendar(spark, sf_dir).select("id", export.jsonld().alias("j"))
    return doc.select("id", *[F.get_json_object("j", f"${p}").alias(n) for n, p in get.items()])


@query(
    "SELECT id, substr(sha256('BEGIN:VEVENT' || e || 'UID:event-' || CAST(id AS VARCHAR) || '@eventloom' || e || 'DTSTAMP:20240110T120000Z' || e || 'DTSTART:' || strftime(start_time, '%Y%m%dT%H%M%SZ') || coalesce(e || 'DTEND:' || strftime(end_time, '%Y%m%dT%H%M%SZ'), '') "
    "|| e || 'SUMMARY:' || title || CASE WHEN coalesce(location, '') <> '' THEN e || 'LOCATION:' || replace(location, ',', '\\,') ELSE '' END || CASE WHEN coalesce(description, '') <> '' THEN e || 'DESCRIPTION:' || description ELSE '' END || CASE WHEN coalesce(url, '') <> '' THEN e || 'URL:' || url ELSE '' END || e || 'END:VEVENT'), 1, 16) AS etag FROM (SELECT *, chr(13) || chr(10) AS e FROM cal)"
)
def k7_event_ics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar(spark, sf_dir).withColumn("rrule", F.lit(None).cast("string"))
    return rows.select("id", export.etag(export.event_ics(_now())).alias("etag"))


_URL = "replace(url_encode(coalesce({0}, '')), '%20', '+')"


@query(
    f"SELECT id, 'https://calendar.google.com/calendar/render?action=TEMPLATE&text=' || {_URL.format('title')} || '&dates=' || strftime(start_time, '%Y%m%dT%H%M%SZ') || '%2F' || strftime(coalesce(end_time, start_time), '%Y%m%dT%H%M%SZ') "
    f"|| '&location=' || {_URL.format('location')} || '&details=' || {_URL.format('description')} AS url FROM cal"
)
def k7_google_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendar(spark, sf_dir).select("id", export.google_calendar_url().alias("url"))


@query("SELECT city, unnest(['# ' || name, url]) AS line FROM feeds WHERE status = 'active'")
def k8_feed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.feed_list(feeds(spark, sf_dir))


@query("SELECT source, source_id, location, count(*) AS count, array_to_string(list(title ORDER BY id)[1:3], '|') AS titles FROM cal WHERE location LIKE 'loc%' AND source IS NOT NULL GROUP BY 1, 2, 3")
def k3_geo_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = calendar(spark, sf_dir).filter("location like 'loc%' and source is not null").withColumn("pos", F.col("id"))
    return aggregates.geo_summary(dropped).withColumn("titles", F.array_join("titles", "|"))


@query(
    "SELECT city, '{\"categories\":[' || c || '],\"images\":[{\"with_image\":' || i || '}]}' AS report FROM (SELECT city, string_agg('{\"category\":\"' || category || '\",\"count\":' || n || '}', ',' ORDER BY category) AS c, CAST(sum(i) AS VARCHAR) AS i "
    "FROM (SELECT city, coalesce(category, '') AS category, CAST(count(*) AS VARCHAR) AS n, count(image_url) AS i FROM cal GROUP BY 1, 2) GROUP BY city)"
)
def k9_report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = calendar(spark, sf_dir)
    return export.report_documents({"categories": cal.groupBy("city", F.coalesce("category", F.lit("")).alias("category")).count(), "images": cal.groupBy("city").agg(F.count("image_url").alias("with_image"))})


@query("SELECT id, name, url FROM feeds WHERE status IN ('active', 'pending') AND city = 'city1' AND id >= 5 ORDER BY name DESC, id LIMIT 7".replace("id >= 5", "id >= 5"))
def s23_rest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = {"status": "in.(active,pending)", "city": "eq.city1", "id": "gte.5", "order": "name.desc,id.asc", "limit": "7", "select": "id,name,url"}
    return registries.rest_filter(feeds(spark, sf_dir), params)


@query("SELECT id, name, url FROM feeds WHERE status IN ('active', 'pending') AND feed_type = 'ics_url' AND city = 'city1'")
def s17_download_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registries.download_list(feeds(spark, sf_dir), "city1").select("id", "name", "url")


@query("SELECT city, url, CASE WHEN status = 'pending' AND id % 2 = 1 THEN 'active' ELSE status END AS status FROM feeds")
def i8_activate_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = feeds(spark, sf_dir)
    return store.activate_pending(stored, stored.filter("id % 2 = 1")).select("city", "url", "status")


_INCOMING = "SELECT id + 1000000 AS id, title, start_time, CASE WHEN id % 4 = 0 THEN 'city9' ELSE city END AS city, source_uid FROM cal WHERE id % 3 = 0"


@query(
    f", inc AS (SELECT * FROM ({_INCOMING}) WHERE coalesce(source_uid, '') <> '' QUALIFY row_number() OVER (PARTITION BY source_uid ORDER BY start_time, id) = 1) "
    "SELECT id, title, start_time, city, source_uid FROM cal c WHERE NOT EXISTS (SELECT 1 FROM inc WHERE inc.source_uid = c.source_uid) UNION ALL SELECT id, title, start_time, city, source_uid FROM inc"
)
def i1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = calendar(spark, sf_dir).select("id", "title", "start_time", "city", "source_uid")
    incoming = spark.sql(_INCOMING.replace("FROM cal", "FROM {cal}"), cal=current)
    return store.upsert(current, incoming)


@query("SELECT id, city FROM cal c WHERE NOT (city = 'city1' AND source_uid IS NOT NULL AND source_uid NOT IN (SELECT source_uid FROM cal WHERE source_uid IS NOT NULL AND id % 2 = 0))")
def i2_delete_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = calendar(spark, sf_dir)
    return store.delete_stale(cal, "city1", cal.filter("id % 2 = 0"))[0].select("id", "city")


def _calendar_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")  # a glob: file or folder
    rows = calendar_of(stream)
    return rows.withColumn("start_time", F.col("start_time").cast("timestamp"))


@query("SELECT start_time AS hour, city, count(*) AS events FROM cal WHERE start_time + INTERVAL 1 HOUR <= (SELECT max(start_time) FROM cal) - INTERVAL 24 HOUR GROUP BY 1, 2")
def i10_streaming_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jobs.run_to_files(jobs.hourly_counts(_calendar_stream(spark, sf_dir)), new_folder(spark, "hourly"), new_folder(spark, "hourly-state"))
    return out.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "city", "events")


@query("SELECT DISTINCT source_uid FROM cal WHERE source_uid IS NOT NULL")
def i6_streaming_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = _calendar_stream(spark, sf_dir).filter("source_uid is not null").select("source_uid", "start_time", "id")
    out = jobs.run_to_files(jobs.first_seen(stream), new_folder(spark, "seen"), new_folder(spark, "seen-state"))
    return out.select("source_uid")
