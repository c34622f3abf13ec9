"""Row predicates of the build, the client and the report.  ``now`` is a parameter everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, search_text, source_list


def upcoming_wall(df: DataFrame, now: Column, hours: int = 24, start: str = "dtstart") -> DataFrame:
    """Wall clocks read as UTC, at or after ``now`` less ``hours``."""
    return df.filter(F.col(start) >= (now - F.make_interval(hours=F.lit(hours))))


def upcoming_instant(df: DataFrame, now: Column, hours: int = 24, start: str = "start_time") -> DataFrame:
    """True instants at or after ``now`` less ``hours``."""
    return df.filter(F.col(start) >= (now - F.make_interval(hours=F.lit(hours))))


def has_title_and_start(df: DataFrame, title: str = "title", start: str = "start_time") -> DataFrame:
    return df.filter((blank(F.col(title)) != "") & F.col(start).isNotNull())


LISTING = (
    "id", "title", "start_time", "end_time", "location", "description", "url", "city", "source", "source_uid",
    "cluster_id", "source_urls", "category", "image_url", "all_day", "merged_ids",
)


def listing(df: DataFrame, city: str, start: Column, end: Column, limit: int = 6000) -> DataFrame:
    """The main read: one city, a time range, earliest first, the listed columns only.
    City and range reach the scan; order and limit are a top-k, not a full sort."""
    kept = df.filter((F.col("city") == city) & (F.col("start_time") >= start) & (F.col("start_time") <= end))
    return kept.select(*[c for c in LISTING if c in df.columns]).orderBy("start_time", "id").limit(limit)


def search(df: DataFrame, term: str | None, category: str | None = None) -> DataFrame:
    """Category first, then the term in title, location, source or description."""
    out = df.filter(F.col("category") == category) if category else df
    if not term:
        return out
    text = search_text(F.col("title"), F.col("location"), F.col("source"), F.col("description"))
    return out.filter(F.contains(text, F.lower(F.lit(term))))


def tile(df: DataFrame, category: str | None, term: str | None, limit: int = 200) -> DataFrame:
    """An embedded tile's rows: not captured posters; the source is not searched."""
    out = df.filter(F.col("source") != "poster_capture").orderBy("start_time", "id").limit(limit)
    out = out.filter(F.col("category") == category) if category else out
    if term:
        t = F.lower(F.lit(term))
        hit = F.lit(False)
        for c in ("title", "description", "location"):
            hit = hit | F.contains(F.lower(blank(F.col(c))), t)
        out = out.filter(hit)
    return out


def visible(source: Column, hidden: Column, aggregators: Column) -> Column:
    """Not hidden: no hidden source is an aggregator, and some source is not hidden."""
    names = source_list(source)
    via = F.exists(names, lambda s: F.array_contains(hidden, s) & F.array_contains(aggregators, s))
    every = F.forall(names, lambda s: F.array_contains(hidden, s))
    return (blank(source) == "") | (~via & ~every)


def not_excluded(df: DataFrame, sources: Column, categories: Column, uids: Column, last_reviewed: Column | None = None) -> DataFrame:
    """External exclusions: sources (split on ', ' as written), categories, uids, and rows
    first seen after the last review."""
    out = df.filter(~F.arrays_overlap(F.split(blank(F.col("source")), ", "), sources))
    out = out.filter(~F.array_contains(categories, blank(F.col("category"))))
    out = out.filter(~F.array_contains(uids, blank(F.col("source_uid"))))
    if last_reviewed is not None:
        out = out.filter(~(F.coalesce("created_at", "start_time") > last_reviewed))
    return out


def day_window(df: DataFrame, base: Column, first: int, last: int) -> DataFrame:
    """Half-open range of whole days after ``base``."""
    return df.filter((F.col("start_time") >= base + F.make_dt_interval(F.lit(first))) & (F.col("start_time") < base + F.make_dt_interval(F.lit(last + 1))))


def feed_violations(feeds: DataFrame, url_pattern: str = r"^scrapers/") -> DataFrame:
    """Scraper rows that may not be stored, with what is wrong; removed rows are exempt."""
    cmd = F.trim(blank(F.col("scraper_cmd")))
    why = (
        F.when(~blank(F.col("url")).rlike(url_pattern), "url is not a scraper path")
        .when(cmd == "", "command is blank")
        .when(~cmd.rlike(r"^python (scrapers|scripts)/"), "command has a wrong prefix")
    )
    rows = feeds.filter((F.col("feed_type") == "scraper") & (F.coalesce(F.col("status"), F.lit("")) != "removed"))
    return rows.withColumn("violation", why).filter(F.col("violation").isNotNull())


def within_horizon(df: DataFrame, now: Column, months: int, start: str = "dtstart") -> DataFrame:
    """From now to ``months`` of 31 days."""
    return df.filter(F.col(start).between(now, now + F.make_dt_interval(F.lit(31 * months))))


def overlaps_ids(ids: Column, wanted: tuple[str, ...]) -> Column:
    """Set membership on id arrays; no wish passes all."""
    return F.lit(True) if not wanted else F.coalesce(F.arrays_overlap(ids, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def any_name_contains(names: Column, part: str) -> Column:
    return F.exists(names, lambda n: F.contains(F.lower(n), F.lit(part.lower())))


def suspicious_hour(hour: Column) -> Column:
    return (hour >= 0) & (hour < 5)


def feed_preview(events: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    """The first future events of a parsed feed."""
    return events.filter(F.col("start_time") >= now).orderBy("start_time", "uid").limit(limit)


def feed_preview_counts(events: DataFrame, now: Column) -> DataFrame:
    return events.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("start_time") >= now).alias("future"),
        F.coalesce(F.bool_or(blank(F.col("rrule")) != ""), F.lit(False)).alias("has_recurrence"),
    )
