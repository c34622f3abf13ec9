"""The stored tables: upsert, guarded stale delete, overrides, feeds and their drift.

A change is a new table: plans here return the full next state, to be written with
``overwrite`` (or merged where the table format can)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, clean_command


class StaleDeleteRefused(Exception):
    """A delete that would remove most of a city without replacing it."""


def upsert(current: DataFrame, incoming: DataFrame, key: str = "source_uid", order: list[Column] | None = None) -> DataFrame:
    """Full-row replace by key; incoming rows without key are dropped, the first of a
    repeated key wins.  A key moves with its row, also to another city."""
    by = Window.partitionBy(key).orderBy(*(order or [F.col("start_time"), F.col("id")]))
    rows = incoming.filter(blank(F.col(key)) != "").withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")
    kept = current.join(rows.select(key), key, "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def stale_rows(events: DataFrame, city: str, incoming: DataFrame, key: str = "source_uid") -> DataFrame:
    """Events of the city whose uid is not incoming; rows without uid are never stale."""
    mine = events.filter((F.col("city") == city) & F.col(key).isNotNull())
    return mine.join(incoming.select(key).distinct(), key, "left_anti")


def delete_stale(events: DataFrame, city: str, incoming: DataFrame, key: str = "source_uid") -> tuple[DataFrame, int]:
    """The table without the city's stale rows, and how many went.  Refused if more than
    half of the city would go and fewer rows come than go; an empty list deletes nothing."""
    current = events.filter(F.col("city") == city).agg(F.count("*").alias("c"))
    gone = stale_rows(events, city, incoming, key).agg(F.count("*").alias("g"))
    n = incoming.agg(F.count("*").alias("i"))
    c, g, i = current.crossJoin(gone).crossJoin(n).first()  # three one-row counts
    if i == 0:
        return events, 0
    if c > 0 and 2 * g > c and i < g:
        raise StaleDeleteRefused(f"{g} of {c} events of {city} would go, {i} came")
    mine = (F.col("city") == city) & F.col(key).isNotNull()
    kept = events.filter(mine).join(incoming.select(key).distinct(), key, "left_semi")
    return kept.unionByName(events.filter(~F.coalesce(mine, F.lit(False)))), g


def carry_categories(events: DataFrame, previous: DataFrame) -> DataFrame:
    """Fill empty categories from the previous build by source_uid."""
    old = previous.filter((blank(F.col("category")) != "") & (blank(F.col("source_uid")) != ""))
    old = old.groupBy("source_uid").agg(F.max_by("category", "id").alias("__old"))
    out = events.join(old, "source_uid", "left")
    return out.withColumn("category", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.col("__old"))).drop("__old")


def apply_overrides(events: DataFrame, overrides: DataFrame) -> DataFrame:
    """A curator's category wins on every write, by source_uid."""
    o = overrides.filter("source_uid is not null").groupBy("source_uid").agg(F.max_by("category", "created_at").alias("__c"))
    return events.join(o, "source_uid", "left").withColumn("category", F.coalesce("__c", "category")).drop("__c")


def reattach_overrides(overrides: DataFrame, events: DataFrame) -> DataFrame:
    """Point overrides at the event that now has their source_uid."""
    ids = events.filter("source_uid is not null").groupBy("source_uid").agg(F.min("id").alias("__id"))
    return overrides.join(ids, "source_uid", "left").withColumn("event_id", F.coalesce("__id", "event_id")).drop("__id")


def overrides_listing(overrides: DataFrame, events: DataFrame, users: DataFrame) -> DataFrame:
    joined = overrides.join(events.select(F.col("id").alias("event_id"), "title", "city"), "event_id").join(users, "curator_id", "left")
    return joined.select("event_id", "title", "city", "category", "original_category", "curator_name", "created_at")


def picked_events(picks: DataFrame, events: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Picks with the user's own enrichment over the event; '' counts as missing."""
    last = enrichments.groupBy(F.col("curator_id").alias("user_id"), "event_id").agg(
        *[F.max_by(c, "id").alias(f"__{c}") for c in ("description", "location", "url")]
    )
    rows = picks.select("user_id", "event_id").join(events.withColumnRenamed("id", "event_id"), "event_id").join(last, ["user_id", "event_id"], "left")
    for c in ("description", "location", "url"):
        rows = rows.withColumn(c, F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c))).drop(f"__{c}")
    return rows


def stamp_picked(events: DataFrame, picks: DataFrame) -> DataFrame:
    """``picked``: any of the merged ids is picked."""
    hit = events.select("id", F.explode("merged_ids").alias("event_id")).join(picks.select("event_id").distinct(), "event_id", "left_semi").select("id").distinct()
    return events.join(hit.withColumn("__p", F.lit(True)), "id", "left").withColumn("picked", F.coalesce("__p", F.lit(False))).drop("__p")


def remove_feed(events: DataFrame, feeds: DataFrame, feed_id: int) -> tuple[DataFrame, DataFrame]:
    """Events and feeds without the feed: its events are those of exactly its city and name."""
    feed = feeds.filter(F.col("id") == feed_id)
    if feed.isEmpty():
        raise ValueError(f"no feed {feed_id}")
    gone = feed.select("city", F.col("name").alias("source"))
    return events.join(gone, ["city", "source"], "left_anti"), feeds.filter(F.col("id") != feed_id)


def scraper_drift(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """(url, type) differences of two scraper lists, by URL."""
    w = manifest.select("url", F.col("name").alias("w_name"), clean_command(F.col("scraper_cmd")).alias("w_cmd"), F.lit(True).alias("w"))
    d = stored.filter("feed_type = 'scraper'").select("url", F.col("name").alias("d_name"), clean_command(F.col("scraper_cmd")).alias("d_cmd"), "status", F.lit(True).alias("d"))
    both = w.join(d, "url", "full_outer")
    in_w, in_d = F.coalesce("w", F.lit(False)), F.coalesce("d", F.lit(False))
    kinds = F.array_compact(F.array(
        F.when(in_w & ~in_d, "workflow_scraper_missing_from_db"),
        F.when(in_w & in_d & (F.col("status") == "removed"), "removed_db_scraper_still_in_workflow"),
        F.when(in_w & in_d & (F.col("w_name") != F.col("d_name")), "scraper_name_mismatch"),
        F.when(in_w & in_d & (F.col("w_cmd") != F.col("d_cmd")), "scraper_command_mismatch"),
        F.when(~in_w & in_d & F.col("status").isin("active", "pending"), "db_scraper_missing_from_workflow"),
    ))
    return both.select("url", F.explode(kinds).alias("type"))


def feed_sync(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(city, url, action): insert, update or retire."""
    w = wanted.select("city", "url", F.col("name").alias("w_name"))
    d = stored.select("city", "url", F.col("name").alias("d_name"), "status")
    act = (
        F.when(F.col("d_name").isNull() & F.col("status").isNull(), "insert")
        .when(F.col("w_name").isNull() & (F.col("status") != "removed"), "retire")
        .when(F.col("w_name") != F.col("d_name"), "update")
    )
    return w.join(d, ["city", "url"], "full_outer").withColumn("action", act).filter("action is not null").select("city", "url", "action")


def activate_pending(feeds: DataFrame, downloaded: DataFrame) -> DataFrame:
    """Pending feeds that were downloaded become active."""
    got = downloaded.select("city", "url").distinct().withColumn("__g", F.lit(True))
    out = feeds.join(got, ["city", "url"], "left")
    return out.withColumn("status", F.when((F.col("status") == "pending") & F.col("__g"), "active").otherwise(F.col("status"))).drop("__g")


def insert_new(feeds: DataFrame, added: DataFrame, key: tuple[str, ...] = ("city", "url")) -> DataFrame:
    return feeds.unionByName(added.dropDuplicates(list(key)).join(feeds.select(*key), list(key), "left_anti"), allowMissingColumns=True)


def rss_latest(current: DataFrame, previous_latest: DataFrame, previous_full: DataFrame, now: Column, limit: int = 100) -> DataFrame:
    """(guid, pub_date): carried items keep their date; items not in the previous full feed
    are dated now; on a first run all are."""
    first = previous_full.isEmpty()
    carried = current.join(previous_latest.select("guid", "pub_date"), "guid")
    fresh = current.join(previous_latest.select("guid"), "guid", "left_anti")
    if not first:
        fresh = fresh.join(previous_full.select("guid"), "guid", "left_anti")
    rows = carried.unionByName(fresh.withColumn("pub_date", now))
    return rows.orderBy(F.desc("pub_date"), "start_time", "guid").limit(limit)


def match_errors(issues: DataFrame, feeds: DataFrame) -> DataFrame:
    """Issues with their feed by name key; keys that several feeds share match none."""
    from ..functions.text import norm_key

    keys = feeds.select(norm_key(F.col("name")).alias("key"), F.col("name").alias("feed"))
    single = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("feed").alias("feed")).filter("n = 1").drop("n")
    return issues.withColumn("key", norm_key(F.col("source"))).join(single, "key", "left").drop("key")


def stale_feeds(history: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(feed): feeds that a report knows and that have no file any more."""
    return history.select("feed").distinct().join(on_disk.select("feed"), "feed", "left_anti")
