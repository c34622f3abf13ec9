"""Same event, many sources: grouping, survivors and merged attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_title, source_list, source_matches_location


def first_known(c: str, order: str = "id", present: Column | None = None) -> Column:
    """The value of ``c`` in the row of least ``order`` among those that have one."""
    ok = F.col(c).isNotNull() if present is None else present
    return F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col(order)))


def deduplicated_events(events: DataFrame) -> DataFrame:
    """One row for each (city, lower-trimmed title, start) of events whose source is not
    ``poster_capture`` (nor null).  A hash aggregate: partial sums on the map side, one
    shuffle on the group key."""
    simple = [c for c in ("end_time", "location", "description", "transcript", "cluster_id", "source_urls", "category", "image_url") if c in events.columns]
    lead = [c for c in ("title", "source_uid", "source_id") if c in events.columns]
    aggs = [F.min("id").alias("id")]
    aggs += [F.min_by(c, "id").alias(c) for c in lead]
    aggs += [first_known(c).alias(c) for c in simple]
    if "url" in events.columns:
        aggs.append(first_known("url", present=F.coalesce(F.col("url"), F.lit("")) != "").alias("url"))
    aggs.append(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("source"))
    if "created_at" in events.columns:
        aggs.append(F.min("created_at").alias("created_at"))
    if "all_day" in events.columns:
        aggs.append(F.bool_or("all_day").alias("all_day"))
    aggs.append(F.array_sort(F.collect_list("id")).alias("merged_ids"))
    if "ics_categories" in events.columns:
        aggs.append(F.min_by("ics_categories", "id").alias("ics_categories"))
    return (
        events.filter(F.col("source") != "poster_capture")
        .groupBy("city", F.lower(F.trim("title")).alias("title_key"), "start_time")
        .agg(*aggs)
        .drop("title_key")
    )


def first_by_uid(events: DataFrame, order: list[Column], uid: str = "source_uid", keep_missing: bool = True) -> DataFrame:
    """The first row of each uid in a total order; rows without uid are kept, or dropped."""
    have = F.coalesce(F.col(uid), F.lit("")) != ""
    by = Window.partitionBy(uid).orderBy(*order)
    once = events.filter(have).withColumn("__n", F.row_number().over(by)).filter("__n = 1").drop("__n")
    return once.unionByName(events.filter(~have)) if keep_missing else once


def merge_groups(events: DataFrame, group: list[str], aggregators: Column, pos: str = "pos") -> DataFrame:
    """Survivor and merged sources of each group: the first primary in ``pos`` order
    survives; names are sorted primaries, then sorted aggregators; ``source_urls`` maps
    each name to a URL, later rows overriding earlier ones."""
    # first by source, so that a group's lists hold its different sources, not its events
    url = F.col("url")
    rest = [c for c in events.columns if c not in group]
    linked = F.max(F.when(url != "", F.struct(F.col(pos).alias("p"), url.alias("u")))).alias("last")
    kinds = events.groupBy(*group, F.col("source").alias("of")).agg(F.min_by(F.struct(*rest), pos).alias("s"), F.min(pos).alias("first"), linked, F.count("*").alias("n"))
    listed = source_list(F.col("of"))
    names = F.array_distinct(F.flatten(F.collect_list(listed)))
    entries = F.flatten(F.collect_list(F.when(F.col("last").isNotNull(), F.transform(listed, lambda s: F.struct(s.alias("key"), F.col("last")["p"].alias("p"), F.col("last")["u"].alias("value"))))))
    best = F.min_by("s", F.struct(F.array_contains(aggregators, F.col("of")).cast("int"), "first"))
    made = kinds.groupBy(*group).agg(best.alias("s"), names.alias("names"), F.array_sort(entries).alias("entries"), F.sum("n").alias("members"))
    agg_of = lambda s: F.array_contains(aggregators, s)
    merged = F.concat(F.array_sort(F.filter("names", lambda s: ~agg_of(s))), F.array_sort(F.filter("names", agg_of)))
    # by name and place, a name's last URL is the one that another name or nothing follows
    after = F.slice("entries", 2, F.size("entries"))
    last = F.filter("entries", lambda e, i: F.coalesce(F.get(after, i)["key"] != e["key"], F.lit(True)))
    urls = F.map_from_entries(F.array_distinct(F.transform(last, lambda e: F.struct(e["key"], e["value"]))))
    out = made.select(*group, "s.*", "names", "members", merged.alias("merged"), urls.alias("source_urls"))
    return out.withColumn("source", F.when(F.size("names") > 1, F.array_join("merged", ", ")).otherwise(F.col("source"))).drop("names", "merged")


def combine_key(city: Column, title: Column, wall_clock: Column) -> list[Column]:
    """Key of the combine stage: the city, the date of the wall clock as written, and the
    title's key form."""
    return [city.alias("city"), F.to_date(wall_clock).alias("day"), normalize_title(title).alias("title_key")]


def display_sources(source: Column, location: Column, aggregators: Column) -> Column:
    """Primaries before aggregators, by name; the first primary that the location names leads."""
    names = source_list(source)
    primary = F.array_sort(F.filter(names, lambda s: ~F.array_contains(aggregators, s)))
    agg = F.array_sort(F.filter(names, lambda s: F.array_contains(aggregators, s)))
    lead = F.slice(F.filter(primary, lambda s: source_matches_location(s, location)), 1, 1)
    ordered = F.concat(lead, F.array_except(primary, lead), agg)
    return F.when(F.size(names) <= 1, source).otherwise(F.array_join(ordered, ", "))


def merge_for_sources(events: DataFrame, aggregators: Column, pos: str = "id") -> DataFrame:
    """Client merge: by city, lower-trimmed title and instant; sources united, first filled
    url, location and description in ``pos`` order."""
    filled = lambda c: first_known(c, pos, F.coalesce(F.col(c), F.lit("")) != "").alias(c)
    lists = F.array_sort(F.collect_list(F.struct(F.col(pos), source_list(F.col("source")).alias("n"))))
    united = F.array_join(F.array_distinct(F.flatten(F.transform(lists, lambda x: x["n"]))), ", ")
    merged = events.groupBy("city", F.lower(F.trim("title")).alias("key"), "start_time").agg(
        F.min_by("title", pos).alias("title"), F.min(pos).alias("id"), filled("url"), filled("location"),
        filled("description"), united.alias("source"), F.array_sort(F.collect_list(pos)).alias("merged_ids"),
    )
    return merged.withColumn("source", display_sources(F.col("source"), F.col("location"), aggregators)).drop("key")
