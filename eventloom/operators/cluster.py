"""Greedy and transitive matching of titles inside small blocks (a day, a time slot).

Work is done on the distinct titles of a block, never on its events; clusters are the connected
components of links that the tasks hand on in place of the pairs they find.  Only order-dependent passes run per block
with ``applyInPandas``, on the columns they need."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank
from ..scratch import materialize
from .graph import components, displaced
from .similar import candidates, linked_titles, score


def cluster_titles(events: DataFrame, slot: list[str], threshold: float = 0.85) -> DataFrame:
    """(id, cluster_id) of every event: clusters of like titles within a slot, numbered from
    0 per slot by their first title; events alone and those without a slot get null.  An
    edge needs similarity at the threshold and no two different locations; clusters are
    transitive."""
    rows = events.select("id", *slot, blank(F.col("title")).alias("title"), blank(F.col("location")).alias("location"))
    kind = [*slot, "title", "location"]
    kinds = materialize(rows.groupBy(*kind).agg(F.min("id").alias("rep"), F.count("*").alias("n")), "kinds")
    links = linked_titles(kinds.dropna(subset=slot).select(*kind, "rep"), slot, threshold)
    joined = kinds.join(components(links, "titles").withColumnRenamed("id", "rep"), "rep", "left").withColumn("group", F.coalesce("component", "rep"))
    joined = materialize(joined, "grouped")
    groups = joined.dropna(subset=slot).groupBy(*slot, "group").agg(F.sum("n").alias("size"), F.min(F.struct(F.lower("title"), "rep")).alias("first")).filter("size > 1")
    number = F.row_number().over(Window.partitionBy(*slot).orderBy("first")) - 1
    numbered = joined.join(groups.select("group", number.alias("cluster_id")), "group").select(*[F.col(c).alias(f"k_{c}") for c in kind], "cluster_id")
    both = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in kind]
    return rows.join(numbered, both, "left").select("id", F.col("cluster_id").cast("int").alias("cluster_id"))


def similarity_histogram(pairs: DataFrame) -> DataFrame:
    bucket = (F.floor(F.col("similarity") * 10) / 10).alias("bucket")
    return pairs.groupBy(bucket).agg(F.count("*").alias("pairs"))


def prefix_groups(keys: DataFrame, min_length: int = 12, max_ratio: float = 0.75) -> DataFrame:
    """(city, day, title_key, merged_key): within a city's day the shorter key absorbs a longer one that
    it begins, if it has ``min_length`` characters, is at most ``max_ratio`` as long, and
    one side has an aggregator.  Keys go by length; an absorbed key is not used again; the
    absorber's aggregator flag grows with what it absorbs.

    ``keys(city, day, title_key, has_agg)`` holds distinct keys, not events.  A group is a
    family: the keys of a city's day whose shortest beginning that is a key of ``min_length`` characters
    is the same.  A key and its beginnings are always in one family."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(n=pdf["title_key"].str.len()).sort_values(["n", "title_key"])
        names, flags = pdf["title_key"].tolist(), pdf["has_agg"].tolist()
        into: dict[str, str] = {}
        for i, short in enumerate(names):
            if short is None or short in into or len(short) < min_length:
                continue
            agg = flags[i]
            for j in range(i + 1, len(names)):
                long = names[j]
                if long in into or not long.startswith(short) or len(short) / len(long) > max_ratio:
                    continue
                if agg or flags[j]:
                    into[long] = short
                    agg = agg or flags[j]
        return pd.DataFrame({"city": pdf["city"], "day": pdf["day"], "title_key": names, "merged_key": [into.get(n, n) for n in names]})

    n = F.explode(F.sequence(F.lit(min_length), F.greatest(F.lit(min_length), F.length("title_key")))).alias("n")
    begins = keys.select("city", "day", "title_key", "has_agg", n).withColumn("begin", F.expr("substring(title_key, 1, n)"))
    known = keys.select(F.col("city").alias("in"), F.col("day").alias("on"), F.col("title_key").alias("known"))
    found = begins.join(known, F.col("city").eqNullSafe(F.col("in")) & F.col("day").eqNullSafe(F.col("on")) & F.col("begin").eqNullSafe(F.col("known")))
    rows = found.groupBy("city", "day", "title_key", "has_agg").agg(F.min("n").alias("n")).withColumn("family", F.expr("substring(title_key, 1, n)"))
    rows = materialize(rows.select("city", "day", "title_key", "has_agg", "family"), "families")
    family = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in ("city", "day", "family")]
    several = rows.groupBy(*[F.col(c).alias(f"f_{c}") for c in ("city", "day", "family")]).agg(F.count("*").alias("members"))
    counted = rows.join(several, family)
    made = counted.filter("members > 1").groupBy("city", "day", "family").applyInPandas(run, "city string, day date, title_key string, merged_key string")
    return made.unionByName(counted.filter("members = 1").select("city", "day", "title_key", F.col("title_key").alias("merged_key")))


def legacy_dedupe(events: DataFrame, slot: list[str], threshold: float = 0.85) -> DataFrame:
    """Ids that stay when, in id order, an event of a slot goes if its title is like one already kept.

    Titles are compared in lower case with single blanks, ``at`` and ``and`` for their signs and
    otherwise only the letters a to z and digits; one without any is like none, so that all such
    events stay.  A title's later events fare no better than its first.  The rest is a graph from
    titles to like ones before them, of which the events that stay are settled by rounds over all
    slots."""
    clean = F.trim(F.regexp_replace(F.lower(blank(F.col("title"))), r"(?U)[\s\x1c-\x1f]+", " "))
    for sign, word in (("@", "at"), ("&", "and")):
        clean = F.replace(clean, F.lit(sign), F.lit(word))
    clean = F.regexp_replace(clean, "[^a-z0-9 ]", "")
    rows = events.select("id", F.to_json(F.struct(*slot)).alias("slot"), clean.alias("title"))  # a null is a slot's value too
    first = materialize(rows.where("title <> ''").groupBy("slot", "title").agg(F.min("id").alias("id")), "first")
    found = candidates(first, ["slot"], threshold, "sequence", "characters")
    found = found.union(found.select("title_b", "title"))
    before = first.select("slot", F.col("title").alias("title_b"), F.col("id").alias("id_b"))
    met = materialize(first.join(found, "title").join(before, ["slot", "title_b"]).where("id > id_b"), "met")
    # the ratio depends on the order of its texts: the later event's comes first
    wanted = met.select("title", "title_b").distinct()
    wanted = wanted.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "title", "title_b")
    like = wanted.where(score(F.col("title"), F.col("title_b"), "sequence", threshold) >= threshold)
    kept = first.select("id")
    gone = displaced(met.join(like, ["title", "title_b"]).select("id", "id_b"))
    if gone is not None:
        kept = kept.join(gone, "id", "left_anti")
    return kept.union(rows.where("title = ''").select("id"))
