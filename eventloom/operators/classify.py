"""Classify events once per title: representative, scorer, fan-out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import category_label
from ..functions.text import blank

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

#: Fixed keywords of the built-in scorer.
KEYWORDS = (
    ("concert", "Music / Concerts"),
    ("music", "Music / Concerts"),
    ("film", "Film / Cinema"),
    ("comedy", "Comedy / Improv"),
    ("story", "Family / Kids"),
    ("hike", "Nature / Outdoors / Recreation"),
    ("yoga", "Health / Wellness"),
    ("council", "Government / Civic"),
    ("trivia", "Games / Trivia"),
    ("workshop", "Education / Workshops"),
)


def keyword_scorer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A deterministic stand-in for a model: the first keyword in title or description."""
    for pdf in batches:
        text = (pdf["title"].fillna("") + " " + pdf["description"].fillna("")).str.lower()
        yield pd.DataFrame({"key": pdf["key"], "answer": [next((c for w, c in KEYWORDS if w in t), None) for t in text]})


def classify(events: DataFrame, scorer: Scorer = keyword_scorer) -> DataFrame:
    """Fill empty categories.  One row for each lower-trimmed title goes to the scorer
    (``key, title, description`` in, ``key, answer`` out); its label is normalised and
    joined back to all events of that title."""
    key = F.lower(F.trim(blank(F.col("title"))))
    todo = events.filter(blank(F.col("category")) == "").withColumn("key", key)
    reps = todo.groupBy("key").agg(F.min_by("title", "id").alias("title"), F.min_by("description", "id").alias("description"))
    scored = reps.mapInPandas(scorer, "key string, answer string").select("key", category_label(F.col("answer")).alias("__label"))
    out = events.withColumn("key", key).join(scored, "key", "left")
    return out.withColumn("category", F.coalesce(F.nullif(F.col("category"), F.lit("")), F.col("__label"))).drop("__label", "key")
