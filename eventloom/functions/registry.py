"""The library's Python functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.web import repair_json
from .html import html_text, unescape
from .similarity import sequence_similarity, title_words, token_set_similarity

FUNCTIONS = {
    "html_text": html_text,
    "html_unescape": unescape,
    "repair_json": repair_json,
    "sequence_similarity": sequence_similarity,
    "title_words": title_words,
    "token_set_similarity": token_set_similarity,
}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
