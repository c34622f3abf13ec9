"""A training-data pipeline over ``documents``: five stages, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next stage's input.  All but the last return the columns
of their input.

1. toxicity: documents that the classifier calls toxic go.
2. line_dedup: lines of passages that occur earlier go; documents left without a
   word go.
3. near_dedup: one document of each group of near-duplicates stays.
4. mixing: sources are mixed to their target weights; a document that the mix takes
   repeatedly occurs repeatedly.
5. packing: the mix is packed into sequences (one row a piece).

A stage's scratch tables are deleted when the next stage starts, its result being
written by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import common, line_dedup, minhash_dedup, mixing, packing, toxicity

#: Toxicity scores cannot be expressed in SQL; the tests hold the rows of each stage against brute force.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_finished: list[str] = []  # scratch tables of the stages run so far


def _stage(first: bool = False) -> Callable[[Stage], Stage]:
    """Account for a stage's scratch tables, and delete those of the stages before, but for
    what ``docs`` still reads."""

    def decorate(stage: Stage) -> Stage:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if not first:
                read = {f.rsplit("/", 2)[1] for f in docs.inputFiles()} if _finished else set()
                common.discard(spark, [p for p in _finished if p in common.written and p.rsplit("/", 1)[1] not in read])
            _finished.clear()
            before = set(common.written)
            out = stage(spark, docs, sf_dir)
            _finished.extend(p for p in common.written if p not in before)
            return out

        return run_stage

    return decorate


@_stage(first=True)
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of this input; keeps the rows not predicted toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.filter_toxic(docs, toxicity.train(docs, labels))


@_stage()
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(docs, as_read=True)


@_stage()
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.one_of_each(docs, as_read=True)


@_stage()
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, as_read=True)


@_stage()
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        common.discard(spark, before)
        before = [common.written[-1]]
    return STAGES[-1][1](spark, docs, sf_dir)
