"""Values carried along a total order within groups, without a window over a whole group.

Rows are dealt into ranges of (group, order) and written with the number of their range, so that
the ranges stay what they are.  A window then runs inside one range of one group, whose size the
number of partitions bounds, and what a range hands on to the later ones of its group is one row:
a group that holds all rows is spread over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize

RANGE = "range_no"


def ranges(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The rows with ``range_no``, which grows along (group, order); rows that are equal in both
    share a range."""
    keys = [*[F.col(g) for g in group], *order]
    return materialize(df.repartitionByRange(*keys).withColumn(RANGE, F.spark_partition_id()), "ranges")


def _handed_on(tails: DataFrame, group: list[str]) -> Window:
    """The earlier ranges of the group: one row a range."""
    return Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)


def ranked(df: DataFrame, group: list[str], order: list[Column], place: str = "place") -> DataFrame:
    """The row number ``place`` (long) in ``order`` within the group.  The order must be total."""
    rows = ranges(df, group, order)
    counts = rows.groupBy(RANGE, *group).agg(F.count("*").alias("rows_in"))
    before = counts.select(RANGE, *group, F.coalesce(F.sum("rows_in").over(_handed_on(counts, group)), F.lit(0)).alias("rows_before"))
    local = rows.withColumn(place, F.row_number().over(Window.partitionBy(RANGE, *group).orderBy(*order)))
    return local.join(before, [RANGE, *group]).withColumn(place, F.col(place) + F.col("rows_before")).drop("rows_before", RANGE)


def carried(rows: DataFrame, group: list[str], order: str, values: dict[str, tuple[Column, bool]]) -> DataFrame:
    """``rows`` (of ``ranges``) with columns that hold the last value that is not null at or above
    each row.  ``values`` gives a column's value and whether the row's own counts."""
    rows = rows.select("*", *[v.alias(f"own_{name}") for name, (v, _) in values.items()])
    tails = rows.groupBy(RANGE, *group).agg(*[F.max_by(f"own_{n}", F.when(F.col(f"own_{n}").isNotNull(), F.col(order))).alias(f"tail_{n}") for n in values])
    above = _handed_on(tails, group)
    tails = tails.select(RANGE, *group, *[F.last(f"tail_{n}", ignorenulls=True).over(above).alias(f"above_{n}") for n in values])
    inside = Window.partitionBy(RANGE, *group).orderBy(order)
    for name, (_, own) in values.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        rows = rows.withColumn(name, F.last(f"own_{name}", ignorenulls=True).over(frame))
    rows = rows.join(tails, [RANGE, *group])
    for name in values:
        rows = rows.withColumn(name, F.coalesce(name, f"above_{name}"))
    return rows.drop(*[f"own_{n}" for n in values], *[f"above_{n}" for n in values])


def automaton(df: DataFrame, group: str, order: str, symbol: str, steps: list[list[int]], state: str = "state") -> DataFrame:
    """The rows as by ``ranges``, with the ``state`` in which a finite automaton meets each one.

    ``steps[s][x]`` follows state ``s`` on symbol ``x``; every group starts in state 0.  A range is
    walked once for all states it may be entered in, and the ranges of a group are chained by what
    each makes of them."""
    n = len(steps)
    keys = [F.col(group), F.col(order)]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(RANGE, F.spark_partition_id())
    kinds = T.ArrayType(T.IntegerType())
    schema = T.StructType([*ranged.schema.fields, T.StructField("met", kinds), T.StructField("left", kinds)])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, current = None, None
        for pdf in batches:
            met, left = [], []
            for g, x in zip(pdf[group], pdf[symbol], strict=True):
                if current is None or g != here:
                    current = list(range(n)) if current is None else [0] * n
                    here = g
                met.append(current)
                current = [steps[s][x] for s in current]
                left.append(current)
            yield pdf.assign(met=met, left=left)

    rows = materialize(ranged.mapInPandas(walk, schema), "states")
    ends = rows.groupBy(RANGE, group).agg(F.max_by("left", order).alias("left"))
    chain = F.collect_list("left").over(_handed_on(ends, [group]))
    entered = ends.select(RANGE, group, F.aggregate(chain, F.lit(0), lambda s, step: F.get(step, s)).alias("entered"))
    return rows.join(entered, [RANGE, group]).withColumn(state, F.get("met", F.col("entered"))).drop("met", "left", "entered")
