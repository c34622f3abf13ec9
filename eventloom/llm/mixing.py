"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash of their id.  A document's virtual
finish time is the source's cumulative tokens up to and including it, divided by
the source's target; a source whose target exceeds its size is repeated, at most
three times.  A global range sort by finish time, truncated at the total budget,
then serves all sources in proportion to their targets.

Both cumulative sums are range-partitioned (see ``running_sum``), so that a source
with a third of all rows is spread over many tasks.  Only ids, sources and sizes
are sorted, never texts: of a source the documents taken once, twice and thrice are
beginnings of its shuffled order, so that the mix itself is one more scan of the
documents, each compared with the last places of its source that are taken.

Targets: weights 5, 2, 1 in turn over the sources by code point, null last; the
budget is the total size; a target stops at three times its source's size and the
excess is shared again by weight until none is above.  The number of sources is
the size of one aggregated table; the level at which targets stop is found by two
running sums over it.

Edge cases: a null text has size 0; documents of size 0 are taken 0 words.  A null
source is a source of its own, distinct from ''.  Repeated rows each take part.
Null ids come last in the shuffle.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, placed, running_sum, small

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009..U+000D."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(src, source_size, target) for ``sizes(src, size)``, one row a source.

    Sources are sorted by the ratio cap / weight; those below the final level get
    their cap.  With C and W the caps and weights of all sources before one, the
    level (total - C) / (all weights - W) is final at the first source whose own
    ratio is not below it."""
    by = sizes.groupBy("src").agg(F.sum("size").cast("long").alias("source_size"))
    one = by.withColumn("one", F.lit(1).cast("long")).withColumn("last", F.col("src").isNull())
    ranked = running_sum(one, [F.col("last"), F.col("src")], "one", "place", "sources")
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, len(weights)) + 1).cast("int"))
    ranked = ranked.withColumn("weight", cycle.cast("long")).withColumn("cap", F.col("source_size") * MAX_REPEATS)
    ratio = F.col("cap").cast("double") / F.col("weight")
    order = [ratio, F.col("place")]
    caps = running_sum(ranked, order, "cap", "caps", "caps")
    both = materialize(running_sum(caps, order, "weight", "weights", "weights"), "levels")
    total, all_weights = both.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return both.select("src", "source_size", F.lit(0.0).alias("target"))
    level = (F.lit(total) - (F.col("caps") - F.col("cap"))).cast("double") / (
        F.lit(all_weights) - (F.col("weights") - F.col("weight"))
    )
    final = both.filter(level <= ratio).orderBy(*order).select(level.alias("level")).first()["level"]
    return both.select(
        "src", "source_size", F.least(F.col("cap").cast("double"), F.lit(final) * F.col("weight")).alias("target")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs(doc_id, text, source)``: doc_id, src, size,
    source_size, target, ``finish`` (virtual finish time of its first copy), ``copies``
    (how often the mix takes it, 0 if left out), and the columns of ``carry``, which
    order rows of one doc_id and size."""
    rows = docs.select(
        "doc_id", F.col("source").alias("src"), n_words(F.col("text")).alias("size"), *[F.col(c) for c in carry]
    )
    rows = materialize(rows, "sizes")
    return _serve(rows, targets(rows, weights), carry)


def _shuffled() -> Column:
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def _serve(rows: DataFrame, goal: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    keyed = rows.withColumn("shuffle", _shuffled()).withColumn("last", F.col("src").isNull())
    keys = [F.col("last"), F.col("src"), F.col("shuffle"), F.col("doc_id"), F.col("size"), *map(F.col, carry)]
    served = running_sum(keyed, keys, "size", "run", "served")
    # the running sum goes over all sources: subtract what the sources before this one hold
    before = running_sum(goal.withColumn("last", F.col("src").isNull()), [F.col("last"), F.col("src")], "source_size", "upto", "before")
    before = before.select(
        F.col("src").alias("s"), "source_size", "target", (F.col("upto") - F.col("source_size")).alias("ahead")
    )
    cum = served.join(before, F.col("src").eqNullSafe(F.col("s"))).withColumn("cum", F.col("run") - F.col("ahead"))
    cum = materialize(cum.drop("shuffle", "last", "s", "run", "ahead"), "queue")
    budget = cum.agg(F.sum("size")).first()[0]
    if not budget:
        return cum.withColumn("finish", F.lit(0.0)).withColumn("copies", F.lit(0))
    copies = cum.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(MAX_REPEATS)]))).filter("size > 0")
    copies = copies.select("size", "src", "cum", _finish(F.col("epoch")).alias("finish"))
    line = running_sum(copies, [F.col("finish"), F.col("src").isNull(), F.col("src"), F.col("cum")], "size", "total", "line")
    cut = (
        line.filter(F.col("total") <= F.lit(budget))
        .select("finish", F.col("src").isNull().alias("n"), "src", "cum")
        .orderBy(*[F.col(c).desc() for c in ("finish", "n")], F.col("src").desc(), F.col("cum").desc())
        .first()
    )
    if cut is None:
        return cum.withColumn("finish", _finish(F.lit(0))).withColumn("copies", F.lit(0))
    taken = F.lit(0)
    for e in range(MAX_REPEATS):
        f = _finish(F.lit(e))
        tie = F.struct(F.col("src").isNull().alias("n"), F.coalesce("src", F.lit("")).alias("s"), F.col("cum").alias("c"))
        upto = F.struct(F.lit(cut["n"]).alias("n"), F.lit(cut["src"] or "").alias("s"), F.lit(cut["cum"]).alias("c"))
        taken = taken + F.when((f < cut["finish"]) | ((f == cut["finish"]) & (tie <= upto)), 1).otherwise(0)
    return cum.withColumn("finish", _finish(F.lit(0))).withColumn(
        "copies", F.when(F.col("size") > 0, taken).otherwise(0)
    )


def _finish(epoch: Column) -> Column:
    """Virtual finish time of a document's copy in the given repeat of its source."""
    return (F.col("cum") + epoch * F.col("source_size")).cast("double") / F.col("target")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, as_read: bool = False) -> DataFrame:
    """The mix itself: the rows of ``docs`` that are taken, each as often as it is taken.

    ``as_read`` tells that ``docs`` is a table as read from files, which is then neither
    copied nor shuffled: a row is compared with the last places of its source that are
    taken once, twice and thrice, one row a source, broadcast if proven few."""
    rows, place = placed(docs, as_read, "mixin")
    judged = mix(rows, weights, tuple(place))
    spot = lambda size: F.struct(_shuffled().alias("a"), F.col("doc_id").alias("b"), size.alias("c"), *[F.col(c) for c in place])
    src, copy = fresh(rows, "source"), fresh(rows, "copy")
    last = [fresh(rows, f"last{e}") for e in range(MAX_REPEATS)]
    ends = judged.filter("copies > 0").groupBy(F.col("src").alias(src)).agg(
        *[F.max(F.when(F.col("copies") > e, spot(F.col("size")))).alias(last[e]) for e in range(MAX_REPEATS)],
    )
    ends = materialize(ends, "ends")
    joined = rows.join(F.broadcast(ends) if small(ends, 100_000) else ends, F.col("source").eqNullSafe(F.col(src)))
    # the words of a text are counted again only where the id alone does not decide
    upto = lambda c: F.when(_shuffled() < c["a"], True).when(_shuffled() > c["a"], False).otherwise(spot(n_words(F.col("text"))) <= c)
    times = sum((F.when(F.col(c).isNotNull() & upto(F.col(c)), 1).otherwise(0) for c in last), F.lit(0))
    times = F.when(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), times).otherwise(0)
    taken = joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times)))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle() -> str:
    """The digest of the mix in DuckDB SQL."""
    return """
WITH d AS (SELECT doc_id, source AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY src IS NULL, src) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
  row_number() OVER (ORDER BY src IS NULL, src) AS place, 3 * source_size AS cap FROM s),
r AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - (sum(cap) OVER o - cap) AS DOUBLE)
  / ((SELECT sum(weight) FROM w) - (sum(weight) OVER o - weight)) AS level FROM r WINDOW o AS (ORDER BY ratio, place)),
f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
t AS (SELECT src, source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM f) * weight) AS target FROM w),
c AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.src ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.src IS NOT DISTINCT FROM t.src),
e AS (SELECT c.*, CAST(cum + epoch * source_size AS DOUBLE) / target AS finish FROM c, (VALUES (0), (1), (2)) v(epoch) WHERE size > 0),
m AS (SELECT *, sum(size) OVER (ORDER BY finish, src IS NULL, src, cum ROWS UNBOUNDED PRECEDING) AS total FROM e),
k AS (SELECT src, cum, count(*) AS copies FROM m WHERE total <= (SELECT sum(size) FROM d) GROUP BY src, cum)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(c.size * coalesce(k.copies, 0) AS BIGINT) AS taken
FROM c LEFT JOIN k ON c.size > 0 AND k.src IS NOT DISTINCT FROM c.src AND k.cum = c.cum"""
