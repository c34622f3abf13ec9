"""Ranked lexical search: the k best documents of each query item, by exact integer scores.

Documents are kept in ranges (blocks) of up to BLOCK rows in the order of their ids.  Over a
block stands, for each term, a hierarchical max tree: the greatest gain of the term in each
leaf range of LEAF documents, in each FAN ranges of those, and so on up to the block.  The sum
of an item's terms over a node bounds every score below it.  Best-first branch-and-bound
takes the node of the highest bound, opens it, and stops at the first bound that is *less*
than the k-th score so far; nodes of an equal bound are opened, as a smaller id wins a tie.

In Spark:

1. One pass over the texts gives for each document its number of terms and its occurrences
   of the items' terms (written; the items' vocabulary is broadcast, see below).  The
   documents, their terms and each term's documents are counted over all of them.
2. Blocks with their gains are built from that table and written, with the trees' roots.
3. The top of the hierarchy: of each item, the SEEDS blocks of the highest root bound are
   searched first.  The k-th score found is a floor that k real documents reach.
4. Every block is searched by every item whose root bound reaches the floor.  What comes back
   is at most k rows an item and block, in total little more than the result, and the
   last ranking is a window with a limit before the shuffle.

What is broadcast grows with the items alone, and its size is checked: items of more than
MAX_CHARS characters or MAX_ITEMS in total are dealt by hash to as many parts as keep each
below, and the parts are searched one after the other.

Edge cases: a null text, of a document or an item, has no terms; such an item has no
rows.  An item of the same id and text counts once; other texts under the same id are items of
their own.  Repeated documents are ranked each; ties go to the smaller doc_id, a null id last.
Without documents or terms the result is empty.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_batches, materialize, text_of

K1_BASE, LENGTH_PART = 12, 25  # of the score: tf / (tf + 1.2 * norm), norm 75% fixed and 25% by length
BLOCK, POSTINGS = 8192, 4_000_000
LEAF, FAN = 32, 8
SEEDS = 2
MAX_CHARS, MAX_ITEMS = 200_000, 4_000
_TERM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and all characters from U+0080, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM).split() if text else []


def weight(documents: int, holding: int) -> int:
    """Weight of a term that ``holding`` of ``documents`` hold; never negative."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def gains(weights: np.ndarray, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What each occurrence adds to a score."""
    return weights * ((1_000_000_000 * tf) // (1000 * tf + K1_BASE * norm))


class MaxTree:
    """The trees of all terms of a block, level by level: ``levels[0]`` has a column for each
    leaf range, the last level one for the block; rows are the block's distinct terms."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, gain: np.ndarray):
        self.starts, self.gain = starts, gain
        self.size = len(starts) - 1
        self.terms, self.row = np.unique(terms, return_inverse=True)
        ranges = -(-self.size // LEAF)
        leaf = np.repeat(np.arange(self.size) // LEAF, np.diff(starts))
        level = np.zeros((len(self.terms), ranges), np.int64)
        np.maximum.at(level, (self.row, leaf), gain)
        self.levels = [level]
        while level.shape[1] > 1:
            width = -(-level.shape[1] // FAN)
            padded = np.zeros((len(level), width * FAN), np.int64)
            padded[:, : level.shape[1]] = level
            level = padded.reshape(len(level), width, FAN).max(axis=2)
            self.levels.append(level)
        self._times = np.zeros(len(self.terms), np.int64)

    def rows_of(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and repeats of an item's terms that the block has."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[at] == terms
        return at[here], times[here]

    def scores(self, leaf: int) -> np.ndarray:
        """Scores of the documents of a leaf range for the item that is searched."""
        first, last = leaf * LEAF, min((leaf + 1) * LEAF, self.size)
        a, b = self.starts[first], self.starts[last]
        return np.add.reduceat(self.gain[a:b] * self._times[self.row[a:b]], self.starts[first:last] - a)

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
        """(score, position) of the k best documents of at least ``floor`` (and above 0)."""
        rows, times = self.rows_of(terms, times)
        if not len(rows):
            return []
        self._times[rows] = times
        best: list[tuple[int, int]] = []  # a heap: the worst of the best first
        least = max(floor, 1)
        top = len(self.levels) - 1
        nodes = [(-int(times @ self.levels[top][rows, 0]), top, 0)]
        while nodes:
            bound, level, at = heapq.heappop(nodes)
            if -bound < least:
                break
            if level:
                below = times @ self.levels[level - 1][rows, at * FAN : (at + 1) * FAN]
                for i in np.flatnonzero(below >= least):
                    heapq.heappush(nodes, (-int(below[i]), level - 1, at * FAN + int(i)))
                continue
            scores = self.scores(at)
            for i in np.flatnonzero(scores >= least):
                entry = (int(scores[i]), -(at * LEAF + int(i)))
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                least = max(least, best[0][0])
        self._times[rows] = 0
        return [(score, -at) for score, at in best]


def _postings(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """doc_id, n, and the items' terms in it with their occurrences; one row a document."""
    text = fresh(docs, "text")
    kept = docs.select("doc_id", text_of(docs).alias(text))

    def counted(columns: dict[str, list]) -> dict[str, object]:
        known, n, terms, tf = vocabulary.value, [], [], []
        for t in columns[text]:
            found = terms_of(t)
            n.append(len(found))
            here = sorted((known[term], count) for term, count in Counter(filter(known.__contains__, found)).items())
            terms.append([h[0] for h in here])
            tf.append([h[1] for h in here])
        return {"doc_id": columns["doc_id"], "n": n, "terms": terms, "tf": tf}

    fields = [kept.schema["doc_id"], T.StructField("n", T.LongType())]
    fields += [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("terms", "tf")]
    return materialize(map_batches(kept, counted, T.StructType(fields)), "postings")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a column of lists without nulls."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _blocks(postings: DataFrame, documents: int, length: int, weights: Broadcast) -> DataFrame:
    """Blocks of documents, one a row: ids, gains by document, and the roots of the trees."""
    kind = postings.schema["doc_id"].dataType
    lists = {"ids": kind, "starts": T.IntegerType(), "terms": T.IntegerType(), "gain": T.LongType(),
             "root_terms": T.IntegerType(), "root_gain": T.LongType()}
    schema = T.StructType([T.StructField("block", T.LongType())] + [T.StructField(n, T.ArrayType(t)) for n, t in lists.items()])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = 0, 0
        parts: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            sizes, terms = _lists(table.column(2))
            tf = _lists(table.column(3))[1].astype(np.int64)
            fixed = 100 - LENGTH_PART
            norm = np.array([fixed + LENGTH_PART * n * documents // length for n in table.column(1).to_pylist()], np.int64)
            gain = gains(weights.value[terms], tf, np.repeat(norm, sizes))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            tree = MaxTree(starts, terms, gain)
            number = (TaskContext.get().partitionId() << 32) + made
            values = [table.column(0), starts, terms, gain, tree.terms, tree.levels[-1][:, 0]]
            arrays = [pa.array(v) if isinstance(v, np.ndarray) else v for v in values]
            arrays = [a.cast(k) for a, k in zip(arrays, (arrays[0].type, pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))]
            one = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays]
            return pa.RecordBatch.from_arrays([pa.array([number]), *one], names=schema.names)

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                count = len(batch.column(2).flatten()) / batch.num_rows
                room = BLOCK - sum(p.num_rows for p in parts)
                part = batch.slice(at, max(1, min(room, int((POSTINGS - held) / max(count, 1)))))
                at += part.num_rows
                held += len(part.column(2).flatten())
                parts.append(part)
                if sum(p.num_rows for p in parts) >= BLOCK or held >= POSTINGS:
                    yield block()
                    made, held = made + 1, 0
                    parts.clear()
        if parts:
            yield block()

    ordered = postings.where(F.size("terms") > 0).sortWithinPartitions(F.asc_nulls_last("doc_id"))
    return materialize(ordered.mapInArrow(built, schema), "blocks")


def _seeds(blocks: DataFrame, items: Broadcast) -> DataFrame:
    """Of each item the SEEDS blocks of the highest root bound: block, and its items."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for at, number in enumerate(batch.column(0).to_pylist()):
                roots, gain = (batch.column(c)[at].values.to_numpy(zero_copy_only=False) for c in (1, 2))
                for i, (terms, times) in enumerate(items.value):
                    slot = np.minimum(np.searchsorted(roots, terms), len(roots) - 1)
                    bound = int((times * gain[slot])[roots[slot] == terms].sum())
                    if bound:
                        best[i] = heapq.nlargest(SEEDS, [*best.get(i, []), (bound, number)])
        rows = [(i, bound, number) for i, found in best.items() for bound, number in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["item", "bound", "block"])

    best = blocks.select("block", "root_terms", "root_gain").mapInArrow(bounded, "item long, bound long, block long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "block")
    chosen = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SEEDS)
    return chosen.groupBy("block").agg(F.collect_list("item").alias("of"))  # at most SEEDS rows an item


def _searched(blocks: DataFrame, items: Broadcast, k: int, floors: dict[int, int]) -> DataFrame:
    """item, doc_id, score of what the blocks yield; ``of``, if there, names a block's items."""
    kind = blocks.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())])
    chosen = ["of"] if "of" in blocks.columns else []

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, starts, terms, gain = (batch.column(c)[at].values for c in range(4))
                tree = MaxTree(*(a.to_numpy(zero_copy_only=False) for a in (starts, terms, gain)))
                rows = [
                    (i, place, score)
                    for i in (batch.column(4)[at].as_py() if chosen else range(len(items.value)))
                    for score, place in tree.search(*items.value[i], k, floors.get(i, 0))
                ]
                if rows:
                    item, place, score = (pa.array(c, pa.int64()) for c in zip(*rows))
                    yield pa.RecordBatch.from_arrays([item, ids.take(place), score], names=schema.names)

    return blocks.select("ids", "starts", "terms", "gain", *chosen).mapInArrow(search, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _part(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The ranking of one bounded part of the items."""
    spark = docs.sparkSession
    texts = [(r[0], r[1]) for r in items.collect()]
    counts = [Counter(terms_of(t)) for _, t in texts]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    made = [sorted((vocabulary[t], n) for t, n in c.items()) for c in counts]
    shared = spark.sparkContext.broadcast([tuple(np.array(m, np.int64).reshape(-1, 2).T) for m in made])
    postings = _postings(docs, spark.sparkContext.broadcast(vocabulary))
    documents, length = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = dict(postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # the items' terms
    weights = np.array([weight(documents, holding.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    blocks = _blocks(postings, documents, max(length, 1), spark.sparkContext.broadcast(weights))
    first = _searched(blocks.join(F.broadcast(_seeds(blocks, shared)), "block"), shared, k, {})
    floors = dict(_best(first, k).where(F.col("rank") == k).select("item", "score").collect())  # one row an item
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(texts)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", items.schema[0].dataType)]))
    ranked = _best(_searched(blocks, shared, k, floors), k)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item, from rank 1."""
    asked = items.select("item_id", text_of(items).alias("text")).where("text IS NOT NULL").distinct()
    count, chars = asked.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-chars // MAX_CHARS), -(-count // MAX_ITEMS))
    found = None
    for part in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)) == part)
        ranked = _part(docs, mine, k)
        found = ranked if found is None else found.unionByName(ranked)
    return found


def oracle(k: int = 20) -> str:
    terms = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    )
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS nn, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
tf AS MATERIALIZED (SELECT r, doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({terms}) AS t FROM benchmark) GROUP BY ALL),
g AS (SELECT item_id, r, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l)))) AS BIGINT) AS score
  FROM q JOIN df USING (t) JOIN tf USING (t), s GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM g WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= {k}"""
