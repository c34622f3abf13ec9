"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted.  Documents longer than the longest are cut
into pieces; pieces are dealt into shards of bounded total length along a global
running sum, so that no task holds an unbounded group and a hot document id is
spread.  Within a shard pieces go, longest first, into the open bin that they fill
best.  If none fits, a bin is opened, and every permitted length that holds the piece
is tried on what is still to be packed: the bin is filled with the longest pieces that
fit, shrunk to the least permitted length, and costed by the token, at its length plus
OVERHEAD (what starting a sequence costs).  The length of least cost is opened, of
equal ones the longest, which later pieces can still fill.  At the end every bin is
downsized to the least permitted length that holds its contents.

Edge cases: null and blank texts have no piece to pack; they keep one row with
``n_tokens`` 0 and no bin.  Repeated rows are packed each.  Extra columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_sum
from .mixing import n_words

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 32
SHARD_TOKENS = 2_000_000


def opening(rest: Counter, sizes: list[int], size: int, capacities: tuple[int, ...], overhead: int) -> int:
    """The capacity to open for a piece of ``size``: the one of least cost a token once
    filled from ``rest``, the counts by size of the pieces still to be packed; ``sizes``
    are those that occur, ascending."""
    costs = []
    for cap in capacities[bisect_left(capacities, size) :]:
        room, at = cap - size, len(sizes)
        while room and (at := bisect_right(sizes, room, 0, at)):
            at -= 1  # the longest that fits, as often as it fits and occurs
            room -= sizes[at] * min(rest[sizes[at]], room // sizes[at])
        full = cap - room
        costs.append(((capacities[bisect_left(capacities, full)] + overhead) / full, -cap))
    return -min(costs)[1]


def best_fit(sizes: list[int], capacities: tuple[int, ...], overhead: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit of ``sizes``, given in descending order: bin and offset of each piece,
    and the downsized capacity of each bin.  Of bins with equal room the latest is
    filled."""
    free: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]  # open bins by free room
    rooms: list[int] = []  # the rooms that occur, ascending
    rest = Counter(sizes)
    left = sorted(rest)
    bins, offsets, used = [], [], []
    for size in sizes:
        rest[size] -= 1
        if not rest[size]:
            left.pop()  # the largest that was left
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = free[room].pop()
            if not free[room]:
                rooms.pop(at)
        else:
            b = len(used)
            room = opening(rest, left, size, capacities, overhead)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += size
        if room > size:
            if not free[room - size]:
                insort(rooms, room - size)
            free[room - size].append(b)
    return bins, offsets, [capacities[bisect_left(capacities, u)] for u in used]


def pieces(docs: DataFrame, longest: int, tokens: Column) -> DataFrame:
    """(doc_id, piece, start, n_tokens): documents cut at the longest length."""
    n = materialize(docs.select("doc_id", tokens.alias("n")), "lengths")  # texts are counted once
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / longest)).cast("int")
    cut = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    start = (F.col("piece") * F.lit(longest)).cast("long")
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(longest)).cast("long").alias("n_tokens"))


def pack(
    docs: DataFrame,
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: int = OVERHEAD,
    shard_tokens: int = SHARD_TOKENS,
    tokens: Column | None = None,
) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, capacity, offset), one row a piece.

    ``start`` is the piece's first token in its document, ``offset`` its place in the
    bin; ``bin_id`` is unique over all shards.  ``tokens`` counts a document's
    tokens; by default the words of ``text``."""
    capacities = tuple(sorted(capacities))
    cut = pieces(docs, capacities[-1], n_words(F.col("text")) if tokens is None else tokens)
    keys = [F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("doc_id"), F.col("piece"), F.col("n_tokens")]
    placed = running_sum(cut, keys, "n_tokens", "upto", "pieces")
    placed = placed.withColumn("shard", F.floor((F.col("upto") - F.col("n_tokens")) / shard_tokens).cast("long"))
    some = placed.filter("n_tokens > 0").drop("upto")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        size = table.column("n_tokens").to_numpy()
        order = np.lexsort((table.column("piece").to_numpy(), -size))
        table, size = table.take(order), size[order]
        bins, offsets, caps = best_fit(size.tolist(), capacities, overhead)
        bins_ = np.array(bins, np.int64)
        out = {n: table.column(n) for n in ("doc_id", "piece", "start", "n_tokens")}
        out["bin_id"] = pa.array(bins_ + (table.column("shard")[0].as_py() << 32))
        out["capacity"] = pa.array(np.array(caps, np.int32)[bins_])
        out["offset"] = pa.array(np.array(offsets, np.int32))
        return pa.table(out)

    schema = f"doc_id {kind}, piece int, start long, n_tokens long, bin_id long, capacity int, offset int"
    packed = some.groupBy("shard").applyInArrow(run, schema)
    none = placed.filter("n_tokens <= 0").select("doc_id", "piece", "start", "n_tokens")
    return packed.unionByName(none, allowMissingColumns=True)
