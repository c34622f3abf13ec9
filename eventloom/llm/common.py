"""Shared helpers of the training-data operators.

Scratch tables go to the folder named by ``spark.checkpoint.dir``, see ``eventloom.scratch``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components  # noqa: F401
from ..scratch import discard, materialize, written  # noqa: F401


def placed(docs: DataFrame, as_read: bool, label: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns that tell its rows apart, and their names.

    With ``as_read`` the caller vouches that ``docs`` is a table as read from files (no
    join or generator has repeated its rows): path and row number in the file tell rows
    apart, nothing is copied, and each scan gives the same.  Otherwise, and where the
    source has no such numbers, rows are numbered and written."""
    path, at = fresh(docs, "path"), fresh(docs, "at")
    try:
        if as_read:
            origin = docs.metadataColumn("_metadata")
            return docs.select("*", origin["file_path"].alias(path), origin["row_index"].alias(at)), [path, at]
    except AnalysisException:
        pass  # not read from files
    numbered = docs.select("*", F.lit("").alias(path), F.monotonically_increasing_id().alias(at))
    return materialize(numbered, label), [path, at]


def small(rows: DataFrame, most: int = 1_000_000) -> bool:
    """True if a list of ids is proven to be of at most ``most`` rows."""
    return rows.limit(most + 1).count() <= most


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use."""
    names = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in names:
        name = f"_{name}"
    return name


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column as a string, null as it is."""
    return F.col(column).cast("string")


def training_fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5: 0 is held out, the rest may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def map_batches(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, object]], schema: str | T.StructType, rows: int = 256
) -> DataFrame:
    """``mapInArrow`` in slices of at most ``rows`` rows and, beyond one row, of at most
    SLICE_BYTES of strings, so that a batch of very long texts is never turned into
    Python objects all at once.  ``fn`` gets columns as Python lists and returns columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                arrays = [_array(out[f.name], f.type) for f in arrow]
                if arrays and len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, bounded in rows and in bytes of its strings."""
    held = np.zeros(batch.num_rows + 1, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            held[1:] += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    held = np.cumsum(held)
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(held, held[at] + SLICE_BYTES, "right")) - 1
        to = max(at + 1, min(at + rows, upto))
        yield batch.slice(at, to - at)
        at = to


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values
    if pa.types.is_list(kind) and values and isinstance(next((v for v in values if v is not None), None), np.ndarray):
        sizes = np.array([len(v) for v in values], dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = np.concatenate(values) if len(values) else np.empty(0)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind.value_type)).cast(kind)
    return pa.array(values, type=kind)


_BASE = np.uint64(0x9E3779B97F4A7C55)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_CHUNK = 1 << 20


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            _powers[name] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64))])
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``[start, end)``, given in ascending order
    without overlap: differences of a running polynomial, computed in chunks so
    that the memory is bounded by the longest span, not by the text."""
    out = np.empty(len(starts), np.uint64)
    buf = np.frombuffer(raw, np.uint8)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        n = int(ends[to - 1]) - base
        up, down = _power(n + 1)
        run = np.empty(n + 1, np.uint64)
        run[0] = 0
        np.cumsum((buf[base : base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=run[1:])
        s, t = starts[at:to] - base, ends[at:to] - base
        out[at:to] = (run[t] - run[s]) * down[s] + (t - s).astype(np.uint64)
        at = to
    return mix64(out)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the words: runs without space and U+0009..U+000D."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[np.frombuffer(raw, np.uint8)], [True]])))
    return edge[::2], edge[1::2]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, in order."""
    return span_hashes(raw, *word_spans(raw))


def words_of(text: str | None) -> list[bytes]:
    """Runs of characters other than space and U+0009..U+000D, as UTF-8.
    ``bytes.split`` cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def running_sum(df: DataFrame, keys: list[Column], value: str, out: str, label: str) -> DataFrame:
    """Inclusive running sum of the long column ``value`` over the total order
    ``keys``, without a single-partition window.

    Rows are range-partitioned and sorted; each partition sums its own rows while
    streaming them; the partition totals (one row a partition, so bounded by the
    number of partitions) give the offsets.  A key that holds a third of all rows
    is spread by the later keys.
    """
    pid, local = fresh(df, "pid"), fresh(df, "local")
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(pid, F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField(local, T.LongType())])
    at = ranged.columns.index(value)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            got = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            run = np.cumsum(got) + total
            total = int(run[-1]) if len(run) else total
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(run, pa.int64())], names=[*batch.schema.names, local]
            )

    summed = materialize(ranged.mapInArrow(sums, schema), label)
    totals = {r[0]: r[1] for r in summed.groupBy(pid).agg(F.sum(value)).collect()}
    offsets, before = {}, 0
    for p in sorted(totals):
        offsets[p] = before
        before += totals[p] or 0
    if not offsets:
        return summed.withColumn(out, F.col(local)).drop(pid, local)
    before = fresh(summed, "before")
    table = df.sparkSession.createDataFrame(list(offsets.items()), f"{pid} int, {before} long")
    return (
        summed.join(F.broadcast(table), pid, "left")
        .withColumn(out, F.col(local) + F.col(before))
        .drop(pid, local, before)
    )
