"""Repeated passages, found by winnowing over line hashes.

Lines are normalised (A-Z lower-cased, white space collapsed; blank lines carry no
content) and hashed.  A *gram* at a line is the shortest run of lines from there
with at least GRAM_WORDS words, a *window* the shortest with at least RUN_WORDS.
Winnowing selects, for every window, the gram of least hash that lies inside it (the
last such one on ties); the choice depends on the window's lines only, so any two
texts that share a run of RUN_WORDS words or more share a selected gram at the same
place: a guaranteed fingerprint.

Every occurrence of a fingerprint is joined with the fingerprint's first occurrence
(by doc_id, then row, then line) only, never with all others, and the match is
extended line by line both ways.  A window of the later occurrence inside the
extended run is deleted.  Windows that the extension does not cover may still repeat
a passage of yet another document: these are settled by their own 128-bit hash, whose
first occurrence stays.  Together, exactly the lines are deleted that lie in a run of
RUN_WORDS words or more which occurs earlier, in another document or in the same.

Documents' line hashes, not texts, are joined, once for each pair of a later and a
first document, however many fingerprints the two share; a hot fingerprint is a hot
join key whose rows carry one short array each, and Spark's skew join splits it.

Edge cases: a null text stays null, empty and blank texts stay as they are.  Of
repeated rows (also of one doc_id) the first stays whole, the later lose all lines
that they repeat.  Texts under RUN_WORDS words lose nothing.  A null doc_id comes
last.  All columns are kept; column names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, mix64, placed, slices, small, span_hashes

RUN_WORDS = 50
GRAM_WORDS = 25


def lines_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line numbers, hashes and word counts of the lines that have a word."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    split = [line.split() for line in raw.split(b"\n")]
    at = np.array([i for i, w in enumerate(split) if w], np.int32)
    joined = [b" ".join(split[i]) for i in at]
    sizes = np.array([len(x) for x in joined], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    hashes = span_hashes(b"\n".join(joined), ends - sizes, ends) if len(at) else np.empty(0, np.uint64)
    return at, hashes, np.array([len(split[i]) for i in at], np.int64)


def _run_hash(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of runs of lines; runs may overlap."""
    out = np.empty(len(starts), np.uint64)
    length = ends - starts
    with np.errstate(over="ignore"):
        acc = mix64(length.astype(np.uint64) + np.uint64(salt))
        for step in range(int(length.max(initial=0))):
            on = length > step
            acc[on] = mix64(acc[on] * np.uint64(0x9E3779B97F4A7C15) + hashes[starts[on] + step])
        out[:] = acc
    return out


def winnow(hashes: np.ndarray, words: np.ndarray, run: int = RUN_WORDS, gram: int = GRAM_WORDS) -> list[dict]:
    """The selected grams: line, end and hash of each, and the windows that chose it."""
    n = len(hashes)
    total = np.concatenate([[0], np.cumsum(words)])
    start = np.arange(n)
    window_end = np.searchsorted(total, total[:-1] + run)
    gram_end = np.searchsorted(total, total[:-1] + gram)
    full = start[window_end <= n]
    if not len(full):
        return []
    has = start[gram_end <= n]
    value = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    value[has] = _run_hash(hashes, has, gram_end[has], 1)
    first = _run_hash(hashes, full, window_end[full], 2)
    second = _run_hash(hashes, full, window_end[full], 3)
    chosen: dict[int, list[dict]] = {}
    for i, a, b in zip(full.tolist(), first.astype(np.int64).tolist(), second.astype(np.int64).tolist(), strict=True):
        end = int(window_end[i])
        last = i + int(np.searchsorted(gram_end[i:end], end, "right"))  # grams i..last-1 end inside the window
        at = last - 1 - int(np.argmin(value[i:last][::-1]))
        chosen.setdefault(at, []).append({"s": i, "e": end, "a": a, "b": b})
    signed = value.astype(np.int64)
    return [{"at": at, "gram": int(signed[at]), "windows": w} for at, w in chosen.items()]


def fingerprints(docs: DataFrame, place: tuple[str, ...] = ()) -> DataFrame:
    """(__row, __doc, __id, __at, __hashes, __prints) and, as ``__place0`` and so on, the
    columns of ``place`` for each row of ``docs(doc_id, text)``, written once: a row number,
    doc_id, doc_id as a number, line numbers, line hashes and selected grams."""
    window = "struct<s:int,e:int,a:bigint,b:bigint>"
    extra = T.StructType.fromDDL(
        f"__at array<int>, __hashes binary, __prints array<struct<at:int,gram:bigint,windows:array<{window}>>>"
    )
    base = docs.select(
        *[F.col(c).alias(f"__place{i}") for i, c in enumerate(place)],
        F.monotonically_increasing_id().alias("__row"),
        F.col("doc_id").alias("__doc"),
        F.col("doc_id").cast("long").alias("__id"),
        F.col("text").cast("string").alias("__text"),
    )
    schema = T.StructType([*base.schema.fields[:-1], *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch):
                at, hashes, prints = [], [], []
                for text in part.columns[-1].to_pylist():
                    lines, h, words = lines_of(text)
                    at.append(lines.tolist())
                    hashes.append(h.tobytes())
                    prints.append(winnow(h, words))
                made = [pa.array(v, f.type) for v, f in zip((at, hashes, prints), list(arrow)[-3:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=arrow.names)

    return materialize(base.mapInArrow(run, schema), "lines")


def mark_repeats(docs: DataFrame, place: tuple[str, ...] = ()) -> DataFrame:
    """For each row of ``docs``: ``__doc`` (its doc_id), ``place`` as ``__place0`` and so on, ``__at``
    (numbers of its non-blank lines) and ``__runs``, the runs [s, e) of these lines that
    repeat earlier text, null if none does."""
    rows = fingerprints(docs, place)
    prints = rows.select("__row", "__id", F.explode("__prints").alias("p")).select(
        F.col("p.gram").alias("gram"),
        F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("__row").alias("row"), F.col("p.at").alias("at")).alias("place"),
        F.col("p.windows").alias("windows"),
    )
    first = prints.groupBy("gram").agg(F.min("place").alias("first"), F.count("*").alias("c")).filter("c > 1").drop("c")
    first = materialize(first, "first")
    shared = materialize(prints.join(F.broadcast(first) if small(first) else first, "gram"), "shared")
    later = shared.filter("place <> first").select(
        F.col("place.row").alias("row"), F.col("first.row").alias("row0"),
        F.struct(F.col("place.at").alias("at"), F.col("first.at").alias("at0"), "gram", "windows").alias("p"),
    )
    later = later.groupBy("row", "row0").agg(F.collect_list("p").alias("prints"))  # of one document: bounded by its text
    hashes = rows.select(F.col("__row").alias("row"), F.col("__hashes").alias("h"))
    paired = later.join(hashes, "row").join(
        hashes.select(F.col("row").alias("row0"), F.col("h").alias("h0")), "row0"
    )
    checked = materialize(
        paired.select("row", "prints", "h", "h0").mapInArrow(
            _extend, "row long, gram long, s int, e int, covered boolean"
        ),
        "extended",
    )
    # windows outside the extended run: settled by their own hash among all windows of that gram
    open_ = materialize(checked.filter("not covered").select("gram").distinct(), "open")
    windows = shared.join(F.broadcast(open_) if small(open_) else open_, "gram", "left_semi")
    windows = windows.select("place", F.explode("windows").alias("w")).select(
        F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.col("w.s").alias("s"), F.col("w.e").alias("e"),
        F.struct("place.n", "place.id", "place.row", F.col("w.s").alias("at")).alias("place"),
    )
    earliest = windows.groupBy("a", "b").agg(F.min("place").alias("first"), F.count("*").alias("c")).filter("c > 1")
    earliest = materialize(earliest, "earliest")
    rest = windows.join(F.broadcast(earliest) if small(earliest) else earliest, ["a", "b"]).filter("place <> first").select(F.col("place.row").alias("row"), "s", "e")
    runs = (
        checked.filter("covered").select("row", "s", "e").union(rest)
        .groupBy("row").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("__runs"))
    )
    return rows.drop("__id", "__hashes", "__prints").join(runs.withColumnRenamed("row", "__row"), "__row", "left").drop("__row")


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extend each match both ways and tell which windows the run covers.  A match that
    lies in the run of the one before, at the same distance, has the same run."""
    for batch in batches:
        for part in slices(batch, 64):
            out: dict[str, list] = {"row": [], "gram": [], "s": [], "e": [], "covered": []}
            for row, prints, h, h0 in zip(*(c.to_pylist() for c in part.columns), strict=True):
                a, b = np.frombuffer(h, np.uint64), np.frombuffer(h0, np.uint64)
                prints.sort(key=lambda p: (p["at"] - p["at0"], p["at"]))
                shift, lo, hi = None, 0, 0
                for p in prints:
                    at, at0 = p["at"], p["at0"]
                    if at - at0 != shift or at >= hi:
                        shift = at - at0
                        lo, hi = _run(a, b, at, at0)
                    for w in p["windows"]:
                        out["row"].append(row)
                        out["gram"].append(p["gram"])
                        out["s"].append(w["s"])
                        out["e"].append(w["e"])
                        out["covered"].append(lo <= w["s"] and w["e"] <= hi)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["row"], pa.int64()), pa.array(out["gram"], pa.int64()), pa.array(out["s"], pa.int32()),
                 pa.array(out["e"], pa.int32()), pa.array(out["covered"], pa.bool_())],
                names=list(out),
            )


def _run(a: np.ndarray, b: np.ndarray, at: int, at0: int) -> tuple[int, int]:
    """The longest run of equal lines around line ``at`` of a and ``at0`` of b, as [lo, hi) of a."""
    k = min(len(a) - at, len(b) - at0)
    differ = np.flatnonzero(a[at : at + k] != b[at0 : at0 + k])
    hi = at + (int(differ[0]) if len(differ) else k)
    k = min(at, at0)
    differ = np.flatnonzero(a[at - k : at][::-1] != b[at0 - k : at0][::-1])
    return at - (int(differ[0]) if len(differ) else k), hi


def removed_lines(marked: DataFrame) -> DataFrame:
    """Adds ``__gone``, the numbers of the lines to delete, ascending."""
    gone = F.array_sort(
        F.array_distinct(
            F.flatten(F.transform("__runs", lambda r: F.slice("__at", r["s"] + 1, r["e"] - r["s"])))
        )
    )
    return marked.withColumn("__gone", F.coalesce(gone, F.array().cast("array<int>")))


def digest(marked: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): lines with a word, how many of them go,
    and their numbers, comma-joined."""
    m = removed_lines(marked)
    return m.select(
        F.col("__doc").alias("doc_id"),
        F.size("__at").cast("long").alias("n_lines"),
        F.size("__gone").cast("long").alias("n_removed"),
        F.array_join(F.col("__gone").cast("array<string>"), ",").alias("removed"),
    )


def without_repeats(docs: DataFrame, as_read: bool = False) -> DataFrame:
    """``docs`` without the repeated lines; a document that loses all its lines with a
    word is dropped, all others stay, in the columns of ``docs``.  ``as_read`` tells that
    ``docs`` is a table as read from files, which is then not copied."""
    rows, place = placed(docs, as_read, "rows")
    gone, whole = fresh(rows, "gone"), fresh(rows, "whole")
    marked = removed_lines(mark_repeats(rows, tuple(place))).filter(F.size("__gone") > 0).select(
        *[F.col(f"__place{i}").alias(c) for i, c in enumerate(place)], F.col("__gone").alias(gone), (F.size("__gone") == F.size("__at")).alias(whole)
    )
    marked = materialize(marked, "gone")
    if small(marked, 500_000) and marked.agg(F.coalesce(F.sum(F.size(gone)), F.lit(0))).first()[0] <= 5_000_000:
        # proven small: the rows that change are broadcast under a number of their file, and no text is shuffled
        file = fresh(marked, "file")
        files = materialize(marked.select(place[0]).distinct().withColumn(file, F.monotonically_increasing_id()), "files")
        few = marked.join(F.broadcast(files), place[0]).drop(place[0])
        m = rows.join(F.broadcast(files), place[0], "left").join(F.broadcast(few), [file, place[1]], "left")
    else:
        m = rows.join(marked, place, "left")
    m = m.filter(~F.coalesce(F.col(whole), F.lit(False)))
    lines = F.split(F.col("text").cast("string"), "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    text = F.when(F.col(gone).isNotNull(), kept).otherwise(F.col("text"))
    return m.select(
        *[(text.cast(docs.schema[c].dataType) if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns]
    )
