"""Quality rules: base counts, and cross-document line frequency.

Lines are normalised (A-Z lower-cased, digits to 0, white space collapsed) and
hashed; for each host (the document's ``source``) the distinct documents of a line
are counted; lines in more than MAX_HOST_MILLE thousandths of their host's documents (and in
more than FEW_DOCS, without which a line would be frequent in any host of a handful) are
removed; and a document that keeps less than half of its words, or under MIN_WORDS, is
rejected as depleted.  The limit is a share at every size of a host.

Rows are counted first, in one aggregation by (host, line) with map-side combine, so a
line that a third of all documents share costs one row a task.  Only for lines that
could be above the limits by their rows are the distinct documents counted.  Frequent
lines are joined back by Spark's choice: broadcast if small enough, else a shuffle.

Edge cases: a null text has no words; it and texts of fewer than MIN_WORDS words
fail the base rules.  A null host is a host of its own.  Repeated rows are judged
each (a row id is assigned when the counts are written), but count as one document of
their doc_id; rows with a null doc_id are not counted.  Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize, mix64, span_hashes, word_spans

MAX_HOST_MILLE = 50
#: A line in so few documents of a host stays, whatever their share.
FEW_DOCS = 5
MIN_WORDS = 10
MIN_KEPT = 0.5
_DIGITS = bytes.maketrans(b"123456789", b"0" * 9)
_SYMBOLS = b"#*$%&|<>"
_M = mix64(np.arange(301, 306, dtype=np.uint64)) | np.uint64(1)
_CONTINUATION = bytes(range(0x80, 0xC0))


def repeat_words(raw: bytes, window: int = 5) -> int:
    """Words inside a ``window``-word window that is found twice or more in the text."""
    starts, ends = word_spans(raw)
    n = len(starts) - window + 1
    if n < 2:
        return 0
    w = span_hashes(raw, starts, ends)
    with np.errstate(over="ignore"):
        h = mix64(sum(w[i : i + n] * _M[i] for i in range(window)))
    ids, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    if len(ids) == n:
        return 0
    at = np.flatnonzero(counts[inverse] > 1)
    words = raw.split()  # equal hashes are confirmed on the words themselves
    exact = Counter(tuple(words[i : i + window]) for i in at)
    delta = np.zeros(len(starts) + 1, np.int64)
    for i in at:
        if exact[tuple(words[i : i + window])] > 1:
            delta[i] += 1
            delta[i + window] -= 1
    return int((np.cumsum(delta[:-1]) > 0).sum())


def measures(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    joined = b"".join(words)
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += bool(line.split())
        else:
            seen.add(line)
    return (
        len(words),
        len(joined.translate(None, _CONTINUATION)),
        len(raw) - len(raw.translate(None, _SYMBOLS)),
        dup,
        repeat_words(raw),
    )


def line_keys(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct normalised lines with a word, and the words that each
    accounts for in the text."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().translate(_DIGITS)
    lines = [b" ".join(w) for w in map(bytes.split, raw.split(b"\n")) if w]
    if not lines:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    whole = b"\n".join(lines)
    sizes = np.array([len(x) for x in lines])
    ends = np.cumsum(sizes + 1) - 1
    words = np.array([x.count(b" ") + 1 for x in lines])
    keys, inverse = np.unique(span_hashes(whole, ends - sizes, ends), return_inverse=True)
    return keys.astype(np.int64), np.bincount(inverse, weights=words).astype(np.int32)


def judge(
    docs: DataFrame, few_docs: int = FEW_DOCS, host: str = "source", max_host_mille: int = MAX_HOST_MILLE
) -> DataFrame:
    """Per row of ``docs(doc_id, text, host)``: doc_id, the base counts, ``base_failed``,
    ``removed_words`` and ``kept``."""

    def run(batch: dict[str, list]) -> dict[str, object]:
        counts = list(zip(*(measures(t) for t in batch["text"]), strict=True))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        lines = [line_keys(t) for t in batch["text"]]
        return {
            **{k: batch[k] for k in ("row", "doc_id", "host")},
            **dict(zip(names, map(list, counts), strict=True)),
            "lines": [a for a, _ in lines],
            "line_words": [b for _, b in lines],
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(
        map_batches(
            docs.select(
                F.monotonically_increasing_id().alias("row"),
                "doc_id",
                F.col(host).cast("string").alias("host"),
                F.col("text").cast("string").alias("text"),
            ),
            run,
            f"row long, doc_id {kind}, host string, n_words long, word_chars long, n_symbols long, "
            "n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<int>",
        ),
        "measures",
    )
    lines = rows.select("row", "doc_id", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l")).select(
        "row", "doc_id", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("w")
    )
    hosts = rows.groupBy("host").agg(F.count_distinct("doc_id").alias("docs")).withColumnRenamed("host", "h")
    above = (F.col("n") > few_docs) & (F.col("n") * 1000 > F.col("docs") * max_host_mille)
    often = lines.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > few_docs)
    often = often.join(materialize(hosts, "hosts"), F.col("host").eqNullSafe(F.col("h"))).filter(above)
    often = materialize(often.select("h", F.col("line").alias("l"), "docs"), "often")
    same = (F.col("line") == F.col("l")) & F.col("host").eqNullSafe(F.col("h"))
    hits = materialize(lines.join(often, same).select("row", "doc_id", "h", "l", "docs", "w"), "hits")
    frequent = hits.groupBy("h", "l").agg(F.count_distinct("doc_id").alias("n"), F.first("docs").alias("docs")).filter(above)
    frequent = frequent.select(F.col("h").alias("host"), F.col("l").alias("line"))
    removed = hits.join(frequent, same).groupBy("row").agg(F.sum("w").cast("long").alias("removed"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (left < MIN_WORDS) | (left < MIN_KEPT * F.col("n_words"))
    return (
        rows.drop("lines", "line_words")
        .join(removed, "row", "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            failed.alias("base_failed"),
            F.coalesce("removed", F.lit(0)).cast("long").alias("removed_words"),
            (~failed & ~depleted).alias("kept"),
        )
    )
