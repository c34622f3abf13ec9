"""Exact token counts of a byte-level BPE vocabulary, by a map-side two-tier lookup.

Texts are cut into pre-tokens by the vocabulary's own pattern; the tokens of a text are the
sum of the tokens of its pre-tokens.  Tier one is a compact table of the lengths of frequent
pre-tokens (their bytes end to end, offsets and one count each), which Spark broadcasts and a
worker opens once as a hash table.  Tier two is a cache in each worker: a pre-token that
the table lacks is encoded by the library once and remembered until the cache is full.
Nothing but the counts leaves a task, so no pre-token is ever shuffled.

What tier one holds changes the speed, never a count.  It is read from a bounded sample:
about SAMPLE_DOCS texts (of at most SAMPLE_CHARS characters), from SAMPLE_FILES files spread
evenly over the table; of their pre-tokens the TABLE most frequent that occur twice or more.

The regex library and the tokenizer library can know different Unicode versions.  Where a
text has a character outside SETTLED, on whose classes they agree (the tests hold every one of
them against the library), that stretch of the text is encoded whole by the library.

Strings of special tokens in a text are one token each, as is the library's default.
Texts are taken in stretches of about STRETCH characters that end before a single space after
another character; no pre-token crosses such a place, so the memory of a very long text is that
of one stretch unless it has no spaces.

Edge cases: a null text is empty: 0 bytes, 0 tokens.  A null id stays null.  Repeated rows are
counted each.  An empty table gives an empty result.  Extra columns are ignored.  A tokenizer
with another pipeline than byte-level BPE without normaliser is refused.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import fresh, slices, text_of

LIMIT = 512
SAMPLE_FILES, SAMPLE_DOCS, SAMPLE_CHARS = 16, 4_000, 40_000
TABLE = 1 << 16
CACHE = 1 << 18
#: Longer pre-tokens are encoded each time.
CACHED_CHARS = 64
STRETCH = 1 << 18
PRE_TOKEN = regex.compile(public_tokenizers.PATTERN)
#: Fixed ranges of characters that both libraries class alike.
SETTLED = (
    (0x0000, 0x0557), (0x0590, 0x088E), (0x0900, 0x0C5B), (0x0E00, 0x0EFF), (0x10A0, 0x11FF), (0x1E00, 0x208E),
    (0x20A0, 0x218B), (0x2190, 0x2426), (0x2460, 0x2B73), (0x2E80, 0x2EF3), (0x3000, 0x318E), (0x31F0, 0xA48C),
    (0xAC00, 0xD7A3), (0xF900, 0xFAD9), (0xFB00, 0xFB06), (0xFE30, 0xFEFF), (0xFF01, 0xFFEE), (0x1F300, 0x1F6D7),
)
_UNSETTLED = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" if a else r"\x00-" + chr(b) for a, b in SETTLED) + "]")


def load(path: str) -> str:
    """The JSON of a tokenizer file, which is checked to be one that can be counted by parts."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    made = json.loads(text)
    pre = made.get("pre_tokenizer") or {}
    plain = all(not t[flag] for t in made["added_tokens"] for flag in ("single_word", "lstrip", "rstrip"))
    usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if made["model"]["type"] != "BPE" or made.get("normalizer") or not usual or not plain:
        raise ValueError(f"{path} is not a byte-level BPE tokenizer without normaliser")
    return text


class Lengths(dict):
    """Tokens of pre-tokens: the frequent table, and a bounded cache of what it lacks."""

    def __init__(self, tokenizer: str, frequent: tuple[bytes, np.ndarray, np.ndarray]):
        super().__init__()
        self.library = Tokenizer.from_str(tokenizer)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        raw, ends, counts = frequent
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        self.frequent = {raw[a:b].decode(): int(n) for a, b, n in zip(starts, ends, counts)}
        self.update(self.frequent)

    def __missing__(self, unit: str) -> int:
        count = self.encoded(unit)
        if len(unit) <= CACHED_CHARS:
            if len(self) >= len(self.frequent) + CACHE:
                self.clear()
                self.update(self.frequent)
            self[unit] = count
        return count

    def encoded(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def units(self, text: str) -> Iterator[list[str] | str]:
        """Lists of pre-tokens, and stretches and special strings to be encoded whole."""
        found = [s for s in self.special if s in text]
        if found:
            yield from (u for part in _parts(text, found) for u in ([part] if part in found else self.units(part)))
            return
        for stretch in _stretches(text):
            yield stretch if _UNSETTLED.search(stretch) else PRE_TOKEN.findall(stretch)

    def count(self, text: str) -> int:
        return sum(self.encoded(u) if isinstance(u, str) else sum(map(self.__getitem__, u)) for u in self.units(text))


def _parts(text: str, special: list[str]) -> list[str]:
    """The text cut before and after special strings, the longest first where they overlap."""
    one_of = "|".join(map(re.escape, sorted(special, key=len, reverse=True)))
    return [p for p in re.split(f"({one_of})", text) if p]


def _stretches(text: str) -> Iterator[str]:
    """Consecutive parts of about STRETCH characters that no pre-token crosses."""
    at = 0
    while len(text) - at > STRETCH:
        to = text.find(" ", at + STRETCH)
        while to > 0 and text[to - 1].isspace():
            to = text.find(" ", to + 1)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:] if at else text


def sample(docs: DataFrame) -> DataFrame:
    """Texts of the bounded sample, one column ``text``."""
    text, files = F.substring(text_of(docs), 1, SAMPLE_CHARS).alias("text"), []
    try:
        path = docs.metadataColumn("_metadata")["file_path"]
        files = sorted(docs.inputFiles())
        some = docs.where(path.isin(files[:: -(-len(files) // SAMPLE_FILES)])) if len(files) > SAMPLE_FILES else docs
    except AnalysisException:
        some = docs  # not read from files
    rows = some.count()
    return some.select(text).sample(min(1.0, SAMPLE_DOCS / max(rows, 1)), seed=13).limit(SAMPLE_DOCS)


def frequent_lengths(texts: DataFrame, tokenizer: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The compact table: pre-tokens end to end as UTF-8, their ends, and their tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, seen = Lengths(tokenizer, (b"", np.empty(0, int), np.empty(0, int))), Counter()
        for batch in batches:
            for text in batch.column(0).drop_null().to_pylist():
                for units in lengths.units(text):
                    if not isinstance(units, str):
                        seen.update(units)
        kept = [u for u, n in seen.most_common(TABLE) if n > 1 and len(u) <= CACHED_CHARS]
        tokens = [lengths.encoded(u) for u in kept]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(tokens, pa.int64())], ["unit", "tokens"])

    rows = texts.coalesce(1).mapInArrow(counted, "unit string, tokens long").collect()
    raw = [r["unit"].encode() for r in rows]
    return b"".join(raw), np.cumsum([len(r) for r in raw], dtype=np.int64), np.array([r["tokens"] for r in rows], np.uint16)


_open: dict[str, Lengths] = {}  # this worker's tables, by the call they belong to


def _lengths(call: str, shared: Broadcast) -> Lengths:
    if call not in _open:
        _open.clear()
        _open[call] = Lengths(*shared.value)
    return _open[call]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and whether they are more than ``limit``, one row a row."""
    tokenizer = load(path or public_tokenizers.path("byte_bpe_50k.json"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((tokenizer, frequent_lengths(sample(docs), tokenizer)))
    call, text = uuid.uuid4().hex, fresh(docs, "text")
    kept = docs.select("doc_id", F.coalesce(text_of(docs), F.lit("")).alias(text))
    kept = kept.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text)
    schema = T.StructType([*kept.schema.fields[:2], T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(call, shared)
        for batch in batches:
            for part in slices(batch):
                counts = [lengths.count(t) for t in part.column(2).to_pylist()]
                columns = [*part.columns[:2], pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens"])

    return kept.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
