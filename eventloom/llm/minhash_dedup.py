"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard.

Two permutations make all signature coordinates: the first scatters the
shingles, the second is read at circularly shifted places, one shift per
coordinate.  Signatures are banded, documents of one band bucket become
candidates, and every link is confirmed on the full shingle sets.

No bucket is ever expanded into all pairs, and no group is held in one task:

* documents with equal shingle sets share a class and are represented by its
  smallest ``doc_id``; exact copies never meet in a bucket;
* each bucket is compared with its smallest member (a star), the verified links
  are joined into components;
* a bucket that still holds members of more than one component is compared
  exhaustively, in blocks of bounded size, by signature and then by full set.
  Pairs inside one component are skipped: they cannot change it; and of the
  links found only those that join two components are emitted.

With 32 bands of 4 coordinates a pair at similarity 0.75 misses every bucket
with probability (1 - 0.75**4)**32 = 5e-6.

Edge cases: a null, empty or blank text has an empty set, ``n_shingles`` 0, and
is linked with nothing, itself its component.  Fewer words than a shingle: the
whole sequence is the only shingle.  Repeated rows are kept, one result each; rows
of one ``doc_id`` with different texts are one vertex of the link graph; a
null ``doc_id`` has a null component (its smallest id being unknown) unless its
class has a member with an id.  Extra columns are ignored.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, fresh, map_batches, materialize, mix64, placed, small, word_hashes

SHINGLE = 5
BANDS = 32
ROWS = 4
SIMILARITY = 75  # per cent

_MULTIPLIERS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of all ``size``-word shingles, ascending."""
    w = word_hashes(text.encode("utf-8", "surrogatepass").lower()) if text else np.empty(0, np.uint64)
    if not len(w):
        return w
    k = min(size, len(w))
    n = len(w) - k + 1
    total = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            total += w[i : i + n] * _MULTIPLIERS[i + 8 * (size - k)]
    return np.unique(mix64(total))


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: coordinate k is the least pi(sigma(x) + k mod 2**32)
    over the shingles x.  sigma keeps the upper half of the mixed 64-bit hash;
    pi is one fixed bijection of the 32-bit integers."""
    sigma = (shingles >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    low = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(sigma), 2048):
            x = sigma[None, at : at + 2048] + shifts
            x *= np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0xC2B2AE35)
            np.minimum(low, x.min(axis=1), out=low)
    return low


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket key for each band; the band number is part of the key."""
    with np.errstate(over="ignore"):
        parts = (sig.reshape(bands, rows).astype(np.uint64) * _MULTIPLIERS[:rows]).sum(axis=1, dtype=np.uint64)
        return mix64(parts + mix64(np.arange(100, 100 + bands, dtype=np.uint64))).astype(np.int64)


def class_of(shingles: np.ndarray) -> bytes | None:
    """A 128-bit digest of a shingle set, null for an empty one."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, class, keys, marks, tiny): the class stands for the shingle
    set, keys are its bucket keys, marks the same as bytes, tiny the low byte of each
    signature coordinate."""
    def sketch(batch: dict[str, list]) -> dict[str, object]:
        out = {c: batch[c] for c in ("doc_id", *carry)} | {"n_shingles": [], "class": [], "keys": [], "marks": [], "tiny": []}
        for text in batch["text"]:
            s = shingle_hashes(text)
            out["n_shingles"].append(len(s))
            out["class"].append(class_of(s))
            sig = signature(s, bands * rows)
            out["keys"].append(band_keys(sig, bands, rows) if len(s) else np.empty(0, np.int64))
            out["marks"].append(out["keys"][-1].tobytes() if len(s) else None)
            out["tiny"].append(sig.astype(np.uint8).tobytes() if len(s) else None)
        return out

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry),
        sketch,
        "doc_id long, " + "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)
        + "n_shingles long, class binary, keys array<long>, marks binary, tiny binary",
    )


def _words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased: ``bytes.lower`` changes these letters only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _shingle_set(text: str) -> set[bytes]:
    """The shingles themselves, for the exact comparison."""
    w = _words(text)
    return {b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the candidate ``pairs(src, dst)``, those whose exact Jaccard similarity
    reaches the threshold.  Only texts that occur in a pair are shuffled; the
    text of a hot ``src`` is on the unsplit side of its join and is parsed once
    per run of equal ids."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    ids = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    texts = texts.join(F.broadcast(ids) if small(ids) else ids, "id", "left_semi")
    texts = texts.dropDuplicates(["id", "text"])
    both = pairs.join(texts.select(F.col("id").alias("dst"), F.col("text").alias("b")), "dst")
    both = both.join(texts.select(F.col("id").alias("src"), F.col("text").alias("a")), "src")

    last: dict[str, object] = {"text": None, "set": set()}

    def keep(batch: dict[str, list]) -> dict[str, object]:
        src, dst = [], []
        for s, d, a, b in zip(batch["src"], batch["dst"], batch["a"], batch["b"], strict=True):
            if last["text"] != a:
                last["text"], last["set"] = a, _shingle_set(a)
            x, y = last["set"], _shingle_set(b)
            if min(len(x), len(y)) * 100 < SIMILARITY * max(len(x), len(y)):
                continue
            common = len(x & y)
            if common and 100 * common >= SIMILARITY * (len(x) + len(y) - common):
                src.append(s)
                dst.append(d)
        return {"src": src, "dst": dst}

    return map_batches(both.select("src", "dst", "a", "b"), keep, "src long, dst long")


def near_duplicates(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) and the columns of ``carry`` for every row of ``docs(doc_id, text)``."""
    rows = materialize(sketches(docs, carry=carry), "sketch")
    classes = rows.filter("class is not null and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"))
    reps = materialize(
        rows.filter("class is not null")
        .join(classes, "class")
        .filter("doc_id = rep")
        .groupBy("class")
        .agg(F.first("rep").alias("rep"), F.first("n_shingles").alias("n"), *(F.first(c).alias(c) for c in ("keys", "marks", "tiny"))),
        "reps",
    )
    bands = reps.select(F.posexplode("keys").alias("band", "key"), "class", "rep")
    shared = bands.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("c")).filter("c > 1")
    members = materialize(bands.join(shared.drop("c"), "key"), "buckets")
    linked = link_components(members, reps.select("class", "n", "marks", "tiny"), docs)
    whole = (
        reps.select("class", "rep")
        .join(linked, F.col("rep") == F.col("id"), "left")
        .select("class", F.coalesce("component", "rep").alias("component_id"))
    )
    return (
        rows.select("doc_id", "n_shingles", "class", *carry)
        .join(whole, "class", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"),
            *carry,
        )
    )


def one_of_each(docs: DataFrame, as_read: bool = False) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the first row of the
    smallest ``doc_id``.  Rows that are linked with nothing stay, repeated rows with
    words fold into one.  ``as_read`` tells that ``docs`` is a table as read from files,
    which is then not copied."""
    rows, place = placed(docs, as_read, "dedupin")
    judged = materialize(near_duplicates(rows, carry=tuple(place)), "judged")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), *[F.col(c) for c in place]))
    group = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    # rows without words and rows without any id are groups of their own
    alone = judged.filter(group.isNull()).select(*place)
    chosen = judged.filter(group.isNotNull()).groupBy(group.alias("g")).agg(best.alias("b"))
    chosen = chosen.select(*[F.col("b").getField(c).alias(c) for c in place])
    stays = materialize(chosen.union(alone), "stays")
    goes = materialize(judged.select(*place).join(stays, place, "left_anti"), "goes")
    if small(goes, 500_000):
        # their places, two numbers each, are proven small; they are broadcast, and no text is shuffled
        file = fresh(rows, "file")
        files = materialize(goes.select(place[0]).distinct().withColumn(file, F.monotonically_increasing_id()), "files")
        gone = goes.join(F.broadcast(files), place[0]).select(file, place[1])
        kept = rows.join(F.broadcast(files), place[0], "left").join(F.broadcast(gone), [file, place[1]], "left_anti")
        return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
    return rows.join(stays, place, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def link_components(members: DataFrame, sketched: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, component) of the linked classes in ``members(key, band, class, rep, leader)``;
    a ``rep`` with several texts is in several classes, so sketches go by class."""
    pairs = (
        members.filter("rep <> leader")
        .select(F.col("leader").alias("src"), F.col("rep").alias("dst"))
        .distinct()
    )
    stars = materialize(verified(materialize(pairs, "pairs"), docs), "stars")
    comps = materialize(components(stars, "star"), "starcomp")
    # buckets with members of more than one component: these may hide further links
    known = members.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", "band", "class", "rep", F.coalesce("component", "rep").alias("comp")
    )
    several = (
        known.groupBy("key")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"))
        .filter("lo <> hi")
        .select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    )
    opened = known.join(several, "key").join(sketched, "class")
    # full sets are shipped only for members that a partner in another component may match
    likely = materialize(likely_members(opened), "likely")
    more = materialize(bucket_links(likely, shingle_sets(likely.select("rep").distinct(), docs)), "more")
    return components(stars.unionByName(more), "all")


BLOCK = 512
_LIKELY = 0.55  # an estimate this low is over five standard errors under the threshold


def shingle_sets(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, sig, hashes): signature and full hashed shingle set of each text of the
    given documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))

    def sets(batch: dict[str, list]) -> dict[str, object]:
        got = [shingle_hashes(t) for t in batch["text"]]
        return {
            "class": [class_of(s) for s in got],
            "sig": [signature(s).tobytes() for s in got],
            "hashes": [s.tobytes() for s in got],
        }

    wanted = F.broadcast(reps) if small(reps) else reps  # so that texts are not shuffled for the few wanted
    made = map_batches(texts.join(wanted, "rep", "left_semi"), sets, "class binary, sig binary, hashes binary")
    return made.dropDuplicates(["class"])


def _in_blocks(opened: DataFrame) -> DataFrame:
    """A bucket of more than BLOCK members is split into blocks, and each pair of blocks
    (i, j) is a group of its own: a group holds 2 * BLOCK members or so at most."""
    rows = opened.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


def _by_group(rows: DataFrame, fn: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Apply ``fn`` to the rows of each (key, i, j), as tuples without these three.  Groups
    come sorted, so a task holds one at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    cols = [c for c in rows.columns if c not in ("key", "i", "j")]
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "comp", "rep")

    def flush(group: tuple | None, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if found := fn(held) if held else []:
            out = [(*group, *f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        held: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    if row[:3] != group:
                        yield from flush(group, held)
                        group, held = row[:3], []
                    held.append(row[3:])
        yield from flush(group, held)

    return rows.select("key", "i", "j", *cols).mapInArrow(run, schema)


def likely_members(opened: DataFrame) -> DataFrame:
    """Of ``opened(key, band, blocks, class, rep, comp, n, marks, tiny)``, the members that
    may be linked to a member of another component in their bucket, judged by size and by
    the low bytes of the signatures (equal by chance once in 256, which is taken off).  A
    pair counts only in the bucket of the first band whose full keys agree: it is a bucket
    of both and, the pair being of two components, an opened one."""
    rows = _in_blocks(opened).select("key", "i", "j", "own", "rep", "comp", "n", "blocks", "class", "band", "marks", "tiny")

    def likely(held: list[tuple]) -> list[tuple]:
        comp = np.array([r[2] for r in held])
        if (comp == comp[0]).all():
            return []
        own, n = np.array([r[0] for r in held]), np.array([r[3] for r in held])
        tiny = np.stack([np.frombuffer(r[8], np.uint8) for r in held])
        cross = (own != own[0]).any()
        marks = np.stack([np.frombuffer(r[7], np.int64) for r in held])
        at = held[0][6]  # the band that this bucket belongs to
        keep = np.zeros(len(held), bool)
        for x in range(len(held) - 1):
            maybe = (comp[x + 1 :] != comp[x]) & (np.minimum(n[x + 1 :], n[x]) * 100 >= SIMILARITY * np.maximum(n[x + 1 :], n[x]))
            if cross:
                maybe &= own[x + 1 :] != own[x]
            ys = np.flatnonzero(maybe) + x + 1
            if len(ys):
                like = ((tiny[ys] == tiny[x]).mean(axis=1) - 1 / 256) / (255 / 256)
                ys = ys[like >= _LIKELY]
                ys = ys[(marks[ys] == marks[x]).argmax(axis=1) == at]
                keep[ys] = True
                keep[x] |= len(ys) > 0
        return [(held[k][1], held[k][2], held[k][4], held[k][5], at) for k in np.flatnonzero(keep)]

    found = _by_group(rows, likely, "key long, i int, j int, rep long, comp long, blocks int, class binary, band int")
    return found.select("key", "band", "class", "rep", "comp", "blocks").distinct()


def bucket_links(likely: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between members of one bucket that are in different components.

    Signatures rule out most pairs; the rest are compared on the full sets, and only links
    that join two components are emitted: at most one less than members, never all pairs.
    A pair that meets in several buckets is compared in the first one only."""
    rows = _in_blocks(likely).join(sets, "class").select("key", "i", "j", "own", "rep", "comp", "sig", "hashes", "band")
    return _by_group(rows, _joins, "key long, i int, j int, src long, dst long").select("src", "dst")


def _joins(held: list[tuple]) -> list[tuple[int, int]]:
    """Links that join components, within one block or between two blocks; rows are
    (own block, rep, comp, sig, hashes, band)."""
    own = np.array([r[0] for r in held])
    label = np.unique(np.array([r[2] for r in held]), return_inverse=True)[1]
    if (label == label[0]).all():
        return []
    cross = (own != own[0]).any()
    sigs = np.stack([np.frombuffer(r[3], dtype=np.uint32) for r in held])
    sets = [np.frombuffer(r[4], dtype=np.uint64) for r in held]
    sizes = np.array([len(s) for s in sets])
    bands = np.stack([band_keys(s) for s in sigs])
    at = held[0][5]  # the band that this bucket belongs to
    out = []
    for x in range(len(held) - 1):
        rest = slice(x + 1, None)
        maybe = label[rest] != label[x]
        if cross:
            maybe &= own[rest] != own[x]
        maybe &= np.minimum(sizes[rest], sizes[x]) * 100 >= SIMILARITY * np.maximum(sizes[rest], sizes[x])
        if not maybe.any():
            continue
        ys = np.flatnonzero(maybe) + x + 1
        like = (sigs[ys] == sigs[x]).mean(axis=1)
        good = (like >= _LIKELY) & ((bands[ys] == bands[x]).argmax(axis=1) == at)
        ys, like = ys[good], like[good]
        for y in ys[np.argsort(-like, kind="stable")]:
            if label[x] == label[y]:
                continue
            shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if 100 * shared >= SIMILARITY * (sizes[x] + sizes[y] - shared):
                out.append((held[x][1], held[y][1]))
                label[label == label[y]] = label[x]
    return out
