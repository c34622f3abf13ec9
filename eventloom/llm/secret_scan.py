"""Secrets in texts: fixed patterns, and a battery of randomness tests.

The base patterns find assignments, access keys and hex runs.  The battery looks at
every other run of key-like characters that is long enough for its encoding (hex,
base32, base64, base64url, inferred from its characters): what base spans leave of a
run is cut at ``=`` (trailing padding stays with its token) and at the characters that
an encoding does not have, for each encoding in turn, and each distinct token is tested for
(a) uniformity over the alphabet by chi-squared, (b) the number of runs above and
below the alphabet's middle, and (c) serial correlation.  Each test's p-value tells
how a random string of that encoding would look; a token counts as random if no
test rejects it.  What is controlled is the false discovery of *ordinary* text:
the p-value of a token under ordinary text combines two by Fisher's method: the probability of so
small a chi-squared value when letters follow a natural-language frequency (a non-central
chi-squared, whose shift grows with length), and a bound of the probability of so many runs
of character classes (lower case, upper case, digits, marks) when neighbours differ in class
with probability CHANGE.  One Benjamini-Hochberg control runs over all tested tokens of the
corpus, those that a test rejects having p-value 1; it is length-aware by weights that double
with each doubling of the length up to MOST_WEIGHT, so that a lone secret need not outweigh
all ordinary tokens of its own length.  Its counts are a table bounded by LEVELS x length classes.

Edge cases: a null text is empty and has no span.  Overlapping finds: a battery
span never overlaps a base span; base spans of different kinds may overlap, as may
battery spans of different encodings, and all stay.  Repeated rows are scanned each, and count each in the control.
Positions are code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialize

#: Fixed patterns of the base kinds, with the least length of what counts.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Runs of one encoding's characters; runs of lower-case hex are base spans.
TOKENS = tuple(map(re.compile, (r"[A-Za-z0-9+/]{20,}", r"[A-Za-z0-9_-]{20,}", r"[A-Z2-7]{24,}", r"[0-9A-F]{24,}")))
PADDING = re.compile(r"=+(?![A-Za-z0-9+/_=-])")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORD = re.compile(r"(?i)password|passwd|secret|token|api_?key", re.ASCII)
#: Encodings: name, alphabet size, least length at which the tests have power.
ENCODINGS = (("hex", 16, 24), ("base32", 32, 24), ("base64", 64, 20), ("base64url", 64, 20))
ALPHA = 0.001
FDR = 0.01
LEVELS = 60
CHANGE = 0.15
MOST_WEIGHT = 8
_ORDER = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")} | {"-": 62, "_": 63}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, leftmost and non-overlapping per kind."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # runs are maximal, so asking for the least length at once finds the same ones
    out += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def encoding_of(token: str) -> tuple[str, int, int] | None:
    """The narrowest encoding whose alphabet holds the token's characters."""
    chars = set(token.rstrip("="))
    if chars <= set("0123456789abcdef") or chars <= set("0123456789ABCDEF"):
        return ENCODINGS[0]
    if chars <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        return ENCODINGS[1]
    if not chars & set("-_=") and chars <= set(_ORDER):
        return ENCODINGS[2]
    if not chars & set("+/="):
        return ENCODINGS[3]
    return None


def _normal_tail(z: float) -> float:
    """P(|Z| >= |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def runs_bound(body: str) -> float:
    """Chernoff's bound of the probability that ordinary text has so many runs of character classes."""
    classes = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in body]
    pairs = len(classes) - 1
    share = sum(x != y for x, y in zip(classes, classes[1:])) / max(pairs, 1)
    if share <= CHANGE:
        return 1.0
    divergence = share * math.log(share / CHANGE)
    if share < 1:
        divergence += (1 - share) * math.log((1 - share) / (1 - CHANGE))
    return math.exp(-pairs * divergence)


def battery(token: str) -> tuple[float, float, str] | None:
    """(least p-value as a random string, p-value as ordinary text, encoding), or
    None if the token is too short for its encoding."""
    enc = encoding_of(token)
    body = token.rstrip("=")
    n = len(body)
    if enc is None or n < enc[2]:
        return None
    name, size, _ = enc
    if name == "hex":
        values = [int(c, 16) for c in body]
    elif name == "base32":
        values = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567".index(c) for c in body]
    else:
        values = [_ORDER[c] for c in body]
    counts = Counter(values).values()
    expected = n / size
    chi = sum(c * c for c in counts) / expected - n
    # a moment-matched normal, good also where cells expect less than one
    uniform = math.erfc((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (1 - 1 / n)) / math.sqrt(2)) / 2
    high = [v >= size / 2 for v in values]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 0.0
        p_runs = min(p_runs, _normal_tail((a - n / 2) / math.sqrt(n / 4)))
    else:
        p_runs = 0.0
    centre = sum(values) / n
    dev = [v - centre for v in values]
    square = sum(d * d for d in dev)
    serial = sum(x * y for x, y in zip(dev, dev[1:])) / square if square else 1.0
    p_serial = _normal_tail((serial + 1 / n) * math.sqrt(n))
    # ordinary text: one case, about 0.065 as the chance that two letters agree
    agree = 0.065 if name != "hex" else 0.17
    shift = n * (n - 1) * agree * size / n - (n - size) - size
    mean, var = size - 1 + max(0.0, shift), 2 * (size - 1) + 4 * max(1.0, shift)
    ordinary = math.erfc((mean - chi) / math.sqrt(2 * var)) / 2
    kinds = sum((any(c.islower() for c in body), any(c.isupper() for c in body), any(c.isdigit() for c in body)))
    if kinds == 1 and name != "hex":
        ordinary = 1.0  # letters of one case only, or digits only: never told from words or numbers
    both = max(ordinary * runs_bound(body), 1e-300)
    ordinary = min(1.0, both * (1 - math.log(both)))  # Fisher's combination
    return min(uniform, p_runs, p_serial), ordinary, name


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Distinct spans of the tokens beside the base spans, given by their start."""
    out, at = set(), 0
    for run in RUN.finditer(text):
        while at < len(base) and base[at][1] <= run.start():
            at += 1
        pieces, start = [], run.start()
        here = at  # base spans come by start; those of other kinds may end before an earlier one
        while here < len(base) and base[here][0] < run.end():
            pieces.append((start, base[here][0]))
            start = max(start, base[here][1])
            here += 1
        pieces.append((start, run.end()))
        for s, e in pieces:
            for kind in TOKENS:
                for m in kind.finditer(text, s, max(s, e)):
                    pad = PADDING.match(text, m.end())
                    out.add((m.start(), pad.end() if pad else m.end()))
    return sorted(out)


def scan_text(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, float]], Counter]:
    """Base spans, (start, end, p-value as ordinary text) of tokens that pass as random,
    and the number of tested tokens by length class."""
    text = text or ""
    base = base_spans(text)
    found, tested = [], Counter()
    for s, e in candidates(text, base):
        got = battery(text[s:e])
        if got:
            tested[length_class(e - s)] += 1
            if got[0] >= ALPHA:
                found.append((s, e, got[1]))
    return base, found, tested


def level_of(p: float) -> int:
    """Logarithmic class of a p-value: 0 for 1, larger for smaller."""
    return min(LEVELS - 1, int(-4 * math.log10(max(p, 1e-300))))


def length_class(n: int) -> int:
    return min(7, int(math.log2(max(n, 1) / 16)))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, extra) with spans as arrays of (start, kind number, end): the base
    spans and those that the battery adds, for every row of ``docs(doc_id, text)``."""

    def run(batch: dict[str, list]) -> dict[str, object]:
        out: dict[str, list] = {"doc_id": batch["doc_id"], "base": [], "found": [], "tested": []}
        for t in batch["text"]:
            base, found, tested = scan_text(t)
            out["tested"].append([{"c": c, "n": n} for c, n in sorted(tested.items())])
            out["base"].append([{"s": s, "k": KINDS.index(k), "e": e} for s, e, k in base])
            out["found"].append(
                [{"s": s, "e": e, "c": length_class(e - s), "l": level_of(p)} for s, e, p in found]
            )
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = materialize(
        map_batches(
            docs.select("doc_id", F.col("text").cast("string").alias("text")),
            run,
            f"doc_id {kind}, base array<struct<s:int,k:int,e:int>>, found array<struct<s:int,e:int,c:int,l:int>>, "
            "tested array<struct<c:int,n:long>>",
        ),
        "scan",
    )
    table = rows.select(F.explode("found").alias("f")).groupBy("f.c", "f.l").count().collect()  # <= 8 * LEVELS rows
    tests = rows.select(F.explode("tested").alias("t")).groupBy("t.c").agg(F.sum("t.n")).collect()  # <= 8 rows
    limit = thresholds({(r[0], r[1]): r[2] for r in table}, {r[0]: r[1] for r in tests})
    least = F.create_map(*[F.lit(x) for c, l in limit.items() for x in (c, l)])
    passed = F.filter("found", lambda f: f["l"] >= least[f["c"]])
    return rows.select(
        "doc_id",
        "base",
        F.transform(passed, lambda f: F.struct(f["s"], F.lit(3).alias("k"), f["e"])).alias("extra"),
    )


def thresholds(counts: dict[tuple[int, int], int], tested: dict[int, int]) -> dict[int, int]:
    """Weighted Benjamini-Hochberg over all length classes: for each the least level (largest
    p-value class) that is discovered, or LEVELS if none is.  ``counts`` are of the tokens
    that pass as random, ``tested`` of all; the weights of all tested tokens have the mean 1."""
    total = sum(tested.values())
    plain = {c: min(MOST_WEIGHT, 2**c) for c in range(8)}
    mean = sum(n * plain[c] for c, n in tested.items()) / total if total else 1.0
    weighted = {(c, level): 10 ** (-level / 4) / (plain[c] / mean) for c in range(8) for level in range(LEVELS)}
    bound = 0.0
    for at in sorted({weighted[key] for key, n in counts.items() if n}, reverse=True):
        found = sum(n for key, n in counts.items() if weighted[key] <= at)
        if at <= FDR * found / total:
            bound = at
            break
    return {c: next((level for level in range(LEVELS) if weighted[c, level] <= bound), LEVELS) for c in range(8)}


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of a scan."""
    name = F.array(*[F.lit(k) for k in KINDS])
    show = lambda spans: F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(show(F.col("base")), 256).alias("base_sha256"),
        show(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )
