"""URL rules by bit-parallel wildcard automata.

Globs are packed into a multiword Shift-And automaton: bit i of the state says that some rule has matched up to its position i.  One step over a
character shifts the state into the next positions and masks it with the
positions that this character fits; a position before ``*`` also keeps its bit.
All rules are simulated at once over each canonical URL, and numpy advances all
URLs of a batch together.

A canonical URL is ``.host`` + path: the host is what follows the first ``://``
up to ``/ ? #`` or the end, A-Z lower-cased; the path is the rest up to ``? #``.
The leading dot lets one pattern ``*.org`` cover a host and its subdomains.

A base rule is two globs, ``*.org`` over ``.host`` and ``/prefix*`` over the path,
in an automaton each, so that no rule can match inside a path.  The block globs
run over the whole canonical URL.

Edge cases: a null URL or one without ``://`` has an empty host and path, no
rule, and the default verdict.  Any characters may occur; ``?`` in a glob is any
one character and ``*`` any run, both including ``/``.  Repeated rows are judged
each.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Fixed rules (verdict, host + path prefix); the longest that fits wins.
BASE_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Fixed globs over the canonical URL that block a page which no base rule decides.
BLOCK_GLOBS = (
    "*.html",
    "*.exe",
    "*.zip",
    "*.m.*/de/*",
    "*/login*",
    "*/wp-admin/*",
    "*/tag/*",
    "*/search/*",
    "*casino*",
    "*.shop.*",
    "*/es/?????",
)


def host_of(url: Column) -> Column:
    """Host of a URL, empty without ``://`` or for null; only A-Z are lower-cased."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.instr(url, "://") > 0, F.translate(host, upper, lower)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


class Automaton:
    """Multiword Shift-And over a list of globs."""

    def __init__(self, globs: list[str]) -> None:
        heads: list[tuple[str | None, bool, bool]] = []  # (character or None for any, keeps its bit, starts a rule)
        self.accept: list[int] = []
        for glob in globs:
            # position 0 of a rule is its start state; each other position stands for one consumed character
            heads.append(("", False, True))
            for c in glob:
                if c == "*":
                    char, _, first = heads[-1]
                    heads[-1] = (char, True, first)
                else:
                    heads.append((None if c == "?" else c, False, False))
            self.accept.append(len(heads) - 1)
        self.words = -(-len(heads) // 64)
        self.chars = sorted({h[0] for h in heads if h[0]})
        self.loops = self._mask(i for i, h in enumerate(heads) if h[1])
        self.start = self._mask(i for i, h in enumerate(heads) if h[2])
        other = self._mask(i for i, h in enumerate(heads) if h[0] is None)
        self.table = np.stack(
            [other] + [self._mask(i for i, h in enumerate(heads) if h[0] is None or h[0] == c) for c in self.chars]
        )
        self.codes = np.array([ord(c) for c in self.chars], np.uint32)

    def _mask(self, bits) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in bits:
            out[i // 64] |= np.uint64(1 << (i % 64))
        return out

    def matches(self, texts: list[str]) -> np.ndarray:
        """(texts x globs) booleans.  Memory follows the batch's total length."""
        n = len(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.searchsorted(self.codes, flat)
        place = np.minimum(place, max(0, len(self.codes) - 1))
        kind = np.where(self.codes[place] == flat, place + 1, 0) if len(self.codes) else np.zeros(len(flat), np.int64)
        first = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        first, lengths = first[order], lengths[order]
        state = np.tile(self.start, (n, 1))
        for t in range(int(lengths[0]) if n else 0):
            live = int(np.searchsorted(-lengths, -t, "left"))  # the texts longer than t come first
            s = state[:live]
            shifted = s << np.uint64(1)
            shifted[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:live] = (shifted & self.table[kind[first[:live] + t]]) | (s & self.loops)
        out = np.zeros((n, len(self.accept)), bool)
        for r, bit in enumerate(self.accept):
            out[order, r] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1) == 1
        return out


def judge_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = BASE_RULES,
    block: tuple[str, ...] = BLOCK_GLOBS,
    default: str = "allow",
    url: str = "url",
) -> DataFrame:
    """All rows of ``pages(page_id, url)`` as (page_id, host, path, rule, verdict)."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i))
    parts = [rules[i][1].partition("/") for i in order]
    hosts = [f"*.{host}" for host, _, _ in parts]
    paths = [f"{slash}{prefix}*" for _, slash, prefix in parts]
    made: dict[str, Automaton] = {}

    def run(batch: dict[str, list]) -> dict[str, object]:
        if not made:
            made.update(host=Automaton(hosts), path=Automaton(paths), block=Automaton(list(block)))
        fits = made["host"].matches([f".{h}" for h in batch["host"]]) & made["path"].matches(batch["path"])
        blocked = made["block"].matches([f".{h}{p}" for h, p in zip(batch["host"], batch["path"], strict=True)]).any(axis=1)
        rule, verdict = [], []
        for row, bad in zip(fits, blocked, strict=True):
            at = next((i for i in range(len(order)) if row[i]), None)
            if at is None:
                rule.append(None)
                verdict.append("block" if bad else default)
            else:
                rule.append(rules[order[at]][1])
                verdict.append(rules[order[at]][0])
        return {**{k: batch[k] for k in ("page_id", "host", "path")}, "rule": rule, "verdict": verdict}

    u = F.col(url).cast("string")
    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(
        pages.select("page_id", host_of(u).alias("host"), path_of(u).alias("path")),
        run,
        f"page_id {kind}, host string, path string, rule string, verdict string",
        rows=4096,
    )


def oracle(block: tuple[str, ...] = BLOCK_GLOBS) -> str:
    """The same judgement in DuckDB SQL."""
    fits = [
        (v, r, f"(h = '{r.split('/', 1)[0]}' OR ends_with(h, '.{r.split('/', 1)[0]}')) AND starts_with(p, '/{r.split('/', 1)[1]}')")
        for v, r in sorted(BASE_RULES, key=lambda x: -len(x[1]))
    ]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for _, r, c in fits)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for v, _, c in fits)
    like = " OR ".join(
        "'.' || h || p LIKE '" + g.replace("_", "\\_").replace("*", "%").replace("?", "_") + "' ESCAPE '\\'" for g in block
    )
    return f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT page_id,
  coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS h,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS p FROM r)
SELECT page_id, h AS host, p AS path, CASE {rule} END AS rule,
  CASE {verdict} WHEN {like} THEN 'block' ELSE 'allow' END AS verdict FROM u"""
