"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and rearranged.

One Arrow-batched pandas UDF does a document's work: the regex library's ``finditer``
walks the units (code points, unless another unit pattern is given) and their end offsets
go to a compact array; two lookups in it slice the text; hashlib gives the seeds of the
document and the digest of the output.  A match takes up to RUN units at once and reports
the end of each, which halves the time and leaves the units as they are, since units are
matched from left to right either way.

The seeds are the first four 8-digit groups of the SHA-256 of ``1:`` and the id.  The
prefix ends after the smaller of two of them modulo (units + 1), the middle after the
larger.  A text that is empty, contains a mark, or falls to the plain share stays as it is.

The output is taken apart again by expressions alone (``restored``): as no plain text
holds a mark, and a mark has ``<`` at its start only, each mark occurs once.

Edge cases: a null text counts as empty, so its form is plain and its output the empty
text.  A null id has the seed of ``1:`` alone; ids that are not integers are hashed as
their text.  Repeated rows give the same result each.  Characters that the unit pattern
does not match belong to the unit after them, at the end to the suffix.  An empty table
gives an empty result.  All columns are kept; one named as the result is replaced.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = r"(?s:.)"
#: Of a hundred documents, those that may be rearranged, and of these those with the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
RUN = 256
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


@lru_cache
def _units(unit: str) -> regex.Pattern:
    return regex.compile(f"({unit}){{1,{RUN}}}+")


def unit_ends(text: str, unit: str = CODE_POINT) -> array:
    """End offsets of the units of a text, from left to right."""
    ends = array("I")
    for match in _units(unit).finditer(text):
        ends.extend(match.ends(1))
    return ends


def seeds(doc_id: str) -> list[int]:
    """Four 32-bit numbers of an id."""
    digest = hashlib.sha256(f"1:{doc_id}".encode("utf-8", "surrogatepass")).digest()
    return [int.from_bytes(digest[at : at + 4], "big") for at in (0, 4, 8, 12)]


def rearrange(doc_id: str, text: str, unit: str, rearranged: int, suffix_first: int) -> tuple:
    """The values of RESULT for one document."""
    ends = unit_ends(text, unit)
    n = len(ends)
    one, two, three, four = seeds(doc_id)
    if not text or three % 100 >= rearranged or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        form, prefix, middle, output = "plain", None, None, text
    else:
        cut, stop = (ends[k - 1] if k else 0 for k in sorted((one % (n + 1), two % (n + 1))))
        head, hole, tail = text[:cut], text[cut:stop], text[stop:]
        prefix, middle = len(head), len(hole)
        if four % 100 < suffix_first:
            form, output = "spm", f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{hole}"
        else:
            form, output = "psm", f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{hole}"
    return n, form, prefix, middle, output, hashlib.sha256(output.encode("utf-8", "surrogatepass")).hexdigest()


def transform(
    docs: DataFrame,
    unit: str = CODE_POINT,
    rearranged: int = REARRANGED,
    suffix_first: int = SUFFIX_FIRST,
    out: str = "fim",
) -> DataFrame:
    """``docs`` with the struct column ``out``: number of units, form, code points of prefix
    and middle (null if plain), the rearranged text and its SHA-256."""

    @F.pandas_udf(RESULT)
    def rearrange_batch(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        made = [rearrange(i, t, unit, rearranged, suffix_first) for i, t in zip(ids, texts)]
        got = pd.DataFrame(made, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
        return got.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    empty = F.lit("")
    made = rearrange_batch(F.coalesce(F.col("doc_id").cast("string"), empty), F.coalesce(text_of(docs), empty))
    kept = [docs[c] for c in docs.columns if c.lower() != out.lower()]
    return docs.select(*kept, made.alias(out))


def restored(fim: Column) -> Column:
    """The original text, from the output and the form alone."""
    part = F.split(fim["output"], f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(fim["form"] == "psm", F.concat(part[1], part[3], part[2]))
        .when(fim["form"] == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(fim["output"])
    )


def digest(transformed: DataFrame, fim: str = "fim") -> DataFrame:
    """Counts and digests of a transformed table, without its texts."""
    made = F.col(fim)
    return transformed.select(
        "doc_id", made["n"].alias("n"), made["form"].alias("form"), made["prefix_chars"].alias("prefix_chars"),
        made["middle_chars"].alias("middle_chars"), made["output_sha256"].alias("output_sha256"),
        F.sha2(restored(made).cast("binary"), 256).alias("restored_sha256"),
    )


def oracle() -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
  CAST('0x' || s[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || s[25:32] AS BIGINT) % 100 AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 >= {REARRANGED} THEN 'plain'
    WHEN h4 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS x, substring(t, a + 1, b - a) AS y, substring(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || x || '{SUFFIX}' || z || '{MIDDLE}' || y WHEN 'spm' THEN '{SUFFIX}' || z || '{PREFIX}' || x || '{MIDDLE}' || y
    ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
