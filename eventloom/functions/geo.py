"""Geography: the location decision list, and distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import REGIONS, STREETS, VIRTUAL

_ADDRESS = (
    rf", (?:{'|'.join(REGIONS)})\b",
    r"\b\d{5}\b",
    r"[A-Z]\d[A-Z]\s?\d[A-Z]\d",
    rf", [A-Z][a-z]+ (?:{'|'.join(REGIONS)})\b",
    rf"(?i)\d+\s+\w+\s+(?:{'|'.join(STREETS)})\b",
)


def has_address(location: Column) -> Column:
    found = F.lit(False)
    for pattern in _ADDRESS:
        found = found | location.rlike(pattern)
    return found


def _any_in(text: Column, names: Column | tuple[str, ...]) -> Column:
    listed = names if isinstance(names, Column) else F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return F.exists(listed, lambda n: F.contains(text, n))


def in_area(location: Column, allowed: Column | tuple[str, ...], excluded: Column | tuple[str, ...] = ()) -> Column:
    """The decision list: no allow list, no location, virtual: in; an excluded name: out;
    nothing like an address: in; an allowed name: in; else out."""
    text = F.lower(location)
    none = F.size(allowed) == 0 if isinstance(allowed, Column) else F.lit(not allowed)
    return (
        F.when(none | (F.coalesce(location, F.lit("")) == ""), True)
        .when(_any_in(text, VIRTUAL), True)
        .when(_any_in(text, excluded), False)
        .when(~has_address(location), True)
        .otherwise(_any_in(text, allowed))
    )


def has_keyword(text: Column, words: tuple[str, ...]) -> Column:
    """One of the words occurs on word boundaries, in any case."""
    if not words:
        return F.lit(False)
    escaped = "|".join("".join(c if c.isalnum() or c == " " else "\\" + c for c in w) for w in words)
    return F.coalesce(text.rlike(rf"(?i)\b(?:{escaped})\b"), F.lit(False))


def keyword_filter(text: Column, location: Column, deny: tuple[str, ...], allow: tuple[str, ...]) -> Column:
    """Denied words drop a row; with an allow list the location must hold one, or be empty."""
    ok = F.lit(True) if not allow else (F.coalesce(location, F.lit("")) == "") | has_keyword(location, allow)
    return ~has_keyword(text, deny) & ok


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance with an earth radius of 3956 miles."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * 3956.0 * F.asin(F.sqrt(a))
