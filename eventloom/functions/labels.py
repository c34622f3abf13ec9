"""Ordered decision lists over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import (
    CATEGORIES,
    COMMAND_CLASSES,
    LOG_CLASSES,
    ORDINALS,
    OWN_PRODIDS,
    PLATFORMS,
    RECURRENCE_WORDS,
    WEEKDAY,
)
from .text import blank


def _first(text: Column, classes: tuple[tuple[str, tuple[str, ...]], ...], otherwise: Column) -> Column:
    out = None
    for name, marks in classes:
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(text, F.lit(m))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def log_issue(message: Column, level: Column) -> Column:
    return _first(F.lower(blank(message)), LOG_CLASSES, F.when(level == "warning", "warning").otherwise("error"))


def command_failure(stderr: Column, stdout: Column) -> Column:
    text = F.lower(F.concat(blank(stdout), F.lit("\n"), blank(stderr)))
    return _first(text, COMMAND_CLASSES, F.lit("command_failed"))


def content_kind(content: Column) -> Column:
    """html, json, empty or unknown, by the first 512 characters."""
    head = F.lower(F.ltrim(F.regexp_replace(F.substring(blank(content), 1, 512), r"^\s+", "")))
    html = F.startswith(head, F.lit("<!doctype")) | F.contains(head, F.lit("<html"))
    json = F.startswith(head, F.lit("{")) | F.startswith(head, F.lit("["))
    return F.when(head == "", "empty").when(html, "html").when(json, "json").otherwise("unknown")


def feed_content(content: Column) -> Column:
    """``quiet`` for a calendar, else ``not_ics:`` and what it is."""
    return F.when(F.contains(blank(content), F.lit("BEGIN:VCALENDAR")), "quiet").otherwise(
        F.concat(F.lit("not_ics:"), content_kind(content))
    )


def platform(prodid: Column, own: tuple[str, ...] = OWN_PRODIDS) -> Column:
    """The platform that wrote a calendar; ``skip`` for patterns of one's own; else ``unknown``."""
    out = None
    for pattern, name in PLATFORMS:
        out = F.when(prodid.rlike(pattern), name) if out is None else out.when(prodid.rlike(pattern), name)
    for pattern in own:
        out = out.when(prodid.rlike(pattern), "skip")
    return out.otherwise("unknown")


def category_label(answer: Column) -> Column:
    """The category that a model's answer names: exactly, else the first contained in it."""
    a = F.trim(answer)
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    inside = F.filter(names, lambda c: F.contains(F.lower(a), F.lower(c)))
    return F.when(F.array_contains(names, a), a).otherwise(F.get(inside, F.lit(0)))


def recurrence_in_text(*texts: Column) -> Column:
    """The recurrence rule that the first of some texts states in words.

    RECURRENCE_WORDS is tried in order; a weekly rule without a day takes the first
    weekday named in that text, else in any of the texts.  Null if no text states one."""
    lower = [F.lower(blank(t)) for t in texts]
    days = [F.nullif(F.regexp_extract(t, rf"\b({WEEKDAY})s?\b", 1), F.lit("")) for t in lower]
    code = lambda day: F.upper(F.substring(day, 1, 2))
    found = []
    for at, t in enumerate(lower):
        rule = None
        for pattern, frequency, ordinal, day in RECURRENCE_WORDS:
            said = F.lit(f"FREQ={frequency}")
            if day:
                number = F.regexp_extract(t, pattern, ordinal) if ordinal else F.lit("")
                number = F.coalesce(F.try_element_at(_map(ORDINALS), number), F.regexp_replace(number, "^0+(?=.)", ""))
                said = F.concat(said, F.lit(";BYDAY="), number, code(F.regexp_extract(t, pattern, day)))
            elif frequency == "WEEKLY":
                named = code(F.coalesce(days[at], *days))
                said = F.concat_ws(";BYDAY=", said, named)
            rule = F.when(t.rlike(pattern), said) if rule is None else rule.when(t.rlike(pattern), said)
        found.append(rule)
    return F.coalesce(*found)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
