"""Event lists in HTML pages by layout: a connector with a page layout of its own is a row of
``config.LAYOUTS``, not code.

A layout names the box of an event and, inside it, the places of its fields by descendant
selectors (tag, ``.class``, ``#id``, ``[attribute]`` and ``=``, ``^=``, ``*=`` of a value), of which
``@name`` takes an attribute instead of the text; ``&`` is the box itself, ``A + B`` joins the first
hits of both.  A page is read once: each selector is a run of bits, an open element carries the
steps reached above it, and a start tag moves all selectors of the layout on with one shift.  Tags
recur from page to page, so that one is parsed and tested when it is first met.

Everything after that, dates, times, links and defaults, is expressions over columns."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from datetime import date
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LAYOUTS
from ..functions.dates import _let, parse_date, parse_time
from ..functions.text import blank

FIELDS = ("title", "date", "time", "location", "url", "description")
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
RAW = ("script", "style")
#: Tags that are known in each layout, and the length up to which they are kept.
KNOWN_TAGS, KNOWN_LENGTH = 4096, 300
_PART = re.compile(r"""([.#]?)([\w-]+)|\[([\w:-]+)(?:([*^]?=)["']?([^\]"']*)["']?)?\]""")

#: Between ``<`` and ``>``: tags, declarations and comments that end at this ``>`` without doubt.
_START = re.compile(r"""([a-zA-Z][a-zA-Z0-9]*)(?:[ \t\n\r\f]+[a-zA-Z_:][\w:.-]*(?:=(?:"[^"]*"|'[^']*'|[\w.:#%-]+))?)*[ \t\n\r\f]*/?""", re.ASCII)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:="([^"]*)"|='([^']*)'|=([\w.:#%-]+))?""", re.ASCII)
_END = re.compile(r"/([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*", re.ASCII)
_NOTE = re.compile(r"!(?:(?i:doctype)(?: [^<\[]*)?|--(?!-)(?:(?!--).)*(?<!-)--)", re.ASCII | re.DOTALL)


def _step(text: str) -> list[tuple[str, str, str]]:
    """Tests of one element: (attribute, operator, value); the tag is the attribute ``""``."""
    tests = []
    for kind, name, attribute, sign, value in _PART.findall(text):
        if name:
            tests.append({"": ("", "=", name.lower()), ".": ("class", "~=", name), "#": ("id", "=", name)}[kind])
        else:
            tests.append((attribute.lower(), sign or "is", value))
    if not tests:
        raise ValueError(f"not a selector step: {text!r}")
    return tests


class Selectors:
    """The selectors of a layout as runs of bits; the first is the box."""

    def __init__(self, box: str, places: dict[str, str]) -> None:
        self.steps, self.first, self.ends, self.own = [], 0, [], []
        for name, place in [("", box), *((f"{f}:{n}", p.strip()) for f, ps in places.items() for n, p in enumerate(ps.split(" + ")))]:
            path, _, attribute = place.partition("@")
            if path.strip() == "&":
                self.own.append((name, attribute))
                continue
            self.first |= 1 << len(self.steps)
            self.steps += [_step(s) for s in path.split()]
            self.ends.append((1 << (len(self.steps) - 1), name, attribute))
        self.last = sum(end for end, _, _ in self.ends)
        self.known = lru_cache(KNOWN_TAGS)(self.tag)

    def tag(self, inner: str) -> tuple[str, dict[str, str] | None, int, str] | None:
        """What stands between ``<`` and ``>``: the tag, its attributes (none of an end tag, nor of a
        note, whose tag is empty), the steps that it fits and what it asks for next: its end (``/``) or
        a script's; None for what is to be parsed in its place."""
        start = _START.fullmatch(inner)
        if start:
            tag, attrs = start[1].lower(), _ATTRIBUTE.findall(inner, start.end(1))
            if "&" in inner:
                alone = _Tag()
                alone.feed(f"<{inner}>")
                held = alone.held
            else:
                held = {name.lower(): a or b or c for name, a, b, c in reversed(attrs)}
            after = "/" if inner[-1] == "/" else tag if tag in RAW else ""
            return None if after == "/" and tag in RAW else (tag, held, self.fitting(tag, held), after)
        end = _END.fullmatch(inner)
        if end:
            return end[1].lower(), None, 0, ""
        return ("", None, 0, "") if _NOTE.fullmatch(inner) else None

    def fitting(self, tag: str, attrs: dict[str, str]) -> int:
        """The steps whose tests an element passes."""
        classes = attrs.get("class", "").split()

        def passes(attribute: str, sign: str, value: str) -> bool:
            if not attribute:
                return tag == value
            if sign == "~=":
                return value in classes
            held = attrs.get(attribute)
            if held is None or sign == "is":
                return held is not None
            return held == value if sign == "=" else held.startswith(value) if sign == "^=" else value in held

        return sum(1 << i for i, tests in enumerate(self.steps) if passes(*tests[0]) and all(passes(*t) for t in tests[1:]))


def _held(attrs: list) -> dict[str, str]:
    """Attributes by name, the first of a name."""
    return {k: v or "" for k, v in reversed(attrs)}


class _Tag(HTMLParser):
    """A start tag alone."""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.held = _held(attrs)


class _Page(HTMLParser):
    """Boxes of a page: for each place the texts found there, in document order."""

    def __init__(self, selectors: Selectors) -> None:
        super().__init__()
        self.selectors, self.boxes = selectors, []
        self.stack: list[tuple[str, int, Sequence, bool]] = []  # tag, steps reached, texts that end with it, is a box
        self.inside: list[dict] = []  # open boxes
        self.texts: list[list[str]] = []  # open texts

    def handle_starttag(self, tag: str, attrs: list) -> None:
        held = _held(attrs)
        self.start(tag, held, self.selectors.fitting(tag, held))

    def start(self, tag: str, held: dict[str, str], fitting: int) -> None:
        above = self.stack[-1][1] if self.stack else 0
        here = fitting & (above << 1 | self.selectors.first)
        opened, is_box = [], False
        if here & self.selectors.last:
            outer = list(self.inside)
            for end, name, attribute in self.selectors.ends:
                if not here & end:
                    continue
                if not name:
                    is_box = True
                elif outer:
                    text = [held.get(attribute, "")] if attribute else []
                    if not attribute:
                        opened.append(text)
                    for box in outer:
                        box.setdefault(name, []).append(text)
        if is_box:
            box = {name: [[held.get(attribute, "")]] for name, attribute in self.selectors.own}
            self.boxes.append(box)
        if tag not in VOID:
            if is_box:
                self.inside.append(box)
            self.texts += opened
            self.stack.append((tag, above | here & ~self.selectors.last, opened, is_box))

    def handle_endtag(self, tag: str) -> None:
        if not self.stack or self.stack[-1][0] != tag and not any(t == tag for t, _, _, _ in reversed(self.stack)):
            return
        while True:
            name, _, opened, is_box = self.stack.pop()
            if opened:
                del self.texts[len(self.texts) - len(opened) :]
            if is_box:
                self.inside.pop()
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.texts and self.stack[-1][0] not in RAW:
            for text in self.texts:
                text.append(data)

    def read(self, html: str) -> bool:
        """Read a page by its known tags; false if some place of it is left to the parser."""
        selectors, stack, texts, raw = self.selectors, self.stack, self.texts, ""
        for piece in html.split("<")[1:]:
            inner, closed, text = piece.partition(">")
            if raw:  # a script's end is looked for
                if inner.lower() != "/" + raw:
                    if inner[:1] in ("/", "!"):
                        return False
                    continue
                raw = ""
            found = selectors.known(inner) if len(inner) <= KNOWN_LENGTH else selectors.tag(inner)
            if found is None or not closed:
                return False
            tag, held, fitting, after = found
            if held is not None:
                above = stack[-1][1] if stack else 0
                if fitting and fitting & (above << 1 | selectors.first):
                    self.start(tag, held, fitting)
                elif tag not in VOID:
                    stack.append((tag, above, (), False))
                if after == "/":
                    self.handle_endtag(tag)
                else:
                    raw = after
            elif stack and stack[-1][0] == tag and not stack[-1][3] and not stack[-1][2]:
                stack.pop()
            elif tag:
                self.handle_endtag(tag)
            if texts and text:
                self.handle_data(unescape(text))
        return not raw


def boxes(html: str, selectors: Selectors) -> list[dict[str, list[str]]]:
    """The filled texts of each box by field; of joined places the first hits."""
    page = _Page(selectors)
    if not page.read(html):
        page = _Page(selectors)
        page.feed(html)
        page.close()
    out = []
    for box in page.boxes:
        found: dict[str, list[list[str]]] = {}
        for name in sorted(box):
            texts = [t for t in (" ".join(" ".join(parts).split()) for parts in box[name]) if t]
            if texts:
                found.setdefault(name.partition(":")[0], []).append(texts)
        out.append({f: ts[0] if len(ts) == 1 else [" ".join(t[0] for t in ts)] for f, ts in found.items()})
    return out


def layout_boxes(pages: DataFrame, layouts: tuple = LAYOUTS) -> DataFrame:
    """(source, found) for each box of ``pages(source, html)``, in the layout of its source; ``found``
    has the texts of each field.  Pages without a layout and null pages have none."""
    places = {row[0]: (row[1], row[2]) for row in layouts}
    fields = list(dict.fromkeys((*FIELDS, *(f for _, fs in places.values() for f in fs))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {source: Selectors(*place) for source, place in places.items()}
        for batch in batches:
            rows = [
                (source, box)
                for source, html in zip(batch["source"].to_pylist(), batch["html"].to_pylist(), strict=True)
                if html is not None  # not a filter, for which a page would be made twice
                for box in boxes(html, ready[source])
            ]
            texts = [pa.array([box.get(f) for _, box in rows], pa.list_(pa.string())) for f in fields]
            found = pa.StructArray.from_arrays(texts, fields)
            yield pa.RecordBatch.from_arrays([pa.array([source for source, _ in rows], pa.string()), found], ["source", "found"])

    known = pages.select("source", "html").where(F.col("source").isin(*places))
    return known.mapInArrow(run, f"source string, found struct<{', '.join(f'`{f}`: array<string>' for f in fields)}>")


_HALVES = r"(?i)^\D*?(\d{1,2}(?::\d{2})?)\s*[-\x{2013}]\s*(\d{1,2}(?::\d{2})?)\s*([ap])\.?\s?m"
_DAYS = r"^([A-Za-z]+)\.?\s+(\d{1,2})\s*[-\x{2013}]\s*(?:([A-Za-z]+)\.?\s+)?(\d{1,2}),?\s+(\d{4})"


def _days(text: Column, today: date) -> tuple[Column, Column]:
    """First and last day: of ``June 5 - 21, 2026`` or ``June 30 - July 2, 2026``, else one date.  A
    date without a year is the next one that is not before ``today``."""
    part = lambda i: F.regexp_extract(text, _DAYS, i)
    several = text.rlike(_DAYS)
    named = lambda month, day: parse_date(F.concat(month, F.lit(" "), day, F.lit(", "), part(5)))
    start = F.when(several, named(part(1), part(2))).otherwise(parse_date(text, since=today))
    return start, F.when(several, named(F.coalesce(F.nullif(part(3), F.lit("")), part(1)), part(4)))


def _clocks(texts: Column) -> tuple[Column, Column]:
    """Start and end of a field with both or of two fields; ``7-9pm`` means the evening twice."""
    first, second = F.get(texts, F.lit(0)), F.get(texts, F.lit(1))
    half = lambda i: parse_time(F.concat(F.regexp_extract(first, _HALVES, i), F.regexp_extract(first, _HALVES, 3), F.lit("m")))
    parts = F.split(first, r"\s*(?:[-\x{2013}]|\bto\b)\s*", 2)
    both = first.rlike(_HALVES)
    # a text of one part is not tried again
    either = lambda parts: F.coalesce(parse_time(F.get(parts, F.lit(0))), F.when(F.size(parts) > 1, parse_time(first)))
    start = F.when(both, half(1)).otherwise(_let(parts, either))
    return start, F.when(both, half(2)).otherwise(parse_time(F.coalesce(second, F.get(parts, F.lit(1)))))


def layout_events(pages: DataFrame, today: date, layouts: tuple = LAYOUTS) -> DataFrame:
    """(source, title, start_time, end_time, location, url, description) of ``pages(source, html)``.

    Events need a title and a date.  Times are instants, read in the layout's zone; without a time an
    event starts at the layout's hour, and one that ends before it starts ends the next day.  A time
    may also stand in the field of the date.  A location that is missing is the layout's; links are
    completed by its site."""
    settings = [(row[0], *row[3:]) for row in layouts]
    table = pages.sparkSession.createDataFrame(settings, "source string, site string, zone string, hour string, default_location string")
    rows = layout_boxes(pages, layouts).join(F.broadcast(table), "source")  # one row a layout
    once = lambda c: F.explode(F.array(c))  # noqa: E731  # a column computed once, though read several times or filtered by
    first = lambda f: F.get(F.col("found")[f], F.lit(0))
    rows = rows.withColumn("title", first("title")).where("title is not null").withColumn("said", first("date"))
    iso = F.col("said").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    start_day, end_day = _days(F.when(iso, F.substring("said", 1, 10)).otherwise(F.col("said")), today)
    rows = rows.select("*", once(start_day).alias("start_day")).where("start_day is not null")
    within = F.when(iso, F.array(F.substring("said", 12, 5))).otherwise(F.array("said"))
    times = F.when(F.size(F.coalesce(F.col("found")["time"], F.array().cast("array<string>"))) > 0, F.col("found")["time"]).otherwise(within)
    start, end = _clocks(F.col("times"))
    rows = rows.withColumn("times", times).withColumn("end_day", end_day).withColumn("start_clock", start).withColumn("end_clock", end)
    at = lambda day, clock: F.try_to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), clock), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    began = at(F.col("start_day"), F.coalesce("start_clock", "hour"))
    ended = F.when(F.col("end_clock").isNotNull() | F.col("end_day").isNotNull(), at(F.coalesce("end_day", "start_day"), F.coalesce("end_clock", "start_clock", "hour")))
    ended = F.when(ended < began, ended + F.expr("INTERVAL 1 DAY")).otherwise(ended)
    instant = lambda c: F.to_utc_timestamp(c.cast("timestamp"), F.col("zone")).cast("timestamp_ntz")
    link, site = first("url"), F.regexp_replace("site", r"/+$", "")
    whole = F.when(link.rlike("^https?:"), link).when(F.startswith(link, F.lit("//")), F.concat(F.lit("https:"), link)).otherwise(F.concat(site, F.lit("/"), F.regexp_replace(link, "^/+", "")))
    return rows.select(
        "source", "title", instant(began).alias("start_time"), instant(ended).alias("end_time"),
        F.coalesce(first("location"), "default_location").alias("location"), F.coalesce(whole, "site").alias("url"), blank(first("description")).alias("description"),
    )
