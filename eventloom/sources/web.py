"""Event records in pages and feeds: JSON-LD, RSS, class-marked HTML.

Fetching is outside the engine; these take text columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BARE_QUOTE, JSON_DESCRIPTION
from ..functions.html import unescape
from ..functions.text import blank, strip_tags_spaced

_DESCRIPTION, _QUOTE = re.compile(JSON_DESCRIPTION), re.compile(BARE_QUOTE)
EVENT_EXTRAS = ("Festival", "Hackathon", "CourseInstance", "EventSeries")


@F.pandas_udf(T.StringType())
def repair_json(s: pd.Series) -> pd.Series:
    """Escape bare quotes inside description values."""

    def mended(text: str) -> str:
        parts, at = [], 0
        for value in _DESCRIPTION.finditer(text):
            parts += [text[at : value.start(1)], _QUOTE.sub('\\\\"', value[1])]
            at = value.end(1)
        return "".join([*parts, text[at:]])

    return s.map(lambda x: None if x is None else mended(x))


def jsonld_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """One parsed ``block`` (variant) per JSON-LD script; broken ones are repaired or dropped."""
    raw = F.regexp_extract_all(F.col(html), F.lit(r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), F.lit(1))
    rows = pages.select(*[c for c in pages.columns if c != html], F.explode(raw).alias("raw"))
    good = rows.withColumn("block", F.try_parse_json("raw"))
    mended = good.filter("block is null").withColumn("block", F.try_parse_json(repair_json("raw")))
    return good.filter("block is not null").unionByName(mended.filter("block is not null")).drop("raw")


def _is_event(kind: Column) -> Column:
    return (kind == "Event") | F.endswith(kind, F.lit("Event")) | kind.isin(*EVENT_EXTRAS)


def jsonld_events(blocks: DataFrame) -> DataFrame:
    """(page_id, item): event objects at top level, in arrays, @graph, ``event`` (of any
    type) and list items."""
    text = blocks.select("page_id", F.to_json("block").alias("j"))
    items = lambda path: F.from_json(F.get_json_object("j", path), "array<string>")
    array = F.when(F.startswith("j", F.lit("[")), F.from_json("j", "array<string>")).otherwise(F.array(F.col("j")))
    typed = text.select("page_id", F.explode(F.array_union(array, F.coalesce(items("$['@graph']"), F.array().cast("array<string>")))).alias("item"))
    listed = text.select("page_id", F.explode(F.coalesce(items("$.itemListElement"), F.array().cast("array<string>"))).alias("li")).select(
        "page_id", F.get_json_object("li", "$.item").alias("item")
    )
    typed = typed.unionByName(listed).filter(_is_event(F.coalesce(F.get_json_object("item", "$['@type']"), F.lit(""))))
    nested = text.select("page_id", F.explode(F.coalesce(items("$.event"), F.array().cast("array<string>"))).alias("item"))
    return typed.unionByName(nested.filter(F.startswith("item", F.lit("{"))))


def jsonld_location(item: Column, default: str = "") -> Column:
    """``name, street, locality, region`` of what is there."""
    get = lambda p: F.nullif(F.get_json_object(item, p), F.lit(""))
    name, plain = get("$.location.name"), get("$.location.address")
    structured = F.nullif(F.concat_ws(", ", get("$.location.address.streetAddress"), get("$.location.address.addressLocality"), get("$.location.address.addressRegion")), F.lit(""))
    address = F.when(F.startswith(blank(plain), F.lit("{")), structured).otherwise(plain)
    return F.coalesce(F.nullif(F.concat_ws(", ", name, address), F.lit("")), F.lit(default))


def jsonld_records(events: DataFrame, now: Column | None = None, location_part: str | None = None) -> DataFrame:
    """Typed records; started events and other places can be left out."""
    get = lambda p: F.get_json_object("item", p)
    rows = events.select(
        "page_id", get("$.name").alias("title"), get("$.startDate").alias("start_text"), get("$.endDate").alias("end_text"),
        get("$.url").alias("url"), jsonld_location(F.col("item")).alias("location"), strip_tags_spaced(get("$.description")).alias("description"),
        F.coalesce(get("$.image.url"), get("$.image[0]"), get("$.image")).alias("image_url"),
    ).withColumn("start_time", F.try_to_timestamp("start_text"))
    rows = rows.filter("title <> '' and start_time is not null")
    if now is not None:
        rows = rows.filter(F.col("start_time") >= now)
    return rows.filter(F.contains(F.lower("location"), F.lit(location_part.lower()))) if location_part else rows


RSS_ITEM = "struct<title:string,link:string,description:string,pubDate:string,guid:string>"


def rss_items(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """(feed, title, link, description, published) of RSS items and Atom entries in a text column."""
    body = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))
    cdata = r"(?s)^<!\[CDATA\[(.*)\]\]>$"
    one = lambda n: F.trim(F.regexp_extract("x", rf"(?s)<{n}\b[^>]*>(.*?)</{n}>", 1))
    plain = lambda c: F.when(c.rlike(cdata), F.regexp_replace(c, cdata, "$1")).otherwise(unescape(c))  # noqa: E731  entities mean themselves in CDATA only
    tag = lambda *names: plain(F.coalesce(*[F.nullif(one(n), F.lit("")) for n in names]))
    rows = feeds.select("feed", F.explode(body).alias("x"))
    link = F.coalesce(tag("link"), unescape(F.nullif(F.regexp_extract("x", r'<link\b[^>]*href="([^"]*)"', 1), F.lit(""))))
    published = tag("pubDate", "published", "updated")
    at = F.coalesce(
        F.try_to_timestamp(published),
        F.try_to_timestamp(F.regexp_replace(published, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(F.regexp_replace(published, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z")),
    )
    return rows.select("feed", tag("title").alias("title"), link.alias("link"), tag("description", "summary").alias("description"), tag("guid", "id").alias("guid"), at.alias("published"))


#: CSS classes of event lists in HTML: the box, title, start, location.
HTML_CLASSES = {
    "ai1ec": ("ai1ec-event", "ai1ec-event-title", "ai1ec-event-time", "ai1ec-event-location"),
    "em_events": ("em-event", "em-item-title", "em-event-date", "em-event-location"),
    "seetickets": ("seetickets-list-event-container", "title", "date", "venue"),
    "sugar_calendar": ("sugar-calendar-event", "sugar-calendar-event-title", "sugar-calendar-event-date", "sugar-calendar-event-location"),
    "wild_apricot": ("boxOuterContainer", "boxHeaderTitle", "eventInfoStartDate", "eventInfoLocation"),
}


class _Boxes(HTMLParser):
    """Text by class inside each box."""

    def __init__(self, classes: tuple[str, ...]) -> None:
        super().__init__()
        self.classes, self.stack, self.found = classes, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        names = (dict(attrs).get("class") or "").split()
        if self.classes[0] in names:
            self.found.append({c: "" for c in self.classes[1:]})
        if tag not in ("br", "img", "input", "meta", "link", "hr"):
            self.stack.append((tag, next((c for c in self.classes[1:] if c in names), None)))

    def handle_endtag(self, tag: str) -> None:
        while self.stack and self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data: str) -> None:
        name = next((c for _, c in reversed(self.stack) if c), None)
        if name and self.found:
            self.found[-1][name] += data


def html_events(pages: DataFrame, kind: str, html: str = "html") -> DataFrame:
    """(source, title, start_text, location) of class-marked event boxes."""
    classes = HTML_CLASSES[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source, text in zip(pdf["source"], pdf["html"], strict=True):
                parser = _Boxes(classes)
                parser.feed(text or "")
                rows += [(source, *(" ".join(box[c].split()) for c in classes[1:])) for box in parser.found]
            yield pd.DataFrame(rows, columns=["source", "title", "start_text", "location"])

    found = pages.select("source", F.col(html).alias("html")).mapInPandas(run, "source string, title string, start_text string, location string")
    return found.filter("title <> ''")


def connector_calendar(events: DataFrame, now: Column, months: int = 6) -> DataFrame:
    """Scraped records as calendar rows: title and start required, inside the horizon, the
    end defaulting to the start."""
    rows = events.filter((blank(F.col("title")) != "") & F.col("start_time").isNotNull())
    rows = rows.filter(F.col("start_time").between(now, now + F.make_dt_interval(F.lit(31 * months))))
    return rows.withColumn("end_time", F.coalesce("end_time", "start_time"))
