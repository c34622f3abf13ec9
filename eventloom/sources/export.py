"""Sinks: ICS, JSON, RSS, JSON-LD, calendar links, feed lists and report documents.

Exports are rows of text made by expressions; writers keep them partitioned by city.
Only a single calendar file, which must be one file, is coalesced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SCHEMA_TYPES
from ..functions.text import blank, ics_escape, rss_guid, source_list


def ics_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def _optional(label: str, value: Column) -> Column:
    return F.when(blank(value) != "", F.concat(F.lit(label), value))


PRODUCER = "eventloom"


def event_ics(now: Column, domain: str = PRODUCER) -> Column:
    """One event as a VEVENT block, CRLF-joined; optional properties only if filled.
    ``domain`` ends the uid."""
    rule = F.when(F.startswith(F.col("rrule"), F.lit("RRULE:")), F.col("rrule")).otherwise(F.concat(F.lit("RRULE:"), F.col("rrule")))
    return F.concat_ws(
        "\r\n",
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:event-"), F.col("id").cast("string"), F.lit(f"@{domain}")),
        F.concat(F.lit("DTSTAMP:"), ics_stamp(now)),
        F.concat(F.lit("DTSTART:"), ics_stamp(F.col("start_time"))),
        F.when(F.col("end_time").isNotNull(), F.concat(F.lit("DTEND:"), ics_stamp(F.col("end_time")))),
        F.when(blank(F.col("rrule")) != "", rule),
        F.concat(F.lit("SUMMARY:"), ics_escape(F.col("title"))),
        _optional("LOCATION:", ics_escape(F.col("location"))),
        _optional("DESCRIPTION:", ics_escape(F.col("description"))),
        _optional("URL:", F.col("url")),
        F.lit("END:VEVENT"),
    )


def calendar_lines(events: DataFrame, name: str, content: str = "content", order: tuple[str, ...] = ("dtstart", "pos"), producer: str = PRODUCER) -> DataFrame:
    """(part, line): header, one row for each event's block, footer, in file order."""
    head = ["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:-//{producer}//Combined Feed//EN", "CALSCALE:GREGORIAN",
            "METHOD:PUBLISH", f"X-WR-CALNAME:{name}", "REFRESH-INTERVAL;VALUE=DURATION:PT1H", "X-PUBLISHED-TTL:PT1H"]
    ends = events.sparkSession.createDataFrame([(0, "\r\n".join(head)), (2, "END:VCALENDAR")], "part int, line string")
    block = F.concat(F.lit("BEGIN:VEVENT\r\n"), F.col(content), F.lit("\r\nEND:VEVENT"))
    body = events.select(F.lit(1).alias("part"), block.alias("line"), *order)
    return body.unionByName(ends, allowMissingColumns=True).orderBy("part", *order).select("part", "line")


def write_calendar(events: DataFrame, name: str, path: str) -> None:
    calendar_lines(events, name).coalesce(1).select("line").write.option("lineSep", "\r\n").text(path)


def write_events_json(events: DataFrame, path: str) -> None:
    events.write.partitionBy("city").json(path)


def place_json(location: Column) -> Column:
    """schema.org Place: name before the first comma, address after it."""
    name = F.trim(F.substring_index(location, ",", 1))
    rest = F.trim(F.regexp_extract(location, r"^[^,]*,(.*)$", 1))
    address = F.when(rest != "", F.struct(F.lit("PostalAddress").alias("@type"), rest.alias("streetAddress")))
    return F.when(blank(location) != "", F.struct(F.lit("Place").alias("@type"), name.alias("name"), address.alias("address")))


def jsonld(end_differs: bool = True) -> Column:
    """An event as a schema.org JSON-LD object; missing parts are left out."""
    kinds = F.create_map(*[F.lit(x) for kv in SCHEMA_TYPES.items() for x in kv])
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.to_json(F.struct(
        F.coalesce(F.try_element_at(kinds, blank(F.col("category"))), F.lit("Event")).alias("@type"),
        F.col("title").alias("name"), F.col("start_time").cast("string").alias("startDate"), F.col("url"),
        F.when(F.col("end_time") != F.col("start_time"), F.col("end_time").cast("string")).alias("endDate"),
        filled("description").alias("description"), place_json(F.col("location")).alias("location"),
        filled("image_url").alias("image"), F.lit("https://schema.org/OfflineEventAttendanceMode").alias("eventAttendanceMode"),
    ))


def xml_escape(c: Column) -> Column:
    s = F.replace(blank(c), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(s, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def rss_rows(events: DataFrame, now: Column, link: str, cap: int = 300, days: int = 90) -> DataFrame:
    """(guid, start_time, item): upcoming events from 12 hours ago as RSS items."""
    lo, hi = now - F.expr("INTERVAL 12 HOURS"), now + F.make_dt_interval(F.lit(days))
    rows = events.filter(F.col("start_time").between(lo, hi))
    guid = rss_guid(F.col("source_uid"), F.col("title"), F.col("start_time").cast("string"))
    item = F.concat(
        F.lit("<item><title>"), xml_escape(F.col("title")), F.lit("</title><link>"),
        xml_escape(F.coalesce(F.nullif(F.col("url"), F.lit("")), F.lit(link))), F.lit("</link><description>"),
        xml_escape(F.substring(blank(F.col("description")), 1, cap)), F.lit('</description><guid isPermaLink="false">'), guid,
        F.lit("</guid><pubDate>"), F.date_format("start_time", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item>"),
    )
    return rows.select(guid.alias("guid"), "start_time", item.alias("item"))


def google_calendar_url() -> Column:
    at = ics_stamp(F.col("start_time"))
    end = F.coalesce(ics_stamp(F.col("end_time")), at)
    enc = lambda c: F.url_encode(blank(c))
    return F.concat(
        F.lit("https://calendar.google.com/calendar/render?action=TEMPLATE&text="), enc(F.col("title")), F.lit("&dates="), F.url_encode(F.concat(at, F.lit("/"), end)),
        F.lit("&location="), enc(F.col("location")), F.lit("&details="), enc(F.col("description")),
    )


def etag(body: Column) -> Column:
    """The first 8 bytes of SHA-256, in hex."""
    return F.substring(F.sha2(body, 256), 1, 16)


def feed_list(feeds: DataFrame) -> DataFrame:
    """(city, place, line): name comments and URLs of active feeds, by name."""
    rows = feeds.filter("status = 'active'").select("city", "name", "url")
    return rows.select("city", "name", "url", F.posexplode(F.array(F.concat(F.lit("# "), F.col("name")), F.col("url"))).alias("place", "line")).orderBy("city", "name", "url", "place").select("city", "line")


def report_documents(parts: dict[str, DataFrame]) -> DataFrame:
    """(city, report): one JSON document per city, an array for each part (rows with ``city``)."""
    out = None
    for name, df in parts.items():
        cols = [c for c in df.columns if c != "city"]
        one = df.groupBy("city").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        out = one if out is None else out.join(one, "city", "full_outer")
    return out.select("city", F.to_json(F.struct(*parts)).alias("report"))


def sources_of(events: DataFrame) -> DataFrame:
    return events.select("id", F.explode(source_list(F.col("source"))).alias("source"))


def user_calendars(picked: DataFrame, now: Column) -> DataFrame:
    """(user_id, ics, etag): one calendar for each user's picks, in order of start."""
    one = F.struct("start_time", "event_id", event_ics(now).alias("block"))
    rows = picked.withColumn("id", F.col("event_id")).groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("blocks"))
    body = F.array_join(F.transform("blocks", lambda b: b["block"]), "\r\n")
    made = rows.select("user_id", F.concat(F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0\r\n"), body, F.lit("\r\nEND:VCALENDAR")).alias("ics"))
    return made.withColumn("etag", etag(F.col("ics")))


def markdown_rows(df: DataFrame) -> DataFrame:
    """(part, line): a Markdown table, its header and separator as parts 0 and 1, and a line
    for each row as part 2."""
    line = lambda cells: f"| {' | '.join(cells)} |"
    head = df.sparkSession.createDataFrame([(0, line(df.columns)), (1, line(["---"] * len(df.columns)))], "part int, line string")
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in df.columns]
    return head.unionByName(df.select(F.lit(2).alias("part"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")))
