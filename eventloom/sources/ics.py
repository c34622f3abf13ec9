"""iCalendar text to typed rows: extraction, fields, images, combine and convert stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.geo import in_area
from ..functions.text import blank, categories_list, ics_unescape, title_case
from ..functions.urls import is_stale


def read_files(spark: SparkSession, path: str, skip: tuple[str, ...] = ("combined",), pattern: str = "*.ics") -> DataFrame:
    """(file, stem, content) of calendar files; bytes that are not UTF-8 are dropped."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    rows = raw.select(name.alias("file"), F.regexp_replace(name, r"\.ics$", "").alias("stem"), text.alias("content"))
    return rows.filter(~F.col("stem").isin(*skip)) if skip else rows


def unfold(content: Column) -> Column:
    return F.regexp_replace(content, r"\r?\n[ \t]", "")


def vevents(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per VEVENT block: ``pos`` in its file, and ``vevent`` text."""
    blocks = F.regexp_extract_all(F.col(content), F.lit(r"(?s)BEGIN:VEVENT\r?\n(.*?)\r?\nEND:VEVENT"), F.lit(1))
    return files.select("*", F.posexplode(blocks).alias("pos", "vevent")).drop(content)


def raw_field(vevent: Column, name: str) -> Column:
    return F.regexp_extract(vevent, rf"(?im)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1)


def field(vevent: Column, name: str, newline: str = "\n") -> Column:
    """A property's unescaped value; null if missing."""
    found = vevent.rlike(rf"(?im)^{name}(?:;[^:\r\n]*)?:")
    return F.when(found, ics_unescape(raw_field(vevent, name), newline))


def date_params(vevent: Column, name: str) -> Column:
    return F.regexp_extract(vevent, rf"(?im)^{name}((?:;[^:\r\n]*)?):", 1)


def tzid(vevent: Column, name: str) -> Column:
    return F.regexp_extract(date_params(vevent, name), r"TZID=([^:;]+)", 1)


def date_list(vevent: Column, name: str) -> Column:
    """All raw values of a property that can have several (EXDATE, RDATE), of all its lines;
    of a period its beginning."""
    lines = F.regexp_extract_all(vevent, F.lit(rf"(?im)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)"), F.lit(1))
    values = F.flatten(F.transform(lines, lambda line: F.split(line, ",")))
    return F.filter(F.transform(values, lambda v: F.trim(F.split(v, "/")[0])), lambda v: v != "")


def with_recurrence(rows: DataFrame, zone: Column) -> DataFrame:
    """Adds what ``recurrence.expand_events`` takes, as wall clocks in the event's ``zone``:
    ``start_time``, ``exdates``, ``rdates``, ``recurrence_id``.  Values with a Z are converted;
    malformed ones drop out; a date without a time has the time of the start."""
    start = dates.local_clock(F.col("dtstart_raw"), zone)
    of_day = F.substring("dtstart_raw", 9, 8)
    clock = lambda v: dates.local_clock(F.when(v.rlike(r"^\d{8}$"), F.concat(v, of_day)).otherwise(v), zone)
    known = lambda c: F.filter(F.transform(c, clock), lambda t: t.isNotNull())
    return rows.withColumns({"start_time": start, "exdates": known(F.col("exdates_raw")), "rdates": known(F.col("rdates_raw")), "recurrence_id": clock(F.col("recurrence_id_raw"))})


def image_url(vevent: Column) -> Column:
    """The first of six vendor forms."""
    get = lambda p: F.nullif(F.trim(F.regexp_extract(vevent, "(?im)" + p, 1)), F.lit(""))
    whale = F.regexp_replace(F.replace(get(r"^X-LIVEWHALE-IMAGE:([^\r\n]+)"), F.lit("\\,"), F.lit(",")), r"/width/\d+/height/\d+/", "/width/400/height/300/")
    shown = [get(rf"^IMAGE;[^:\r\n]*DISPLAY={d}[^:\r\n]*:(https?://[^\r\n]+)") for d in ("fullsize", "badge", "thumbnail")]
    press = get(r"^X-WP-IMAGES-URL:([^\r\n]+)")
    sized = [F.nullif(F.regexp_extract(press, rf"(?i)(?:^|,){s}\\;(https?://[^\\,]+)", 1), F.lit("")) for s in ("large", "full", "medium")]
    return F.coalesce(
        get(r"^ATTACH;[^:\r\n]*FMTTYPE=image/[^:\r\n]*:([^\r\n]+)"), get(r"^X-TKF-FEATURED-IMAGE:([^\r\n]+)"), whale,
        *shown, get(r"^IMAGE;[^:\r\n]*:(https?://[^\r\n]+)"), *sized,
        F.concat(F.lit("https://calendar.duke.edu"), get(r"^X-BEDEWORK-IMAGE:(/public/Images/[^\r\n]+)")),
    )


def repair_dates(content: Column) -> Column:
    """``YYYYMMDDZ`` is a date, not a time."""
    return F.regexp_replace(content, r"(?m)^((?:DTSTART|DTEND)[^:\r\n]*:\d{8})Z(\r?)$", "$1$2")


def parse(files: DataFrame) -> DataFrame:
    """Blocks with their raw and typed fields (unfolded)."""
    rows = vevents(files.withColumn("content", unfold(repair_dates(F.col("content")))))
    v = F.col("vevent")
    return rows.select(
        "*",
        field(v, "SUMMARY").alias("title"), field(v, "LOCATION").alias("location"), field(v, "DESCRIPTION").alias("description"),
        field(v, "URL").alias("url"), F.nullif(F.trim(F.regexp_extract(v, r"UID:([^\r\n]+)", 1)), F.lit("")).alias("uid"),
        F.nullif(raw_field(v, "RRULE"), F.lit("")).alias("rrule"), date_list(v, "EXDATE").alias("exdates_raw"), date_list(v, "RDATE").alias("rdates_raw"),
        F.nullif(F.trim(raw_field(v, "RECURRENCE-ID")), F.lit("")).alias("recurrence_id_raw"), raw_field(v, "DTSTART").alias("dtstart_raw"),
        raw_field(v, "DTEND").alias("dtend_raw"), tzid(v, "DTSTART").alias("tzid"), tzid(v, "DTEND").alias("end_tzid"),
        date_params(v, "DTSTART").alias("dtstart_params"), field(v, "X-SOURCE").alias("x_source"),
        categories_list(field(v, "CATEGORIES")).alias("ics_categories"), image_url(v).alias("image_url"),
    )


def name_sources(rows: DataFrame, names: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Source name and URL of each event: its own X-SOURCE, else the feed's name, else the
    file stem in title case; the fallback URL where the event has none.  ``names(stem, name)``
    and ``fallbacks(stem, fallback)`` are registries, joined by stem."""
    out = rows.join(names, "stem", "left").join(fallbacks, "stem", "left")
    plain = title_case(F.replace("stem", F.lit("_"), F.lit(" ")))
    return out.withColumn("source", F.coalesce("x_source", "name", plain)).withColumn(
        "url", F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("fallback"))
    ).drop("name", "fallback")


def combine(rows: DataFrame, now: Column, year: int, month: int, allowed: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> DataFrame:
    """The build's filters: 24 h by wall clock read as UTC, stale URLs, area (only with an
    allow list); then order by start and the first of each uid."""
    from ..operators.dedup import first_by_uid

    kept = rows.withColumn("dtstart", dates.wall_clock(F.col("dtstart_raw"))).filter("dtstart is not null")
    kept = kept.filter(F.col("dtstart") >= now - F.expr("INTERVAL 24 HOURS"))
    kept = kept.filter(~is_stale(blank(F.col("url")), year, month))
    if allowed:
        kept = kept.filter(in_area(F.col("location"), allowed, excluded))
    order = [F.col("dtstart"), F.col("file"), F.col("pos")]
    return first_by_uid(kept, order, "uid").orderBy(*order)


def convert(rows: DataFrame, city_zone: Column, now: Column) -> DataFrame:
    """The JSON stage: instants by TZID or city zone, ISO text with offset, all-day flag,
    24 h by true instant, title and start required."""
    zoned = dates.with_event_zone(rows, "tzid", city_zone, "zone")
    zoned = dates.with_event_zone(zoned, "end_tzid", F.col("zone"), "end_zone")
    at = dates.instant(F.col("dtstart_raw"), F.col("zone"))
    end = dates.instant(F.col("dtend_raw"), F.col("end_zone"))
    out = zoned.withColumn("start_at", at).withColumn("end_at", end)
    out = out.withColumn("start_time", dates.iso_local(F.col("start_at"), F.col("zone"))).withColumn("end_time", dates.iso_local(F.col("end_at"), F.col("end_zone")))
    out = out.withColumn("all_day", dates.is_all_day(F.col("dtstart_raw"), F.col("dtstart_params")))
    return out.filter((blank(F.col("title")) != "") & F.col("start_at").isNotNull() & (F.col("start_at") >= now - F.expr("INTERVAL 24 HOURS"))).orderBy("start_time", "file", "pos")
