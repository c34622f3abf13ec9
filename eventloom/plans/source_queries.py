"""Registered queries of sources and sinks: texts in a source's form are made from the
driver's tables, and read back by the source's functions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONNECTORS, LAYOUTS
from ..functions import text
from ..scratch import new_folder
from ..sources import apis, export, ics, layouts, registries, web
from .adapter import calendar, feeds
from .queries import NOW, _now, _table, query

_EARLY = "TIMESTAMP_NTZ '2000-01-01 00:00:00'"


def _put(label: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(label), value))


def _files(rows: DataFrame, *lines: Column) -> DataFrame:
    """One calendar file for each row."""
    block = F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR"), F.lit("BEGIN:VEVENT"), _put("UID:", F.col("id").cast("string")), *lines, F.lit("END:VEVENT"), F.lit("END:VCALENDAR"))
    return rows.select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.concat(F.lit("my_"), F.col("source_id")).alias("stem"), block.alias("content"))


def _id(c: str = "uid") -> Column:
    return F.col(c).cast("bigint").alias("id")


_stamp = lambda form="yyyyMMdd'T'HHmmss": F.date_format("start_time", form)
_kind = lambda n: F.col("id") % n


@query("SELECT id, trim(title) AS title, strftime(start_time, '%Y%m%dT%H%M%S') AS dtstart_raw FROM cal")
def s1_read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar files written by city, and read whole."""
    path = new_folder(spark, "calendars")
    block = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), _put("UID:", F.col("id").cast("string")), _put("SUMMARY:", F.col("title")), _put("DTSTART:", _stamp()), F.lit("END:VEVENT"))
    calendar(spark, sf_dir).select("city", block.alias("value")).write.option("lineSep", "\r\n").partitionBy("city").text(path)
    return ics.parse(ics.read_files(spark, path, pattern="*.txt")).select(_id(), "title", "dtstart_raw")


@query(
    "SELECT id, CASE id % 4 WHEN 0 THEN strftime(start_time, '%Y-%m-%dT%H:%M:%S') || '-05:00' WHEN 1 THEN strftime(start_time - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '-08:00' WHEN 2 THEN strftime(start_time, '%Y-%m-%dT%H:%M:%S') || '-08:00' "
    "ELSE strftime(start_time, '%Y-%m-%dT00:00:00') || '-08:00' END AS start_time, id % 4 = 3 AS all_day FROM cal WHERE trim(title) <> ''"
)
def s5_event_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The convert stage (S19): the event's zone, UTC, an unknown zone, and a date alone."""
    start = F.when(_kind(4) == 0, F.concat(F.lit("DTSTART;TZID=America/New_York:"), _stamp())).when(_kind(4) == 1, F.concat(F.lit("DTSTART:"), _stamp(), F.lit("Z"))).when(
        _kind(4) == 2, F.concat(F.lit("DTSTART;TZID=No/Such:"), _stamp())
    ).otherwise(F.concat(F.lit("DTSTART;VALUE=DATE:"), _stamp("yyyyMMdd")))
    rows = ics.parse(_files(calendar(spark, sf_dir), start, _put("SUMMARY:", F.col("title"))))
    return ics.convert(rows, F.lit("America/Los_Angeles"), F.expr(_EARLY).cast("timestamp")).select(_id(), "start_time", "all_day")


@query(
    "SELECT id, CASE id % 8 WHEN 0 THEN 'https://i/a' || id WHEN 1 THEN 'https://i/k' || id WHEN 2 THEN 'https://i/width/400/height/300/' || id || ',x' WHEN 3 THEN 'https://i/b' || id WHEN 4 THEN 'https://i/p' || id "
    "WHEN 5 THEN 'https://i/l' || id WHEN 6 THEN 'https://calendar.duke.edu/public/Images/' || id END AS image_url FROM cal"
)
def s6_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id").cast("string")
    say = lambda before, after="": F.concat(F.lit(before), n, F.lit(after))
    forms = (
        say("ATTACH;FMTTYPE=image/png:https://i/a"), say("X-TKF-FEATURED-IMAGE:https://i/k"), say("X-LIVEWHALE-IMAGE:https://i/width/80/height/60/", "\\,x"),
        F.concat(say("IMAGE;VALUE=URI;DISPLAY=THUMBNAIL:https://i/t"), F.lit("\r\n"), say("IMAGE;VALUE=URI;DISPLAY=BADGE:https://i/b")), say("IMAGE;VALUE=URI:https://i/p"),
        say("X-WP-IMAGES-URL:thumbnail\\;https://i/t,large\\;https://i/l"), say("X-BEDEWORK-IMAGE:/public/Images/"), F.lit("X-OTHER:none"),
    )
    line = F.element_at(F.array(*forms), (_kind(8) + 1).cast("int"))
    return ics.parse(_files(calendar(spark, sf_dir), line)).select(_id(), "image_url")


@query("SELECT id, strftime(start_time, '%Y%m%d') AS dtstart_raw, CASE WHEN id % 2 = 0 THEN strftime(start_time, '%Y%m%d') ELSE strftime(start_time, '%Y%m%dT%H%M%SZ') END AS dtend_raw FROM cal")
def s7_repaired_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(_kind(2) == 0, _stamp("yyyyMMdd'Z'")).otherwise(_stamp("yyyyMMdd'T'HHmmss'Z'"))
    return ics.parse(_files(calendar(spark, sf_dir), _put("DTSTART;VALUE=DATE:", _stamp("yyyyMMdd'Z'")), _put("DTEND:", end))).select(_id(), "dtstart_raw", "dtend_raw")


@query(
    "SELECT id, CASE WHEN id % 3 = 0 THEN 'X ' || city WHEN source_id = 'feed1' THEN 'The First' ELSE 'My Feed' || substr(source_id, 5) END AS source, coalesce(nullif(url, ''), CASE WHEN source_id = 'feed2' THEN 'https://two/' END) AS url FROM cal"
)
def s8_source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X-SOURCE, a registry, or the file's stem in title case; and the fallback link."""
    said = F.when(_kind(3) == 0, F.concat(F.lit("X "), F.col("city")))
    rows = ics.parse(_files(calendar(spark, sf_dir), _put("X-SOURCE:", said), _put("URL:", F.col("url"))))
    names = spark.createDataFrame([("my_feed1", "The First")], "stem string, name string")
    links = spark.createDataFrame([("my_feed2", "https://two/")], "stem string, fallback string")
    return ics.name_sources(rows, names, links).select(_id(), "source", "url")


@query(
    ", r AS (SELECT id, strftime(start_time, '%Y%m%dT%H%M%SZ') AS raw, start_time AS dtstart, url, source_uid AS uid FROM cal WHERE id % 2 = 0 AND title IS NOT NULL "
    f"AND start_time >= {NOW} - INTERVAL 24 HOUR AND NOT coalesce(CAST(nullif(regexp_extract(url, '/(\\d{{4}})/(\\d{{2}})/', 1), '') AS INT) * 12 + CAST(nullif(regexp_extract(url, '/(\\d{{4}})/(\\d{{2}})/', 2), '') AS INT) < 2024 * 12 + 1, false)) "
    "SELECT id, uid, dtstart FROM r QUALIFY uid IS NULL OR row_number() OVER (PARTITION BY uid ORDER BY dtstart, 'f' || id) = 1"
)
def s18_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calendar(spark, sf_dir).filter("id % 2 = 0")
    block = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), _put("UID:", F.col("source_uid")), _put("DTSTART:", _stamp("yyyyMMdd'T'HHmmss'Z'")), _put("URL:", F.col("url")), F.lit("END:VEVENT"))
    files = rows.select("id", F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), F.lit("s").alias("stem"), block.alias("content"))
    return ics.combine(ics.parse(files), _now(), 2024, 1).select("id", "uid", "dtstart")


_OBJECT = "concat('{\"@type\":\"', kind, '\",\"name\":\"', title, '\",\"startDate\":\"', date_format(start_time, \"yyyy-MM-dd'T'HH:mm:ss\"), '\",\"url\":\"u', id, '\",\"location\":{\"name\":\"Hall\",\"address\":{\"streetAddress\":\"', id, ' Elm\",\"addressLocality\":\"Davis\"}},\"description\":\"', told, '\"}')"


@query(
    "SELECT id AS page_id, title, start_time, 'u' || id AS url, 'Hall, ' || id || ' Elm, Davis' AS location, CASE WHEN id % 5 = 0 THEN 'say \"hi\" now' ELSE 'by the river' END AS description FROM cal WHERE title <> ''"
)
def s9_jsonld_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-LD objects alone, in arrays, graphs, list items and schools; a fifth of them broken (S9-S11)."""
    rows = calendar(spark, sf_dir).withColumn("kind", F.when(_kind(5) == 4, "Thing").when(_kind(2) == 0, "Event").otherwise("MusicEvent"))
    rows = rows.withColumn("told", F.when(_kind(5) == 0, 'say "hi" now').otherwise("<i>by</i> the   river")).withColumn("o", F.expr(_OBJECT))
    put = lambda before, after: F.concat(F.lit(before), F.col("o"), F.lit(after))
    shape = F.element_at(F.array(F.col("o"), put("[", "]"), put('{"@graph":[', "]}"), put('{"itemListElement":[{"item":', "}]}"), put('{"@type":"School","event":[', "]}")), (_kind(5) + 1).cast("int"))
    pages = rows.select(F.col("id").alias("page_id"), F.concat(F.lit('<html><script type="application/ld+json">'), shape, F.lit("</script></html>")).alias("html"))
    made = web.jsonld_records(web.jsonld_events(web.jsonld_blocks(pages)))
    return made.select("page_id", "title", F.col("start_time").cast("timestamp_ntz").alias("start_time"), "url", "location", "description")


@query(
    "SELECT CAST(id AS VARCHAR) AS feed, trim(title) || ' & <b>' AS title, CASE WHEN id % 2 = 0 THEN coalesce(nullif(url, ''), 'https://x/?a=1&b=2') ELSE 'https://y/?a&b=' || id END AS link, CASE WHEN id % 2 = 0 THEN nullif(trim(coalesce(description, '')), '') ELSE '&amp; kept' END AS description, start_time AS published FROM cal"
)
def s12_rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS items with entities, and Atom entries with CDATA."""
    rows = calendar(spark, sf_dir).withColumn("title", F.concat(F.trim("title"), F.lit(" & <b>")))
    link = F.coalesce(F.nullif("url", F.lit("")), F.lit("https://x/?a=1&b=2"))
    rss = F.concat(
        F.lit("<rss><channel><item><title>"), export.xml_escape(F.col("title")), F.lit("</title><link>"), export.xml_escape(link), F.lit("</link><description>"), export.xml_escape(F.col("description")),
        F.lit("</description><pubDate>"), F.date_format("start_time", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate></item></channel></rss>"),
    )
    atom = F.concat(
        F.lit("<feed><entry><title><![CDATA["), F.col("title"), F.lit(']]></title><link rel="alternate" href="https://y/?a&amp;b='), F.col("id").cast("string"), F.lit('"/><summary><![CDATA[&amp; kept]]></summary><updated>'),
        F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry></feed>"),
    )
    made = web.rss_items(rows.select(F.col("id").cast("string").alias("feed"), F.when(_kind(2) == 0, rss).otherwise(atom).alias("xml")))
    return made.select("feed", "title", "link", "description", F.col("published").cast("timestamp_ntz").alias("published"))


@query(
    ", d AS (SELECT id, start_time + i * INTERVAL 1 DAY AS t, i FROM cal, range(20) r(i)) "
    f"SELECT CAST(id AS VARCHAR) AS source, t AS start_time, 'Hall' AS location FROM d WHERE isodow(t) IN (2, 4) AND t >= {NOW} - INTERVAL 1 DAY AND t <= {NOW} + INTERVAL 30 DAY AND CAST(t AS DATE) <> DATE '2024-01-16'"
)
def s13_widget_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly widget events, tried on 20 days, less a skipped one (S13, U20)."""
    event = F.concat(
        F.lit('{"name":"N","start":{"date":"'), _stamp("yyyy-MM-dd"), F.lit('","time":"'), _stamp("HH:mm"),
        F.lit('"},"location":["7"],"repeatPeriod":"weeklyOn","repeatFrequency":"weekly","repeatWeeklyOnDays":["tu","th"],"exceptions":[{"type":"skip","originalDate":1705363200000}]}'),
    )
    body = F.concat(F.lit('{"data":{"settings":{"locations":[{"id":"7","name":"Hall"}],"eventTypes":[],"events":['), event, F.lit("]}}}"))
    widgets = calendar(spark, sf_dir).select(F.col("id").cast("string").alias("source"), body.alias("body"))
    return apis.elfsight_events(widgets, _now(), months=1, limit=20).select("source", "start_time", "location")


def _bodies(rows: DataFrame) -> dict[str, Column]:
    """A page of each API with one record."""
    c, lit, n = F.col, F.lit, F.col("id").cast("string")
    obj = lambda **fields: F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    sub = lambda **fields: F.struct(*[v.alias(k) for k, v in fields.items()])
    page = lambda before, one, after="]}": F.concat(lit(before), one, lit(after))
    iso = _stamp("yyyy-MM-dd'T'HH:mm:ss")
    return {
        "tribe": page('{"events":[', obj(title=c("title"), start_date=_stamp("yyyy-MM-dd HH:mm:ss"), venue=sub(venue=c("location"), city=lit("Davis")), url=c("url"), id=n)),
        "cityspark": page('{"Value":[', obj(Name=c("title"), StartUTC=F.concat(iso, lit("Z")), Venue=c("location"), Links=F.array(sub(url=c("url"))), Id=n)),
        "ckan": page('{"result":{"records":[', obj(title=c("title"), start=iso, location=c("location"), url=c("url")), "]}}"),
        "godaddy": page('{"events":[', obj(title=c("title"), start=F.concat(iso, lit("-05:00")), location=c("location"), desc=lit("<p>a &amp; b</p>"))),
        "escribe": page('{"d":[', obj(MeetingName=c("title"), StartDate=_stamp("yyyy/MM/dd HH:mm:ss"), Description=c("location"), Location=lit("Room"), Url=F.concat(lit("Meeting.aspx?Id="), n), ID=n)),
        "bookmanager": page('{"rows":[', obj(title=c("title"), date=_stamp("yyyyMMdd"), start_time=_stamp("HH:mm:ss"), location_text=c("location"), id=n)),
        "squarespace": page('{"items":[', obj(title=c("title"), startDate=F.unix_millis(F.col("start_time").cast("timestamp")), location=sub(addressTitle=c("location"), addressLine1=lit("L1")), fullUrl=F.concat(lit("/e/"), n))),
        "social_pinpoint": page('{"result":[', obj(event_title=F.concat(lit("A &amp; "), F.trim("title")), event_start_date=_stamp("yyyy-MM-dd HH:mm:ss"), event_venue=c("location"), event_type=lit("Online"), event_full=c("url"), event_id=n)),
        "bibliocommons": page('{"entities":{"locations":{"b1":{"name":"Main"},"b2":{"name":"Main"}},"events":{"e1":{"definition":', obj(title=c("title"), start=iso, branchLocationId=lit("b1"), nonBranchLocationId=lit("b2"), locationDetails=c("location")), "}}}}"),
    }


_API = "list_extract(['tribe', 'cityspark', 'ckan', 'godaddy', 'escribe', 'bookmanager', 'squarespace', 'social_pinpoint', 'bibliocommons'], CAST(id % 9 + 1 AS INTEGER))"


@query(
    f", a AS (SELECT *, {_API} AS api, nullif(trim(coalesce(location, '')), '') AS place, nullif(url, '') AS link FROM cal) "
    "SELECT CAST(id AS VARCHAR) AS source, api, CASE api WHEN 'social_pinpoint' THEN 'A & ' || trim(title) WHEN 'escribe' THEN trim(title) WHEN 'bookmanager' THEN trim(title) WHEN 'godaddy' THEN trim(title) WHEN 'bibliocommons' THEN trim(title) ELSE title END AS title, "
    "CASE WHEN api IN ('cityspark', 'squarespace') THEN start_time ELSE start_time + INTERVAL 5 HOUR END AS start_time, "
    "CASE api WHEN 'tribe' THEN coalesce(place || ', ', '') || 'Davis' WHEN 'squarespace' THEN coalesce(place || ', ', '') || 'L1' WHEN 'escribe' THEN coalesce(place, 'Room') WHEN 'social_pinpoint' THEN coalesce(place, 'Online') "
    "WHEN 'bibliocommons' THEN 'Main' || coalesce(', ' || place, '') ELSE coalesce(place, CASE WHEN api IN ('cityspark', 'bookmanager') THEN '' ELSE 'Somewhere' END) END AS location, "
    "CASE api WHEN 'tribe' THEN url WHEN 'ckan' THEN url WHEN 'cityspark' THEN coalesce(link, 'https://s.org/') WHEN 'escribe' THEN 'https://s.org/Meeting.aspx?Id=' || id WHEN 'bookmanager' THEN 'https://s.org/events' WHEN 'squarespace' THEN 'https://s.org/e/' || id "
    "WHEN 'social_pinpoint' THEN coalesce(link, 'https://s.org/') WHEN 'bibliocommons' THEN 'https://s.bibliocommons.com/v2/events/e1' END AS url, "
    "CASE api WHEN 'tribe' THEN 'tribe-' || id || '@s.org' WHEN 'cityspark' THEN CAST(id AS VARCHAR) WHEN 'escribe' THEN id || '@s.org' WHEN 'bookmanager' THEN 'bm-' || id || '@s.org' WHEN 'social_pinpoint' THEN id || '@s.org' WHEN 'bibliocommons' THEN 'e1@s.org' END AS uid FROM a"
)
def s14_api_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine JSON APIs, an event each by its id; with library places looked up (S14, J17)."""
    rows, out = calendar(spark, sf_dir), None
    for i, (api, body) in enumerate(_bodies(rows).items()):
        pages = rows.filter(_kind(9) == i).select(
            F.col("id").cast("string").alias("source"), body.alias("body"), F.lit("s.org").alias("domain"), F.lit("America/New_York").alias("zone"), F.lit("Somewhere").alias("default_location"), F.lit("https://s.org/").alias("site")
        )
        made = apis.api_events(pages, api).withColumn("api", F.lit(api))
        out = made if out is None else out.unionByName(made)
    return out.select("source", "api", "title", F.col("start_time").cast("timestamp_ntz").alias("start_time"), "location", "url", "uid")


_TRIBE = [c for c in CONNECTORS if c[1] == "tribe"]


@query(
    ", c AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c[0]}', '{c[2]}', 5, '{c[4]}')" for i, c in enumerate(_TRIBE)) + ") v(n, source, domain, hours, place)) "
    f"SELECT c.source, cal.title, start_time + to_hours(CAST(hours AS INTEGER)) AS start_time, coalesce(nullif(trim(coalesce(location, '')), ''), place) AS location, 'tribe-' || id || '@' || domain AS uid FROM cal JOIN c ON c.n = cal.id % {len(_TRIBE)}"
)
def s16_connector_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of configured connectors, with their domain, zone and default location."""
    names = F.array(*[F.lit(c[0]) for c in _TRIBE])
    one = F.to_json(F.struct("title", _stamp("yyyy-MM-dd HH:mm:ss").alias("start_date"), F.struct(F.col("location").alias("venue")).alias("venue"), F.col("id").cast("string").alias("id")))
    pages = calendar(spark, sf_dir).select(F.element_at(names, (_kind(len(_TRIBE)) + 1).cast("int")).alias("source"), F.concat(F.lit('{"events":['), one, F.lit("]}")).alias("body"))
    made = apis.api_events(pages.join(apis.connectors(spark), "source"), "tribe")
    return made.select("source", "title", F.col("start_time").cast("timestamp_ntz").alias("start_time"), "location", "uid")


@query("SELECT CAST(id AS VARCHAR) AS source, trim(title) || ' (' || id || ')' AS title, strftime(start_time, '%Y-%m-%d') || ' at ' || strftime(start_time, '%H:%M') AS start_text, coalesce(trim(location), '') AS location FROM cal")
def s15_html_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five kinds of class-marked event lists, an event each by its id."""
    rows, out = calendar(spark, sf_dir), None
    for i, (kind, (box, title, start, place)) in enumerate(web.HTML_CLASSES.items()):
        page = F.concat(
            F.lit(f'<div class="x {box}"><img src="a"><h3 class="{title}"><a>'), F.col("title"), F.lit("</a>("), F.col("id").cast("string"), F.lit(f')</h3><p class="{start} y">'), _stamp("yyyy-MM-dd"), F.lit(" <b>at</b>\n "), _stamp("HH:mm"),
            F.lit(f'</p><span class="{place}">'), F.coalesce("location", F.lit("")), F.lit("</span></div>"),
        )
        made = web.html_events(rows.filter(_kind(5) == i).select(F.col("id").cast("string").alias("source"), page.alias("html")), kind)
        out = made if out is None else out.unionByName(made)
    return out


def _element(step: str, attribute: str = "", value: Column | None = None) -> tuple[Column, Column]:
    """The tags of an element that a selector step fits, with an attribute of a given value."""
    tests = [t for t in layouts._step(step) if not attribute or t[0] != attribute]
    tag = next((v for a, _, v in tests if not a), "div")
    classes = " ".join(v for a, sign, v in tests if sign == "~=")
    held = f' class="a {classes}"' if classes else ""
    held += "".join(f' {a}="{v}z"' if sign == "^=" else f' {a}="z{v}"' if sign == "*=" else f' {a}="{v}"' for a, sign, v in tests if a and sign != "~=")
    ends = F.concat(F.lit(f' {attribute}="'), value, F.lit('">')) if attribute else F.lit(">")
    return F.concat(F.lit(f"<{tag}{held}"), ends), F.lit(f"</{tag}>")


def _placed(place: str, value: Column) -> Column:
    """A value at a place, below elements that its selector fits."""
    path, _, attribute = place.partition("@")
    tags = [_element(step) for step in path.split()[:-1]]
    tags.append(_element(path.split()[-1], attribute, value))
    return F.concat(*[a for a, _ in tags], F.lit("" if attribute else " <br>"), F.lit("") if attribute else value, *[b for _, b in reversed(tags)])


def _page(places: dict[str, str], box: str, values: dict[str, Column]) -> Column:
    """A page with an event's box between others' rests."""
    joined = {"date": (_stamp("MMM"), _stamp("d"), F.lit(""))}
    own = next(((p[2:], values[f]) for f, p in places.items() if p.startswith("&@")), ("", None))
    outer, inner = box.split()[:-1], _element(box.split()[-1], *own)
    parts = []
    for field, place in places.items():
        several = place.split(" + ")
        if not place.startswith("&"):
            parts += [_placed(p, v) for p, v in zip(several, joined[field] if len(several) > 1 else (values[field],), strict=False)]
    tags = [_element(step) for step in outer]
    return F.concat(F.lit("<html><h3>Events</h3>"), *[a for a, _ in tags], inner[0], *parts, inner[1], *[b for _, b in reversed(tags)], F.lit("<p class='date title time'>none</p></html>"))


_LAYOUT_SQL = ", ".join(
    f"({i}, '{source}', '{site.rstrip('/')}', {8 if zone.endswith('Angeles') else 5}, '{default}', {'time' in places or '@' in places['date'] or source.startswith('Toronto')}, {int(hour[:2])}, {'location' in places}, {'url' in places}, {' + ' in places['date']}, '{site}')"
    for i, (source, _, places, site, zone, hour, default) in enumerate(LAYOUTS)
)


@query(
    f", c AS (SELECT * FROM (VALUES {_LAYOUT_SQL}) v(n, source, base, hours, place, timed, hour, placed, linked, yearless, site)), "
    f"e AS (SELECT cal.id, cal.title, nullif(trim(coalesce(cal.location, '')), '') AS location, cal.start_time, c.* EXCLUDE (n) FROM cal JOIN c ON c.n = cal.id % {len(LAYOUTS)}), "
    "d AS (SELECT *, CASE WHEN yearless THEN CASE WHEN make_date(2024, month(start_time), day(start_time)) < DATE '2024-01-10' THEN make_date(2025, month(start_time), day(start_time)) ELSE make_date(2024, month(start_time), day(start_time)) END ELSE CAST(start_time AS DATE) END AS day FROM e) "
    "SELECT source, trim(title) AS title, day + CASE WHEN timed THEN to_minutes(CAST(hour(start_time) * 60 + minute(start_time) AS BIGINT)) ELSE to_hours(hour) END + to_hours(hours) AS start_time, "
    "CASE WHEN placed THEN coalesce(location, place) ELSE place END AS location, CASE WHEN linked THEN base || '/e/' || id ELSE site END AS url FROM d"
)
def s15_layout_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectors with page layouts of their own, an event each by its id."""
    day = _stamp("MMMM d, yyyy")
    clock = _stamp("h:mm a")
    page = None
    for i, (source, box, places, *_) in enumerate(LAYOUTS):
        when = _stamp("yyyy-MM-dd'T'HH:mm:ss") if "@" in places["date"] else F.concat(day, F.lit(" "), clock) if source.startswith("Toronto") else day
        values = {"title": F.col("title"), "date": when, "time": clock, "location": F.coalesce("location", F.lit("")), "url": F.concat(F.lit("/e/"), F.col("id").cast("string")), "description": F.lit("About it")}
        made = _page(places, box, values)
        page = F.when(_kind(len(LAYOUTS)) == i, made) if page is None else page.when(_kind(len(LAYOUTS)) == i, made)
    names = F.array(*[F.lit(row[0]) for row in LAYOUTS])
    pages = calendar(spark, sf_dir).select(F.get(names, _kind(len(LAYOUTS)).cast("int")).alias("source"), page.alias("html"))
    made = layouts.layout_events(pages, date(2024, 1, 10))
    return made.select("source", "title", "start_time", "location", "url")


@query("SELECT city AS file, lower(name) AS name, id % 3 = 0 AS excluded FROM feeds WHERE id % 4 <> 1")
def s20_area_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(_kind(4) == 1, "# only a note").otherwise(F.concat(F.when(_kind(3) == 0, F.element_at(F.array(F.lit("!"), F.lit("- ")), (_kind(2) + 1).cast("int"))).otherwise(""), F.upper("name"), F.lit("  # note")))
    rows = feeds(spark, sf_dir).select(F.col("city").alias("file"), F.col("id").alias("line_no"), line.alias("line"))
    return registries.area_registry(rows)


@query(
    ", l AS (SELECT city AS file, id * 4 + 1 AS line_no, city, 'scrape' AS phase, 'run ' || id AS command, CASE id % 3 WHEN 0 THEN 'error' ELSE 'warning' END AS level, CASE id % 3 WHEN 0 THEN 'http_error' ELSE 'parse_warning' END AS kind, "
    "CASE id % 3 WHEN 0 THEN 'HTTP Error 404' ELSE 'Broken property in ' || id END AS message FROM feeds WHERE id % 3 < 2) "
    "SELECT * FROM l UNION ALL SELECT city, id * 4 + 2, city, 'scrape', 'run ' || id, 'error', 'error', '[' || city || '][scrape] EXIT 1 run ' || id FROM feeds WHERE id % 2 = 1"
)
def s21_build_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.concat(F.lit("["), F.col("city"), F.lit("][scrape] "))
    run, n = F.concat(F.lit("run "), F.col("id").cast("string")), F.col("id").cast("string")
    said = F.when(_kind(3) == 0, "2024-01-10 - x - ERROR - HTTP Error 404").when(_kind(3) == 1, F.concat(F.lit("2024-01-10 - x - WARNING - Broken property in "), n)).otherwise("all is well")
    lines = F.array(F.concat(mark, F.lit("RUN "), run), said, F.concat(mark, F.lit("EXIT "), _kind(2).cast("string"), F.lit(" "), run))
    rows = feeds(spark, sf_dir).select(F.col("city").alias("file"), "id", F.posexplode(lines).alias("at", "line"))
    return registries.build_issues(rows.select("file", (F.col("id") * 4 + F.col("at")).alias("line_no"), "line")).drop("source")


@query(
    ", l AS (SELECT id, id * 10 AS base, city, 'run ' || id AS run FROM feeds) "
    "SELECT 'all' AS file, base + 1 AS line_no, city, 'scrape' AS phase, run AS command, run AS source, 'error' AS level, 'traceback' AS kind, 'ValueError: ' || id AS message FROM l WHERE id % 2 = 0 "
    "UNION ALL SELECT 'all', base + 7, city, 'scrape', run || ' by late_' || id || '.py', 'late_' || id, 'error', 'traceback', 'KeyError: no date' FROM l "
    "UNION ALL SELECT 'all', base + 6, city, 'scrape', run || ' by late_' || id || '.py', 'late_' || id, 'error', 'timeout', 'Read Timeout' FROM l"
)
def s21_tracebacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log of all feeds' lines: tracebacks inside commands and after them, a timeout below a script's name."""
    n, mark = F.col("id").cast("string"), F.concat(F.lit("["), F.col("city"), F.lit("][scrape] "))
    head, frame = F.lit("Traceback (most recent call last):"), lambda s: F.concat(F.lit('  File "/w/'), s, F.lit('.py", line 3'))
    late = F.concat(F.lit("late_"), n)
    lines = F.array(
        F.concat(mark, F.lit("RUN run "), n), F.when(_kind(2) == 0, head).otherwise("all is well"), F.when(_kind(2) == 0, frame(F.lit("a"))).otherwise(""),
        F.when(_kind(2) == 0, F.lit("    raise ValueError: inside")).otherwise("  well"), F.when(_kind(2) == 0, F.concat(F.lit("ValueError: "), n)).otherwise("done"),
        F.concat(mark, F.lit("EXIT 0 run "), n, F.lit(" by late_"), n, F.lit(".py")), F.lit("  Read Timeout"), head, frame(late), F.lit("KeyError: no date"),
    )
    rows = feeds(spark, sf_dir).select("id", F.posexplode(lines).alias("at", "line"))
    return registries.build_issues(rows.select(F.lit("all").alias("file"), (F.col("id") * 10 + F.col("at")).alias("line_no"), "line"))


@query("SELECT city AS file, url, name FROM feeds WHERE url LIKE 'https://%'")
def s22_feed_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feeds(spark, sf_dir).select("city", "id", F.posexplode(F.array(F.concat(F.lit("# "), F.col("name"), F.lit(" ")), F.concat(F.lit(" "), F.col("url")))).alias("at", "line"))
    return registries.feed_registry(rows.select(F.col("city").alias("file"), (F.col("id") * 2 + F.col("at")).alias("line_no"), "line"))


@query(
    ", e AS (SELECT chr(13) || chr(10) AS e) SELECT 0 AS part, 'BEGIN:VCALENDAR' || e || 'VERSION:2.0' || e || 'PRODID:-//eventloom//Combined Feed//EN' || e || 'CALSCALE:GREGORIAN' || e || 'METHOD:PUBLISH' || e || 'X-WR-CALNAME:All' || e || 'REFRESH-INTERVAL;VALUE=DURATION:PT1H' || e || 'X-PUBLISHED-TTL:PT1H' AS line FROM e "
    "UNION ALL SELECT 1, 'BEGIN:VEVENT' || e || 'UID:' || id || e || 'SUMMARY:' || title || e || 'END:VEVENT' FROM cal, e UNION ALL SELECT 2, 'END:VCALENDAR'"
)
def k1_calendar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("UID:"), F.col("id").cast("string"), F.lit("\r\nSUMMARY:"), F.col("title"))
    rows = calendar(spark, sf_dir).select(content.alias("content"), F.col("start_time").alias("dtstart"), F.col("id").alias("pos"))
    return export.calendar_lines(rows, "All")


@query("SELECT id, title, start_time, location, description, url, city, source, category, all_day FROM cal")
def k2_events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON, a folder a city, and read again."""
    rows = calendar(spark, sf_dir).select("id", "title", "start_time", "location", "description", "url", "city", "source", "category", "all_day")
    path = new_folder(spark, "events-json")
    export.write_events_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query(
    "SELECT o_orderkey AS id, o_orderstatus, c.id AS event_id, c.title AS event_title FROM orders LEFT JOIN cal c ON c.id = o_orderkey WHERE (o_orderstatus LIKE 'F%' OR o_custkey < 20) AND o_orderkey NOT IN (1, 2)"
)
def s23_rest_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table read with a related row embedded, alternatives and a pattern."""
    params = {"select": "id,o_orderstatus,event(id,title)", "or": "(o_orderstatus.like.F*,o_custkey.lt.20)", "id": "not.in.(1,2)"}
    rows = _table(spark, sf_dir, "orders").withColumn("id", F.col("o_orderkey"))
    got = registries.rest_filter(rows, params, {"event": (calendar(spark, sf_dir), "id", "id")})
    return got.select("id", "o_orderstatus", F.col("event.id").alias("event_id"), F.col("event.title").alias("event_title"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 20 THEN left(text, 20) || '...' ELSE text END AS short FROM conversations")
def u3_short_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.truncate(F.col("text"), 20).alias("short"))
