"""Event records of JSON event APIs and calendar widgets, and the connectors that differ
only in configuration.  Fetching is outside the engine: responses are rows
(source, body), with the columns of a connector where they matter: ``domain`` for uids,
``zone`` of local times, ``default_location``, ``site`` for relative links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONNECTORS
from ..functions.html import unescape
from ..functions.text import blank

DEFAULTS = {"domain": "", "zone": "UTC", "default_location": "", "site": ""}


def connectors(spark: SparkSession) -> DataFrame:
    """The configured connectors, a table of fixed size."""
    return spark.createDataFrame(list(CONNECTORS), "source string, kind string, domain string, zone string, default_location string, site string")


def _get(path: str) -> Column:
    return F.get_json_object("o", f"$.{path}")


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _joined(*parts: Column, by: str = ", ") -> Column:
    return F.nullif(F.concat_ws(by, *map(_filled, parts)), F.lit(""))


def _place(*parts: Column) -> Column:
    return F.coalesce(_joined(*parts), F.col("default_location"))


def _local(c: Column, form: str) -> Column:
    """The instant of local time text in the connector's zone."""
    return F.to_utc_timestamp(F.try_to_timestamp(c, F.lit(form)), F.col("zone"))


def _iso(c: Column) -> Column:
    """The instant of ISO text; local in the connector's zone if it has no offset."""
    at = F.try_to_timestamp(c)
    return F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), at).otherwise(F.to_utc_timestamp(at, F.col("zone")))


def _bare(c: Column, by: str = " ") -> Column:
    """Without tags and doubled blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(blank(c), r"<[^>]+>", by), r"\s+", " "))


def _link(c: Column) -> Column:
    """A link that is relative to the connector's site."""
    site = F.regexp_replace(F.col("site"), r"/+$", "")
    return F.when(c.rlike(r"^https?:"), c).when(blank(c) != "", F.concat(site, F.lit("/"), F.regexp_replace(c, r"^/+", "")))


def _uid(lead: str, path: str) -> Column:
    return F.concat(F.lit(lead), _filled(_get(path)), F.lit("@"), F.col("domain"))


def _tribe() -> dict[str, Column]:
    start = lambda p: F.to_utc_timestamp(F.try_to_timestamp(F.substring(_get(p), 1, 19)), F.col("zone"))
    return {
        "title": _get("title"), "start_time": start("start_date"), "end_time": start("end_date"),
        "location": _place(_get("venue.venue"), _get("venue.address"), _get("venue.city"), _get("venue.state")),
        "description": F.substring(unescape(F.trim(F.regexp_replace(F.regexp_replace(blank(_get("description")), r"\s*<[^>]+>\s*", ""), r"\s+", " "))), 1, 500),
        "url": _get("url"), "uid": _uid("tribe-", "id"),
    }


def _cityspark() -> dict[str, Column]:
    slug = F.regexp_replace(F.regexp_replace(F.lower(blank(_get("Name"))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    day, pid = F.substring(blank(_get("DateStart")), 1, 13), blank(_get("PId"))
    detail = F.when((slug != "") & (pid != "") & (day != ""), F.concat(F.col("site"), F.lit("#/details/"), slug, F.lit("/"), pid, F.lit("/"), day)).otherwise(F.col("site"))
    return {
        "title": F.coalesce(_get("Name"), F.lit("Untitled Event")), "start_time": _iso(_get("StartUTC")), "end_time": F.coalesce(_iso(_get("EndUTC")), _iso(_get("StartUTC"))), "location": blank(_get("Venue")),
        "description": blank(_get("Description")), "url": F.coalesce(_filled(_get("Links[0].url")), detail), "uid": F.coalesce(_filled(_get("Id")), _get("PId")),
    }


def _ckan() -> dict[str, Column]:
    return {
        "title": _get("title"), "start_time": _iso(_get("start")), "end_time": _iso(_get("end")), "location": _place(_get("location")),
        "description": blank(_get("description")), "url": _get("url"), "uid": _uid("", "_id"),
    }


def _godaddy() -> dict[str, Column]:
    told = _bare(unescape(blank(_get("desc"))))
    return {
        "title": F.trim(_get("title")), "start_time": _iso(_get("start")), "end_time": _iso(_get("end")), "location": _place(_get("location")),
        "description": F.when(F.length(told) > 500, F.concat(F.substring(told, 1, 497), F.lit("..."))).otherwise(told),
    }


def _escribe() -> dict[str, Column]:
    clean = lambda p: F.trim(unescape(blank(_get(p))))
    start, end = (_local(_get(p), "yyyy/MM/dd HH:mm:ss") for p in ("StartDate", "EndDate"))
    links = F.from_json(_get("MeetingDocumentLink"), "array<struct<Title:string,Url:string>>")
    shown = F.slice(F.transform(F.filter(links, lambda x: _filled(x["Title"]).isNotNull() & (blank(x["Url"]) != "")), lambda x: F.concat(F.trim(x["Title"]), F.lit(": "), _link(x["Url"]))), 1, 3)
    kind = F.when(clean("MeetingType") != clean("MeetingName"), F.concat(F.lit("Meeting type: "), _filled(clean("MeetingType"))))
    return {
        "title": clean("MeetingName"), "start_time": start, "end_time": F.coalesce(end, start), "location": F.coalesce(_filled(clean("Description")), clean("Location")),
        "description": F.concat_ws("\n\n", kind, F.nullif(F.array_join(shown, "\n"), F.lit(""))), "url": F.coalesce(_link(_get("Url")), F.col("site")), "uid": _uid("", "ID"),
    }


def _bookmanager() -> dict[str, Column]:
    day = F.coalesce(_filled(_get("date")), _filled(_get("original_date")))
    last = F.coalesce(_filled(_get("end_date")), day)
    all_day = F.coalesce(_get("all_day") == "true", F.lit(False))
    begin = F.when(all_day, "00:00:00").otherwise(F.coalesce(_filled(_get("start_time")), F.lit("00:00:00")))
    until = F.when(all_day, "00:00:00").otherwise(F.coalesce(_filled(_get("end_time")), begin))
    at = lambda d, t: F.when(F.length(day) == 8, _local(F.concat(d, t), "yyyyMMddHH:mm:ss"))
    kind = F.concat(F.lit("["), _filled(_get("category.name")), F.lit("]"))
    return {
        "title": F.trim(_get("title")), "start_time": at(day, begin), "end_time": at(last, until), "location": F.trim(blank(_get("location_text"))),
        "description": _joined(kind, _bare(F.coalesce(_filled(_get("description")), _get("summary"))), by="\n"), "url": F.concat(F.lit("https://"), F.col("domain"), F.lit("/events")),
        "uid": _uid("bm-", "id"),
    }


def _squarespace() -> dict[str, Column]:
    at = lambda p: F.timestamp_millis(_get(p).try_cast("bigint"))
    return {
        "title": F.coalesce(_get("title"), F.lit("Untitled")), "start_time": at("startDate"), "end_time": at("endDate"),
        "location": _place(_get("location.addressTitle"), _get("location.addressLine1"), _get("location.addressLine2")),
        "description": _bare(F.coalesce(_filled(_get("body")), _get("excerpt"))), "url": _link(_get("fullUrl")),
    }


def _social_pinpoint() -> dict[str, Column]:
    clean = lambda p: F.trim(unescape(blank(_get(p))))
    start, end = (_local(_get(p), "yyyy-MM-dd HH:mm:ss") for p in ("event_start_date", "event_end_date"))
    kind, rsvp = clean("event_type"), _filled(_get("event_rsvp_link"))
    online = F.lower(kind) == "online"
    said = lambda label, c: F.concat(F.lit(label), _filled(c))
    return {
        "title": clean("event_title"), "start_time": start, "end_time": F.coalesce(end, start),
        "location": F.coalesce(_joined(clean("event_venue"), _bare(unescape(blank(_get("event_address.address"))))), F.when(online, "Online"), F.lit("")),
        "description": F.concat_ws("\n\n", said("Project: ", clean("project_title")), _filled(_bare(unescape(blank(_get("event_description"))))), F.when(~online, said("Type: ", kind)), said("Registration: ", rsvp)),
        "url": F.coalesce(_filled(_get("event_full")), rsvp, _filled(_get("project_url")), F.col("site")), "uid": _uid("", "event_id"),
    }


#: Where an API lists its records (the first place that is there), and how a record reads.
APIS: dict[str, tuple[tuple[str, ...], Callable[[], dict[str, Column]]]] = {
    "tribe": (("$.events",), _tribe),
    "cityspark": (("$.Value",), _cityspark),
    "ckan": (("$.result.records",), _ckan),
    "godaddy": (("$.events",), _godaddy),
    "escribe": (("$.d",), _escribe),
    "bookmanager": (("$.rows",), _bookmanager),
    "squarespace": (("$.upcoming", "$.items"), _squarespace),
    "social_pinpoint": (("$.result",), _social_pinpoint),
}
COLUMNS = ("title", "start_time", "end_time", "location", "description", "url", "uid")


def _configured(responses: DataFrame) -> DataFrame:
    for name, value in DEFAULTS.items():
        responses = responses.withColumn(name, F.coalesce(name, F.lit(value)) if name in responses.columns else F.lit(value))
    return responses


def api_events(
    responses: DataFrame, api: str, body: str = "body", keep: Column | None = None, change: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Event records of a JSON API's pages: one row per listed object with a title and a start.
    Hooks: ``keep`` filters the objects (column ``o``, JSON text), ``change`` maps the records."""
    if api == "bibliocommons":
        rows, fields = _library_rows(_configured(responses), body), _library()
    else:
        places, mapping = APIS[api]
        listed = F.coalesce(*[F.get_json_object(body, p) for p in places])
        rows, fields = _configured(responses).withColumn("o", F.explode(F.from_json(listed, "array<string>"))), mapping()
    rows = rows if keep is None else rows.filter(keep)
    made = rows.select("source", *[fields.get(c, F.lit(None).cast("string")).alias(c) for c in COLUMNS])
    made = made.filter("title <> '' and start_time is not null")
    return made if change is None else change(made)


def _library_rows(responses: DataFrame, body: str) -> DataFrame:
    """One row an event of a page's entities, with the names of its places."""
    named = F.from_json(F.get_json_object(body, "$.entities.locations"), "map<string,struct<name:string>>")
    events = F.from_json(F.get_json_object(body, "$.entities.events"), "map<string,string>")
    return responses.select("*", named.alias("places"), F.explode(events).alias("event_id", "o"))


def _library() -> dict[str, Column]:
    name = lambda p: _filled(F.try_element_at("places", _get(f"definition.{p}"))["name"])
    branch, other = name("branchLocationId"), name("nonBranchLocationId")
    at = lambda index, own: _iso(F.coalesce(_filled(_get(index)), _get(f"definition.{own}")))
    on = F.coalesce(_get("definition.isCancelled") != "true", F.lit(True))
    start = at("indexStart", "start")
    return {
        "title": F.when(on, F.trim(_get("definition.title"))), "start_time": start, "end_time": F.coalesce(at("indexEnd", "end"), start),
        "location": blank(_joined(branch, F.when(branch.isNull() | (branch != other), other), _get("definition.locationDetails"))),
        "description": unescape(F.trim(F.regexp_replace(blank(_get("definition.description")), r"\s*<[^>]+>\s*", "\n"))),
        "url": F.concat(F.lit("https://"), F.element_at(F.split("domain", r"\."), 1), F.lit(".bibliocommons.com/v2/events/"), F.col("event_id")),
        "uid": F.concat("event_id", F.lit("@"), "domain"),
    }


def first_audience(priority: tuple[str, ...], audience: str) -> Column:
    """A hook for ``keep``: of a library event's audiences the first in ``priority`` is this one."""
    ids = F.from_json(_get("definition.audienceIds"), "array<string>")
    return F.coalesce(F.get(F.filter(F.array(*[F.lit(a) for a in priority]), lambda a: F.array_contains(ids, a)), F.lit(0)) == audience, F.lit(False))


def elfsight_events(widgets: DataFrame, now: Column, body: str = "body", months: int = 3, limit: int = 500) -> DataFrame:
    """Occurrences of a widget's events; location and type ids are looked up in the same document.

    A repeated event is tried day by day (weekly), week by week (monthly) or at its interval
    (daily), at most ``limit`` times from its start; those from a day before ``now`` to the end
    of the repetition or of ``months`` of 30 days stay, but for skipped dates."""
    settings = "$.data.settings"
    entry = "array<struct<id:string,name:string>>"
    rows = widgets.select(
        "source", F.from_json(F.get_json_object(body, f"{settings}.locations"), entry).alias("places"),
        F.from_json(F.get_json_object(body, f"{settings}.eventTypes"), entry).alias("types"),
        F.explode(F.from_json(F.get_json_object(body, f"{settings}.events"), "array<string>")).alias("o"),
    )
    named = lambda known, ids: F.transform(F.filter(known, lambda e: F.array_contains(ids, e["id"])), lambda e: e["name"])
    ids = lambda p: F.coalesce(F.from_json(_get(p), "array<string>"), F.array(_get(p)))
    base = F.try_to_timestamp(F.concat_ws(" ", _get("start.date"), F.coalesce(_get("start.time"), F.lit("00:00"))), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")
    # generated, so that a repetition is parsed once, not for each day that is tried
    rows = rows.withColumn("base", base).filter("base is not null").select("*", F.explode(F.array(_repetition())).alias("rule"))
    occurrence = F.explode(_occurrences(F.col("base"), F.col("rule"), now, months, limit)).alias("start_time")
    out = rows.select(
        "source", _get("name").alias("title"), occurrence, F.array_join(named(F.col("places"), ids("location")), ", ").alias("location"),
        named(F.col("types"), ids("eventType")).alias("types"), _bare(_get("description")).alias("description"),
    )
    return out.withColumn("uid", F.substring(F.md5(F.concat_ws("-", "title", F.col("start_time").cast("string"))), 1, 16))


_WEEKDAYS = ("mo", "tu", "we", "th", "fr", "sa", "su")


def _repetition() -> Column:
    """How a widget's event repeats: the fields of its record, typed."""
    freq, every = F.coalesce(_get("repeatFrequency"), F.lit("weekly")), F.coalesce(_get("repeatInterval").try_cast("int"), F.lit(1))
    days = F.coalesce(F.from_json(_get("repeatWeeklyOnDays"), "array<string>"), F.array().cast("array<string>"))
    skips = F.from_json(_get("exceptions"), "array<struct<type:string,originalDate:bigint>>")
    skipped = F.transform(F.filter(skips, lambda x: x["type"] == "skip"), lambda x: F.to_date(F.timestamp_millis(x["originalDate"])))
    return F.struct(
        F.coalesce(_get("repeatPeriod"), F.lit("noRepeat")).alias("period"),
        freq.alias("freq"),
        F.when(freq == "daily", every).when(freq == "monthly", 7).otherwise(1).alias("step"),
        F.when(_get("repeatEnds") == "onDate", F.try_to_timestamp(_get("repeatEndsDate.date"), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")).alias("ends"),
        F.array_intersect(days, F.array(*[F.lit(d) for d in _WEEKDAYS])).alias("days"),
        F.coalesce(skipped, F.array().cast("array<date>")).alias("skipped"),
    )


def _occurrences(base: Column, rule: Column, now: Column, months: int, limit: int) -> Column:
    period, freq, wanted = rule["period"], rule["freq"], rule["days"]
    cutoff = now + F.make_dt_interval(F.lit(30 * months))
    last = F.least(cutoff, F.coalesce(rule["ends"], cutoff))
    names = F.array(*[F.lit(d) for d in _WEEKDAYS])
    listed = lambda t: F.array_contains(wanted, F.element_at(names, F.weekday(t) + 1))
    week = lambda t: F.floor((F.dayofmonth(t) - 1) / 7)
    custom = period == "custom"
    fits = lambda t: (
        F.when((period == "weeklyOn") | (custom & (freq == "weekly")), (F.size(wanted) == 0) | listed(t))
        .when(custom & (freq == "monthly"), listed(t) & (week(t) == week(base)))
        .otherwise(custom & (freq == "daily"))
    )
    tried = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: base + F.make_dt_interval(i * rule["step"]))
    since = now - F.expr("INTERVAL 1 DAY")
    met = F.filter(tried, lambda t: (t <= last) & (t >= since) & fits(t) & ~F.array_contains(rule["skipped"], F.to_date(t)))
    once = F.when(base >= since, F.array(base)).otherwise(F.array().cast("array<timestamp_ntz>"))
    return F.when(period == "noRepeat", once).otherwise(met)
