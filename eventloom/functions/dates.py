"""Date and time expressions.  Wall clocks are TIMESTAMP_NTZ, instants TIMESTAMP."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The months.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}


def valid_zones(spark: SparkSession) -> DataFrame:
    """Known zone names, a table of bounded size (about 600 rows)."""
    return spark.createDataFrame([(z,) for z in sorted(available_timezones())], "zone string")


def with_event_zone(df: DataFrame, tzid: str, city_zone: Column, out: str = "zone") -> DataFrame:
    """The row's TZID if it is a known zone, else the city's; unknown names never
    reach a conversion, which would fail on them."""
    zones = F.broadcast(valid_zones(df.sparkSession).withColumnRenamed("zone", "__zone"))
    return df.join(zones, F.col(tzid) == F.col("__zone"), "left").withColumn(out, F.coalesce("__zone", city_zone)).drop("__zone")


def wall_clock(value: Column) -> Column:
    """ICS date-time text as the wall clock that it shows (a Z is ignored); null if malformed."""
    v = F.trim(value)
    return F.coalesce(
        F.when(v.rlike(r"^\d{8}T\d{6}Z?$"), F.try_to_timestamp(F.substring(v, 1, 15), F.lit("yyyyMMdd'T'HHmmss"))),
        F.when(v.rlike(r"^\d{8}$"), F.try_to_timestamp(v, F.lit("yyyyMMdd"))),
    ).cast("timestamp_ntz")


def instant(value: Column, zone: Column) -> Column:
    """The instant of ICS date-time text: UTC with a Z, else local to ``zone``."""
    wall = wall_clock(value).cast("timestamp")
    return F.when(F.endswith(F.trim(value), F.lit("Z")), wall).otherwise(F.to_utc_timestamp(wall, zone))


def local_clock(value: Column, zone: Column) -> Column:
    """The wall clock of ICS date-time text in ``zone``: with a Z converted, else as it is."""
    wall = wall_clock(value)
    return F.when(F.endswith(F.trim(value), F.lit("Z")), F.convert_timezone(F.lit("UTC"), zone, wall)).otherwise(wall)


def iso_local(at: Column, zone: Column) -> Column:
    """ISO-8601 text of an instant in a zone, with offset."""
    local = F.from_utc_timestamp(at, zone)
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(at)) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    return F.concat(
        F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"),
        sign,
        F.format_string("%02d:%02d", F.floor(F.abs(minutes) / 60).cast("int"), (F.abs(minutes) % 60).cast("int")),
    )


def is_all_day(value: Column, params: Column) -> Column:
    """VALUE=DATE, or eight digits without a time."""
    p = F.upper(F.coalesce(params, F.lit("")))
    return (F.contains(p, F.lit("VALUE=DATE")) & ~F.contains(p, F.lit("VALUE=DATE-TIME"))) | F.coalesce(
        F.trim(value).rlike(r"^\d{8}$"), F.lit(False)
    )


def ordinal_weekday(d: Column) -> Column:
    """Which of its weekday in the month a date is: 1 for days 1-7."""
    return F.ceil(F.dayofmonth(d) / 7).cast("int")


def time_label(at: Column) -> Column:
    """``7:30 PM``, '' at midnight."""
    t = F.date_format(at, "h:mm a")
    return F.when(F.date_format(at, "HH:mm") == "00:00", "").otherwise(t)


def normalize_captured(value: Column) -> Column:
    """Captured date-times: a date alone means 19:00; offsets and seconds are optional."""
    v = F.trim(value)
    return F.coalesce(
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(F.concat(v, F.lit(" 19:00")), F.lit("yyyy-MM-dd HH:mm"))),
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"), F.try_to_timestamp(F.substring(F.rpad(F.regexp_replace(v, r"(Z|[+-]\d{2}:?\d{2}|\.\d+.*)$", ""), 19, ":00"), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))),
    ).cast("timestamp_ntz")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _month(word: Column) -> Column:
    """The number of a month by its name or the first three letters of it."""
    named = F.create_map(*[F.lit(x) for name, n in MONTHS.items() for key in dict.fromkeys((name, name[:3])) for x in (key, n)])
    return F.try_element_at(named, word)


def _tokens(text: Column) -> Column:
    """Numbers, words, runs of blanks and single marks of a text; commas and the endings of
    ordinals are left out, and ``p.m.`` is a word."""
    bare = F.regexp_replace(F.lower(F.trim(text)), r"(?<=\d)(st|nd|rd|th)\b|(?<=[ap])[.]\s?(?=m)|(?<=[ap][.]?\s?m)[.]|,", "")
    return F.regexp_extract_all(bare, F.lit(r"[0-9]+|[a-z]+|\s+|[^0-9a-z\s]"), F.lit(0))


def _shape(tokens: Column) -> Column:
    """One character a token, by which forms are recognised: d, D, #, Y for numbers of one to
    four digits, M for a month, W for a weekday, a for AM or PM, w for another word, _ for blanks;
    marks stand for themselves."""

    def kind(t: Column) -> Column:
        return (
            F.when(t.rlike("^[0-9]"), F.substring(F.lit("dD#Y*"), F.least(F.length(t), F.lit(5)), F.lit(1)))
            .when(t.rlike("^[^a-z]"), F.when(t.rlike(r"^\s"), "_").otherwise(t))
            .when(_month(t).isNotNull(), "M")
            .when(t.rlike("^(mon|tue|wed|thu|fri|sat|sun)"), "W")
            .when(t.rlike("^[ap]m"), "a")
            .otherwise("w")
        )

    return F.array_join(F.transform(tokens, kind), "")


def _place(shape: Column, before: str, form: str) -> Column:
    """At which token a form begins; null if it does not occur."""
    pattern = f"^({before}){form}"
    return F.when(shape.rlike(pattern), F.length(F.regexp_extract(shape, pattern, 1)))


#: Accepted forms of a date, the first that occurs and is sound: what may stand before, the shape, and
#: where in it year, month and day are.
DATE_FORMS = (
    (".*?", "Y-D-D", 0, 2, 4),
    (".*?", "D[.]D[.]D", 4, 0, 2),
    (".*?", "[MWwa]_[dD]_Y", 4, 0, 2),
    ("(?:W_)?", "M_[dD]_Y$", 4, 0, 2),
    ("(?:W_)?", "[dD]/[dD]/[DY]$", 4, 0, 2),
    ("(?:W_)?", "[dD]_M_Y$", 4, 2, 0),
)
#: With a target year also this one.
YEARLESS_FORM = (".*?", "[MWwa]_[dD]", None, 0, 2)


def parse_date(text: Column, year: int | None = None, since: date | None = None) -> Column:
    """The first date found in a text: ``2026-02-03``, ``02.03.26`` (month first),
    ``February 3, 2026``, and, given a target ``year``, ``Feb 3``; beyond these, a text that is
    ``2/3/2026``, ``2/3/26`` or ``3 February 2026`` (a weekday before it).  Null if none is.  Given
    ``since`` in place of a year, ``Feb 3`` is the next one that is not before it."""
    year = since.year if since else year

    def sound(tokens: Column, places: tuple) -> Callable[[Column], Column]:
        def made(at: Column) -> Column:
            y, m, d = (F.lit(str(year)) if p is None else F.get(tokens, at + p) for p in places)
            y = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
            m = F.coalesce(_month(m).cast("string"), F.when(m.rlike("^[0-9]+$"), m))
            return F.when(m.isNotNull(), F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("y-M-d")))

        return made

    def found(tokens: Column, shape: Column) -> Column:
        of = lambda before, form, *places: _let(_place(shape, before, form), sound(tokens, places)).cast("date")
        dates = [of(*form) for form in DATE_FORMS]
        if since:
            dates.append(_let(of(*YEARLESS_FORM), lambda d: F.when(d < F.lit(since), F.add_months(d, 12)).otherwise(d)))
        elif year:
            dates.append(of(*YEARLESS_FORM))
        return F.coalesce(*dates)

    return _let(_tokens(text), lambda tokens: _let(_shape(tokens), lambda shape: found(tokens, shape)))


#: What a text with a time of day has somewhere, as cheap to find as most texts without one are to leave.
_TIMELY = r":|[ap](?:[.]\s?|,+)?m"


def parse_time(text: Column) -> Column:
    """The first time of day found in a text, as ``HH:mm``: with AM or PM (also ``p.m.``, ``730pm``),
    else ``18:00``; null without either.  A text may also be noon or midnight."""

    def clock(hour: Column, minute: Column) -> Column:
        two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
        said = lambda h: _let(minute, lambda m: F.when((h < 24) & (m < 60), F.concat(two(h), F.lit(":"), two(m))))
        return _let(hour, said)

    def halves(tokens: Column, at: Column) -> Column:
        parted = F.get(tokens, at + 1) == ":"
        word = F.get(F.filter(F.slice(tokens, at + 1, 5), lambda t: t.rlike("^[ap]m")), F.lit(0))

        def of_number(number: Column) -> Column:
            packed = ~parted & (number > 99)
            hour = F.when(packed, F.floor(number / 100)).otherwise(number)
            minute = F.when(packed, number % 100).when(parted, F.get(tokens, at + 2).try_cast("int")).otherwise(0)
            return F.when(hour <= 12, clock(hour % 12 + F.when(F.startswith(word, F.lit("p")), 12).otherwise(0), minute))

        return _let(F.get(tokens, at).try_cast("int"), of_number)

    def found(tokens: Column, shape: Column) -> Column:
        half = _place(shape, ".*?", "(?:[dD](?::D)?|[#Y])_?a")
        day = _let(_place(shape, ".*?", "[dD]:D"), lambda at: clock(F.get(tokens, at).try_cast("int"), F.get(tokens, at + 2).try_cast("int")))
        return _let(half, lambda at: F.when(at.isNotNull(), halves(tokens, at)).otherwise(day))

    def of_text(word: Column) -> Column:
        timely = _let(_tokens(word), lambda tokens: _let(_shape(tokens), lambda shape: found(tokens, shape)))
        return F.when(word == "noon", "12:00").when(word == "midnight", "00:00").when(word.rlike(_TIMELY), timely)

    return _let(F.lower(F.trim(text)), of_text)


def repair_double_conversion(at: Column, host: Column, hosts: tuple[str, ...], zone: Column) -> Column:
    """Hosts that write local time as if it were UTC get it taken as wall clock again."""
    return F.when(host.isin(*hosts), F.to_utc_timestamp(at, zone)).otherwise(at)
