"""Recurrence rules: text, and expansion into occurrences.

A recurrence set is what a rule yields, and the added dates, less the excluded ones; an
instance that was moved replaces the one it names.  A rule is expanded without Python: a
``sequence`` over the wall-clock days of the window, a filter with one test for each part,
the times of day, and, for BYSETPOS, the rank of an occurrence in its period.  That is done once for each
distinct rule and start, and the days of a rule once for each distinct date of a start; events take
their list by a join.

Parts: FREQ (DAILY, WEEKLY, MONTHLY, YEARLY), INTERVAL, COUNT, UNTIL, WKST, BYMONTH, BYWEEKNO,
BYYEARDAY, BYMONTHDAY, BYDAY, BYHOUR, BYMINUTE, BYSECOND, BYSETPOS.  Whether a part limits a
period's days or expands them, membership of a day is the same test; what differs is the default
of a missing part, the start's own month, day or weekday.  UNTIL with a time is compared as
such, with a Z after conversion to the event's zone; a date alone includes its whole day.
A row without a rule, or with a rule that this grammar does not accept, occurs once, at its start.
A start that its rule does not yield is no occurrence (the standard leaves this open).  In
the first week of a weekly rule, BYSETPOS counts from the start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize

_DAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
_DAY = f"(?:{'|'.join(_DAYS)})"
_NUMBERS = r"[+-]?\d{1,3}(?:,[+-]?\d{1,3})*"
_PARTS = (
    "FREQ=(?:DAILY|WEEKLY|MONTHLY|YEARLY)", r"INTERVAL=\d{1,6}", r"COUNT=\d{1,6}", r"UNTIL=\d{8}(?:T\d{6}Z?)?", f"WKST={_DAY}",
    rf"BYDAY=(?:[+-]?\d{{0,2}}{_DAY})(?:,[+-]?\d{{0,2}}{_DAY})*",
    f"BY(?:MONTH|WEEKNO|YEARDAY|MONTHDAY|HOUR|MINUTE|SECOND|SETPOS)={_NUMBERS}",
)
_GRAMMAR = rf"^(?:RRULE:)?(?=(?:.*;)?FREQ=)(?:(?:{'|'.join(_PARTS)})(?:;|$))+$"


def part(rule: Column, name: str) -> Column:
    """A part of an RRULE, null if it is missing."""
    return F.nullif(F.regexp_extract(F.upper(rule), rf"(?:^|;|:){name}=([^;]*)", 1), F.lit(""))


def build_rule(freq: Column, interval: Column, byday: Column, until: Column) -> Column:
    """RRULE text of its parts; an interval of 1 and missing parts are left out."""
    return F.concat_ws(
        ";",
        F.concat(F.lit("FREQ="), F.upper(freq)),
        F.when(interval > 1, F.concat(F.lit("INTERVAL="), interval.cast("string"))),
        F.when(F.coalesce(byday, F.lit("")) != "", F.concat(F.lit("BYDAY="), F.upper(byday))),
        F.when(until.isNotNull(), F.concat(F.lit("UNTIL="), F.date_format(until, "yyyyMMdd"))),
    )


def is_sound(rule: Column) -> Column:
    """A rule that can be expanded."""
    return F.coalesce(F.upper(F.trim(rule)).rlike(_GRAMMAR), F.lit(False))


def rule_parts(rule: Column) -> Column:
    """The parts of a rule's text as a struct, its lists as lists."""
    rule = F.trim(rule)
    listed = lambda name: F.filter(F.split(F.coalesce(part(rule, name), F.lit("")), ","), lambda d: d != "")
    numbers = ("MONTH", "MONTHDAY", "YEARDAY", "WEEKNO", "HOUR", "MINUTE", "SECOND", "SETPOS")
    return F.struct(
        is_sound(rule).alias("sound"),
        *[part(rule, n).alias(n) for n in ("FREQ", "INTERVAL", "COUNT", "UNTIL", "WKST")],
        F.transform(listed("BYDAY"), lambda d: F.regexp_replace(d, "^[+]", "")).alias("BYDAY"),
        *[F.transform(listed(f"BY{n}"), lambda d: d.try_cast("int")).alias(f"BY{n}") for n in numbers],
    )


def parse_rule(parts: Column, start: Column, zone: Column | None = None) -> Column:
    """The ``rule_parts`` of a rule with the defaults that the start gives to missing ones."""
    numbers = lambda name: parts[name]
    freq = parts["FREQ"]
    # the number of a weekday means nothing in a day or week
    days = F.when(freq.isin("DAILY", "WEEKLY"), F.transform(parts["BYDAY"], lambda d: F.right(d, F.lit(2)))).otherwise(parts["BYDAY"])
    months, month_days, year_days, weeks = (numbers(f"BY{n}") for n in ("MONTH", "MONTHDAY", "YEARDAY", "WEEKNO"))
    free = (F.size(parts["BYDAY"]) + F.size(month_days) + F.size(year_days) + F.size(weeks)) == 0
    own_weekday = F.element_at(F.array(*[F.lit(d) for d in _DAYS]), F.weekday(start) + 1)
    until = parts["UNTIL"]
    last = F.try_to_timestamp(F.rpad(F.substring(until, 1, 15), 15, "T235959"), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")
    if zone is not None:
        last = F.when(F.endswith(until, F.lit("Z")), F.convert_timezone(F.lit("UTC"), zone, last)).otherwise(last)
    own = lambda name, value: F.when(F.size(numbers(name)) > 0, F.array_sort(numbers(name))).otherwise(F.array(value))
    hours, minutes, seconds = own("BYHOUR", F.hour(start)), own("BYMINUTE", F.minute(start)), own("BYSECOND", F.second(start))
    clock = lambda h: F.flatten(F.transform(minutes, lambda m: F.transform(seconds, lambda s: h * 3600 + m * 60 + s)))
    return F.struct(
        parts["sound"].alias("sound"),
        freq.alias("freq"),
        F.greatest(F.lit(1), F.coalesce(parts["INTERVAL"].try_cast("int"), F.lit(1))).alias("every"),
        parts["COUNT"].try_cast("int").alias("n"),
        last.alias("last"),
        (F.coalesce(F.array_position(F.array(*[F.lit(d) for d in _DAYS]), parts["WKST"]), F.lit(1)) - 1).cast("int").alias("week_start"),
        F.when(free & (freq == "YEARLY") & (F.size(months) == 0), F.array(F.month(start))).otherwise(months).alias("months"),
        F.when(free & freq.isin("YEARLY", "MONTHLY"), F.array(F.dayofmonth(start))).otherwise(month_days).alias("month_days"),
        year_days.alias("year_days"),
        weeks.alias("weeks"),
        F.when(free & (freq == "WEEKLY"), F.array(own_weekday)).otherwise(days).alias("days"),
        # whether a numbered weekday is one of the month's or of the year's
        ((freq == "MONTHLY") | (F.size(months) > 0)).alias("of_month"),
        numbers("BYSETPOS").alias("places"),
        F.array_distinct(F.flatten(F.transform(hours, clock))).alias("clock"),
    )


def _week_of(day: Column, week_start: Column) -> Column:
    """The first day of a day's week."""
    return F.date_sub(day, F.pmod(F.weekday(day) - week_start, F.lit(7)))


def _period(day: Column, rule: Column) -> Column:
    """The first day of the period that a day belongs to."""
    return (
        F.when(rule["freq"] == "YEARLY", F.trunc(day, "year"))
        .when(rule["freq"] == "MONTHLY", F.trunc(day, "month"))
        .when(rule["freq"] == "WEEKLY", _week_of(day, rule["week_start"]))
        .otherwise(day)
    )


def _period_end(day: Column, rule: Column) -> Column:
    first = _period(day, rule)
    return (
        F.when(rule["freq"] == "YEARLY", F.date_sub(F.add_months(first, 12), 1))
        .when(rule["freq"] == "MONTHLY", F.last_day(day))
        .when(rule["freq"] == "WEEKLY", F.date_add(first, 6))
        .otherwise(day)
    )


def _fits(day: Column, first: Column, rule: Column) -> Column:
    """Does a day belong to the rule that starts on ``first``?"""
    code = F.element_at(F.array(*[F.lit(d) for d in _DAYS]), F.weekday(day) + 1)
    of_month, in_month = F.dayofmonth(day), F.dayofmonth(F.last_day(day))
    of_year = F.dayofyear(day)
    in_year = F.dayofyear(F.date_sub(F.add_months(F.trunc(day, "year"), 12), 1))
    at, size = F.when(rule["of_month"], of_month).otherwise(of_year), F.when(rule["of_month"], in_month).otherwise(in_year)
    nth, from_end = F.ceil(at / 7).cast("int"), -(F.floor((size - at) / 7) + 1).cast("int")
    # a week belongs to the year of its fourth day
    middle = F.date_add(_week_of(day, rule["week_start"]), 3)
    year_end = F.date_sub(F.add_months(F.trunc(middle, "year"), 12), 1)
    last_middle = F.date_sub(year_end, F.pmod(F.weekday(year_end) - rule["week_start"] - 3, F.lit(7)))
    week, weeks = (F.floor((F.dayofyear(m) - 1) / 7).cast("int") + 1 for m in (middle, last_middle))
    months = (F.year(day) - F.year(first)) * 12 + F.month(day) - F.month(first)
    periods = (
        F.when(rule["freq"] == "DAILY", F.datediff(day, first))
        .when(rule["freq"] == "WEEKLY", F.datediff(_week_of(day, rule["week_start"]), _week_of(first, rule["week_start"])) / 7)
        .when(rule["freq"] == "MONTHLY", months)
        .otherwise(F.year(day) - F.year(first))
    )
    within = lambda name, *values: (F.size(rule[name]) == 0) | F.arrays_overlap(rule[name], F.array(*values))
    return (
        (periods % rule["every"] == 0)
        & within("months", F.month(day))
        & within("month_days", of_month, of_month - in_month - 1)
        & within("year_days", of_year, of_year - in_year - 1)
        & within("weeks", week, week - weeks - 1)
        & within("days", code, F.concat(nth.cast("string"), code), F.concat(from_end.cast("string"), code))
    )


def _placed(times: Column, periods: Column, backwards: Column, rule: Column) -> Column:
    """The occurrences whose rank in their period, from either end, is among the places; the periods of
    the occurrences, and these backwards, are columns, as they are looked up for each occurrence."""
    n = F.size(times)

    def wanted(t: Column, i: Column) -> Column:
        period = F.get(periods, i)
        from_first = i - F.array_position(periods, period) + 2
        from_last = i - n + F.array_position(backwards, period) - 1
        return F.arrays_overlap(rule["places"], F.array(from_first.cast("int"), from_last.cast("int")))

    return F.filter(times, wanted)


#: What decides whether a day belongs to a rule.
_DAY_PARTS = ("freq", "every", "week_start", "months", "month_days", "year_days", "weeks", "days", "of_month")


def _with_times(rows: DataFrame, start: str, from_day: Column, to_day: Column, out: str, only: Column | None = None) -> DataFrame:
    """Adds what the parsed rules (``__rule``) yield in whole days of [from_day, to_day], and before
    where that must be counted, as the list ``out``; null without a sound rule or where not ``only``."""
    r, begin, first = F.col("__rule"), F.col(start), F.to_date(F.col(start))
    asked = r["sound"] if only is None else r["sound"] & only
    ranked = F.size(r["places"]) > 0
    stop = F.least(to_day, F.coalesce(F.to_date(r["last"]), to_day))
    # a rule with COUNT must be counted from its start; others may begin at the window, with
    # BYSETPOS at the beginning of its period (of the first week at the start)
    lead = F.when(r["n"].isNotNull(), first).otherwise(F.greatest(first, from_day))
    whole = F.when(r["freq"] == "WEEKLY", F.greatest(first, _period(lead, r))).otherwise(_period(lead, r))
    lead, upto = F.when(ranked, whole).otherwise(lead), F.when(ranked, _period_end(stop, r)).otherwise(stop)
    # the days do not depend on the clock, so that all starts of a date share them
    search = F.struct(*[r[n].alias(n) for n in _DAY_PARTS], first.alias("first"), lead.alias("lead"), upto.alias("upto"))
    rows = rows.withColumn("__search", F.when(asked & (upto >= lead), search))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but the work is here
    q = F.col("__search")
    found = rows.select("__search").where("__search is not null").distinct().repartition(spread, "__search")
    found = found.select("__search", F.filter(F.sequence(q["lead"], q["upto"]), lambda d: _fits(d, q["first"], q)).alias("__days"))
    rows = rows.join(found, "__search", "left").drop("__search")
    days = F.coalesce("__days", F.when(asked, F.array().cast("array<date>")))
    at = lambda d, s: d.cast("timestamp_ntz") + F.make_dt_interval(secs=s)
    rows = rows.withColumn(out, F.flatten(F.transform(days, lambda d: F.transform(r["clock"], lambda s: at(d, s)))))
    # generated, so that the optimizer cannot move the periods of a whole list into the test of each member
    periods = F.when(ranked, F.transform(out, lambda t: _period(t.cast("date"), r)))
    rows = rows.select("*", F.explode_outer(F.array(F.struct(periods.alias("forth"), F.reverse(periods).alias("back")))).alias("__periods"))
    times = F.when(ranked, _placed(F.col(out), F.col("__periods")["forth"], F.col("__periods")["back"], r)).otherwise(F.col(out))
    times = F.filter(times, lambda t: (t >= begin) & (r["last"].isNull() | (t <= r["last"])))
    return rows.withColumn(out, F.when(r["n"].isNotNull(), F.slice(times, 1, F.greatest(r["n"], F.lit(0)))).otherwise(times)).drop("__days", "__periods")


def _distinct(df: DataFrame, rule: str, start: str, **more: Column) -> DataFrame:
    """The distinct rules and starts of ``df``, and ``more``, with the parsed rule as the struct ``__rule``."""
    columns = {"rrule": F.col(rule), "start": F.col(start), **more}
    keys = df.select(*[c.alias(f"__{n}") for n, c in columns.items()]).distinct()
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = keys.repartition(spread, *keys.columns)
    # generated, so that the optimizer cannot move the parsing into the tests of single days
    keys = keys.select("*", F.explode_outer(F.array(rule_parts(F.col("__rrule")))).alias("__parts"))
    rule = parse_rule(F.col("__parts"), F.col("__start"), F.col("__zone") if "zone" in more else None)
    return keys.select("*", F.explode_outer(F.array(rule)).alias("__rule")).drop("__parts")


def _with_list(df: DataFrame, lists: DataFrame, rule: str, start: str, out: str, **more: Column) -> DataFrame:
    """Adds the list ``out`` of a row's rule and start; ``lists`` are of the keys of ``_distinct``, and written,
    so that Spark knows whether they can be broadcast."""
    columns = {"rrule": F.col(rule), "start": F.col(start), **more}
    lists = materialize(lists.select(*[f"__{n}" for n in columns], out), "occurrences")
    same = [c.eqNullSafe(F.col(f"__{n}")) for n, c in columns.items()]
    return df.join(lists, same).drop(*[f"__{n}" for n in columns])


def expand(
    df: DataFrame,
    rule: str,
    start: str,
    from_day: Column,
    to_day: Column,
    excluded: str | None = None,
    out: str = "occurrence",
    limit: int | None = None,
    added: str | None = None,
    zone: Column | None = None,
) -> DataFrame:
    """One row for each occurrence of the set in [from_day, to_day]; rows without a sound
    rule occur once, at their start.  ``start`` is a wall clock (TIMESTAMP_NTZ), and so
    is ``out``: 19:00 stays 19:00 across a clock change.  COUNT counts what the rule yields
    from the start.  ``added`` is a list of wall clocks; ``excluded`` one of wall clocks or of
    dates, which take out all of their day.  ``limit`` bounds the occurrences of one row."""
    given, kinds = df.columns, {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if excluded:  # generated for the same reason as the rule is
        df = df.select("*", F.explode_outer(F.array(F.coalesce(F.col(excluded), F.array().cast(kinds[excluded])))).alias("__gone"))
    more = {"from": from_day, "to": to_day} | ({} if zone is None else {"zone": zone})
    lists = _with_times(_distinct(df, rule, start, **more), "__start", F.col("__from"), F.col("__to"), "__times")
    rows = _with_list(df, lists, rule, start, "__times", **more)
    none = F.array().cast("array<timestamp_ntz>")
    times = F.coalesce("__times", F.when(F.col(start).isNotNull(), F.array(F.col(start))), none)
    if added:
        times = F.array_sort(F.array_union(times, F.coalesce(F.col(added), none)))
    times = F.filter(times, lambda t: F.to_date(t).between(from_day, to_day))
    if limit is not None:
        times = F.slice(times, 1, limit)
    if excluded:
        by_day = kinds[excluded] == "array<date>"
        times = F.filter(times, lambda t: ~F.array_contains("__gone", F.to_date(t) if by_day else t))
    # an outer explode: for an inner one the optimizer would test the list before, expanding each rule twice
    return rows.select(*given, F.explode_outer(times).alias(out)).where(F.col(out).isNotNull())


def _repeats(df: DataFrame) -> Column:
    """Whether a row stands for more than its start."""
    ruled = F.coalesce(F.col("rrule"), F.lit("")) != ""
    return ruled | (F.size("rdates") > 0) if "rdates" in df.columns else ruled


def expand_events(df: DataFrame, today: Column, window_days: int = 90, zone: Column | None = None) -> DataFrame:
    """Events with ``rrule`` in the window from today; repeated instances get the uid
    suffix ``__YYYYMMDD`` and lose their rule.  Within a ``file`` that has any rule, all
    its events pass through the window; other files have no horizon.

    ``rdates`` and ``exdates`` (lists of wall clocks) are added and taken out, and a row with
    a ``recurrence_id`` (wall clock) replaces the instance of its uid that it names, wherever
    in the window it was moved to; these three columns may be missing.  The events are written
    once, as the steps read them several times; what they come from is not read again."""
    df = materialize(df, "events")
    lists = {n: n if n in df.columns else None for n in ("exdates", "rdates")}
    ruled = df.groupBy("file").agg(F.bool_or(_repeats(df)).alias("__ruled"))
    marked = df.join(ruled, "file")
    inside = expand(
        marked.filter("__ruled"), "rrule", "start_time", today, F.date_add(today, window_days),
        excluded=lists["exdates"], added=lists["rdates"], zone=zone,
    )
    if "recurrence_id" in df.columns:
        moved = df.where("recurrence_id IS NOT NULL").select(
            F.col("file").alias("__file"), F.col("uid").alias("__uid"), F.col("recurrence_id").alias("__instance")
        )
        named = (F.col("file") == F.col("__file")) & (F.col("uid") == F.col("__uid")) & (F.col("occurrence") == F.col("__instance"))
        inside = inside.join(moved.distinct(), named & F.col("recurrence_id").isNull(), "left_anti")
    suffix = F.concat(F.lit("__"), F.date_format("occurrence", "yyyyMMdd"))
    repeated = _repeats(df) | F.col("recurrence_id").isNotNull() if "recurrence_id" in df.columns else _repeats(df)
    inside = inside.withColumn("uid", F.when(repeated & ~F.endswith("uid", suffix), F.concat("uid", suffix)).otherwise(F.col("uid")))
    inside = inside.withColumn("start_time", F.col("occurrence")).withColumn("rrule", F.lit(None).cast("string")).drop("occurrence")
    return inside.unionByName(marked.filter("not __ruled")).drop("__ruled")


def expand_enrichments(df: DataFrame, from_day: Column, to_day: Column) -> DataFrame:
    """Curated recurring events as virtual rows: a negative id, source ``Picks: name``."""
    rows = expand(df.filter(F.coalesce("rrule", F.lit("")) != ""), "rrule", "start_time", from_day, to_day)
    return rows.withColumn("virtual_id", F.concat(F.lit("enrichment-"), F.col("id").cast("string"), F.lit("-"), F.date_format("occurrence", "yyyyMMdd"))).withColumn(
        "source", F.concat(F.lit("Picks: "), F.coalesce("curator_name", F.lit("")))
    )


#: Days searched for a next occurrence, first of every rule and then of those that had none; in 28
#: years every date has met every weekday, 29 February included.
HORIZONS = (366, 28 * 366)


def next_occurrence(df: DataFrame, now: Column) -> DataFrame:
    """(id, next_start) at or after ``now``; ids without one are left out."""
    today = F.to_date(now)
    later = lambda c: F.filter(c, lambda t: t >= now)
    rows = _with_times(_distinct(df, "rrule", "start_time"), "__start", today, F.date_add(today, HORIZONS[0]), "__near")
    once = F.when(~F.col("__rule")["sound"], F.array("__start"))
    rows = materialize(rows.withColumn("__near", later(F.coalesce("__near", once))), "near")
    open_ = F.size("__near") == 0
    found = F.array_min("__near")
    if not rows.where(open_ & F.col("__rule")["sound"]).isEmpty():
        rows = _with_times(rows, "__start", today, F.date_add(today, HORIZONS[1]), "__far", open_)
        found = F.array_min(F.when(open_, later(F.col("__far"))).otherwise(F.col("__near")))
    rows = _with_list(df, rows.withColumn("next_start", found).where("next_start is not null"), "rrule", "start_time", "next_start")
    return rows.groupBy("id").agg(F.min("next_start").alias("next_start"))
