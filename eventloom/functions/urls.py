"""Expressions on URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SLUG_RULES, SLUG_SKIPS


def host(url: Column) -> Column:
    """Authority of a URL, without failing on dirty input."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_stale(url: Column, year: int, month: int) -> Column:
    """A ``/YYYY/MM/`` part lies before the given month."""
    y = F.regexp_extract(url, r"/(\d{4})/(\d{2})/", 1)
    m = F.regexp_extract(url, r"/(\d{4})/(\d{2})/", 2)
    dated = F.coalesce(y, F.lit("")) != ""
    return F.coalesce(dated & ((y.try_cast("int") * 12 + m.try_cast("int")) < year * 12 + month), F.lit(False))


def feed_slug(url: Column) -> Column:
    """A readable file stem for a feed: the first provider of SLUG_RULES that it shows, else
    domain and path."""
    netloc, where = host(url), path(url)
    domain = F.split(F.replace(netloc, F.lit("www."), F.lit("")), r"\.")[0]
    squash = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"[^a-zA-Z0-9]+", "_")), r"^_+|_+$", "")
    slug = F.when(F.lit(False), "")
    for place, mark, lead, needed, last in SLUG_RULES:
        shows = F.contains(netloc if place == "host" else where, F.lit(mark))
        tail = F.when(F.regexp_extract(url, last, 1) != "", F.concat(F.lit("_"), F.regexp_extract(url, last, 1))).otherwise("") if last else F.lit("")
        if needed:  # the part in the URL names the feed; that of one provider is kept as it is
            part = F.regexp_extract(url, needed, 1)
            shows, name = shows & (part != ""), part if lead == "tockify_" else squash(part)
        elif place == "host":  # the account is the host's first label
            name = F.coalesce(F.nullif(F.regexp_extract(netloc, rf"^([^.]+)\.{re.escape(mark)}", 1), F.lit("")), F.lit(mark.split(".")[0]))
        else:
            name = domain
        if mark == "/live/ical/":
            name = F.concat(domain, F.lit("_livewhale"))
        if mark == "/fs/calendar-manager/":
            ids = F.array_join(F.regexp_extract_all(url, F.lit(last), F.lit(1)), "_")
            name, tail = F.substring(squash(F.when(ids != "", F.concat(domain, F.lit("_cal_"), ids)).otherwise(F.concat(domain, F.lit("_calendar_manager")))), 1, 50), F.lit("")
        slug = slug.when(shows, F.concat(F.lit(lead), name, tail))
    parts = F.slice(F.filter(F.split(where, "/"), lambda p: (p != "") & ~p.isin(*SLUG_SKIPS)), 1, 2)
    plain = F.when(F.size(parts) > 0, F.concat(domain, F.lit("_"), F.array_join(parts, "_"))).otherwise(domain)
    return slug.otherwise(F.substring(squash(plain), 1, 50))
