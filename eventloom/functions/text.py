"""String expressions on titles, sources, descriptions and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    """Null as ''."""
    return F.coalesce(c, F.lit(""))


def normalize_title(title: Column) -> Column:
    """Key form of a title: one leading article off, letters and digits only, lower
    case, at most 40 characters."""
    bare = F.regexp_replace(title, r"(?i)^(the |a |an )", "")
    return F.substring(F.lower(F.regexp_replace(bare, r"[^\p{L}\p{N}]", "")), 1, 40)


def source_list(source: Column) -> Column:
    """Comma-joined names as a list: trimmed, without blanks, first occurrence kept."""
    names = F.transform(F.split(blank(source), ","), lambda s: F.trim(s))
    return F.array_distinct(F.filter(names, lambda s: s != ""))


def venue_token(c: Column) -> Column:
    """Lower case without punctuation, articles and doubled blanks."""
    s = F.regexp_replace(F.lower(blank(c)), r"[^\w\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\b(the|a|an)\b", " "), r"\s+", " "))


def source_matches_location(source: Column, location: Column) -> Column:
    """A source's name occurs in the location, as it is or as a venue token."""
    place, raw, token = venue_token(location), F.lower(F.trim(blank(source))), venue_token(source)
    return ((raw != "") & F.contains(place, raw)) | ((token != "") & F.contains(place, token))


def term_snippet(description: Column, term: Column, context: int = 40) -> Column:
    """The term in bold between ``context`` characters on either side; null if absent."""
    text = F.regexp_replace(F.regexp_replace(description, r"[\r\n]+", " "), r" {2,}", " ")
    quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    sides = F.split(text, quoted, 2)
    left, right = sides[0], F.get(sides, F.lit(1))
    found = F.substring(text, F.length(left) + 1, F.length(term))
    left = F.when(F.length(left) > context, F.concat(F.lit("..."), F.right(left, F.lit(context)))).otherwise(left)
    right = F.when(F.length(right) > context, F.concat(F.left(right, F.lit(context)), F.lit("..."))).otherwise(right)
    return F.when((blank(description) != "") & (blank(term) != ""), F.concat(left, F.lit("**"), found, F.lit("**"), right))


def truncate(c: Column, length: int) -> Column:
    """At most ``length`` characters, then an ellipsis."""
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def ics_escape(c: Column) -> Column:
    r"""Text as an ICS value: \ ; , and line ends escaped, in this order."""
    s = F.replace(blank(c), F.lit("\\"), F.lit("\\\\"))
    s = F.replace(F.replace(s, F.lit(";"), F.lit("\\;")), F.lit(","), F.lit("\\,"))
    return F.replace(s, F.lit("\n"), F.lit("\\n"))


def ics_unescape(c: Column, newline: str = "\n") -> Column:
    r"""ICS value as text, in the order \n \, \; \\ (so a literal ``\\n`` is misread)."""
    s = F.replace(c, F.lit("\\n"), F.lit(newline))
    s = F.replace(F.replace(s, F.lit("\\,"), F.lit(",")), F.lit("\\;"), F.lit(";"))
    return F.trim(F.replace(s, F.lit("\\\\"), F.lit("\\")))


def source_links(source: Column, urls: Column, hidden: Column | None = None) -> Column:
    """``Source: [a](url), b``; hidden sources are left out unless all are hidden."""
    names = source_list(source)
    if hidden is not None:
        seen = F.filter(names, lambda s: ~F.array_contains(hidden, s))
        names = F.when(F.size(seen) > 0, seen).otherwise(names)
    link = lambda s: F.when(
        blank(F.try_element_at(urls, s)) != "", F.concat(F.lit("["), s, F.lit("]("), F.try_element_at(urls, s), F.lit(")"))
    ).otherwise(s)
    return F.when(blank(source) == "", "").otherwise(F.concat(F.lit("Source: "), F.array_join(F.transform(names, link), ", ")))


def categories_list(c: Column) -> Column:
    """CATEGORIES values; null if there is none."""
    names = F.filter(F.transform(F.split(blank(c), ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(names) > 0, names)


def event_uid(title: Column, start_iso: Column, domain: str) -> Column:
    return F.concat(F.md5(F.concat(title, F.lit("-"), start_iso)), F.lit(f"@{domain}"))


def rss_guid(uid: Column, title: Column, start: Column) -> Column:
    """The uid, or a digest of title and start."""
    return F.coalesce(F.nullif(uid, F.lit("")), F.md5(F.concat(blank(title), F.lit("|"), blank(start))))


def short_uid(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 16)


def norm_key(c: Column) -> Column:
    """Letters and digits of the lower-cased name."""
    return F.regexp_replace(F.lower(blank(c)), "[^a-z0-9]", "")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(blank(html), r"<[^>]+>", "")


def strip_tags_spaced(html: Column) -> Column:
    """Tags as blanks, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(blank(html), r"<[^>]+>", " "), r"\s+", " "))


def title_case(c: Column) -> Column:
    """Each run of letters capitalised, so that ``3d x`` gives ``3D X``."""
    runs = F.regexp_extract_all(blank(c), F.lit(r"([A-Za-z]+|[^A-Za-z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), "")


def search_text(title: Column, location: Column, source: Column, description: Column) -> Column:
    """What a search looks through; blanks stay where a field is null."""
    return F.lower(F.concat(blank(title), F.lit(" "), blank(location), F.lit(" "), blank(source), F.lit(" "), blank(description)))


def google_calendar_id_url(calendar_id: Column) -> Column:
    return F.concat(F.lit("https://calendar.google.com/calendar/ical/"), F.url_encode(calendar_id), F.lit("/public/basic.ics"))


def clean_command(cmd: Column) -> Column:
    """A scraper command without its output option, blanks collapsed."""
    bare = F.regexp_replace(blank(cmd), r"(^|\s)(--output|-o)([ =]\S+)", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def url_map(c: Column) -> Column:
    """``source_urls`` JSON as a map; invalid text gives an empty one."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
