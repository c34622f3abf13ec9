"""Hand-written expectations: time zones, recurrence, slugs, similarity, guards, reports."""

import random
from collections import Counter, defaultdict
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from eventloom.functions import dates, geo, html, labels, recurrence, text, urls
from eventloom.functions.similarity import token_set
from eventloom.functions import registry
from eventloom.functions.snippet import REPORT, SITE, with_snippet
from eventloom.operators import aggregates, classify, cluster, dedup, filters, store, windows
from eventloom.sources import apis, export, ics, registries, web
from eventloom.streaming import jobs


def one(spark, column, **values):
    """Evaluate a column over one row of string values."""
    df = spark.createDataFrame([tuple(values.values())] or [(1,)], ", ".join(f"{k} string" for k in values) or "x int")
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "value, zone, want",
    [
        ("20250115T200000Z", "America/Los_Angeles", "2025-01-15T12:00:00-08:00"),
        ("20250115T190000", "America/Los_Angeles", "2025-01-15T19:00:00-08:00"),
        ("20250615T190000", "America/Los_Angeles", "2025-06-15T19:00:00-07:00"),
        ("20250115", "America/Los_Angeles", "2025-01-15T00:00:00-08:00"),
        ("20250115T190000", "America/New_York", "2025-01-15T19:00:00-05:00"),
        ("20250615T190000", "Asia/Kolkata", "2025-06-15T19:00:00+05:30"),
        ("garbage", "America/Los_Angeles", None),
    ],
)
def test_iso_text(spark, value, zone, want):
    at = dates.instant(F.col("v"), F.col("z"))
    assert one(spark, dates.iso_local(at, F.col("z")), v=value, z=zone) == want


@pytest.mark.parametrize("wall, utc", [("20260308T023000", "2026-03-08 10:30:00"), ("20261101T013000", "2026-11-01 08:30:00")])
def test_clock_changes(spark, wall, utc):
    got = one(spark, dates.instant(F.col("v"), F.lit("America/Los_Angeles")).cast("string"), v=wall)
    assert got == utc


CALENDAR = """BEGIN:VCALENDAR\r
PRODID:-//Meetup//Meetup Calendar//EN\r
BEGIN:VEVENT\r
UID:one\r
DTSTART;TZID=America/New_York:20260615T180000\r
DTEND:20260616T000000Z\r
SUMMARY:Talk\\, part 1\\; long \r
 title\r
LOCATION:Hall\r
X-SOURCE-ID:x\r
CATEGORIES:a, b ,,c\r
IMAGE;DISPLAY=BADGE:https://i/badge\r
IMAGE;DISPLAY=FULLSIZE:https://i/full\r
END:VEVENT\r
BEGIN:VEVENT\r
UID:two\r
DTSTART;VALUE=DATE:20260622\r
SUMMARY:Day\r
X-SOURCE:Own Name\r
URL:https://x/2020/01/e\r
X-WP-IMAGES-URL:medium\\;https://i/m\\;1\\;2\\,large\\;https://i/l\\;1\\;2\r
END:VEVENT\r
BEGIN:VEVENT\r
UID:one\r
DTSTART;TZID=Bad/Zone:20260616T180000\r
SUMMARY:Later copy\r
END:VEVENT\r
END:VCALENDAR\r
"""


def test_ics_stages(spark, tmp_path):
    (tmp_path / "my_3d_feed.ics").write_bytes(CALENDAR.encode() + b"\xff")
    (tmp_path / "combined.ics").write_text(CALENDAR)
    files = ics.read_files(spark, str(tmp_path))
    rows = ics.parse(files).orderBy("pos").collect()
    assert [r.title for r in rows] == ["Talk, part 1; long title", "Day", "Later copy"]
    assert rows[0].tzid == "America/New_York" and rows[0].ics_categories == ["a", "b", "c"]
    assert [r.image_url for r in rows] == ["https://i/full", "https://i/l", None]
    assert [r.x_source for r in rows] == [None, "Own Name", None]
    names = spark.createDataFrame([], "stem string, name string")
    falls = spark.createDataFrame([("my_3d_feed", "https://fall/")], "stem string, fallback string")
    named = ics.name_sources(ics.parse(files), names, falls)
    assert {r.source for r in named.collect()} == {"My 3D Feed", "Own Name"}
    now = F.expr("TIMESTAMP_NTZ '2026-06-01 00:00:00'")
    kept = ics.combine(named, now, 2026, 6)
    assert [r.title for r in kept.collect()] == ["Talk, part 1; long title"]  # a stale URL and a repeated uid go
    out = ics.convert(named, F.lit("America/Los_Angeles"), F.expr("TIMESTAMP '2026-06-01 00:00:00'")).collect()
    assert [(r.start_time, r.end_time, r.all_day) for r in out] == [
        ("2026-06-15T18:00:00-04:00", "2026-06-15T20:00:00-04:00", False),
        ("2026-06-16T18:00:00-07:00", None, False),
        ("2026-06-22T00:00:00-07:00", None, True),
    ]
    assert registries.prodids(files).first()["platform"] == "Meetup"
    preview = filters.feed_preview_counts(named.withColumn("start_time", dates.wall_clock(F.col("dtstart_raw"))), F.expr("TIMESTAMP_NTZ '2026-06-16 00:00:00'")).first()
    assert (preview.total, preview.future, preview.has_recurrence) == (3, 2, False)
    lines = [r.line for r in export.calendar_lines(named.withColumn("dtstart", F.col("dtstart_raw")), "Mine", "vevent").collect()]
    assert lines[0].startswith("BEGIN:VCALENDAR") and lines[-1] == "END:VCALENDAR" and len(lines) == 5


def test_saturday_rule(spark):
    df = spark.createDataFrame([(1, "FREQ=WEEKLY;BYDAY=SA;COUNT=8", datetime(2026, 6, 15, 14, 30))], "id long, rrule string, start_time timestamp_ntz")
    got = [r.occurrence for r in recurrence.expand(df, "rrule", "start_time", F.lit(date(2026, 6, 1)), F.lit(date(2026, 12, 31))).orderBy("occurrence").collect()]
    days = [(6, 20), (6, 27), (7, 4), (7, 11), (7, 18), (7, 25), (8, 1), (8, 8)]
    assert got == [datetime(2026, m, d, 14, 30) for m, d in days]


def random_rule(rnd):
    """A rule whose parts dateutil and the standard read alike, and a start."""
    pick = lambda xs, n: sorted(rnd.sample(xs, rnd.randint(1, n)))
    days = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]
    listed = lambda xs: ",".join(map(str, xs))
    freq = rnd.choice(["DAILY", "WEEKLY", "MONTHLY", "YEARLY"])
    rule = [f"FREQ={freq}"]
    if rnd.random() < 0.5:
        rule.append(f"INTERVAL={rnd.randint(1, 3)}")
    if rnd.random() < 0.35:
        rule.append(f"BYMONTH={listed(pick(range(1, 13), 4))}")
    monthly = freq == "MONTHLY" or "BYMONTH" in rule[-1]
    kind = rnd.random()
    if kind < 0.45:
        numbered = freq in ("MONTHLY", "YEARLY") and rnd.random() < 0.5
        most = 4 if monthly else 40
        rule.append(f"BYDAY={listed(f'{rnd.choice([-1, 1]) * rnd.randint(1, most)}{d}' if numbered else d for d in pick(days, 3))}")
    elif kind < 0.65 and freq != "WEEKLY":
        rule.append(f"BYMONTHDAY={listed(pick([1, 2, 13, 15, 28, 30, 31, -1, -3], 3))}")
    elif kind < 0.75 and freq == "YEARLY":
        rule.append(f"BYYEARDAY={listed(pick([1, 60, 100, 366, -1, -200], 3))}")
    elif kind < 0.85 and freq == "YEARLY":
        rule += [f"BYWEEKNO={listed(pick([1, 10, 20, 52, 53, -1, -2], 3))}", f"BYDAY={listed(pick(days, 3))}"]
    if rnd.random() < 0.2:
        rule += [f"BYHOUR={listed(pick(range(8, 22), 2))}", f"BYMINUTE={listed(pick([0, 15, 30], 2))}"]
    if rnd.random() < 0.3 and len(rule) > 1 and freq != "DAILY":
        rule.append(f"BYSETPOS={listed(pick([1, 2, 3, -1, -2], 2))}")
    if rnd.random() < 0.4:
        rule.append(f"WKST={rnd.choice(days)}")
    ending = rnd.random()
    if ending < 0.3:
        rule.append(f"COUNT={rnd.randint(1, 20)}")
    elif ending < 0.6:
        rule.append(f"UNTIL=2026{rnd.randint(1, 12):02d}{rnd.randint(1, 28):02d}T{rnd.choice(['000000', '120000', '190000'])}")
    return ";".join(rule), datetime(2025, rnd.randint(1, 12), rnd.randint(1, 28), rnd.choice([0, 9, 19]), rnd.choice([0, 30]))


def test_rules_equal_dateutil(spark):
    """300 rules, the six of old, and those that were wrong once, over a window of half a year."""
    rrulestr = pytest.importorskip("dateutil.rrule").rrulestr
    rnd = random.Random(5)
    start = datetime(2026, 1, 6, 19, 0)
    fixed = [
        "FREQ=DAILY;INTERVAL=3", "FREQ=WEEKLY;BYDAY=MO,WE;UNTIL=20260301T235959", "FREQ=MONTHLY;BYDAY=-1TU", "FREQ=MONTHLY;COUNT=4", "FREQ=YEARLY", "FREQ=WEEKLY;INTERVAL=2;COUNT=5",
        "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1", "FREQ=DAILY;BYMONTH=2", "FREQ=WEEKLY;BYDAY=TU;UNTIL=20260203T120000", "FREQ=WEEKLY;INTERVAL=2;WKST=SU;BYDAY=SU,TU",
        "FREQ=MONTHLY;BYMONTHDAY=15", "FREQ=MONTHLY;BYMONTHDAY=-1", "FREQ=YEARLY;BYMONTH=3;BYDAY=2SU", "FREQ=YEARLY;BYDAY=20MO", "FREQ=MONTHLY;BYDAY=FR;BYMONTHDAY=13",
    ]
    rules = [(r, start) for r in fixed] + [random_rule(rnd) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "id long, rrule string, start_time timestamp_ntz")
    lo, hi = date(2026, 1, 1), date(2026, 6, 30)
    got = defaultdict(list)
    for r in recurrence.expand(df, "rrule", "start_time", F.lit(lo), F.lit(hi)).collect():
        got[r.id].append(r.occurrence)
    wrong = []
    for i, (rule, at) in enumerate(rules):
        want = rrulestr(rule, dtstart=at).between(datetime(2026, 1, 1), datetime(2026, 6, 30, 23, 59, 59), inc=True)
        if sorted(got[i]) != want:
            wrong.append((rule, at, sorted(got[i])[:4], want[:4], len(got[i]), len(want)))
    assert not wrong, (len(wrong), wrong[:6])
    assert sum(map(len, got.values())) > 3000


def test_sets_and_unsound_rules(spark):
    rows = [
        (1, "FREQ=WEEKLY;UNTIL=20260120", datetime(2026, 1, 6, 19), [datetime(2026, 1, 13, 19)], [datetime(2026, 1, 7, 8), datetime(2026, 1, 20, 19), datetime(2027, 1, 1)]),
        (2, "FREQ=HOURLY", datetime(2026, 1, 6, 19), None, None),
        (3, "FREQ=DAILY;BYEASTER=1", datetime(2026, 1, 6, 19), None, None),
        (4, "", datetime(2026, 1, 6, 19), [datetime(2026, 1, 6, 19)], None),
        (5, None, None, None, None),
        (6, "FREQ=DAILY;UNTIL=20260108T000000Z", datetime(2026, 1, 6, 19), None, None),
        (7, "COUNT=3", datetime(2026, 1, 6, 19), None, None),
        (8, "rrule:freq=daily;count=2", datetime(2026, 1, 6, 19), None, None),
    ]
    df = spark.createDataFrame(rows, "id long, rrule string, start_time timestamp_ntz, gone array<timestamp_ntz>, more array<timestamp_ntz>")
    got = defaultdict(list)
    ny = F.lit("America/New_York")
    for r in recurrence.expand(df, "rrule", "start_time", F.lit(date(2026, 1, 1)), F.lit(date(2026, 1, 31)), excluded="gone", added="more", zone=ny).collect():
        got[r.id].append(r.occurrence)
    once = [datetime(2026, 1, 6, 19)]
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [datetime(2026, 1, 6, 19), datetime(2026, 1, 7, 8), datetime(2026, 1, 20, 19)], 2: once, 3: once, 6: [*once, datetime(2026, 1, 7, 19)], 7: once, 8: [*once, datetime(2026, 1, 7, 19)],
    }  # UNTIL of 6 is 19:00 of 7 January in New York
    days = df.select("id", "rrule", "start_time", F.array(F.lit(date(2026, 1, 13))).alias("gone")).where("id = 1")
    assert recurrence.expand(days, "rrule", "start_time", F.lit(date(2026, 1, 1)), F.lit(date(2026, 1, 31)), excluded="gone").count() == 2


def test_moved_instances(spark):
    body = "\r\n".join([
        "BEGIN:VCALENDAR", "BEGIN:VEVENT", "UID:a", "DTSTART;TZID=America/New_York:20260106T190000", "RRULE:FREQ=WEEKLY;COUNT=4",
        "EXDATE;TZID=America/New_York:20260113T190000", "EXDATE:20260128T000000Z", "RDATE;VALUE=DATE:20260131", "END:VEVENT",
        "BEGIN:VEVENT", "UID:a", "RECURRENCE-ID:20260121T000000Z", "DTSTART;TZID=America/New_York:20260122T200000", "SUMMARY:moved", "END:VEVENT", "END:VCALENDAR",
    ])
    files = spark.createDataFrame([("f", body)], "file string, content string")
    rows = ics.with_recurrence(ics.parse(files), F.lit("America/New_York"))
    got = recurrence.expand_events(rows, F.lit(date(2026, 1, 1)), 60, F.lit("America/New_York")).orderBy("start_time").collect()
    assert [(r.start_time, r.uid, r.title) for r in got] == [
        (datetime(2026, 1, 6, 19), "a__20260106", None), (datetime(2026, 1, 22, 20), "a__20260122", "moved"), (datetime(2026, 1, 31, 19), "a__20260131", None),
    ]


def test_next_occurrence_in_far_years(spark):
    rows = [(1, "FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=29", datetime(2024, 2, 29, 9)), (2, "FREQ=DAILY;COUNT=2", datetime(2024, 1, 1)), (3, None, datetime(2099, 1, 1)), (4, None, datetime(2026, 5, 1))]
    df = spark.createDataFrame(rows, "id long, rrule string, start_time timestamp_ntz")
    got = {r.id: r.next_start for r in recurrence.next_occurrence(df, F.expr("TIMESTAMP_NTZ '2026-01-08 09:01:00'")).collect()}
    assert got == {1: datetime(2028, 2, 29, 9), 3: datetime(2099, 1, 1), 4: datetime(2026, 5, 1)}


def test_event_expansion_window(spark):
    rows = [("f", "u1", "FREQ=WEEKLY", datetime(2026, 1, 1, 9)), ("f", "u2", None, datetime(2027, 1, 1, 9)), ("g", "u3", None, datetime(2027, 1, 1, 9))]
    df = spark.createDataFrame(rows, "file string, uid string, rrule string, start_time timestamp_ntz")
    got = sorted((r.file, r.uid) for r in recurrence.expand_events(df, F.lit(date(2026, 1, 10)), 14).collect())
    assert got == [("f", "u1__20260115"), ("f", "u1__20260122"), ("g", "u3")]  # u2 lies beyond its file's window


def test_enrichments_and_next(spark):
    df = spark.createDataFrame([(7, "FREQ=WEEKLY", datetime(2026, 1, 1, 9), "Ann")], "id long, rrule string, start_time timestamp_ntz, curator_name string")
    got = recurrence.expand_enrichments(df, F.lit(date(2026, 1, 8)), F.lit(date(2026, 1, 15))).collect()
    assert {r.virtual_id for r in got} == {"enrichment-7-20260108", "enrichment-7-20260115"} and got[0].source == "Picks: Ann"
    assert recurrence.next_occurrence(df, F.expr("TIMESTAMP_NTZ '2026-01-08 09:01:00'")).first().next_start == datetime(2026, 1, 15, 9)


@pytest.mark.parametrize(
    "url, slug",
    [
        ("https://www.meetup.com/asheville-hiking-group/events/ical/", "meetup_asheville_hiking_group"),
        ("https://tockify.com/api/feeds/ics/ashevillefarmers", "tockify_ashevillefarmers"),
        ("https://www.buncombenc.gov/common/modules/iCalendar/iCalendar.aspx?catID=40&feed=calendar", "civicplus_buncombenc_40"),
        ("https://calendar.google.com/calendar/ical/abc123%40group.calendar.google.com/public/basic.ics", "gcal_abc123"),
        ("https://example.libcal.com/ical_subscribe.php?cid=1234", "libcal_example_1234"),
        ("https://example.campuslabs.com/engage/events.ics", "campuslabs_example"),
        ("https://www.ashevillecityschools.net/fs/calendar-manager/events.ics?calendar_ids[]=24&calendar_ids[]=10&calendar_ids[]=6", "ashevillecityschools_cal_24_10_6"),
        ("https://events.iu.edu/live/ical/events/group_id/56", "events_livewhale_56"),
        ("https://www.site.org/events/list/jazz/club/x", "site_jazz_club"),
    ],
)
def test_slugs(spark, url, slug):
    assert one(spark, urls.feed_slug(F.col("u")), u=url) == slug


@pytest.mark.parametrize(
    "a, b, score",
    [
        ("One-On-One Tech Help", "Tech Help", 1.0), ("Bilingual Family Storytime", "Family Storytime", 1.0),
        ("Community Coffee Tasting", "Community Yoga", 0.783), ("Mushroom Hike", "Mushroom Identification", 0.762),
        ("Karaoke Sundays", "Sabroso Sundays", 0.733), ("Honky Tonk Open Mic", "Open Mic Night", 0.727), ("", "", 1.0), ("", "x", 0.0),
    ],
)
def test_token_set(a, b, score):
    assert token_set(a, b) == pytest.approx(score, abs=5e-4)


def test_normalize_title(spark):
    key = lambda t: one(spark, text.normalize_title(F.col("t")), t=t)
    assert key("The Sam Grisman Project") == key("Sam Grisman Project") == "samgrismanproject"
    assert key("Café – Été!") == "caféété" and len(key("x" * 99)) == 40
    assert one(spark, text.title_case(F.col("t")), t="3d x's") == "3D X'S"


def test_prefix_groups(spark):
    rows = [
        (date(2026, 1, 1), "handsonahardbody", False), (date(2026, 1, 1), "handsonahardbodyatspreckelsperforming", True),
        (date(2026, 1, 2), "afterschoolclub", False), (date(2026, 1, 2), "afterschoolclubrobotics", False), (date(2026, 1, 3), "short", True), (date(2026, 1, 3), "shortandlong", True),
    ]
    cities = [("a", *r) for r in rows] + [("b", *rows[1]), ("c", *rows[0])]  # no city's keys meet another's
    df = spark.createDataFrame(cities, "city string, day date, title_key string, has_agg boolean")
    got = {(r.city, r.title_key): r.merged_key for r in cluster.prefix_groups(df).collect()}
    assert got.pop(("a", "handsonahardbodyatspreckelsperforming")) == "handsonahardbody"
    assert len(got) == 7 and all(k == v for (_, k), v in got.items())


def test_prefix_groups_query_reads_whole_titles(spark, tmp_path):
    """Against the greedy pass over each whole day, on nested titles of up to 50 letters."""
    import random

    from eventloom.plans import queries

    rnd = random.Random(2)
    texts = ["Hands on a Hard Body", "Hands on a Hard Body at Spreckels", "Hands on a Hard Body at Spreckels performing arts", "short", None]
    for _ in range(200):
        texts.append((rnd.choice(texts) or "hands")[:40] + " " + "".join(rnd.choices("ab", k=rnd.randint(1, 9))))
    rows = [(i, t, rnd.choice(["src0", "src1", "src1"])) for i, t in enumerate(texts)]
    rows = [(i, t, s, "en") for i, t, s in rows]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    want, days = {}, {}
    for i, t, source, _ in rows:
        key = t and "".join(c for c in t.lower() if c.isalnum())[:40]
        day = days.setdefault(i % 7 + 1, {})
        day[key] = day.get(key, False) or source == "src0"
    for d, keys in days.items():
        order = sorted((k for k in keys if k), key=lambda k: (len(k), k))
        want |= {(d, k): k for k in keys}
        for at, short in enumerate(order):
            agg = keys[short]
            for long in order[at + 1 :] if len(short) >= 12 and want[d, short] == short else ():
                if want[d, long] == long and long.startswith(short) and len(short) / len(long) <= 0.75 and (agg or keys[long]):
                    want[d, long], agg = short, agg or keys[long]
    assert sum(len(k or "") > 21 and m != k for (_, k), m in want.items()) > 5
    got = {(r.day.day, r.title_key): r.merged_key for r in queries.e3_prefix_groups(spark, str(tmp_path)).collect()}
    assert got == want


def test_clusters_are_transitive(spark):
    t = datetime(2026, 1, 1)
    rows = [(1, "Open Mic Night", "A", t), (2, "Open Mic Night", None, t), (3, "Open Mic Night", "B", t), (4, "Yoga", None, t), (5, "Open Mic Night", "A", datetime(2026, 1, 2))]
    df = spark.createDataFrame(rows, "id long, title string, location string, start_time timestamp_ntz")
    got = {r.id: r.cluster_id for r in cluster.cluster_titles(df, ["start_time"]).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: None, 5: None}  # an event alone in its slot has no cluster
    kept = {r.id for r in cluster.legacy_dedupe(df, ["start_time"]).collect()}
    assert kept == {1, 4, 5}


def test_merge_groups(spark):
    rows = [(1, "k", "Agg", "http://a"), (2, "k", "Zed", "http://z"), (3, "k", "Ann, Agg", "http://n")]
    df = spark.createDataFrame(rows, "pos long, key string, source string, url string")
    r = dedup.merge_groups(df, ["key"], F.array(F.lit("Agg"))).first()
    assert (r.pos, r.source, r.source_urls) == (2, "Ann, Zed, Agg", {"Agg": "http://n", "Zed": "http://z", "Ann": "http://n"})


GEO = [(None, True), ("", True), ("Zoom", True), ("Napa County Fair, CA 94558", True), ("Lake Berryessa Library", False), ("Some Theater", True),
       ("1 Main Street, Reno, NV", False), ("K0K1E0 somewhere", False), ("12 Elm St Napa", True), ("Room 12345", False)]


@pytest.mark.parametrize("place, kept", GEO)
def test_area(spark, place, kept):
    assert one(spark, geo.in_area(F.col("p"), ("napa",), ("berryessa",)), p=place) is kept
    assert one(spark, geo.in_area(F.col("p"), (), ("berryessa",)), p=place) is True


def test_source_names(spark):
    def names(values):
        df = spark.createDataFrame([(i, "c", s) for i, s in enumerate(values)], "id long, city string, source string")
        return {r["name"]: r.event_count for r in aggregates.source_names(df).collect()}

    school, design = "IU Eskenazi School of Art, Architecture + Design", "Architecture + Design, Eskenazi Museum of Art"
    got = names([school, school, design])
    assert got["Architecture + Design"] == 3 and got["IU Eskenazi School of Art"] == 2
    assert names(["IU Cinema"] * 3 + ["IU Cinema, IU Arts & Humanities Institute", "Eskenazi Museum of Art, IU Cinema"])["IU Cinema"] == 5
    assert names(["Real Source, ", "", "A,,B"]) == {"Real Source": 1, "A": 1, "B": 1}


def test_stale_delete(spark):
    def run(stored, incoming):
        s = spark.createDataFrame([(i, "c", u) for i, u in enumerate(stored)], "id long, city string, source_uid string")
        return store.delete_stale(s, "c", spark.createDataFrame([(u,) for u in incoming], "source_uid string"))

    assert run("abcd", "abc")[1] == 1 and run("ab", "ab")[1] == 0
    assert run(["old-1", "old-2"], ["new-1", "new-2"])[1] == 2
    assert run(["survivor"], [str(i) for i in range(3500)] + ["survivor"])[1] == 0
    with pytest.raises(store.StaleDeleteRefused):
        run("abcdefghij", "a")
    kept, gone = run([*"abcdefghij"], [*"abcde"])
    assert gone == 5 and kept.count() == 5
    assert run("ab", [])[1] == 0
    kept, gone = run(["a", None], ["a"])
    assert gone == 0 and kept.count() == 2


def test_feed_history(spark):
    def kinds(*days):
        rows = [("c", "f", date(2026, 1, 1 + i), n, "x" if n is None else None) for i, n in enumerate(days)]
        df = spark.createDataFrame(rows, "city string, feed string, date date, count int, error string")
        return [r.anomaly for r in windows.feed_anomalies(df).orderBy("date").collect()]

    assert kinds(10, 0) == ["zero_events"] and kinds(10, 5) == ["significant_drop"]
    assert kinds(10, 6) == kinds(4, 1) == [] and kinds(10, None, 5) == ["significant_drop"] and kinds(0, 0) == []
    rows = [("c", "f", date(2026, 1, d), n, e) for d, n, e in ((1, 7, None), (2, 0, None), (3, 0, "x"), (4, 0, None), (5, 0, None))]
    df = spark.createDataFrame(rows, "city string, feed string, date date, count int, error string")
    r = windows.silent_feeds(df).first()
    assert (r.was, r.was_date, r.silent_since) == (7, date(2026, 1, 1), date(2026, 1, 4))


def test_collapse_needs_five(spark):
    rows = [(i, "T", "L", datetime(2026, 1, 1 + i, 10)) for i in range(5)] + [(10 + i, "U", "L", datetime(2026, 1, 1 + i, 10)) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, title string, location string, start_time timestamp_ntz")
    got = windows.collapse_long_running(df, F.lit(date(2026, 1, 3)), by=()).collect()
    assert sorted(r.id for r in got if r.is_recurring) == [0, 2] and sum(not r.is_recurring for r in got) == 4
    cities = df.withColumn("city", F.when(F.col("id") < 2, "a"))  # three of five remain in one city
    assert not any(r.is_recurring for r in windows.collapse_long_running(cities, F.lit(date(2026, 1, 3))).collect())


def test_paging():
    assert windows.next_start(0, 50, 120) == 49 and windows.next_start(98, 50, 120) is None


LOG = """[davis][scrape] RUN python scrapers/a.py
2026 - Logger - ERROR - 404 Client Error: x
[davis][scrape] EXIT 0 python scrapers/a.py
[davis][load] RUN load
2026 - Logger - WARNING - Broken property
Traceback (most recent call last):
[davis][load] EXIT 2 load
"""


def test_build_log(spark, tmp_path):
    (tmp_path / "b.log").write_text(LOG)
    got = [(r.phase, r.level, r.kind) for r in registries.build_issues(registries.lines(spark, str(tmp_path))).orderBy("line_no").collect()]
    assert got == [("scrape", "error", "http_error"), ("load", "warning", "parse_warning"), ("load", "error", "traceback"), ("load", "error", "error")]


def test_registries(spark, tmp_path):
    (tmp_path / "feeds.txt").write_text("# One\nhttps://a/\n\n# Two\n# Three\nhttps://b/\n")
    got = [(r.url, r["name"]) for r in registries.feed_registry(registries.lines(spark, str(tmp_path))).collect()]
    assert got == [("https://a/", "One"), ("https://b/", "Three")]


PAGE = """<html><script type="application/ld+json">{"@graph":[{"@type":"MusicEvent","name":"A","startDate":"2026-01-02T10:00:00",
"location":{"name":"Hall","address":{"streetAddress":"1 Elm","addressLocality":"Napa"}}},{"@type":"Place","name":"no"}]}</script>
<script type="application/ld+json">[{"@type":"Event","name":"B","startDate":"2026-01-03","location":{"address":"Elsewhere"}}]</script>
<script type="application/ld+json">{"@type":"School","event":[{"@type":"Thing","name":"C","startDate":"2026-01-04"}]}</script>
<script type="application/ld+json">{"itemListElement":[{"item":{"@type":"Festival","name":"D","startDate":"2026-01-05"}}]}</script>
<script type="application/ld+json">{"@type":"Event","name":"E","description": "say "hi" now", "startDate":"2026-01-06"}</script></html>"""


def test_jsonld(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>none</p>")], "page_id long, html string")
    got = {r.title: r.location for r in web.jsonld_records(web.jsonld_events(web.jsonld_blocks(pages))).collect()}
    assert got == {"A": "Hall, 1 Elm, Napa", "B": "Elsewhere", "C": "", "D": "", "E": ""}


def test_jsonld_filters(spark):
    blocks = web.jsonld_blocks(spark.createDataFrame([(1, PAGE)], "page_id long, html string"))
    kept = web.jsonld_records(web.jsonld_events(blocks), now=F.lit("2026-01-03").cast("timestamp"), location_part="WHERE")
    assert [r.title for r in kept.collect()] == ["B"]


def test_sql_functions_and_hooks(spark):
    registry.register(spark)
    row = spark.sql("SELECT token_set_similarity('Jazz Night', 'night jazz') AS a, html_unescape('a &amp; b') AS b, title_words('B a b') AS c, sequence_similarity('x', 'x') AS d").first()
    assert (row.a, row.b, row.c, row.d) == (1.0, "a & b", ["a", "b"], 1.0)
    body = '{"events":[{"title":"Keep","start_date":"2026-01-02 10:00:00"},{"title":"Drop","start_date":"2026-01-02 10:00:00"}]}'
    responses = spark.createDataFrame([("s", body)], "source string, body string")
    made = apis.api_events(responses, "tribe", keep=F.get_json_object("o", "$.title") != "Drop", change=lambda df: df.withColumn("title", F.upper("title")))
    assert [r.title for r in made.collect()] == ["KEEP"]
    library = '{"entities":{"events":{"1":{"definition":{"title":"T","start":"2026-01-02T10:00","audienceIds":["x","y"]}},"2":{"definition":{"title":"U","start":"2026-01-02T10:00","audienceIds":["y"]}},"3":{"definition":{"title":"V","start":"2026-01-02T10:00","isCancelled":true,"audienceIds":["y"]}}}}}'
    pages = spark.createDataFrame([("s", library)], "source string, body string")
    assert [r.title for r in apis.api_events(pages, "bibliocommons", keep=apis.first_audience(("x", "y"), "y")).collect()] == ["U"]


def test_rss_and_apis(spark):
    xml = "<rss><item><title><![CDATA[A & B]]></title><link>http://x</link><pubDate>Fri, 02 Jan 2026 10:00:00 +0000</pubDate></item></rss>"
    r = web.rss_items(spark.createDataFrame([("f", xml)], "feed string, xml string")).first()
    assert (r.title, r.link, r.published) == ("A & B", "http://x", datetime(2026, 1, 2, 10))
    body = '{"events":[{"title":"T","start_date":"2026-01-02 10:00:00","venue":{"venue":"V"},"url":"u"},{"title":""}]}'
    r = apis.api_events(spark.createDataFrame([("s", body)], "source string, body string"), "tribe").collect()
    assert [(x.title, x.location) for x in r] == [("T", "V")]
    body = '{"data":{"settings":{"locations":[{"id":"1","name":"L"}],"eventTypes":[{"id":"9","name":"Kind"}],"events":[{"name":"N","start":{"date":"2026-01-02","time":"10:00"},"location":["1"],"eventType":"9"}]}}}'
    r = apis.elfsight_events(spark.createDataFrame([("s", body)], "source string, body string"), F.lit("2026-01-01").cast("timestamp_ntz")).first()
    assert (r.title, r.location, r.types, len(r.uid)) == ("N", "L", ["Kind"], 16)
    page = '<div class="em-event x"><h3 class="em-item-title"><a>Jazz</a> Night</h3><div class="em-event-date">Jan 2<br>2026</div></div>'
    r = web.html_events(spark.createDataFrame([("s", page)], "source string, html string"), "em_events").first()
    assert (r.title, r.start_text) == ("Jazz Night", "Jan 22026")


def test_text_helpers(spark):
    assert one(spark, text.term_snippet(F.col("d"), F.lit("FOX")), d="x" * 50 + "\n the fox runs") == "..." + "x" * 35 + " the **fox** runs"
    assert one(spark, html.html_text(F.col("h")), h="&lt;b&gt;x&lt;/b&gt; &amp; y") == "x & y"
    assert one(spark, labels.feed_content(F.col("c")), c=" <!DOCTYPE html>") == "not_ics:html"
    assert one(spark, labels.platform(F.col("p")), p="-//Org Name//domain.com//") == "skip"
    assert one(spark, labels.recurrence_in_text(F.col("t")), t="Meets every other Tuesday") is None
    assert one(spark, labels.recurrence_in_text(F.col("t")), t="the 2nd Friday of the month") == "FREQ=MONTHLY;BYDAY=2FR"
    assert one(spark, dates.normalize_captured(F.col("t")).cast("string"), t="2026-01-02") == "2026-01-02 19:00:00"
    assert one(spark, dates.parse_date(F.col("t")).cast("string"), t="Friday, January 2nd, 2026") == "2026-01-02"
    assert one(spark, dates.parse_time(F.col("t")), t="7:30 p.m.") == "19:30"
    assert one(spark, text.clean_command(F.col("t")), t="python scrapers/a.py --output x.ics  -q") == "python scrapers/a.py -q"


def test_exports(spark):
    df = spark.createDataFrame([(1, "A, B", datetime(2026, 1, 2), datetime(2026, 1, 2), "Hall, 1 Elm", "Film / Cinema", "", None, "u")], "id long, title string, start_time timestamp, end_time timestamp, location string, category string, description string, image_url string, url string")
    got = df.select(export.jsonld().alias("j")).first().j
    assert '"@type":"ScreeningEvent"' in got and '"streetAddress":"1 Elm"' in got and "endDate" not in got and "image" not in got


def test_classify_fans_out(spark):
    rows = [(1, " Jazz Concert", None, None), (2, "jazz concert ", None, ""), (3, "Other", "with yoga", None), (4, "Jazz Concert", None, "Food / Drink"), (5, None, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, description string, category string")
    got = {r.id: r.category for r in classify.classify(df).collect()}
    assert got == {1: "Music / Concerts", 2: "Music / Concerts", 3: "Health / Wellness", 4: "Food / Drink", 5: None}


def test_snippets(spark):
    rows = [
        ("Tickets here. Join us for a night of music by the river! Zoom link", "Music", "Join us for a night of music by the river!", None),
        ("<p>A &amp; B play<br>the very best of all the music</p>", "x", "the very best of all the music", None),
        ("About us: come and join the very best of all singers from the town.", None, "About us: come and join the very best of all singers from the town.", "come and join the very best of all singers from the town."),
        ("x" * 40 + " and the " + "y" * 51 + " z.", None, "x" * 40 + " and the " + "y" * 51 + "...", "x" * 40 + " and the..."),
        ("Join from almost anywhere in the world and sing with us.", None, None, "Join from almost anywhere in the world and sing with us."),
        ("The Jazz Night at the club", "The Jazz Night at the Club", None, None),
        ("", "x", None, None), ("too short", None, None, None), (None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, description string, title string")
    for variant, at in ((SITE, 2), (REPORT, 3)):
        got = {r.i: r.snippet for r in with_snippet(df, variant=variant).collect()}
        assert got == {i: r[3] if at == 3 and r[3] else r[2] for i, r in enumerate(rows)}


def test_dates_in_texts(spark):
    days = {
        "on 2026-02-03": "2026-02-03", "02.03.26": "2026-02-03", "Feb 3 2026": "2026-02-03", "Sat February 3, 2026 at 7": "2026-02-03", "Friday, January 2nd, 2026": "2026-01-02",
        "2/3/26": "2026-02-03", "3 Mar 2026": "2026-03-03", "Smarch 3, 2026": None, "2026-13-45": None, "Feb 3": None, "": None,
    }
    times = {"7:30 p.m.": "19:30", "Doors 7pm": "19:00", "12AM": "00:00", "12:15 PM": "12:15", "18:00": "18:00", "2026-01-02": None, "7": None, "25:00": None, "noon": "12:00", "": None}
    for text_, want in days.items():
        assert one(spark, dates.parse_date(F.col("t")).cast("string"), t=text_) == want, text_
    assert one(spark, dates.parse_date(F.col("t"), 2027).cast("string"), t="Room 4, Feb 3") is None  # the first word and number decide
    assert one(spark, dates.parse_date(F.col("t"), 2027).cast("string"), t="Feb 3") == "2027-02-03"
    for text_, want in times.items():
        assert one(spark, dates.parse_time(F.col("t")), t=text_) == want, text_


def test_clusters_keep_every_event(spark):
    rows = [
        (1, "Jazz Night", "Hall", "a"), (2, "jazz night", "", "a"), (3, "Night Jazz", "Bar", "a"), (4, "Chess", None, "a"), (5, "Jazz Night", "Hall", "b"), (6, "Jazz Night", "Hall", "b"),
        (7, "Poetry slam", "x", "b"), (8, "Poetry slams", "", "b"), (9, "Jazz Night", "Hall", None), (10, "Jazz Night", "Hall", None), (11, None, None, "a"), (12, "Chess club", "x", "a"), (13, "Chess club", "y", "a"),
    ]
    df = spark.createDataFrame(rows, "id long, title string, location string, slot string")
    got = {r.id: r.cluster_id for r in cluster.cluster_titles(df, ["slot"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1, 8: 1, 9: None, 10: None, 11: None, 12: 0, 13: 0}
    kept = {r.id for r in cluster.legacy_dedupe(df.fillna({"slot": "a"}), ["slot"]).collect()}
    assert kept == {1, 3, 4, 5, 7, 11, 12}


def test_upsert_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "source_uid string, city string, id long, start_time timestamp"
    add = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    add([("a", "x", 1, datetime(2026, 1, 1)), ("b", "x", 2, datetime(2026, 1, 1)), (None, "x", 3, datetime(2026, 1, 1))])
    run = lambda: jobs.upsert_stream(spark.readStream.schema(schema).parquet(src), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    add([("a", "y", 9, datetime(2026, 1, 2))])
    run()
    state = lambda: {(r.source_uid, r.city, r.id) for r in jobs.read_current(spark, str(tmp_path / "t")).collect()}
    assert state() == {("a", "y", 9), ("b", "x", 2)}
    # a batch that was published before its commit is replayed
    for f in sorted((tmp_path / "c" / "commits").glob("*1*")):
        f.unlink()
    run()
    assert state() == {("a", "y", 9), ("b", "x", 2)} and jobs.latest(spark, str(tmp_path / "t"))[0] == 2
    # another checkpoint goes on from the current generation
    add([("c", "z", 11, datetime(2026, 1, 3))])
    jobs.upsert_stream(spark.readStream.schema(schema).parquet(src), str(tmp_path / "t"), str(tmp_path / "c2")).awaitTermination()
    assert {u for u, _, _ in state()} == {"a", "b", "c"}


def test_history_and_refresh(spark, tmp_path):
    schema = "city string, feed string, date date, count int, error string, seq long"
    src, table = str(tmp_path / "in"), str(tmp_path / "h")
    add = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    run = lambda: jobs.history_stream(spark.readStream.schema(schema).parquet(src), table, str(tmp_path / "c"), 2).awaitTermination()
    day = lambda n: datetime(2026, 1, n).date()
    add([("x", "f", day(1), 3, None, 1), ("x", "f", day(2), 4, None, 2), ("x", "g", day(2), 4, None, 3)])
    run()
    add([("x", "f", day(2), 5, None, 4), ("x", "f", day(3), 6, None, 5)])
    run()
    assert {(r.feed, r.date.day, r["count"]) for r in jobs.read_current(spark, table).collect()} == {("f", 2, 5), ("f", 3, 6), ("g", 2, 4)}
    assert jobs.refresh(spark.range(3), str(tmp_path / "r")).count() == 3 and jobs.refresh(spark.range(5), str(tmp_path / "r")).count() == 5


def test_events_share_the_search_of_their_rule(spark):
    """Days are searched once for a rule and date, however many events have it."""
    from eventloom.functions import recurrence

    starts = [datetime(2026, 1, 1 + i % 2, 9) for i in range(40)] + [None]
    rows = spark.createDataFrame([(i, s, ("FREQ=WEEKLY", "no rule", None)[i % 3]) for i, s in enumerate(starts)], "id long, start timestamp_ntz, rrule string")
    searched = recurrence._distinct(rows, "rrule", "start")
    assert searched.count() == 7
    got = Counter(r.id for r in recurrence.expand(rows, "rrule", "start", F.lit(date(2026, 1, 1)), F.lit(date(2026, 1, 15))).collect())
    assert got == {i: (3 if s.day == 1 else 2) if i % 3 == 0 else 1 for i, s in enumerate(starts) if s}
    nexts = recurrence.next_occurrence(rows.withColumnRenamed("start", "start_time"), F.expr("TIMESTAMP_NTZ '2026-01-02 08:00:00'"))
    want = {i: datetime(2026, 1, 8 if s.day == 1 else 2, 9) for i, s in enumerate(starts) if s and (i % 3 == 0 or s.day == 2)}
    assert {r.id: r.next_start for r in nexts.collect()} == want
