"""State carried by feeds: micro-batches against the batch answer and plain loops, restarts included."""

from datetime import date, datetime, timedelta
from random import Random

from pyspark.sql import functions as F

from eventloom.operators.windows import feed_anomalies
from eventloom.streaming import feeds, jobs

HISTORY = "city string, feed string, date date, count int, error string, seq long"
BUILD = "city string, guid string, start_time timestamp, built timestamp"


def by_loop(entries):
    """Anomalies of one feed by its list of entries, the day's last replaced."""
    past, out = [], set()
    for d, n, error, _ in entries:
        good = next((c for _, c, e in reversed(past) if e is None and c is not None), None)
        if good and n == 0:
            out.add((d, good, n, "zero_events"))
        elif good and n is not None and good >= 5 and (good - n) / good >= 0.5:
            out.add((d, good, n, "significant_drop"))
        past = [p for p in past if p[0] != d] + [(d, n, error)]
    return out


def test_anomalies_in_batches(spark, tmp_path):
    rng, day = Random(3), date(2026, 1, 1)
    feed = {f: [(day + timedelta(i), rng.choice([0, 0, 2, 7, 9, 20]), rng.choice([None, None, "x"]), i) for i in range(12)] for f in "abc"}
    feed["a"].insert(7, (feed["a"][6][0], 0, None, 6))  # the day again, with the same seq order
    feed["a"][6] = (*feed["a"][6][:1], 20, None, 5)
    feed["b"][3] = (feed["b"][3][0], None, None, 3)
    rows = [("x" if f != "c" else None, f, *r) for f in feed for r in feed[f]]
    src, table = str(tmp_path / "in"), str(tmp_path / "t")
    today = F.lit(day + timedelta(11))
    for lo, hi in ((0, 4), (4, 7), (7, 12)):  # each run goes on from the checkpoint
        part = [r for r in rows if lo <= (r[2] - day).days < hi] + [("x", "late", None, 1, None, 1)]
        spark.createDataFrame(part, HISTORY).write.mode("append").parquet(src)
        feeds.anomaly_log(spark.readStream.schema(HISTORY).parquet(src), table, str(tmp_path / "c"), today, 8).awaitTermination()
    got = {(r.feed, r.date, r.previous, r["count"], r.anomaly) for r in jobs.read_current(spark, table).collect()}
    want = {(f, *a) for f in feed for a in by_loop(feed[f]) if a[0] >= day + timedelta(3)}
    assert got == want and len(want) > 5
    single = spark.createDataFrame([r for r in rows if r[1] == "c"], HISTORY)
    batch = {(r.date, r.previous, r["count"], r.anomaly) for r in feed_anomalies(single).collect()}
    assert {g[1:] for g in got if g[0] == "c"} == {b for b in batch if b[0] >= day + timedelta(3)}


def by_builds(builds, limit):
    """{city: {guid: date or None}} by a plain loop over builds."""
    memory = {}
    for stamp, items in builds:
        for city in {c for c, _, _ in items}:
            old, mine = memory.get(city, {}), {}
            for c, g, s in items:
                if c == city and g is not None:
                    mine[g] = min(s, mine.get(g, s))
            dates = {g: old[g] if old.get(g) else stamp if not old or g not in old else None for g in mine}
            top = sorted((g for g in dates if dates[g]), key=lambda g: (-dates[g].timestamp(), mine[g], g))[:limit]
            memory[city] = {g: dates[g] if g in top else None for g in mine}
    return memory


def test_latest_items_in_builds(spark, tmp_path):
    rng, t = Random(5), datetime(2026, 1, 1)
    builds = []
    for k in range(5):
        items = [(c, f"g{i}", t + timedelta(days=i % 4)) for c in "xy" for i in range(12) if rng.random() < 0.7 and (c, k) != ("y", 2)]
        builds.append((t + timedelta(days=k), items + items[:2] + [("x", None, t)]))
    src, table = str(tmp_path / "in"), str(tmp_path / "t")
    for some in (builds[:1], builds[1:3], builds[3:]):  # two builds in one batch, too
        rows = [(c, g, s, stamp) for stamp, items in some for c, g, s in items]
        spark.createDataFrame(rows, BUILD).write.mode("append").parquet(src)
        feeds.latest_stream(spark.readStream.schema(BUILD).parquet(src), table, str(tmp_path / "c"), 4).awaitTermination()
    got = {(r.city, r.guid): r.pub_date for r in jobs.read_current(spark, table).collect()}
    want = {(c, g): d for c, m in by_builds(builds, 4).items() for g, d in m.items()}
    assert got == want and sum(d is not None for d in want.values()) == 8
