"""The store's procedures in SQL against the operators."""

import pytest
from pyspark.sql import functions as F

from eventloom.functions import procedures
from eventloom.operators.store import StaleDeleteRefused, delete_stale, remove_feed, stale_rows


def test_procedures(spark):
    rows = [(i, "x" if i < 10 else "y", f"s{i % 2}" if i % 3 else None, f"u{i}" if i % 4 else None, "c") for i in range(12)]
    events = spark.createDataFrame(rows, "id long, city string, source string, source_uid string, category string")
    feeds = spark.createDataFrame([(1, "x", "s0"), (2, "z", "s0"), (3, None, None)], "id long, city string, name string")
    curated = spark.createDataFrame([("u1", "old", 1), ("u1", "new", 2), ("u2", "c", 1), (None, "n", 1)], "source_uid string, category string, created_at int")
    for uids in ([f"u{i}" for i in range(6)] + ["u1", None], ["u1"], []):
        incoming = spark.createDataFrame([(u,) for u in uids], "source_uid string")
        procedures.register(spark, events=events, incoming=incoming, feeds=feeds, overrides=curated)
        gone = {r.id for r in spark.sql("SELECT * FROM stale_events('x')").collect()}
        assert gone == {r.id for r in stale_rows(events, "x", incoming).collect()}
        for city in ("x", "y", "nowhere"):
            said = spark.sql(f"SELECT * FROM delete_stale_events('{city}')").first()
            if said.refused:
                with pytest.raises(StaleDeleteRefused):
                    delete_stale(events, city, incoming)
            else:
                assert said.deleted == delete_stale(events, city, incoming)[1]
            assert said.refused == (uids == ["u1"] and city != "nowhere")
    for feed in (1, 2, 3):
        kept = remove_feed(events, feeds, feed)[0].count()
        assert spark.sql(f"SELECT events_deleted FROM remove_feed({feed})").first()[0] == 12 - kept
    assert spark.sql("SELECT * FROM remove_feed(9)").isEmpty()
    assert [(r.id, r.curated) for r in spark.sql("SELECT * FROM overridden_events()").collect()] == [(1, "new")]
    problem = lambda *a: spark.range(1).select(F.expr(f"scraper_row_problem({', '.join('NULL' if x is None else repr(x) for x in a)})")).first()[0]
    good = "cities/a-b/x.ics"
    assert problem(good, "scraper", None, "python scrapers/x.py") is None and problem(None, "ics_url", "active", None) is None
    assert problem(None, "scraper", "removed", None) is None and problem(None, "scraper", "active", None) == "url"
    assert problem(good, "scraper", "active", " ") == "no command" and problem(good, "scraper", None, "bash x.sh") == "command"
