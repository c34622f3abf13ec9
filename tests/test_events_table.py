"""The events by uid bucket: results of the plain operators, untouched files, races."""

import pytest
from pyspark.sql import functions as F

from eventloom.operators import events_table as et
from eventloom.operators.store import apply_overrides, upsert

ROWS = "id long, title string, start_time timestamp_ntz, city string, source_uid string, category string"
CURATED = "source_uid string, event_id long, category string, created_at int"


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.select("id", "title", "city", "source_uid", "category").collect())


def test_write(spark, tmp_path):
    table = str(tmp_path / "t")
    uid = F.when(F.col("id") % 5 != 0, F.concat(F.lit("u"), F.col("id").cast("string")))
    start = spark.range(40).select("id", F.lit("a").alias("title"), F.expr("TIMESTAMP_NTZ '2026-01-01 10:00:00'").alias("start_time"), F.lit("x").alias("city"), uid.alias("source_uid"), F.lit("old").alias("category"))
    curated = spark.createDataFrame([("u1", 1, "first", 1), ("u1", 1, "last", 2), ("u2", 2, "two", 1), ("gone", 99, "g", 1), (None, 7, "n", 1)], CURATED)
    et.create(start, curated, table, 8)
    assert rows_of(et.events(spark, table)) == rows_of(apply_overrides(start, curated))
    with pytest.raises(et.LostRace):
        et.create(start, curated, table, 8)

    incoming = spark.createDataFrame([(101, "b", None, "y", "u1", "new"), (102, "c", None, "y", "u1", "new"), (103, "d", None, "y", " ", "new"), (104, "e", None, "y", None, "new")], ROWS)
    files = lambda: {p for b, p in et.version(spark, table)[1].items() if b.isdigit()}
    before = files()
    assert et.write(incoming, table) == 2 and len(before - files()) == 1  # one uid, one bucket
    want = apply_overrides(upsert(start, incoming.filter("trim(source_uid) <> ''")), curated)
    assert rows_of(et.events(spark, table)) == rows_of(want)
    assert {(r.source_uid, r.event_id) for r in et.overrides(spark, table).collect()} == {("u1", 101), ("u2", 2), ("gone", 99), (None, 7)}
    assert et.write(incoming.limit(0), table) == 2 and et.version(spark, table)[0] == 2


def test_race(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    one = lambda i, u, t: spark.createDataFrame([(i, t, None, "x", u, "c")], ROWS)
    et.create(one(1, "a", "old"), spark.createDataFrame([], CURATED), table, 2)
    publish, first = et.publish, []

    def slow(session, path, number, folders):
        if not first:  # another writer comes between reading and publishing
            first.append(number)
            et.write(one(2, "b", "other"), table)
        return publish(session, path, number, folders)

    monkeypatch.setattr(et, "publish", slow)
    assert et.write(one(3, "a", "new"), table) == 3
    assert {(r.source_uid, r.title) for r in et.events(spark, table).collect()} == {("a", "new"), ("b", "other")}
    monkeypatch.setattr(et, "publish", lambda *a: False)
    with pytest.raises(et.LostRace):
        et.write(one(4, "a", "newer"), table, 2)
    assert et.version(spark, table)[0] == 3
