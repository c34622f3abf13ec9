"""Values carried through ranges, and what is built on them, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from eventloom.operators import cluster, graph, runs
from eventloom.sources import registries


@pytest.fixture
def many_ranges(spark):
    """Ranges of few rows, so that groups and blocks go on over several of them."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_ranked(many_ranges):
    random.seed(5)
    rows = [(random.choice("aaab"), random.randrange(9), i) for i in range(300)]
    got = runs.ranked(many_ranges.createDataFrame(rows, "g string, x int, id int"), ["g"], [F.col("x").desc(), F.col("id")]).collect()
    want = {}
    for g in "ab":
        for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = place
    assert {r.id: r.place for r in got} == want and len(got) == 300


def test_ranked_nothing(spark):
    assert runs.ranked(spark.createDataFrame([], "g string, x int"), ["g"], [F.col("x")]).count() == 0


def plain_issues(lines):
    """(line_no, source, level, kind of source, message) by walking the lines."""
    out, at, label = [], 0, None
    while at < len(lines):
        line = lines[at].rstrip()
        run, left = re.match(registries.RUN_LINE, line), re.match(registries.EXIT_LINE, line)
        logged = re.search(registries.LOGGED, line)
        if run or left:
            label = run[3].strip() if run else None
        elif logged:
            out.append((at, label or re.sub("Scraper$", "", logged[1]), logged[2].lower(), logged[3]))
        elif registries.TRACEBACK in line:
            end, final, script = at + 1, line, None
            while end < len(lines):
                below = lines[end].rstrip()
                named = re.search(registries.TRACED_SCRIPT, below)
                script = named[1] if named else script
                if end > at + 1 and below and below[0] != " ":
                    final = below
                    break
                end += 1
            out.append((at, label or script, "error", final))
            at = end
        elif re.search(registries.ERROR_LINE, line):
            named = re.search(registries.SCRIPT, line) or (re.search(registries.SCRIPT, lines[at - 1]) if at else None)
            out.append((at, label or (named and named[1]), "error", line.strip()))
        at += 1
    return out


PIECES = (
    "[davis][scrape] RUN One source", "[davis][scrape] EXIT 0 One source", "[davis][load]  RUN load ", "[davis][scrape] 2026-01-02 10:11 - AbcScraper - ERROR - 404 Client Error",
    "[davis][scrape] Abc - WARNING - Broken property", "Traceback (most recent call last):", "  Traceback (most recent call last):", '  File "/a/b/one.py", line 3', '  File "/a/b/two-b.py", line 4',
    "    call()", "", "ValueError: no", "x.py: error: unknown", "HTTP Error 500", "python other.py", "    requests ConnectionError", "  ", "fine",
)


@pytest.mark.parametrize("seed", range(4))
def test_log_equals_a_walk(many_ranges, seed):
    random.seed(seed)
    files = {"long": random.choices(PIECES, k=400), "short": random.choices(PIECES, k=3), "traced": [PIECES[5]] * 40, "open": ["fine", PIECES[5], *["  x"] * 60, "", PIECES[7]]}
    rows = [(f, i, line) for f, lines in files.items() for i, line in enumerate(lines)]
    random.shuffle(rows)
    got = registries.build_issues(many_ranges.createDataFrame(rows, "file string, line_no int, line string")).collect()
    assert sorted((r.file, r.line_no, r.source or "", r.level, r.message) for r in got) == sorted((f, n, s or "", lv, m) for f, lines in files.items() for n, s, lv, m in plain_issues(lines))
    assert all(r.kind == "traceback" for r in got if registries.TRACEBACK in files[r.file][r.line_no])


def test_no_log(spark):
    assert registries.build_issues(spark.createDataFrame([], "file string, line_no int, line string")).count() == 0


def test_displaced(spark):
    random.seed(3)
    links = {(max(p), min(p)) for p in (random.sample(range(60), 2) for _ in range(70))} | {(i + 1, i) for i in range(100, 109)}
    stay = []
    for i in range(110):
        if not any((i, k) in links for k in stay):
            stay.append(i)
    gone = graph.displaced(spark.createDataFrame(sorted(links), "id int, id_b int"))
    assert sorted(r.id for r in gone.collect()) == sorted(set(range(110)) - set(stay))
    assert graph.displaced(spark.createDataFrame([], "id int, id_b int")) is None


def test_titles_without_characters_stay(spark):
    rows = [(1, "d", " "), (2, "d", None), (3, "d", "Jazz & Tea @ Home"), (4, "d", "jazz  and tea at home"), (5, None, "Jazz and Tea at Home"), (6, None, "jazz and tea at home!"), (7, "d", "!?"), (8, "d", "!?")]
    got = cluster.legacy_dedupe(spark.createDataFrame(rows, "id int, day string, title string"), ["day"])
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 5, 7, 8]
