"""Steps whose work must not grow faster than their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import recurrence, similarity, snippet
from eventloom.operators import dedup, similar
from eventloom.sources import apis, web


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_merge_groups_lists_sources_not_events(spark):
    rows = [(1, "k", i, ("b, a", "a", "agg", None)[i % 4], f"u{i}" if i % 3 else "") for i in range(40)]
    events = spark.createDataFrame(rows, "city long, title_key string, id long, source string, url string")
    out = dedup.merge_groups(events, ["city", "title_key"], F.array(F.lit("agg")), "id")
    lists = [line for line in plan(out).splitlines() if "Aggregate [" in line]
    assert len(lists) == 2 and "collect_list" in lists[0] and "collect_list" not in lists[1]
    got = out.where("source is not null").first()
    assert (got.members, got.source_urls) == (40, {"a": "u37", "b": "u32", "agg": "u38"})


def test_jsonld_blocks_without_join(spark):
    pages = spark.createDataFrame([(1, "x", '<script type="application/ld+json">{"a":1}</script><script type="application/ld+json">{"a":2}</script>')], "page_id long, more string, html string")
    blocks = web.jsonld_blocks(pages)
    assert "Join" not in plan(blocks) and blocks.columns == ["page_id", "more", "block"]
    assert sorted(r.j for r in blocks.select(F.to_json("block").alias("j")).collect()) == ['{"a":1}', '{"a":2}']


def test_widget_repetition_is_parsed_once(spark):
    event = '{"name":"N","start":{"date":"2024-01-02","time":"09:00"},"repeatPeriod":"weeklyOn","repeatWeeklyOnDays":["tu"],"exceptions":[{"type":"skip","originalDate":1705363200000}]}'
    widgets = spark.createDataFrame([("s", f'{{"data":{{"settings":{{"events":[{event}]}}}}}}')], "source string, body string")
    out = apis.elfsight_events(widgets, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), months=1).select("start_time")
    text = plan(out)
    assert text.count("repeatWeeklyOnDays") == 1 and text.count("exceptions") == 1
    assert sorted(r.start_time.day for r in out.collect()) == [2, 9, 23, 30]


def syllables(n):
    """Texts with the same characters and much the same pairs of them, which an index of these cannot tell apart."""
    rnd = np.random.default_rng(5)
    made = [" ".join("".join(rnd.permutation(["th", "an", "er", "on", "ed", "in"])) for _ in range(k)) for k in rnd.integers(1, 12, n)]
    return sorted({*made, *[t[:-1] + "x" for t in made[::9]]}, key=lambda t: (len(t), t))


@pytest.mark.parametrize("method, of_both, threshold", [("levenshtein", False, 0.6), ("sequence", True, 0.85)])
def test_like_texts_of_a_slot_by_blocks(spark, monkeypatch, method, of_both, threshold):
    texts = syllables(150)
    monkeypatch.setattr(similar, "BLOCK", 100)  # several blocks of a length
    titles = spark.createDataFrame([(1, t) for t in texts], "slot long, title string")
    rows = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :]]
    pairs = spark.createDataFrame(rows, "a string, b string").withColumn("d", F.levenshtein("a", "b"))
    size = F.length("a") + F.length("b") if of_both else F.greatest(F.length("a"), F.length("b"))
    want = {(min(r.a, r.b), max(r.a, r.b)) for r in pairs.where(F.col("d") <= (1 - threshold) * size + 1e-9).collect()}
    got = [tuple(r) for r in similar.candidates(titles, ["slot"], threshold, method).collect()]
    # no more than the distance lets through, which is exact for one method and close for the other
    assert set(got) == want and len(got) == len(want) and 10 < len(want) < len(rows) / 4


def test_distances_of_a_text_and_a_block(spark):
    texts = ["", "a", "k" * 63, "k" * 64, "k" * 32 + "y" * 33, "\u00e9k" * 70, "ky" * 100, "k" * 300]
    known, bits = similarity.bit_rows(texts)
    sizes = np.array([len(t) for t in texts])
    for text in (*texts[1:], "z" * 130):
        rows = np.array([known.get(c, 0) for c in text])
        want = spark.createDataFrame([(i, text, t) for i, t in enumerate(texts)], "i int, a string, b string").select("i", F.levenshtein("a", "b").alias("d"))
        assert similarity.distances(rows, bits, sizes).tolist() == [r.d for r in want.orderBy("i").collect()]


def test_periods_are_found_once_for_a_list(spark):
    rows = spark.sql("SELECT 1 AS id, 'FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=1,-1' AS rrule, TIMESTAMP_NTZ '2024-01-01 09:00:00' AS start_time")
    day = lambda d: F.lit(d).cast("date")
    keys = recurrence._distinct(rows, "rrule", "start_time")
    out = recurrence._with_times(keys, "__start", day("2024-01-01"), day("2024-03-31"), "times")
    assert not [line for line in plan(out).splitlines() if "trunc(" in line and "array_position(" in line]
    assert [f"{t:%m%d}" for t in out.first().times] == ["0101", "0131", "0201", "0229", "0301", "0329"]


def test_events_with_rules_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(file):
        read.add(1)
        return file

    rows = spark.sql("SELECT 'f' AS file, 'u' AS uid, 'FREQ=DAILY;COUNT=2' AS rrule, TIMESTAMP_NTZ '2024-01-02 09:00:00' AS start_time")
    rows = rows.withColumn("file", F.udf(seen)("file"))
    out = recurrence.expand_events(rows, F.lit("2024-01-01").cast("date"))
    assert sorted(r.uid for r in out.collect()) == ["u__20240102", "u__20240103"] and read.value == 1


def test_sentences_try_one_side_of_an_edge_and_one_key(spark):
    rows = spark.createDataFrame([("The zoo", "The zoo. Come to the zoo\u00e9 and the \u00e9fee, a_the b-the zoom9 for all.")], "title string, description string")
    made = snippet.with_snippet(rows)
    assert "(?=[A-Za-z0-9_])" not in plan(made) and plan(made).count("[^a-z0-9]+") == 2  # of the title and of a sentence
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    texts = spark.createDataFrame([(a + w + b,) for w in ("the", "Zoom", "fee", "free but", "price", "tickets", "from anywhere in the world") for a in ("", " ", "x", "_", "\u00e9", "-") for b in ("", " ", "x", "9", "\u00e9", ".")], "s string")
    patterns = {p for _, *ps, _, _ in snippet.SITE.points for p in ps if p} | set(snippet.SITE.rejects) | {snippet.SNIPPET_AFTER_LABEL}
    for p in patterns:
        assert texts.where(snippet.SITE.like(F.col("s"), p) != F.col("s").rlike(p.replace(r"\b", edge))).isEmpty(), p


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_subsequences_only_of_pairs_whose_characters_suffice(monkeypatch):
    rnd = np.random.default_rng(7)
    made = [" ".join(rnd.choice(["than", "eron", "edin", "wést", "ouly", "tion"], k)) for k in rnd.integers(1, 40, 120)]
    texts = sorted({*made, *[t[:-2] + "x" for t in made[::5]]}, key=lambda t: (len(t), t))
    tried, inner = [], similarity.in_common
    monkeypatch.setattr(similarity, "in_common", lambda a, b, by_words: tried.extend(zip(a, b, strict=True)) or inner(a, b, by_words))
    ids = np.arange(len(texts))
    got = [(int(a), int(b)) for a, b in zip(*similarity.matching_pairs(ids, texts, ids, texts, 0.85, False), strict=True)]
    every = [(i, j) for i in ids for j in ids if i < j]
    assert sorted(got) == [(i, j) for i, j in every if common(texts[i], texts[j]) >= 0.425 * (len(texts[i]) + len(texts[j])) - 1e-9]
    assert 15 < len(got) <= len(tried) < len(every) / 4
    sides = ["", "a", "k" * 63, "k" * 64 + "y", "ky" * 100, *texts[::9]]
    pairs = [(a, b) for a in sides for b in sides]
    assert similarity.subsequences(*map(list, zip(*pairs, strict=True))).tolist() == [common(a, b) for a, b in pairs]


def test_words_of_the_same_syllables_are_few_candidates(spark):
    rnd = np.random.default_rng(9)
    made = [" ".join("".join(rnd.permutation(["th", "an", "er", "on"])[:3]) for _ in range(8)) for _ in range(90)]
    texts = sorted({*made, *[t.replace("er", "r", 1) for t in made[::6]]})
    titles = spark.createDataFrame([(1, t) for t in texts], "slot long, title string")
    every = [(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :]]
    want = {(a, b) for a, b in every if similarity.token_set(a, b) >= 0.85}
    sorted_words = lambda t: " ".join(sorted(set(t.split())))
    rows = titles.select("slot", "title", F.monotonically_increasing_id().alias("tid")).collect()
    named = spark.createDataFrame([(r.slot, r.tid, sorted_words(r.title)) for r in rows], "slot long, tid long, text string")
    near = similar._by_blocks(named.select("slot", "tid"), named.select("tid", "text"), ["slot"], 0.85, "words")
    # the characters of all these texts are nearly the same
    assert len(want) > 100 and near.count() < len(every) / 10
    scored = similar.alike(titles, ["slot"], 0.85, "token_set")
    assert {(r.title, r.title_b) for r in scored.collect()} == want
    # scores are taken above the shuffle that spreads the pairs
    shown = plan(scored)
    assert shown.index("token_set_at_least") < shown.index("RepartitionByExpression")


def test_frequent_word_is_dealt_to_several_tasks(spark):
    titles = spark.createDataFrame([(1, "the")] + [(1, f"the w{i} x{i}") for i in range(100)], "slot long, title string").withColumn("tid", F.monotonically_increasing_id())
    words = titles.select("tid", F.split("title", " ").alias("words"))
    met = similar._by_words(titles.select("slot", "tid"), words, ["slot"], 0.85)
    assert met.count() == 100 and met.select(F.spark_partition_id()).distinct().count() > 1
