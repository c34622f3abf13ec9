"""Groups of like titles by blocks against all pairs, and what is written for them."""

import random
from collections import defaultdict

import pytest

from eventloom import scratch
from eventloom.functions.similarity import token_set
from eventloom.operators import cluster, similar


def groups(rows, threshold):
    """Ids of each cluster, by all pairs of a slot."""
    root = {r[0]: r[0] for r in rows}
    find = lambda i: i if root[i] == i else find(root[i])
    for i, slot, a, p in rows:
        for j, other, b, q in rows:
            if i < j and slot == other and (not p or not q or p == q) and (a == b or token_set(min(a, b), max(a, b)) >= threshold):
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = defaultdict(set)
    for i in root:
        out[find(i)].add(i)
    return {frozenset(g) for g in out.values() if len(g) > 1}


def titles(seed):
    """Titles of few syllables with changed copies, one-word titles, titles without a word and long ones."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.sample(["th", "an", "er", "on", "ed", "in"], rnd.randint(1, 3)))
    out = ["the", "the of", "!!!", "?", ""]
    for _ in range(60):
        base = [word() for _ in range(rnd.choice([2, 4, 9, 60]))]
        out.append(" ".join(base))
        if rnd.random() < 0.5:
            base[rnd.randrange(len(base))] += rnd.choice(["x", "the"])
            out.append(" ".join(rnd.sample(base, len(base))) + rnd.choice(["", " the", "!"]))
    return [(i, i % 2, t, rnd.choice(["", "a", "b", "c"])) for i, t in enumerate(out)]


@pytest.mark.parametrize("threshold", [0.85, 0.7])
def test_groups_by_blocks_equal_all_pairs(spark, monkeypatch, threshold):
    monkeypatch.setattr(similar, "BLOCK", 25)  # several blocks of a slot
    monkeypatch.setattr(similar, "MOST_IN_BLOCK", 1)
    rows = titles(4)
    rows += [(1000 + i, s, t, p) for i, s, t, _ in rows[::3] for p in ["b"]]  # titles with several locations
    events = spark.createDataFrame(rows, "id long, slot long, title string, location string")
    got = defaultdict(set)
    for r in cluster.cluster_titles(events, ["slot"], threshold).join(events, "id").collect():
        if r.cluster_id is not None:
            got[r.slot, r.cluster_id].add(r.id)
    assert {frozenset(g) for g in got.values()} == groups(rows, threshold)
    assert 4 < len(got) and max(map(len, got.values())) < len(rows) / 2


def test_like_pairs_are_not_written(spark):
    n = 150  # all of them like each other
    rows = [(i, 1, f"an evening of jazz and poetry by the river {i:03}", "") for i in range(n)]
    before = set(scratch.written)
    events = spark.createDataFrame(rows, "id long, slot long, title string, location string")
    assert cluster.cluster_titles(events, ["slot"]).where("cluster_id = 0").count() == n
    written = [spark.read.parquet(p).count() for p in scratch.written if p not in before]
    assert len(written) > 3 and max(written) <= n
