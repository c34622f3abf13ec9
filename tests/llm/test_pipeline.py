"""Each stage of the pipeline against brute force on its own input."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

pytest.importorskip("eventloom.llm")

from eventloom.llm import common, packing, toxicity  # noqa: E402
from test_operators import DOCS, components_of, cost_of, plain_packing, plain_without_repeats, words  # noqa: E402

import corpus_pipeline  # noqa: E402

EXTRA = DOCS + ", `__at` int, size string"


def corpus():
    """Documents of every kind that a stage decides on, with labels."""
    rnd = random.Random(12)
    vocab = [a + b for a in "klmnprst" for b in ("ado", "ive", "ing", "er", "oun", "ech")]
    line = lambda n: " ".join(rnd.choice(vocab) + str(rnd.randrange(50)) for _ in range(n))
    shared = ["\n".join(line(20) for _ in range(4)), line(70)]
    docs, labels = [], []
    for i in range(260):
        lines = [line(rnd.randint(4, 30)) for _ in range(rnd.randint(1, 6))]
        toxic = rnd.random() < 0.3
        if toxic:
            lines[rnd.randrange(len(lines))] += " you idiot trashbag"
        if rnd.random() < 0.2:
            lines.insert(rnd.randrange(len(lines) + 1), rnd.choice(shared))
        text = "\n".join(lines)
        if docs and rnd.random() < 0.3:
            text = rnd.choice(docs)[1] or ""
            if rnd.random() < 0.7:
                text = " ".join(rnd.choice(vocab) if rnd.random() < 0.01 else w for w in text.split(" "))
        docs.append((i * 7 % 1009, text, "en", ("hot", "hot", "b", None, "")[i % 5], len(text), i, "x"))
        labels.append((i * 7 % 1009, 1, int("idiot" in text)))
    docs += [(2000, None, None, "b", None, None, None), (2001, "", "en", "b", 0, 1, "y"), (2002, " \n ", "en", "b", 0, 1, "y"), (2003, line(3000), "en", "long", 1, 1, "z")]
    docs += [docs[3], docs[3], (None, line(30), "en", "b", 1, 1, "w"), (None, None, None, None, None, None, None)]
    return docs, labels


def plain_scores(docs, labels):
    """FTRL-proximal on dictionaries, an example at a time, over the rows that may be learnt from."""
    import zlib

    import numpy as np

    truth = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 5}
    texts = {}
    for d in docs:
        if d[0] in truth and len(d[1] or "") <= toxicity.SAMPLE_CHARS:
            texts[d[0]] = min(texts.get(d[0], d[1]), d[1])
    ids = sorted(texts)
    feats = {i: sorted(set(toxicity.features(texts[i]).tolist())) for i in ids}
    z, n = defaultdict(float), defaultdict(float)
    alpha, beta, l1, l2 = 0.1, 1.0, 2.0, 1.0
    bias = lambda: -z["bias"] / ((beta + math.sqrt(n["bias"])) / alpha)

    def weight(f):
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(4):
        for r in order.permutation(len(ids)):
            i = ids[r]
            w = {f: weight(f) for f in feats[i]} | {"bias": bias()}
            g = 1 / (1 + math.exp(-sum(w.values()))) - truth[i]
            for f in w:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    return [1 / (1 + math.exp(-sum(weight(f) for f in set(toxicity.features(d[1]).tolist())) - bias())) for d in docs]


def plain_dedup(docs):
    sets, comp = components_of([(d[0], d[1]) for d in docs])
    best, out = {}, Counter()
    for k, d in enumerate(docs):
        if not sets[k] or comp[k] is None:
            out[d] += 1
        elif d[0] is not None and (comp[k] not in best or d[0] < best[comp[k]][0]):
            best[comp[k]] = d
    return out + Counter(best.values())


def plain_mix(docs):
    """Weighted fair queueing with a list: how often each row is taken."""
    size = Counter()
    for d in docs:
        size[d[3]] += len(words(d[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, open_, left = {}, set(order), sum(size.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * size[s]}
        for s in over or open_:
            goal[s] = 3 * size[s] if over else share * weight[s]
        left -= sum(goal[s] for s in over)
        open_ = open_ - over if over else set()
    queue = []
    for s in order:
        mine = sorted((hashlib.md5(str("" if d[0] is None else d[0]).encode()).hexdigest(), -1 if d[0] is None else d[0], len(words(d[1])), k) for k, d in enumerate(docs) if d[3] == s)
        cum = 0
        for *_, n, k in mine:
            cum += n
            queue += [((cum + e * size[s]) / goal[s], s is None, s or "", cum, k, n) for e in range(3) if n]
    taken, total = Counter(), 0
    for *_, k, n in sorted(queue):
        total += n
        if total > sum(size.values()):
            break
        taken[k] += 1
    return Counter({d: sum(taken[k] for k, e in enumerate(docs) if e == d) for d in docs if any(taken[k] for k, e in enumerate(docs) if e == d)})


def test_every_stage_equals_brute_force(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, EXTRA).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    cur = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, counts = cur.columns, []
    for name, stage in corpus_pipeline.STAGES:
        given = [tuple(r) for r in cur.collect()]
        before = list(common.written)
        stage(spark, cur, str(tmp_path)).coalesce(1).write.parquet(str(tmp_path / name))
        cur = spark.read.parquet(str(tmp_path / name))
        got = Counter(tuple(r) for r in cur.collect())
        if name != "packing":
            assert cur.columns == columns
        if name == "toxicity":
            assert got == Counter(d for d, p in zip(given, plain_scores(given, labels)) if p < 0.5)
        elif name == "line_dedup":
            assert Counter((r[0], r[1]) for r in got.elements()) == plain_without_repeats(given)
        elif name == "near_dedup":
            assert got == plain_dedup(given)
        elif name == "mixing":
            assert got == plain_mix(given)
        else:
            sizes = sorted((len(words(d[1])) for d in given), reverse=True)
            want = plain_packing([s for s in sizes if s], packing.CAPACITIES, packing.OVERHEAD)
            bins = defaultdict(list)
            for r in cur.filter("n_tokens > 0").collect():
                bins[r.bin_id, r.capacity].append(r.n_tokens)
            assert Counter(tuple(sorted(b)) for b in bins.values()) == Counter(tuple(sorted(b)) for b in want)
            assert sum(c for _, c in bins) + packing.OVERHEAD * len(bins) == cost_of(want, packing.CAPACITIES, packing.OVERHEAD)
            assert got.total() == len(given)
        counts.append(got.total())
        if name not in ("toxicity", "packing"):
            assert not [p for p in before if p in common.written and p in corpus_pipeline._finished]
    assert counts[0] < len(docs) and counts[2] < counts[1]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[-1]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None)] * 3, [(1, "a b c", "en", "s", 5, 1, "x")]])
def test_stages_take_empty_and_null_tables(spark, tmp_path, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(rows, EXTRA).write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        # as read from files, and as a frame that is not
        for df in (spark.read.parquet(str(tmp_path / "documents.parquet")), spark.createDataFrame(rows, EXTRA)):
            out = stage(spark, df, str(tmp_path))
            got = out.count()
            # without a label every text scores 0.5, which is toxic; texts without words are not mixed
            assert got == (0 if name == "toxicity" or (name == "mixing" and rows and rows[0][1] is None) else len(rows)), name


def test_scratch_of_finished_stages_is_deleted(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, EXTRA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = set(common.written)
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = [p.rsplit("/", 1)[1] for p in common.written if p not in before]
    assert [p for p in left if p.startswith("stage-")] == [p for p in left if p.startswith("stage-mixing")]
    assert not [p for p in left if p.startswith(("lines", "sketch", "queue"))]
    assert out.count() > 0
