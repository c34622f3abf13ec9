"""Fill-in-the-middle, ranked search and token counts against brute force."""

import hashlib
import heapq
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("eventloom.llm")

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from eventloom.llm import fill_in_middle, ranked_search, token_counts  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    vocab = [a + b for a in "abcdeé" for b in "klmnñ"] + ["Kl", "DON'T", "x1", "42", "—", "日本", "é", "a_b"]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 60))) for _ in range(120)]
    texts += [None, "", " ", "\n\n\t  x", "a<P>b", "x<S>", "<M>", "a <P <S <M", "word " * 3000, "z" * 20_000, "  many   spaces \n here ", "\x00nul"]
    texts += ["before <|endoftext|> after <|endoftext|><|endoftext|>", "<|endof<|endoftext|>text|>", "new ౜ ⃀ letters \U00010940ࢗ", "👍🏽 emoji 🧑‍🚀"]
    texts += [texts[0]] * 3
    out = [(i * 7 % 1009, t, "en", None, None) for i, t in enumerate(texts)]
    return out + [out[0], (None, texts[1], None, None, None), (5000, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


def plain_fim(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_in_middle_equals_plain_and_restores(docs, rows):
    got = fill_in_middle.transform(docs)
    kept = sorted(repr((r.doc_id, r.text, *r.fim[:5])) for r in got.collect())
    assert kept == sorted(repr((r[0], r[1], *plain_fim(*r[:2]))) for r in rows)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    made = sorted(map(repr, map(tuple, fill_in_middle.digest(got).collect())))
    want = ((r[0], *(p := plain_fim(*r[:2]))[:4], sha(p[4]), sha(r[1])) for r in rows)
    assert made == sorted(map(repr, want))
    assert {plain_fim(*r[:2])[1] for r in rows} == {"plain", "psm", "spm"}


def test_fill_in_middle_equals_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    got = sorted(map(repr, (tuple(r) for r in fill_in_middle.digest(fill_in_middle.transform(docs)).collect())))
    assert got == sorted(map(repr, con.sql(fill_in_middle.oracle()).fetchall()))


@pytest.mark.parametrize("unit", [r"\X", r"\S+\s*", r"[a-z]+"])
def test_other_units_keep_the_text(docs, rows, unit):
    got = fill_in_middle.transform(docs, unit=unit)
    back = got.select("doc_id", "text", fill_in_middle.restored(got.fim).alias("back"), "fim").collect()
    assert all(r.back == (r.text or "") for r in back) and len(back) == len(rows)
    if unit == r"\X":
        assert all(r.fim.n <= len(r.text or "") for r in back) and any(r.fim.n < len(r.text or "") for r in back)


def test_unit_ends_over_many_runs():
    text = "aé日\n" * 1000
    assert list(fill_in_middle.unit_ends(text)) == list(range(1, 4001))
    assert list(fill_in_middle.unit_ends("ab  c", r"\S+")) == [2, 5]


def plain_rank(rows, items, k=20):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    docs = [(r[0], Counter(term.findall((r[1] or "").translate(lower)))) for r in rows]
    n = sum(1 for _, c in docs if c)
    length = sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        asked = Counter(term.findall((text or "").translate(lower)))
        scored = []
        for doc_id, c in docs:
            m = 75 + 25 * sum(c.values()) * n // length
            score = sum(
                times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, times in asked.items() if t in c
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, s[3], -s[0]) for i, s in enumerate(heapq.nsmallest(k, scored))]
    return sorted(map(repr, out))


ITEMS = [(1, "ak bl éñ don't"), (2, "KL kl 42 x1 x1 x1"), (3, None), (4, ""), (5, "nowhere"), (6, "日本 word z"), (7, "ak bl éñ don't"), (1, "ak bl éñ don't"), (8, "after before word zzz")]


@pytest.mark.parametrize("k, chars", [(20, 200_000), (3, 30)])
def test_ranked_search_equals_brute_force(spark, docs, rows, monkeypatch, k, chars):
    monkeypatch.setattr(ranked_search, "MAX_CHARS", chars)  # the second time the items come in parts
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = ranked_search.rank(docs, items, k)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_rank(rows, ITEMS, k)


def test_ranked_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search.rank(docs.limit(0), items).collect() == []
    assert ranked_search.rank(docs.where("text IS NULL OR text = ''"), items).collect() == []
    assert ranked_search.rank(docs, items.limit(0)).collect() == []
    assert ranked_search.rank(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def made_tree(rnd, size, vocabulary):
    per_doc = [sorted(rnd.sample(range(vocabulary), rnd.randint(1, 6))) for _ in range(size)]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in per_doc])])
    terms = np.array([t for p in per_doc for t in p])
    # few values, so that many scores are equal; and a few documents that stand out
    gain = np.array([rnd.choice((5, 10)) + (100 if i % 997 == 0 else 0) for i, p in enumerate(per_doc) for _ in p])
    return ranked_search.MaxTree(starts, terms, gain), per_doc


@pytest.mark.parametrize("size", [1, 31, 33, 257, 3000])
def test_max_tree_search_equals_scan(size):
    rnd = random.Random(size)
    tree, per_doc = made_tree(rnd, size, 40)
    for level, above in zip(tree.levels, tree.levels[1:]):
        assert (level.max(axis=1) == above.max(axis=1)).all()
    for _ in range(20):
        terms = np.array(sorted(rnd.sample(range(50), 4)))
        times = np.array([rnd.randint(1, 3) for _ in terms])
        by_term = dict(zip(terms.tolist(), times.tolist()))
        scores = [
            (sum(by_term.get(t, 0) * int(g) for t, g in zip(p, tree.gain[a : a + len(p)])), -at)
            for at, (p, a) in enumerate(zip(per_doc, tree.starts))
        ]
        want = heapq.nlargest(20, [s for s in scores if s[0] > 0])
        got = sorted(((s, -at) for s, at in tree.search(terms, times, 20, 0)), reverse=True)
        assert got == want
        if want:  # a floor that is reached keeps all that reach it
            floor = want[len(want) // 2][0]
            got = sorted(((s, -at) for s, at in tree.search(terms, times, 20, floor)), reverse=True)
            assert got == [w for w in want if w[0] >= floor]


def test_max_tree_prunes(monkeypatch):
    rnd = random.Random(1)
    terms = np.array([t for _ in range(8000) for t in sorted(rnd.sample(range(40), 3))])
    hot = np.isin(np.arange(len(terms)) // 3 // ranked_search.LEAF, [5, 77])  # the ranges that hold the best
    gain = np.array([rnd.randint(1, 10) for _ in terms]) + 100 * hot
    tree = ranked_search.MaxTree(np.arange(0, len(terms) + 1, 3), terms, gain)
    opened, plain = [], ranked_search.MaxTree.scores
    monkeypatch.setattr(ranked_search.MaxTree, "scores", lambda tree, leaf: opened.append(leaf) or plain(tree, leaf))
    assert len(tree.search(np.array([3, 4]), np.array([1, 1]), 5, 0)) == 5
    assert set(opened) <= {5, 77}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_equal_library(docs, rows, library):
    got = token_counts.count_tokens(docs, limit=30)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = [(r[0], len((r[1] or "").encode()), n(r[1]), n(r[1]) > 30) for r in rows]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want))
    assert token_counts.count_tokens(docs.limit(0)).collect() == []


def test_small_table_cache_and_stretches(rows, library, monkeypatch):
    """Nothing depends on what the tiers hold or on where long texts are cut."""
    monkeypatch.setattr(token_counts, "CACHE", 3)
    monkeypatch.setattr(token_counts, "STRETCH", 7)
    text = token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))
    raw = [" ak".encode(), "ak".encode()]
    frequent = (b"".join(raw), np.cumsum([len(r) for r in raw]), np.array([len(library.encode(r.decode()).ids) for r in raw]))
    lengths = token_counts.Lengths(text, frequent)
    for _, t, *_ in rows:
        assert lengths.count(t or "") == len(library.encode(t or "", add_special_tokens=False).ids)
        assert len(lengths) <= 2 + 3
    assert {" ak", "ak"} <= set(lengths)


def test_stretches_are_whole(monkeypatch):
    monkeypatch.setattr(token_counts, "STRETCH", 10)
    for t in ("", "a b", "word   word " * 9, "x" * 50, " " * 50, "a\n \n b " * 20):
        assert "".join(token_counts._stretches(t)) == t


def test_settled_characters_are_classed_alike(library):
    """Each character beside a letter, a digit, a mark and spaces, as both libraries cut it."""
    for first, last in token_counts.SETTLED:
        for at in range(first, last + 1, 64):
            chars = [chr(c) for c in range(at, min(at + 64, last + 1))]
            text = "".join(f"a{c}1{c}!{c} {c}  x" for c in chars)
            cut = [span for _, span in library.pre_tokenizer.pre_tokenize_str(text)]
            assert cut == [m.span() for m in token_counts.PRE_TOKEN.finditer(text)], hex(at)


def test_other_pipelines_are_refused():
    with pytest.raises(ValueError):
        token_counts.load(public_tokenizers.path("word_bpe_49k.json"))


def test_clashing_names_stay(spark):
    wide = spark.createDataFrame(
        [(1, "some text here", 1, "x", 2, "b", 3)], "doc_id long, text string, n long, form string, score long, fim string, __text long"
    )
    got = fill_in_middle.transform(wide)
    assert got.columns == ["doc_id", "text", "n", "form", "score", "__text", "fim"]
    assert fill_in_middle.digest(got).first()["n"] == 14
    items = spark.createDataFrame([("q", "text", 1)], "item_id string, text string, item long")
    assert [tuple(r)[:3] for r in ranked_search.rank(wide, items).collect()] == [("q", 1, 1)]
    assert token_counts.count_tokens(wide).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_ids_that_are_texts(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two")], "doc_id string, text string")
    items = spark.createDataFrame([(1, "two")], "item_id long, text string")
    assert [r.doc_id for r in ranked_search.rank(docs, items).orderBy("rank").collect()] == ["a", "b", None]
    assert token_counts.count_tokens(docs).count() == fill_in_middle.digest(fill_in_middle.transform(docs)).count() == 3
