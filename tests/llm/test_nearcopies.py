"""The pipeline's near-copy stage against all pairs by exact Jaccard similarity."""

import random

import corpus_pipeline
import pytest
from leafmark.llm import nearcopies
from pyspark.sql import functions as F


def brute(texts):
    """Places kept: the least of each group of texts at a similarity of 0.8 or more."""

    def own(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, lead = [own(t) for t in texts], list(range(len(texts)))
    find = lambda x: x if lead[x] == x else find(lead[x])
    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                lead[max(find(i), find(j))] = min(find(i), find(j))
    return {i for i in range(len(texts)) if find(i) == i}


def corpus(seed):
    """Texts, copies with some words changed (similarities of about 0.5 to 1), and common boilerplate."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(400)}"
    boiler = [word() for _ in range(30)]
    out = [None, "", " ", "a b", "A  b", "a b c", "x " * 40, "x " * 90]
    for _ in range(40):
        base = [word() for _ in range(r.randrange(5, 200))] + (boiler if r.random() < 0.5 else [])
        for _ in range(r.randrange(1, 5)):
            new = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 25)):
                new[r.randrange(len(new))] = word()
            out.append(" ".join(new))
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "few"), [(1, 48), (2, 48), (1, 1), (2, 3)])
def test_near_dedup_keeps_the_first_of_each_group(spark, seed, few, monkeypatch):
    """Also with nearly all shingles taken for common to many."""
    monkeypatch.setattr(nearcopies, "FEW", few)
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, k string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == brute(texts)
    assert len(brute(texts)) <= len(set(texts)) - 15


def test_a_large_group_of_near_copies_makes_few_links(spark):
    """Pairs are not made within what is joined already."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(300):
        new = list(base)
        new[r.randrange(len(new))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(new))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = nearcopies._keys(docs)
    classes = marked.groupBy("k").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"))
    assert nearcopies.near_links(docs, classes, len(texts)).count() < 20 * len(texts)
    assert [r["doc_id"] for r in nearcopies.keep_first(docs).collect()] == [0]


@pytest.fixture
def verified(monkeypatch):
    """How many pairs are held against the exact similarity, by name."""
    seen, own = {}, nearcopies._verified

    def counted(docs, classes, pairs, name):
        seen[name] = pairs.count()
        return own(docs, classes, pairs, name)

    monkeypatch.setattr(nearcopies, "_verified", counted)
    return seen


def test_copies_of_a_text_meet_at_that_text(spark, verified):
    """Copies changed at random places are far from each other, but not from the text; a smaller one with the same words joins none."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base[i : i + 75]) for i in range(0, 75, 25)] + [" ".join(base)]
    for _ in range(200):
        new = list(base)
        for _ in range(3):
            new[r.randrange(5, 145)] = f"x{r.randrange(10**9)}"
        texts.append(" ".join(new))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"] for x in nearcopies.keep_first(docs).collect()} == brute(texts)
    assert verified["stars"] + verified["pairs"] < 6 * len(texts)


def test_frequent_shingles_that_are_not_listed_pair_few(spark, monkeypatch):
    """A text with few shingles of many nodes can be like another only if they meet at a shingle of few nodes too."""
    made, own = [], nearcopies._paired

    def counted(rows, also=""):
        out = own(rows, also)
        made.append(out.count())
        return out

    monkeypatch.setattr(nearcopies, "_paired", counted)
    monkeypatch.setattr(nearcopies, "COMMON", 0)
    r = random.Random(6)
    runs = [[f"f{i}_{j}" for j in range(5)] for i in range(40)]
    texts = [" ".join(w for i in r.sample(range(40), 20) for w in [*runs[i], *(f"x{r.randrange(10**9)}" for _ in range(6))]) for _ in range(200)]
    texts += [t.rsplit(" ", 3)[0] for t in texts[:50]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(nearcopies, "FEW", 10)
    assert {x["doc_id"] for x in nearcopies.keep_first(docs).collect()} == brute(texts) == set(range(200))
    # Each copy meets its text at up to a fifth of some 215 shingles.
    assert made[0] < 60 * len(texts) and made[1] < 2 * len(texts)


@pytest.mark.parametrize(("seed", "few", "listed"), [(3, 1, 0), (3, 3, 30), (4, 2, 0), (4, 8, 200)])
def test_groups_whatever_is_listed(spark, seed, few, listed, monkeypatch):
    monkeypatch.setattr(nearcopies, "FEW", few)
    monkeypatch.setattr(nearcopies, "COMMON", listed)
    monkeypatch.setattr(nearcopies, "RADIUS", 0)
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in nearcopies.keep_first(docs).collect()} == brute(texts)


def test_columns_of_any_kind_and_name(spark):
    docs = spark.sql("SELECT * FROM VALUES (1L, 'a b c d e f', map('k', 1), 5), (2L, 'a b c d e f', map('k', 2), 6), (2L, 'z', null, 7), (3L, 'q', null, 8) AS t(doc_id, text, m, `x.y`)")
    got = nearcopies.keep_first(docs)
    assert got.columns == docs.columns and sorted((r["doc_id"], r["x.y"]) for r in got.collect()) == [(1, 5), (3, 8)]


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "q r s t"), (2, "q r s t"), (7, "a b c"), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(nearcopies.keep_first(docs).collect(), key=str) == sorted([r for r in docs.collect() if r["doc_id"] in (None, 2, 8)], key=str)
    assert nearcopies.keep_first(docs.limit(0)).count() == 0
