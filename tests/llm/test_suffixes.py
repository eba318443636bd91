"""Deep-shallow sorting and repeat removal against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from leafmark.llm import suffixes


def brute(texts, length):
    """Per text: n_bytes, n_removed, n_spans and kept_sha256 by counting every window."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        rest = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_deep_shallow_sorts(seed):
    r = random.Random(seed)
    strings = list({bytes(r.choice(b"ab") for _ in range(r.randrange(1, 60))) for _ in range(200)} | {b"", b"a" * 300, b"a" * 301})
    order, lengths = suffixes.deep_shallow(strings, 0, shallow=16)
    assert [strings[i] for i in order] == sorted(strings)
    assert lengths == [suffixes.common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]


def corpus(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    passages = [word(n) for n in (150, 210, 260, 400, 900)]
    texts = [None, "", "x", passages[4], passages[4], "ab" * 300, "no no no " * 80, word(199)]
    for _ in range(80):
        texts.append(word(r.randrange(0, 300)) + "".join(r.choice(passages) + word(r.randrange(0, 90)) for _ in range(r.randrange(0, 4))))
    near = word(1500)
    return [*texts, near, near[:700] + "Q" + near[701:], near[5:]]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("big", "huge", "hot", "held"), [(20_000, 1_000_000, 500, 16_000_000), (3, 1_000_000, 1, 3_000), (3, 12, 40, 1)])
def test_removal_matches_brute_force(spark, seed, big, huge, hot, held, monkeypatch):
    """Also with small bounds: anchors dealt by ranges and by windows, rows broadcast, contexts settled or not in a task."""
    for name, value in (("BIG", big), ("HUGE", huge), ("HOT", hot), ("HELD", held)):
        monkeypatch.setattr(suffixes, name, value)
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = suffixes.remove_repeats(docs.selectExpr("doc_id", "text", "1 AS uid", "'x' AS data")).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts, 200)
    kept = suffixes.remove_repeats(docs, with_text=True).orderBy("doc_id").collect()
    assert [hashlib.sha256(r["kept"]).hexdigest() for r in kept] == [x[3] for x in brute(texts, 200)]


def test_many_contexts_agree_with_pairs():
    r = random.Random(5)
    core = bytes(r.choice(b"abcd") for _ in range(120))
    lefts = [bytes(r.choice(b"ab") for _ in range(r.randrange(40, 80))) for _ in range(60)]
    rights = [core + bytes(r.choice(b"ab") for _ in range(r.randrange(20, 80))) for _ in range(60)]
    lefts[:20], rights[20:30] = [lefts[0]] * 20, [rights[0]] * 10
    lefts[30:40], rights[30:40] = [x + y for x, y in zip([lefts[1]] * 10, lefts[:10], strict=True)], [core + b"ab" * 20 + x[120:] for x in rights[:10]]
    pairs = list(dict.fromkeys(zip(lefts, rights, strict=True)))
    lefts, rights = [a for a, _ in pairs], [b for _, b in pairs]
    want = []
    for i in range(len(pairs)):
        best = None
        for j in range(len(pairs)):
            if i != j:
                a, b = suffixes.common(lefts[i], lefts[j]), suffixes.common(rights[i], rights[j])
                if a + b >= 200:
                    best = (max(a, best[0]), max(b, best[1])) if best else (a, b)
        want.append(best)
    assert suffixes.reaches(lefts, rights, 200, 0) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(docs).collect() == []
