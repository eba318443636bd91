"""Whole-text chains, license places, secret spans and quality verdicts against plain versions."""

import collections
import random
import re

import numpy as np
import pytest

from leafmark.llm import crf, langid, licenses, quality, secrets


def frame(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, lang[i] if lang else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)


def marginals(scores, trans):
    """Forward-backward of one chain, word by word, in logarithms."""
    n, k = scores.shape
    a, b, pairs = scores.copy(), np.zeros((n, k)), np.zeros((k, k))
    for t in range(1, n):
        a[t] = np.logaddexp.reduce(a[t - 1][:, None] + trans, 0) + scores[t]
    for t in range(n - 2, -1, -1):
        b[t] = np.logaddexp.reduce(trans + (scores[t + 1] + b[t + 1])[None, :], 1)
    z = np.logaddexp.reduce(a[-1])
    for t in range(n - 1):
        pairs += np.exp(a[t][:, None] + trans + (scores[t + 1] + b[t + 1])[None, :] - z)
    return np.exp(a + b - z), pairs, z


def best_path(scores, trans):
    now, back = scores[0], []
    for x in scores[1:]:
        tries = now[:, None] + trans
        back.append(tries.argmax(0))
        now = tries.max(0) + x
    path = [int(now.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("labels", [2, 4, 20])
def test_a_text_is_one_chain(labels):
    r = np.random.default_rng(labels)
    lengths = np.array([700, 1, 5000, 3, crf.SEGMENT, crf.SEGMENT + 1])
    scores, trans = 2 * r.normal(size=(lengths.sum(), labels)), r.normal(size=(labels, labels))
    got, pairs, log_z = crf.forward_backward(scores, lengths, trans)
    labels_, at, all_pairs, total = crf.viterbi(scores, lengths, trans), 0, 0, 0.0
    for n in lengths:
        want, own, z = marginals(scores[at : at + n], trans)
        assert np.abs(want - got[at : at + n]).max() < 1e-8
        assert labels_[at : at + n].tolist() == best_path(scores[at : at + n], trans)
        all_pairs, total, at = all_pairs + own, total + z, at + n
    assert np.abs(pairs - all_pairs).max() < 1e-6 and abs(log_z - total) < 1e-6


def test_language_of_a_long_text_by_the_plain_field():
    r = random.Random(5)
    words = {"xx": ["alpha", "beta", "gamma"], "yy": ["uno", "due", "tre"]}
    model = langid.learn([(" ".join(r.choices(words[y], k=60)), y) for y in words for _ in range(30)])
    text = " ".join(r.choices(words["xx"], k=2600) + r.choices(words["yy"], k=2400))
    scores = model.emissions(text.split())[:, :2].astype(float)
    mean = marginals(scores, model.trans.astype(float))[0].mean(0)
    [(_, lang, score)] = langid._labels(model)([(1, text)])
    assert lang == model.languages[int(mean.argmax())] and abs(score - mean.max()) < 1e-4


def test_every_language_is_learned(spark):
    texts, langs = [], []
    for i in range(90):
        texts += [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{k}x" for k in range(20))] * 3
        langs += [f"l{i:02d}"] * 3
    texts.append("long " * langid.TRAIN_CHARS)
    langs.append("zz")
    # Texts of 5 documents in 6 are learned from.
    rows = langid.sample(frame(spark, texts * 3, langs * 3))
    assert {y for _, y in rows} == set(langs)
    assert max(len(t) for t, _ in rows) <= langid.TRAIN_CHARS


def test_secret_labels_by_the_plain_field():
    r = np.random.default_rng(3)
    model = secrets.learn(["some plain words to read and to learn from " * 20] * 20)
    words = [secrets._secret(r) if x < 0.02 else secrets._decoy(r) if x < 0.2 else "word" for x in r.random(5000)]
    assert secrets.tagged_words(words, model).tolist() == best_path(secrets.emissions(words, model), model.trans)


def plain_spans(text):
    """The contract's base spans, by its patterns alone."""
    out = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32])


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_on_random_texts(seed):
    r = random.Random(seed)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "'", '"', " ", "  ", ":", "=", "abcd1234", "x" * 7, "AKIA", "AKIA" + "B7" * 8, "0a1b" * 8, "0a1b" * 7, "\n", "é", "ſecret", "-", "."]
    for _ in range(400):
        text = "".join(r.choices(parts, k=r.randrange(0, 14)))
        assert secrets.base_spans(text) == plain_spans(text), text


def test_planted_secrets_are_found_on_texts_not_learned_from():
    r = np.random.default_rng(9)
    prose = lambda: [("".join(r.choice(list("abcdefghilmnorstu"), r.integers(2, 9)))) for _ in range(300)]
    model = secrets.learn([" ".join(prose()) for _ in range(80)])
    planted = found = false = 0
    for _ in range(60):
        words = prose()
        own = []
        for at in sorted(r.choice(290, 3, replace=False).tolist(), reverse=True):
            own.append(secrets._secret(r))
            words[at:at] = [*r.choice(["token:", "secret =", "use", "with key"]).split(), own[-1]]
        text = " ".join(words)
        spans = secrets.crf_spans(text, model)
        held = [text[s:e] for s, e in spans]
        planted += len(own)
        found += sum(any(x in h for h in held) for x in own)
        false += sum(not any(x in h or h in x for x in own) for h in held)
    assert found >= 0.95 * planted and false <= 0.05 * planted


def test_a_secret_of_several_words_is_one_span():
    text = "a b c"
    model = secrets.Model(np.zeros((3 * secrets.N_FEATURES, 3), np.float32), np.zeros((3, 3), np.float32))
    model_words = np.array([0, 1, 2])
    original = secrets.tagged_words
    try:
        secrets.tagged_words = lambda words, m: model_words
        assert secrets.crf_spans(text, model) == [(2, 5)]
    finally:
        secrets.tagged_words = original


@pytest.mark.parametrize("seed", range(4))
def test_license_places_on_random_texts(seed):
    r = random.Random(seed)
    parts = ["under", "the", "mit", "MIT", "license", "License.", "apache", "Apache", "version", "2", "2.0", "cc", "by", "nc", "cc-by-nc", "é", "smith", "licensed", "\n", "  ", "Version,"]
    for _ in range(150):
        text = r.choice(["", " "]).join([" ".join(r.choices(parts, k=r.randrange(0, 40))), r.choice(["", "under the mit license", "cc by nc cc by nc"])])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            own = phrase.split()
            hits = [i for i in range(len(words)) if words[i : i + len(own)] == own]
            places += hits
            labels |= {label} if hits else set()
        got = licenses.scan(text)
        assert got[:5] == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(got[5].split(","))


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: MIT or ask the legal team", "mit"), ("SPDX-License-Identifier: see the file", ""), ("SPDX-License-Identifier: Apache-2.0 OR see there", "apache-2"),
        ("SPDX-License-Identifier: mit or apache-2.0", "apache-2,mit"), ("SPDX-License-Identifier: LicenseRef-own AND Zlib", "licenseref-own,zlib"),
    ],
)
def test_prose_after_a_tag_is_no_license(text, labels):
    assert licenses.scan(text)[5] == labels


def test_many_license_places_are_counted_in_one_go():
    n_words, n_base, first, last, *_ = licenses.scan("cc by nc " * 200_000)
    assert (n_words, n_base, first, last) == (600_000, 200_000, 0, 599_997)


def js(p, q):
    p, q = np.array(p, float) / sum(p), np.array(q, float) / sum(q)
    total = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        total += (a * np.log2(a / m) if a else 0) / 2 + (b * np.log2(b / m) if b else 0) / 2
    return max(0.0, total) ** 0.5


def test_quality_verdicts_by_hand(spark):
    r = random.Random(8)
    prose = {"en": "the of and to in a is that for it house river table".split(), "de": "der die und in den von zu das haus fluss tisch".split(), "xx": "kala mati sulo pera nuti woma".split()}
    texts, langs = [None, "", "short"], ["en", None, "de"]
    for lang, words in prose.items():
        for _ in range(25):
            texts.append(" ".join(f"{r.choice(words)}{r.choice(['', '', '.', ','])}" if r.random() < 0.8 else f"w{r.randrange(10**6)}" for _ in range(120)))
            langs.append(lang)
        texts.append(" ".join(f"$${r.randrange(10**9)}##" for _ in range(90)))
        langs.append(r.choice([lang, None]))
    measured = [quality.measure(t) for t in texts]
    sums = collections.defaultdict(lambda: [0, 0])
    for m, lang in zip(measured, langs, strict=True):
        if lang and not m[5]:
            for i in (0, 1):
                h = m[6 + i]
                sums[lang][i] = sums[lang][i] + h * quality.SCALE // max(1, int(h.sum()))
    got = {x["doc_id"]: x for x in quality.judge(frame(spark, texts, langs)).collect()}
    judged = 0
    for i, (m, lang) in enumerate(zip(measured, langs, strict=True)):
        if lang in sums:
            near = lang
        else:
            near = min((x for x in sorted(sums) if x in quality.COMMON_WORDS), key=lambda x: js(m[7], sums[x][1]) if m[7].sum() else 1.0)
        char = js(m[6], sums[near][0]) if m[6].sum() >= quality.MIN_CHARS else 0.0
        word = js(m[7], sums[near][1]) if m[0] >= quality.MIN_WORDS and near in quality.COMMON_WORDS else 0.0
        kept = not m[5] and char <= quality.CHAR_LIMIT and word <= quality.WORD_LIMIT
        assert got[i]["kept"] == kept and got[i]["reference"] == near
        judged += not m[5] and not kept
    assert judged >= 2 and all(got[i]["kept"] for i in range(len(texts)) if langs[i] == "xx" and not measured[i][5] and "$$" not in texts[i])
