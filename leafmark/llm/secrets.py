"""Op 8: secret scans by base patterns and a linear-chain conditional random field.

The field tags each word as secret begin (B), inside (I) or outside (O) from its
shape, those of its neighbours and features of its file, decoded by Viterbi over the
whole text. A begin and the insides that follow it are one added span; spans of the
base patterns always stay.

A word whose O score leads by more than any labels of its neighbours could give back is
O on the best path. Such words cut the chain: what lies between two of them is decoded
with its certain neighbours at both ends, and nothing else can change a label.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm import crf
from leafmark.llm.arrow import map_rows
from leafmark.llm.caches import held
from leafmark.storage import table

#: Base patterns in their listed order (fixed values).
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.A)
HEX = re.compile(r"[0-9a-f]+", re.A)
KINDS = ("assign", "access", "hex", "crf")
#: Documents to learn from, and the characters of a document's window at most.
TRAIN_ROWS = 240
TRAIN_CHARS = 8_000
ROUNDS = 40
LABELS = 3  # O, B, I
#: Characters from which a word of a base match is taught as a secret.
TAUGHT = 12
_PLAIN = re.compile(r"[\"'(\[]*[^\W\d_]+(?:['’-][^\W\d_]+)*[\"')\]]*[.,;:!?…]*").fullmatch
_VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+")
_HEX_MAP = bytes(0x68 if chr(c) in "0123456789abcdef" else 0x20 for c in range(256))
_LEXICON = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "private", "login")
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "pk_", "rk_", "xox", "eyJ", "AIza", "glpat-", "npm_", "Bearer")
N_FEATURES = 160


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base matches that count, leftmost and apart within a kind."""
    raw = text.encode()
    low = raw.lower()
    out = []
    if any(k in low for k in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"h" * 32 in raw.translate(_HEX_MAP):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out)


def shape_features(word: str) -> list[int]:
    """Feature numbers of a word's shape; 0 pads. A plain word (letters and punctuation) has one of a few."""
    low = word.lower()
    keys = [20 + i for i, k in enumerate(_LEXICON) if k in low]
    if _PLAIN(word):
        return [1, 2 if word[0].isupper() else 3, 4 + min(len(word) // 4, 5), 11 if word[-1] == ":" else 12, *keys]
    core = max(_VALUE.findall(word), key=len, default="")
    n = len(core)
    digits, lower, upper = (sum(map(f, core)) for f in (str.isdigit, str.islower, str.isupper))
    kinds = [("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s") for c in core]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    counts = np.unique(list(core), return_counts=True)[1] if core else np.zeros(0)
    entropy = float(-(counts / n * np.log2(counts / n)).sum()) if n else 0.0
    mixed = (digits > 0) + (lower > 0) + (upper > 0)
    out = [13, 40 + min(n // 4, 15), 56 + int(min(entropy, 5.9) * 2), 70 + min(turns, 15), 90 + mixed, 95 + min(10 * digits // max(n, 1), 9)]
    out += [106] * (n > 0 and n == digits) + [107] * ("=" in word or ":" in word) + [108] * ("@" in word) + [109] * (len(word) > n + 4)
    out += [110] * (n >= 16 and all(c in "0123456789abcdef" for c in core)) + [111] * ("/" in core) + [112] * ("-" in core) + [113] * ("." in core)
    out += [114] * (word in "=:=>->") + [115] * (n == 0) + [116] * (word[:1] in "\"'") + [117] * ("http" in low or "www" in low)
    out += [120 + i for i, p in enumerate(_PREFIXES) if core.startswith(p)]
    return out + keys


def _features(words: list[str]) -> np.ndarray:
    rows = [shape_features(w) for w in words]
    out = np.zeros((len(rows), max(map(len, rows), default=1)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


#: Features of a file, from this number on: the step that the share of odd words among its words has reached.
FILE_FEATURE = 140
FILE_STEPS = (0.0, 0.01, 0.05, 0.2)


def file_step(odd: float, words: int) -> int:
    return int(np.searchsorted(FILE_STEPS, odd / max(1, words), side="right")) - 1


def _secret(random: np.random.Generator) -> str:
    """A made-up secret of one of several forms."""
    pick = lambda alphabet, n: "".join(random.choice(list(alphabet), n))
    up, low, dig = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    form = int(random.integers(8))
    return [
        lambda: "AKIA" + pick(up + dig, 16),
        lambda: "ghp_" + pick(up + low + dig, 36),
        lambda: "sk_live_" + pick(up + low + dig, 24),
        lambda: pick("0123456789abcdef", int(random.choice([32, 40, 64]))),
        lambda: "eyJ" + pick(up + low + dig, 30) + "." + pick(up + low + dig + "_-", 40),
        lambda: pick(up + low + dig + "+/", 40),
        lambda: "xoxb-" + pick(dig, 12) + "-" + pick(up + low + dig, 24),
        lambda: pick(up + low + dig, 20),
    ][form]()


def _decoy(random: np.random.Generator) -> str:
    """A made-up word that looks odd but is no secret."""
    pick = lambda alphabet, n: "".join(random.choice(list(alphabet), n))
    dig = "0123456789"
    forms = (
        lambda: pick(dig, 16), lambda: ".".join(pick(dig, int(random.integers(1, 4))) for _ in range(4)),
        lambda: f"name.{pick(dig, 2)}@mail{pick(dig, 1)}.example.com", lambda: f"+{pick(dig, 1)}-{pick(dig, 3)}-{pick(dig, 4)}",
        lambda: f"https://www.example.com/{pick('abcdefgh', 6)}/{pick(dig, 4)}", lambda: f"{pick(dig, 4)}-{pick(dig, 2)}-{pick(dig, 2)}",
        lambda: f"word{random.choice(['$$$', '***', '%%%', '&&&', '###', '!!'])}", lambda: f"{pick(dig, 2)}.{pick(dig, 1)}", lambda: "|",
        lambda: "snake_case_name", lambda: "CamelCaseName2", lambda: "key=value",
    )
    return forms[int(random.integers(len(forms)))]()


class Model:
    """weights: [3 neighbours (before, own, after) * N_FEATURES, labels]."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray) -> None:
        self.weights, self.trans = weights, trans
        parts = weights.reshape(3, N_FEATURES, LABELS)
        #: Scores that a file's step adds to a word through the word before, itself and the word after.
        self.file = parts[:, FILE_FEATURE : FILE_FEATURE + len(FILE_STEPS)]
        #: What choosing a label over O can gain at most by its two transitions.
        self.gain = np.maximum(0, (trans - trans[:, :1]).max(0)) + np.maximum(0, (trans - trans[:1]).max(1))

    def emissions(self, words: list[str]) -> np.ndarray:
        found = _features(words)
        parts = [self.weights[k * N_FEATURES : (k + 1) * N_FEATURES][found].sum(1) for k in range(3)]
        odd = np.array([[not _PLAIN(w)] for w in words], np.float32)
        return np.concatenate([*parts, odd], 1)


def learn(texts: list[str], seed: int = 11) -> Model:
    """Fits the field to real texts with made-up secrets and decoys put between their words."""
    random = np.random.default_rng(seed)
    words, gold, lengths = [], [], []
    lead = ["password =", "token:", "secret =", "api_key =", "key:", "Authorization: Bearer", "login with", "export KEY =", "use", "the", ""]
    for text in sorted(texts) or ["a plain text without anything to hide"]:
        own = text.split() or ["a"]
        joined = " ".join(own)
        spans = [m.span(1) for m in ASSIGN.finditer(joined) if len(m[1]) >= 8] + [(s, e) for s, k, e in base_spans(joined) if k]
        at, y, w = 0, [], []
        for word in own:
            hit = any(s < at + len(word) and e > at for s, e in spans)
            y.append(1 if hit and _VALUE.search(word) and len(word) >= TAUGHT else 0)
            w.append(word)
            at += len(word) + 1
            chance = random.random()
            if chance < 0.02:
                before = lead[int(random.integers(len(lead)))].split()
                secret = _secret(random)
                secret = f'"{secret}"' if random.random() < 0.4 else secret
                w += [*before, secret]
                y += [0] * len(before) + [1]
            elif chance < 0.08:
                w.append(_decoy(random))
                y.append(0)
        for i in range(1, len(y)):
            if y[i] and y[i - 1]:
                y[i] = 2
        step = file_step(sum(not _PLAIN(x) for x in w), len(w))
        words += [(x, step) for x in w]
        gold += y
        lengths.append(len(w))
    kinds = {w: i for i, w in enumerate(dict.fromkeys(words))}
    types = np.array([kinds[w] for w in words], np.int64)
    steps = np.array([[FILE_FEATURE + step] for _, step in kinds], np.int64)
    features = np.concatenate([_features([w for w, _ in kinds]), steps], 1)
    weights, trans = crf.train(features, types, np.array(gold, np.int64), np.array(lengths, np.int64), LABELS, N_FEATURES, ROUNDS, shifts=(-1, 0, 1))
    return Model(weights, trans)


def _scores(model: Model) -> crf.TypeScores:
    return held(("secrets", model.weights.tobytes()[:4096]), lambda: crf.TypeScores(model.emissions, 3 * LABELS + 1))


def emissions(words: list[str], model: Model) -> np.ndarray:
    """Scores of each word of a text for O, B and I, with those of its neighbours and its file."""
    k, found = LABELS, _scores(model).of(words)
    step = file_step(float(found[:, 3 * k].sum()), len(words))
    before, own, after = (found[:, i * k : (i + 1) * k] + model.file[i, step] for i in range(3))
    out = own.copy()
    out[1:] += before[:-1]
    out[:-1] += after[1:]
    return out


def tagged_words(words: list[str], model: Model) -> np.ndarray:
    """The label of each word of a text on its best path."""
    scores = emissions(words, model)
    unsure = (scores[:, :1] - scores[:, 1:] <= model.gain[1:]).any(1)
    labels = np.zeros(len(words), np.int64)
    if unsure.any():
        # Stretches of unsure words with a certain one at each end, where there is one.
        near = unsure.copy()
        near[1:] |= unsure[:-1]
        near[:-1] |= unsure[1:]
        rows = np.flatnonzero(near)
        # Two certain words in a row end one stretch and begin the next.
        fresh = (np.diff(rows) > 1) | (~unsure[rows[1:]] & ~unsure[rows[:-1]])
        lengths = np.diff(np.flatnonzero(np.concatenate([[True], fresh, [True]])))
        labels[rows] = crf.viterbi(scores[rows], lengths, model.trans)
    return labels


def crf_spans(text: str, model: Model) -> list[tuple[int, int]]:
    """Spans of the field's begins with their insides, from the first value-like run to the end of the last."""
    words = text.split()
    if not words:
        return []
    labels = tagged_words(words, model)
    if not labels.any():
        return []
    out: list[tuple[int, int]] = []
    inside = False
    for label, m in zip(labels, re.finditer(r"\S+", text), strict=True):
        if label:
            core = max(_VALUE.finditer(m[0]), key=lambda v: v.end() - v.start(), default=None)
            start, end = (m.start() + core.start(), m.start() + core.end()) if core else m.span()
            if label == 2 and inside:
                out[-1] = out[-1][0], end
            else:
                out.append((start, end))
        inside = label > 0
    return out


def scan(text: str | None, model: Model) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, base_sha256, spans of a whole text."""
    text = text or ""
    base = base_spans(text)
    joined = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    starts, reach = [s for s, _, _ in base], list(itertools.accumulate((e for *_, e in base), max))
    met = lambda s, e: (i := bisect.bisect_left(starts, e)) > 0 and reach[i - 1] > s  # noqa: E731  a base span overlaps
    more = [(s, 3, e) for s, e in crf_spans(text, model) if not met(s, e)]
    counts = [sum(k == i for _, k, _ in base) for i in range(3)]
    return *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)


def sample(docs: DataFrame) -> list[str]:
    """At most TRAIN_ROWS texts, spread over all documents by a hash of doc_id; of a longer text, a window of TRAIN_CHARS from a hashed place."""
    usable = docs.where(F.col("text").isNotNull())
    spread = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30))
    start = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1))).cast("int")
    n = docs.count()
    share = usable.where(spread < int((1 << 30) * min(1.0, 3.0 * TRAIN_ROWS / max(n, 1))))
    picked = share.select(spread.alias("at"), F.substr("text", start + 1, F.lit(TRAIN_CHARS)).alias("text"))
    return [r["text"] for r in picked.orderBy("at", "text").limit(TRAIN_ROWS).collect()]


def scan_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Secrets of every row of docs (doc_id, text).

    spans lists kind:start:end in code points, end exclusive, by start. A null text
    counts as empty: no spans, and the checksum of an empty string. Equal rows get
    equal results; other columns are ignored.
    """

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in each:
            yield doc_id, *scan(text, model)

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: secrets of all documents."""
    docs = table(spark, sf_dir, "documents")
    return scan_documents(docs, learn(sample(docs)))
