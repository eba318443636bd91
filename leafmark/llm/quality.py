"""Op 1: quality rules by distribution divergence.

Each text's histogram of character classes and its histogram of common words are
held against references of its language by Jensen-Shannon distance. The references
are means over all documents that pass the base rules, so one long text weighs no
more than a short one. A distance counts only if the text is long enough for it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.arrow import map_rows
from leafmark.storage import materialize, table

#: Function words of each language that has a reference: its most common words, from general knowledge.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er so dass",
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son",
    "it": "di che e la il un a per in una sono mi ho lo ma ha le si ti i con cosa se io come da ci no questo",
    "nl": "de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das",
}
MIN_WORDS = 50
MIN_CHARS = 200
#: Distances (0 to 1) beyond which a text fails.
CHAR_LIMIT = 0.30
WORD_LIMIT = 0.60
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "symbol", "other")
SCALE = 1_000_000
_WORDS = sorted({w.encode() for ws in COMMON_WORDS.values() for w in ws.split()})
_FORMS = {f: i for i, w in enumerate(_WORDS) for f in (w, w.decode().capitalize().encode())}


def _class_of(cp: int) -> int:
    c, kind = chr(cp), unicodedata.category(chr(cp))
    if c in SPACES or kind[0] == "Z":
        return 3
    if c in SYMBOLS or kind in ("Sm", "Sc", "Sk", "So"):
        return 6
    if c in ".,;:!?":
        return 4
    return {"Lu": 1, "Lt": 1, "Nd": 2}.get(kind, 0 if kind[0] in "LM" else 5 if kind[0] == "P" else 7)


_TABLE = np.array([_class_of(i) for i in range(0x3000)], np.uint8)


def char_classes(text: str) -> np.ndarray:
    """Code points of each of CLASSES in the whole text."""
    cps = np.frombuffer(text.encode("utf-32-le"), "<u4")
    rare = cps >= len(_TABLE)
    if not rare.any():
        return np.bincount(_TABLE[cps], minlength=len(CLASSES))
    out = np.bincount(_TABLE[cps[~rare]], minlength=len(CLASSES))
    for cp, n in zip(*np.unique(cps[rare], return_counts=True), strict=True):
        out[_class_of(int(cp))] += n
    return out


def repeat_words(ids: np.ndarray, kinds: int, window: int = 3) -> int:
    """Words in windows that stand twice or more."""
    if len(ids) <= window:
        return 0
    n = len(ids) - window + 1
    key = ids[:n].astype(np.int64)
    for k in range(1, window):
        if kinds and key.max() >= (1 << 62) // max(kinds, 1):
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * kinds + ids[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    inside = np.zeros(len(ids), bool)
    found = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    for k in range(window):
        inside[found + k] = True
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, bool, np.ndarray, np.ndarray]:
    """The base counts of a whole text, whether it fails by them, and its two histograms."""
    text = text or ""
    words = text.encode().split()
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n_repeat = repeat_words(ids, len(index))
    common = np.zeros(len(_WORDS) + 1, np.int64)
    counts = np.bincount(ids, minlength=len(index))
    for form in _FORMS.keys() & index.keys():
        common[_FORMS[form]] += counts[index[form]]
    common[-1] = len(words) - common.sum()
    failed = len(words) < MIN_WORDS or 100 * n_repeat > 50 * len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), n_repeat, failed, char_classes(text), common


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of rows of p and q, each scaled to sum 1; 1 if one is empty."""
    p, q = np.atleast_2d(p).astype(float), np.atleast_2d(q).astype(float)
    a, b = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
    p, q = p / np.maximum(a, 1e-300), q / np.maximum(b, 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        of = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(1)
        out = np.sqrt(np.clip((of(p) + of(q)) / 2, 0, 1))
    return np.where((a[:, 0] > 0) & (b[:, 0] > 0), out, 1.0)


FEATURES = "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, classes binary, common binary"


def features(docs: DataFrame) -> DataFrame:
    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, lang, text in each:
            *base, classes, common = measure(text)
            yield doc_id, lang, *base, classes.astype("<i8").tobytes(), common.astype("<i8").tobytes()

    return map_rows(docs, rows, FEATURES)


def references(found: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean histograms of each language over all its documents that pass the base rules."""

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        sums: dict[str, np.ndarray] = {}
        for lang, *parts in each:
            hists = [np.frombuffer(x, "<i8") for x in parts]
            share = np.concatenate([h * SCALE // max(1, int(h.sum())) for h in hists])
            sums[lang] = sums.get(lang, 0) + share
        for lang, s in sums.items():
            for i in np.flatnonzero(s):
                yield lang, int(i), int(s[i])

    usable = found.where(~F.col("base_failed") & F.col("lang").isNotNull()).select("lang", "classes", "common")
    sums = map_rows(usable, rows, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    out = {}
    for r in sums.collect():  # languages by bins
        out.setdefault(r["lang"], np.zeros(len(CLASSES) + len(_WORDS) + 1))[r["bin"]] = r["n"]
    return {k: (v[: len(CLASSES)], v[len(CLASSES) :]) for k, v in sorted(out.items())}


def judge(docs: DataFrame, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """Base counts and verdict of every row of docs (doc_id, text, lang).

    A text is held against the reference of its lang; if that is null or has no
    reference, against the one whose common words are nearest. The character
    distance counts from MIN_CHARS code points on; the common-word distance from
    MIN_WORDS words on, and only where the reference's language has a list of
    common words, so a text in another language is judged by its characters. A null text has no words, and fails for that; so does an
    empty one. If nothing passes the base rules there is no reference, and the base
    rules alone decide. Equal rows get equal results. Other columns are ignored.
    """
    found = materialize(features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")), "quality")
    known = references(found)
    names = list(known)
    listed = [i for i, n in enumerate(names) if n in COMMON_WORDS] or list(range(len(names)))

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        while part := list(islice(each, 1024)):
            classes = np.array([np.frombuffer(r[8], "<i8") for r in part])
            common = np.array([np.frombuffer(r[9], "<i8") for r in part])
            if names:
                by_word = np.stack([js_distance(common, known[n][1]) for n in names], 1)
                by_char = np.stack([js_distance(classes, known[n][0]) for n in names], 1)
                near = np.array(listed)[by_word[:, listed].argmin(1)]
                at = np.array([names.index(r[1]) if r[1] in known else near[i] for i, r in enumerate(part)])
                row = np.arange(len(part))
                word, char = by_word[row, at], by_char[row, at]
            for i, r in enumerate(part):
                d_char = float(char[i]) if names and classes[i].sum() >= MIN_CHARS else None
                d_word = float(word[i]) if names and r[2] >= MIN_WORDS and names[at[i]] in COMMON_WORDS else None
                passed = (d_char is None or d_char <= char_limit) and (d_word is None or d_word <= word_limit)
                yield r[0], *r[2:8], bool(passed and not r[7]), names[at[i]] if names else None, d_char, d_word

    out = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, reference string, char_distance double, word_distance double"
    return map_rows(found, rows, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: base counts and verdict of all documents."""
    return judge(table(spark, sf_dir, "documents"))
