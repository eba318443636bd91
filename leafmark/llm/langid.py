"""Op 6: language of a text by a linear-chain conditional random field over its words.

A long word, as of a text without spaces, is cut into several. Each word has affix,
n-gram and lexicon features; learned transitions let the label change inside a text
where languages are mixed. Forward-backward over the whole text, one chain, gives each
word's label probabilities, and a text's are their mean over its words with a letter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm import caches, crf
from leafmark.llm.arrow import map_rows
from leafmark.storage import table

#: Labelled rows to learn from, for each language, at most, and the characters of a row's window at most.
TRAIN_ROWS = 160
TRAIN_CHARS = 20_000
LEXICON = 4000
BUCKETS = 1 << 15
WIDTH = 20
ROUNDS = 30
UNDETERMINED = "und"
#: Mean probability below which a text is in no learned language for certain.
LEAST_SCORE = 0.4


def held_out() -> Column:
    """True for every fifth document by crc32 of its doc_id; these are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _bare(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}<>«»…-#*$%&|@/\\=+0123456789").lower()


def words_of(text: str | None) -> list[str]:
    """The words of a text; one of more than WIDTH - 2 letters, or a text without spaces, is several of that length."""
    out = (text or "").split()
    size = WIDTH - 2
    if max(map(len, out), default=0) <= size:
        return out
    parts: list[str] = []
    for w in out:
        # Lower case may be longer than the word.
        if len(w) <= size or len(bare := _bare(w)) <= size:
            parts.append(w)
        else:
            parts.extend(bare[i : i + size] for i in range(0, len(bare), size))
    return parts


def word_features(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """Feature numbers of each word: 1-3 first and 1-4 last letters, its 3-grams, and its place in the lexicon. 0 is no feature."""
    bare = [_bare(w) for w in words]
    cut = [f"^{w}$" if len(w) <= WIDTH - 2 else f"^{w[: WIDTH // 2 - 1]}{w[-(WIDTH // 2 - 1) :]}$" for w in bare]
    chars = np.array(cut, f"U{WIDTH}").view(np.uint32).reshape(len(cut), WIDTH).astype(np.uint64) if cut else np.zeros((0, WIDTH), np.uint64)
    size = (chars > 0).sum(1)
    mixed = chars * np.uint64(0x9E3779B97F4A7C15)
    grams = (mixed[:, :-2] * np.uint64(31) + mixed[:, 1:-1] * np.uint64(17) + mixed[:, 2:]) ^ np.uint64(0xABCD)
    grams[chars[:, 2:] == 0] = 0
    columns = [grams]
    at = np.arange(len(cut))
    for n in (1, 2, 3):
        h = np.full(len(cut), n, np.uint64)
        for i in range(n):
            h = (h ^ chars[:, 1 + i]) * np.uint64(0x100000001B3) ^ (h >> np.uint64(29))
        columns.append(np.where(size > n + 2, h, 0)[:, None])
    for n in (1, 2, 3, 4):
        h = np.full(len(cut), 40 + n, np.uint64)
        for i in range(n):
            h = (h ^ chars[at, np.maximum(size - 2 - i, 0)]) * np.uint64(0x100000001B3) ^ (h >> np.uint64(29))
        columns.append(np.where(size > n + 2, h, 0)[:, None])
    hashed = np.concatenate(columns, 1)
    hashed ^= hashed >> np.uint64(32)
    hashed *= np.uint64(0xD6E8FEB86659FD93)
    numbers = np.where(np.concatenate(columns, 1) == 0, 0, 1 + (hashed >> np.uint64(40)) % np.uint64(BUCKETS - 1)).astype(np.int64)
    numbers[size <= 2] = 0
    return np.concatenate([numbers, np.array([BUCKETS + lexicon[w] if w in lexicon else 0 for w in bare], np.int64)[:, None]], 1)


class Model:
    """Languages, lexicon, feature weights and transitions."""

    def __init__(self, languages: list[str], lexicon: dict[str, int], weights: np.ndarray, trans: np.ndarray) -> None:
        self.languages, self.lexicon, self.weights, self.trans = languages, lexicon, weights, trans

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each language, and whether it has a letter."""
        import regex

        letter = regex.compile(r"\p{L}").search
        scores = self.weights[word_features(words, self.lexicon)].sum(1)
        return np.concatenate([scores, np.array([[letter(w) is not None] for w in words], np.float32)], 1)


def learn(rows: list[tuple[str, str]]) -> Model | None:
    """Fits the model to (text, language) rows; None without any."""
    languages = sorted({y for _, y in rows})
    if not languages:
        return None
    random = np.random.default_rng(7)
    pieces: list[tuple[int, list[str]]] = []
    counts: Counter = Counter()
    for text, y in sorted(rows):
        words = words_of(text)
        counts.update({w.strip(".,;:!?").lower() for w in words})
        at = 0
        while at < len(words):
            n = int(random.integers(4, 40))
            pieces.append((languages.index(y), words[at : at + n]))
            at += n
    lexicon = {w: i for i, (w, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) if n > 2 and w}
    # Pieces of several texts, and so of several languages, make a chain.
    order = random.permutation(len(pieces))
    gold, words, lengths = [], [], []
    for at in range(0, len(order), 4):
        own = [pieces[i] for i in order[at : at + 4]]
        lengths.append(sum(len(w) for _, w in own))
        for y, w in own:
            gold += [y] * len(w)
            words += w
    kinds = {w: i for i, w in enumerate(dict.fromkeys(words))}
    features = word_features(list(kinds), lexicon)
    types = np.array([kinds[w] for w in words], np.int64)
    weights, trans = crf.train(features, types, np.array(gold, np.int64), np.array(lengths, np.int64), len(languages), BUCKETS + LEXICON, ROUNDS)
    return Model(languages, lexicon, weights, trans)


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """At most TRAIN_ROWS labelled texts of each language from documents that are not held out.

    Of a text of more than TRAIN_CHARS characters, a window of that many from a place that a
    hash of its doc_id chooses. Every language with a labelled text is learned.
    """
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not sizes:
        return []
    share = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 2.0 * TRAIN_ROWS / r["n"]))))
    spread = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    start = F.pmod(F.xxhash64(F.lit(4), "doc_id"), F.greatest(F.length("text") - TRAIN_CHARS + 1, F.lit(1))).cast("int")
    few = usable.where(spread < share[F.col("lang")]).select("lang", F.substr("text", start + 1, F.lit(TRAIN_CHARS)).alias("text"), spread.alias("at"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))
    picked = few.withColumn("place", place).where(F.col("place") <= TRAIN_ROWS)
    return sorted((r["text"], r["lang"]) for r in picked.select("lang", "text").collect())


def _labels(model: Model | None) -> Callable[[Iterable[tuple]], Iterator[tuple]]:
    """A function from (doc_id, text) rows to (doc_id, lang_pred, score) rows in the same order."""
    key = b"" if model is None else model.weights.tobytes()[:4096] + model.trans.tobytes()

    def rows(each: Iterable[tuple]) -> Iterator[tuple]:
        if model is None:
            yield from ((doc_id, UNDETERMINED, 0.0) for doc_id, _ in each)
            return
        k = len(model.languages)
        scores = caches.held(("langid", key), lambda: crf.TypeScores(model.emissions, k + 1))
        held: list[tuple[int, int]] = []  # (document's place, words) of the block
        ids: list = []
        words: list[str] = []
        sums: list[np.ndarray] = []

        def block() -> None:
            lengths = np.array([n for _, n in held], np.int64)
            found = scores.of(words)
            emission, letter = found[:, :k], found[:, k:]
            marginal = crf.forward_backward(emission, lengths, model.trans, with_pairs=False)[0]
            marks = np.concatenate([marginal * letter, letter], 1)
            starts = np.cumsum([0, *lengths[:-1]])
            for (i, _), total in zip(held, np.add.reduceat(marks, starts, axis=0, dtype=np.float64), strict=True):
                sums[i] += total

        def results() -> Iterator[tuple]:
            for doc_id, total in zip(ids, sums, strict=True):
                if total[k] < 0.5:
                    yield doc_id, UNDETERMINED, 0.0
                else:
                    mean = total[:k] / total[k]
                    best = int(mean.argmax())
                    yield doc_id, model.languages[best], float(min(1.0, mean[best]))

        for doc_id, text in each:
            ids.append(doc_id)
            sums.append(np.zeros(k + 1))
            own = words_of(text)
            if own:
                held.append((len(ids) - 1, len(own)))
                words.extend(own)
            if len(words) >= crf.BLOCK_WORDS:
                block()
                held.clear()
                words.clear()
            if not held:
                yield from results()
                ids.clear()
                sums.clear()
        if held:
            block()
        yield from results()

    return rows


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text).

    A null text, or one without a letter, is ``und`` with score 0, as is every
    text if there was nothing to learn from. Ties go to the first language in
    order of its name. Only the text is used.
    """
    return map_rows(docs.select("doc_id", "text"), _labels(model), "doc_id bigint, lang_pred string, score double")


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """docs with the same columns, without rows that are ``und`` or score below least.

    Learns from the labelled rows of docs. Without any, nothing can be told between
    languages, and only rows without a letter go.
    """
    model = learn(sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")))
    if model is None:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    label = _labels(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                found = label((None, t) for t in part.column(at).to_pylist())
                yield part.filter(pa.array([y != UNDETERMINED and score >= least for _, y, score in found], pa.bool_()))

    # Under plain names, as mapInArrow takes a dot in a name for a field's.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: predicted language of all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    found = predict(docs, learn(sample(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
