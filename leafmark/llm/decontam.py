"""Op 10: benchmark decontamination by latent semantic retrieval.

TF-IDF passages are projected on the leading right singular vectors of a passage
matrix, found by a randomised SVD whose products are summed over partitions. Each
passage of every document is held against all benchmark passages by cosine; what
comes near, or has a run of words in common with an item, is checked by the longest common subsequence of words and by whether the
item's answer is there too, so that paraphrases count and chance likeness does not.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.arrow import map_rows
from leafmark.storage import materialize, table

#: Latent dimensions, and more columns for the sketch.
RANK, EXTRA = 128, 16
POWER = 2
#: Passages: windows of two steps.
STEP = 24
#: Cosine from which a passage is a candidate.
COSINE = 0.60
#: Shares of an item's words in common, in order: enough alone, and enough with the answer.
VERBATIM, PARAPHRASE, ANSWER = 0.80, 0.50, 0.5
#: An item of fewer words must be there word for word.
SHORT = 8
#: Words of less weight are too common to tell an item by, and are left out of both sides
#: of the comparison unless fewer than SHORT would be left of the item.
LIGHT = 1.0
#: Words in a row that a text and an item have in common for the item to be a candidate; all of a shorter item.
GRAM = 5
#: Items (with all their passages) of a block; more items are searched block by block.
#: RANK dimensions tell the passages of some 200 items apart, and lose some of more.
ITEM_BLOCK = 200
BLOCK_CHARS = 2_000_000
_KEEP = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_KEEP).split()


def vocabulary(items: list[list[bytes]]) -> dict[bytes, int]:
    """The words of a block of items, numbered from 1."""
    return {w: i for i, w in enumerate(sorted({w for words in items for w in words}), 1)}


def numbers_of(words: list[bytes], vocab: dict[bytes, int]) -> np.ndarray:
    """Each word's number, 0 for words that no item has."""
    return np.fromiter(map(vocab.get, words, repeat(0)), np.int64, len(words))


def frequencies(docs: DataFrame, vocab: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each word of the vocabulary stands, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        vocab, n = shared.value, 0
        known, counts = frozenset(vocab), Counter()
        for (text,) in each:
            counts.update(known.intersection(words_of(text)))
            n += 1
        yield 0, n
        yield from ((vocab[w], k) for w, k in counts.items())

    total = map_rows(docs.select("text"), rows, "word int, n bigint", out_rows=20_000).groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocab) + 1)
    for r in total.collect():  # the words of a block of items at most
        out[r["word"]] = r["n"]
    return out, int(out[0])


def passages(ids: np.ndarray) -> list[np.ndarray]:
    """Windows of two steps over the ids of a text, one step apart."""
    return [ids[i : i + 2 * STEP] for i in range(0, max(1, len(ids) - STEP), STEP)]


def _sketch(parts: list[np.ndarray], weights: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """A'(A C) for the TF-IDF rows A of the passages and a matrix of columns C."""
    flat, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    w = weights[flat]
    norm = np.sqrt(np.bincount(row, w * w, len(parts))) + 1e-9
    w = w / norm[row]
    mapped = np.zeros((len(parts), columns.shape[1]))
    np.add.at(mapped, row, w[:, None] * columns[flat])
    out = np.zeros_like(columns)
    np.add.at(out, flat, w[:, None] * mapped[row])
    return out


def fit_basis(spark: SparkSession, parts: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """[words, RANK] leading right singular vectors of the TF-IDF matrix of a block's passages.

    Randomised subspace iteration: each round multiplies a thin matrix by A'A, the
    sum over partitions of their own products, and makes its columns orthonormal.
    """
    width, tasks = min(RANK + EXTRA, len(weights)), 4
    matrix = spark.createDataFrame(pa.table({"ids": pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))})).repartition(tasks)
    columns = np.linalg.qr(np.random.default_rng(3).standard_normal((len(weights), width)))[0]

    def product(now: np.ndarray) -> np.ndarray:
        def rows(each: Iterator[tuple]) -> Iterator[tuple]:
            own = [np.array(ids, np.int64) for (ids,) in each]
            if own:
                yield (_sketch(own, weights, now).astype(np.float32).tobytes(),)

        parts = map_rows(matrix, rows, "part binary", out_rows=1).toLocalIterator()
        return sum(np.frombuffer(r[0], np.float32).reshape(now.shape).astype(float) for r in parts)

    for _ in range(POWER):
        columns = np.linalg.qr(product(columns))[0]
    # Rotate to singular directions and keep the leading ones.
    middle = columns.T @ product(columns)
    turn = np.linalg.eigh((middle + middle.T) / 2)[1]
    return (columns @ turn[:, ::-1])[:, :RANK].astype(np.float32)


def lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, one bit of a number for each word of a."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & at.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def grams(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size words."""
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for i in range(size):
        out = (out ^ ids[i : i + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Index:
    """Benchmark items, their latent passages, and what finding them in a text takes."""

    def __init__(self, spark: SparkSession, items: list[tuple[int, str]], vocab: dict[bytes, int], weights: np.ndarray) -> None:
        self.light = {w for w, i in vocab.items() if weights[i] < LIGHT}
        self.items, all_bare = [], True
        for i, t in items:
            sentences = [w for s in re.split("[.?!]", t or "") if (w := words_of(s))]
            words, answer = words_of(t), sentences[-1] if sentences else []
            telling = self.telling(words)
            bare = len(telling) >= SHORT
            all_bare &= bare
            # The item, its words, those compared, those of its answer, and whether common ones are out.
            self.items.append((i, words, telling if bare else words, (self.telling(answer) or answer) if bare else answer, bare))
        # Common words are left out of the latent space too, unless some item has little else.
        used = np.where(weights < LIGHT, 0.0, weights) if all_bare else weights.copy()
        used[0] = 0.0
        own = [(k, p) for k, (_, words, *_) in enumerate(self.items) for p in passages(numbers_of(words, vocab)) if len(p)]
        basis = fit_basis(spark, [p for _, p in own], used) if own else np.zeros((len(used), 1), np.float32)
        self.vocab, self.latent_word = vocab, used > 0
        self.basis = basis * used[:, None].astype(np.float32)
        latent = [self.basis[p].sum(0) for _, p in own]
        self.owners = np.array([k for k, _ in own], np.int64)
        self.latent = np.array([z / (np.linalg.norm(z) + 1e-9) for z in latent], np.float32).reshape(len(own), self.basis.shape[1])

        # For each gram size, the hashes of the items' grams in order, and each one's item.
        self.exact = []
        told: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (_, words, *_) in enumerate(self.items):
            if words:
                size = min(GRAM, len(words))
                told.setdefault(size, []).append((np.unique(grams(numbers_of(words, vocab), size)), k))
        for size, own_grams in sorted(told.items()):
            hashes, places = np.concatenate([g for g, _ in own_grams]), np.repeat([k for _, k in own_grams], [len(g) for g, _ in own_grams])
            order = np.argsort(hashes, kind="stable")
            self.exact.append((size, hashes[order], places[order]))

    def telling(self, words: list[bytes]) -> list[bytes]:
        """The words that are not too common."""
        return [w for w in words if w not in self.light]

    def same_runs(self, ids: np.ndarray) -> list[tuple[int, int, float]]:
        """(item's place, first word, 0) of the runs of words in common with an item, one for every STEP words."""
        out = set()
        known = ids > 0
        for size, hashes, places in self.exact:
            if len(ids) < size:
                continue
            all_known = np.lib.stride_tricks.sliding_window_view(known, size).all(1)
            at = np.flatnonzero(all_known)
            own = grams(ids, size)[at]
            low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            for i in np.flatnonzero(high > low):
                out.update((int(k), int(at[i]) // STEP * STEP) for k in places[low[i] : high[i]])
        return [(k, at, 0.0) for k, at in sorted(out)]

    def candidates(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(item's place, first word of the passage, cosine) from COSINE on, and of runs in common (cosine 0 if not that near)."""
        ids = numbers_of(words, self.vocab)
        near = self.near_passages(np.where(self.latent_word[ids], ids, 0))
        there = {(k, at) for k, at, _ in near}
        return near + [r for r in self.same_runs(ids) if r[:2] not in there]

    def near_passages(self, ids: np.ndarray) -> list[tuple[int, int, float]]:
        """(item's place, first word of the passage, cosine) from COSINE on."""
        hits = np.flatnonzero(ids)
        if not len(hits) or not len(self.owners):
            return []
        step = hits // STEP
        first = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1]]))
        z = np.zeros((max(2, -(-len(ids) // STEP)), self.basis.shape[1]), np.float32)
        z[step[first]] = np.add.reduceat(self.basis[ids[hits]], first, 0)
        z = z[:-1] + z[1:]
        norm = np.linalg.norm(z, axis=1)
        there = np.flatnonzero(norm > 1e-6)
        z = z[there] / norm[there, None]
        out = []
        for at in range(0, len(z), 4096):
            near = z[at : at + 4096] @ self.latent.T
            out += [(int(self.owners[q]), int(there[at + p]) * STEP, float(near[p, q])) for p, q in zip(*np.nonzero(near >= COSINE), strict=True)]
        return out

    def leaks(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        """(item_id, cosine, share of the item in common, share of its answer, first word of the passage) of each item found."""
        words = words_of(text)
        best: dict[int, tuple[float, float, float, int]] = {}
        for k, at, cosine in self.candidates(words):
            _, whole, item, answer, bare = self.items[k]
            region = words[max(0, at - len(whole)) : at + 2 * STEP + len(whole)]
            if len(whole) < SHORT:
                joined = b" ".join([b"", *region, b""])
                share = found = float(b" ".join([b"", *whole, b""]) in joined)
            else:
                region = self.telling(region) if bare else region
                # The best stretch about as long as the item, not scattered words of a long region.
                span, share, found = len(item) + len(item) // 4, 0.0, 0.0
                if sum(map(set(region).__contains__, item)) < PARAPHRASE * len(item) or lcs(item, region) < PARAPHRASE * len(item):
                    continue
                for s in range(0, max(1, len(region) - span // 2), max(1, len(item) // 8)):
                    part = region[s : s + span]
                    x = lcs(item, part) / len(item)
                    if x > share:
                        share, found = x, lcs(answer, part) / max(1, len(answer))
            if share >= VERBATIM or (share >= PARAPHRASE and found >= ANSWER):
                old = best.get(k)
                if old is None or (share, cosine) > (old[1], old[0]):
                    best[k] = cosine, share, found, at
        return [(self.items[k][0], *v) for k, v in sorted(best.items())]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ITEM_BLOCK items and BLOCK_CHARS characters at most, one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(math.ceil(n / ITEM_BLOCK), math.ceil(chars / BLOCK_CHARS))
    for b in range(blocks):
        own = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()]
        if own:
            yield own


def indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[Index]:
    """An index for each block of items, one at a time; document frequencies are of all docs."""
    for own in _blocks(benchmark):
        vocab = vocabulary([words_of(t) for _, t in own])
        found, n = frequencies(docs, vocab)
        yield Index(docs.sparkSession, own, vocab, np.log((1 + n) / (1 + found)) + 0.1)


def _leaks(docs: DataFrame, benchmark: DataFrame, key: str) -> DataFrame:
    """Items found in each row of docs (key, text): a written table of key and LEAK.

    A block of items is indexed, sent out, searched for in all documents and let go before the
    next, so neither the driver nor a worker holds more than one.
    """
    spark, out = docs.sparkSession, None
    for built in indexes(docs, benchmark):
        shared = spark.sparkContext.broadcast(built)

        def rows(each: Iterator[tuple], shared=shared) -> Iterator[tuple]:
            index = shared.value
            for k, text in each:
                for leak in index.leaks(text):
                    yield k, *leak

        part = materialize(map_rows(docs.select(key, "text"), rows, f"{key} bigint, {LEAK}"), "leaks")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], f"{key} bigint, {LEAK}") if out is None else out


LEAK = "item_id bigint, cosine double, share double, answer_share double, first_word bigint"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Items found in each row of docs (doc_id, text): doc_id, item_id, cosine, share, answer_share, first_word.

    A row for each document and item found; clean documents have none. A null text
    holds nothing; a null item is not searched. Equal rows get equal results, and
    each repeated item its own. Other columns of both tables are ignored.
    """
    return _leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, "doc_id")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows in which an item is found; columns as they were.

    What is found hangs on the text alone, so rows go by a hash of it. Spark broadcasts
    the hashes if they are few, by their size as written.
    """
    mark = F.xxhash64("text")
    found = _leaks(docs.select(mark.alias("mark"), "text"), benchmark, "mark").select("mark").distinct()
    found = materialize(found, "leaky")
    return docs.join(found, mark == found["mark"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: benchmark items found in all documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
