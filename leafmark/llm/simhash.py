"""Op 9: SimHash fingerprints linked at a small Hamming distance by a Gray-order index.

Fingerprints that differ in at most r bits agree on one of r + 1 blocks of bits, so
each distinct fingerprint is dealt to r + 1 buckets, one for each block's value. A
bucket that holds too many is cut again by blocks of the bits that it leaves free;
after a few cuts so few bits are free that a bucket is small by necessity. Within a
bucket the fingerprints are sorted by Gray rank, where neighbours share most bits,
and an index over that order finds the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.arrow import map_rows
from leafmark.llm.components import connected
from leafmark.storage import materialize, table

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints of a bucket before it is cut again.
BUCKET = 4096
FANOUT = 8
QUERIES = 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 if it has no word."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join
    parts = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    hashes = np.frombuffer(b"".join([digest(join(p), seed) for p in parts]), np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Codes in Gray order under a tree of masked bit patterns.

    A node stands for a run of codes and keeps the bits they all share. Those its
    parent keeps already are factored out, so the differences counted on the way
    down add up, and a whole run is left as soon as they exceed the radius.
    """

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT) -> None:
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes, self.fanout = codes[self.order], fanout
        levels = [(self.codes, self.codes)]  # bits set in all, bits set in any
        while len(levels[-1][0]) > 1:
            low, high = levels[-1]
            cuts = np.arange(0, len(low), fanout)
            levels.append((np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)))
        shared = [~(low ^ high) for low, high in levels]
        self.levels = []
        for k in reversed(range(len(levels))):
            mask = shared[k]
            if k + 1 < len(levels):
                mask = mask & ~shared[k + 1][np.arange(len(mask)) // fanout]
            self.levels.append((levels[k][0], mask))

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query's place, code's place in the given order) within the radius."""
        at, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        gone = np.zeros(len(queries), np.int64)
        for k, (pattern, mask) in enumerate(self.levels):
            if k:
                node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                inside = node < len(pattern)
                node, at, gone = node[inside], np.repeat(at, self.fanout)[inside], np.repeat(gone, self.fanout)[inside]
            gone = gone + np.bitwise_count((queries[at] ^ pattern[node]) & mask[node])
            near = gone <= radius
            at, node, gone = at[near], node[near], gone[near]
        return at, self.order[node]


def linked(codes: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For distinct codes, the smallest place of each one's group of links among them."""
    label, index = np.arange(len(codes)), GrayIndex(codes)
    for start in range(0, len(codes), QUERIES):
        a, b = index.search(codes[start : start + QUERIES], radius)
        a = a + start
        a, b = a[a != b], b[a != b]
        while len(a):
            x, y = label[a], label[b]
            if (x == y).all():
                break
            low, high = np.minimum(x, y), np.maximum(x, y)
            np.minimum.at(label, high, low)
            label = label[label]
            while (label != label[label]).any():
                label = label[label]
    return label


def _cut(mask: int, parts: int) -> list[int]:
    """The mask with each of several parts of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    size, more = divmod(len(free), parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i < more)
        out.append(mask | sum(1 << b for b in free[at : at + n]))
        at += n
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Each row (mask, fp, rep) once for each of the masks that follow its own."""
    follow = F.create_map(*(x for k, v in masks.items() for x in (F.lit(_signed(k)).cast("long"), F.array(*(F.lit(_signed(m)).cast("long") for m in v)))))
    return rows.select(F.explode(follow[F.col("mask")]).alias("mask"), "fp", "rep").withColumn("value", F.col("mask").bitwiseAND(F.col("fp")))


def links(classes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that join the same groups as all pairs within the radius would.

    classes: distinct fingerprints fp (long) with a node rep (long, not null) each.
    """
    masks = {0: _cut(0, radius + 1)}
    rows, done = _deal(classes.select(F.lit(0).cast("long").alias("mask"), "fp", "rep"), masks), None
    while True:
        masks = {m: _cut(m, radius + 1) for ms in masks.values() for m in ms}
        if min(64 - m.bit_count() for m in masks) <= 12:
            break  # at most 2 ** 12 distinct fingerprints are left in a bucket
        sizes = rows.groupBy("mask", "value").agg(F.count("*").alias("n"))
        hot = materialize(sizes.where(F.col("n") > bucket).select("mask", "value"), "hot")
        if hot.isEmpty():
            break
        calm = rows.join(hot, ["mask", "value"], "left_anti").select("mask", "fp", "rep", "value")
        done = calm if done is None else done.unionByName(calm)
        rows = materialize(_deal(rows.join(hot, ["mask", "value"], "left_semi"), masks), "dealt")
    rows = rows.select("mask", "fp", "rep", "value") if done is None else done.unionByName(rows.select("mask", "fp", "rep", "value"))
    dealt = rows.select("mask", "value", "fp", "rep").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")

    def pairs(each: Iterator[tuple]) -> Iterator[tuple]:
        for _, members in groupby(each, key=lambda r: r[:2]):
            own = list(members)
            if len(own) > 1:
                label = linked(np.array([r[2] for r in own], np.int64).view(np.uint64), radius)
                for i in np.flatnonzero(label != np.arange(len(own))):
                    yield own[i][3], own[label[i]][3]

    return map_rows(dealt, pairs, "u bigint, v bigint")


def fingerprints(docs: DataFrame) -> DataFrame:
    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in each:
            yield doc_id, _signed(fingerprint(text))

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, "doc_id bigint, fp bigint")


def groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprint and near-copy group of every row of docs (doc_id, text).

    A null text, and one without a word, has fingerprint zero and links like any
    other. component_id is the smallest doc_id that links reach. Rows of one doc_id
    are one node, so they join their groups. A row with a null doc_id takes the
    group of its fingerprint's other documents (null if there are none) and links
    nothing itself. An empty table gives no row. Other columns are ignored.
    """
    marked = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    known = classes.where("rep IS NOT NULL")
    found = links(known, radius)
    # A doc_id whose rows have different fingerprints joins their classes.
    several = marked.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    again = marked.join(several, "doc_id", "left_semi").join(known, "fp").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    joined = connected(found.unionByName(again))
    named = classes.join(joined, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def _named(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def _first_rows(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The smallest row of each doc_id in first (by text, then by a hash of the rest), and the rows with a null doc_id; columns as they were."""
    rest = [c for c in docs.columns if c != "doc_id"]
    row = F.struct(*(_named(c).alias(c) for c in rest))
    order = F.struct("text", F.xxhash64(F.to_json(F.struct(*(_named(c).alias(f"c{i}") for i, c in enumerate(rest) if c != "text"), F.lit(0).alias("end")))))
    kept = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("row"))
    return kept.select(*(F.col("doc_id") if c == "doc_id" else F.col("row").getField(c).alias(c) for c in docs.columns)).unionByName(docs.where("doc_id IS NULL"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without those that are not the first of their group; columns as they were.

    Of rows of one doc_id the smallest stays. Rows with a null doc_id all stay.
    """
    first = groups(docs.where("doc_id IS NOT NULL"), radius).where("doc_id = component_id").select("doc_id").distinct()
    return _first_rows(docs, first)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: fingerprint and group of all documents."""
    return groups(table(spark, sf_dir, "documents"))
