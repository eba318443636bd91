"""Op 7: best-fit decreasing packing of token sequences into windows.

A document longer than a window first gives full windows, each a sequence of its
own; what is left over is one piece shorter than a window. Pieces are dealt to
groups of a bounded number by a hash of doc_id, and each group is packed alone:
longest piece first, each into the open window whose remaining capacity is the
smallest that still holds it. A segment tree over remaining capacities finds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.arrow import map_rows
from leafmark.llm.tokens import crc_u32, encoder, tokenizer_path
from leafmark.storage import materialize, table

WINDOW = 4096
END_ID = 2
#: Pieces of a group on average. Each group leaves about one window part empty.
GROUP_PIECES = 2048
#: Sequence ids are group << SEQUENCE_BITS | number within the group.
SEQUENCE_BITS = 32


class CapacityTree:
    """Open windows by remaining capacity; leaf c of the tree counts those with c left."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        at = self.size + capacity
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes the tightest window with at least this capacity: (capacity, window)."""
        at, count = self.size + least, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        capacity = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window number, offset) of each piece, for lengths in descending order, at most window each."""
    tree, made, out = CapacityTree(window), 0, []
    for n in lengths:
        found = tree.take(n)
        capacity, number = found or (window, made)
        made += found is None
        out.append((number, window - capacity))
        if capacity > n:
            tree.add(capacity - n, number)
    return out


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def cut(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Token ids of each whole text, with the end id, cut into full windows and a rest."""
    where = vocabulary or tokenizer_path()

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        encode, end = encoder(where).encode, np.array([end_id], "<u2").tobytes()
        for doc_id, text in each:
            ids = np.frombuffer(encode(text) + end, "<u2")
            for at in range(0, len(ids), window):
                own = ids[at : at + window]
                out = (doc_id, at, len(own), crc_u32(own), len(ids))
                yield (*out, own.tolist()) if with_ids else out

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, PIECES + (", ids array<int>" if with_ids else ""))


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Packs docs (doc_id, text) into sequences of at most window tokens.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and ids if asked for. A null or empty text is its end id
    alone. Rows of one doc_id are documents of their own. An empty table gives no
    row. Other columns are ignored. Ties in length go by doc_id, start and
    checksum, so the packing does not depend on the partitioning.
    """
    pieces = materialize(cut(docs, vocabulary, end_id, window, with_ids), "pieces")
    full = pieces.where(F.col("length") == window)
    rest = pieces.where(F.col("length") < window)
    groups = max(1, math.ceil(rest.count() / GROUP_PIECES))
    group = F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(groups))
    dealt = rest.select(group.alias("group_id"), "*").repartition("group_id").sortWithinPartitions("group_id", F.desc("length"), "doc_id", "start", "ids_crc32")
    names = pieces.columns

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        from itertools import groupby

        for key, members in groupby(each, key=lambda r: r[0]):
            own = list(members)
            for r, (number, offset) in zip(own, best_fit([r[3] for r in own], window), strict=True):
                yield (*r[1:], key << SEQUENCE_BITS | number, offset)

    kinds = PIECES + (", ids array<int>" if with_ids else "")
    packed = map_rows(dealt.select("group_id", *names), rows, f"{kinds}, sequence_id bigint, offset bigint")
    # Full windows: ids above those of all groups, a number for each row from its partition and place.
    alone = full.withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents in windows of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"))
