"""Op 3: token ids as one wavelet-matrix file per shard segment.

A wavelet matrix keeps a sequence as bit planes. Plane k holds bit k (highest
first) of every id in the order left by the planes above it, which have moved the
ids with a 0 bit before those with a 1 bit, each in its old order. With a rank
directory on each plane, one id is read, its occurrences before a place counted,
and its j-th occurrence found, in one step a plane.

Each segment is one blob of zstd-compressed planes in one row of a Parquet table,
written by Spark's own committer to the shared folder: a lost executor leaves no
half-written file, and any store that Spark writes will do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.arrow import map_rows
from leafmark.llm.tokens import crc_u32, encoder, tokenizer_path
from leafmark.storage import new_path, table

MAGIC = b"WVM1"
#: Ids of a segment at least, but for a shard's last; whole documents only.
SEGMENT_IDS = 1 << 20
#: Shards for each shuffle partition.
SHARDS_EACH = 2
END_ID = 1


def _mask(n: int, bits: np.ndarray) -> pa.BooleanArray:
    return pa.BooleanArray.from_buffers(pa.bool_(), n, [None, pa.py_buffer(bits)])


class WaveletMatrix:
    """A sequence of unsigned integers as succinct bit planes."""

    def __init__(self, n: int, planes: np.ndarray, zeros: np.ndarray) -> None:
        self.n, self.planes, self.zeros, self._ranks = n, planes, zeros, None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        depth = max(1, int(ids.max()).bit_length()) if n else 1
        now = np.ascontiguousarray(ids, "<u2" if depth <= 16 else "<u4")
        planes, zeros = np.zeros((depth, (n + 7) // 8), np.uint8), np.zeros(depth, np.int64)
        for k in range(depth):
            planes[k] = np.packbits((now & now.dtype.type(1 << (depth - 1 - k))).astype(bool), bitorder="little")
            # Arrow filters by bitmaps as they are, several times faster than indexing by booleans.
            values = pa.array(now)
            low, high = (values.filter(_mask(n, bits)).to_numpy() for bits in (~planes[k], planes[k]))
            zeros[k] = len(low)
            now = np.concatenate([low, high])
        return cls(n, planes, zeros)

    def to_bytes(self) -> bytes:
        import zstandard

        packed = [zstandard.ZstdCompressor(level=1).compress(p.tobytes()) for p in self.planes]
        head = struct.pack("<4sQI", MAGIC, self.n, len(packed))
        return b"".join([head, *(struct.pack("<QQ", len(p), z) for p, z in zip(packed, self.zeros, strict=True)), *packed])

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        import zstandard

        magic, n, depth = struct.unpack_from("<4sQI", blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        sizes = [struct.unpack_from("<QQ", blob, 16 + 16 * k) for k in range(depth)]
        at, planes = 16 + 16 * depth, np.zeros((depth, (n + 7) // 8), np.uint8)
        for k, (size, _) in enumerate(sizes):
            raw = zstandard.ZstdDecompressor().decompress(blob[at : at + size], max_output_size=max(1, (n + 7) // 8)) if n else b""
            planes[k] = np.frombuffer(raw, np.uint8)
            at += size
        return cls(n, planes, np.array([z for _, z in sizes], np.int64))

    # rank and select -------------------------------------------------------

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        if self._ranks is None:
            count = np.array([bin(x).count("1") for x in range(256)], np.int64)
            self._ranks = [np.concatenate([[0], np.cumsum(count[p])]) for p in self.planes]
        byte, rest = divmod(i, 8)
        more = bin(int(self.planes[k][byte]) & ((1 << rest) - 1)).count("1") if rest else 0
        return int(self._ranks[k][byte]) + more

    def _bit(self, k: int, i: int) -> int:
        return int(self.planes[k][i >> 3]) >> (i & 7) & 1

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(len(self.planes)):
            bit, ones = self._bit(k, i), self._ones(k, i)
            i = int(self.zeros[k]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value before place i."""
        depth = len(self.planes)
        if value >> depth:
            return 0
        low, high = 0, min(i, self.n)
        for k in range(depth):
            a, b = self._ones(k, low), self._ones(k, high)
            low, high = (int(self.zeros[k]) + a, int(self.zeros[k]) + b) if value >> (depth - 1 - k) & 1 else (low - a, high - b)
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _seek(self, k: int, bit: int, j: int) -> int:
        """The place of the j-th (from 0) such bit of plane k."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(k, mid + 1)
            if (ones if bit else mid + 1 - ones) > j:
                high = mid
            else:
                low = mid + 1
        return low

    def select(self, value: int, j: int) -> int:
        """The place of the j-th occurrence of value, from 0."""
        if not 0 <= j < self.count(value):
            raise IndexError(j)
        depth, low = len(self.planes), 0
        for k in range(depth):
            ones = self._ones(k, low)
            low = int(self.zeros[k]) + ones if value >> (depth - 1 - k) & 1 else low - ones
        at = low + j
        for k in reversed(range(depth)):
            bit = value >> (depth - 1 - k) & 1
            at = self._seek(k, bit, at - int(self.zeros[k]) if bit else at)
        return at

    def occurrences(self, value: int) -> Iterator[int]:
        for j in range(self.count(value)):
            yield self.select(value, j)

    def decode(self) -> np.ndarray:
        """All ids: from the lowest plane up, each undoing its own partition."""
        depth = len(self.planes)
        now = np.zeros(self.n, np.uint16 if depth <= 16 else np.uint32)
        for k in reversed(range(depth)):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            back = np.empty_like(now)
            back[np.flatnonzero(~bit)] = now[: self.zeros[k]]
            back[np.flatnonzero(bit)] = now[self.zeros[k] :] | now.dtype.type(1 << (depth - 1 - k))
            now = back
        return now


SHARD_SCHEMA = "shard int, segment int, ids_before bigint, doc_ids array<bigint>, lengths array<bigint>, n_ids bigint, blob binary"


def _shard_of(doc_id: Column, bounds: list[int]) -> Column:
    """The number of bounds that doc_id exceeds, so shards ascend with it; null goes first."""
    if not bounds:
        return F.lit(0)
    cut = F.array(*(F.lit(b).cast("long") for b in bounds))
    return F.coalesce(F.size(F.filter(cut, lambda b: b < doc_id)), F.lit(0))


def _bounds(docs: DataFrame, shards: int) -> list[int]:
    if shards < 2:
        return []
    found = docs.select(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 10 * shards).alias("q")).first()["q"]
    return sorted(set(found or []))


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, shards: int | None = None) -> None:
    """Encodes docs (doc_id, text) and writes wavelet-matrix segments to path.

    Shards are ranges of doc_id cut at quantiles, so that ids of all shards in
    order are ids of all documents in ascending doc_id order (null first; rows of
    one doc_id by text). A null text holds the end id alone. An empty table gives
    no segment. Other columns are ignored.
    """
    spark = docs.sparkSession
    shards = shards or SHARDS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = _bounds(docs, shards)
    where = vocabulary or tokenizer_path()

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        encode, end = encoder(where).encode, np.array([end_id], "<u2").tobytes()
        shard, segment, before, ids, lengths, held, size = None, 0, 0, [], [], [], 0

        def flush() -> tuple:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(held), "<u2"))
            return shard, segment, before, ids, lengths, size, matrix.to_bytes()

        for at, doc_id, text in each:
            if held and (at != shard or size >= SEGMENT_IDS):
                yield flush()
                segment, before, ids, lengths, held, size = segment + 1, before + size, [], [], [], 0
            if at != shard:
                shard, segment, before = at, 0, 0
            own = encode(text) + end
            held.append(own)
            ids.append(doc_id)
            lengths.append(len(own) // 2)
            size += len(own) // 2
        if held:
            yield flush()

    dealt = docs.select(_shard_of(F.col("doc_id"), bounds).alias("shard"), "doc_id", "text").repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "text")
    map_rows(dealt, rows, SHARD_SCHEMA, out_rows=1).write.option("compression", "none").parquet(path)


def read_shards(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids."""
    stored = spark.read.parquet(path)
    # A row for each shard (a few for each shuffle partition), whatever the number of documents or segments.
    totals = {r["shard"]: r["n"] for r in stored.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    first, at = {}, 0
    for shard in sorted(totals):
        first[shard], at = at, at + totals[shard]
    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for shard, before, doc_ids, lengths, blob in each:
            ids, at = WaveletMatrix.from_bytes(blob).decode(), 0
            for doc_id, n in zip(doc_ids, lengths, strict=True):
                own = ids[at : at + n]
                out = (doc_id, first[shard] + before + at, n, crc_u32(own))
                yield (*out, own.tolist()) if with_ids else out
                at += n

    kept = stored.select("shard", "ids_before", "doc_ids", "lengths", "blob")
    return map_rows(kept, rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document's place, length and checksum, read back from the files."""
    path = new_path(spark, "shards")
    write_shards(table(spark, sf_dir, "documents"), path)
    return read_shards(spark, path)
