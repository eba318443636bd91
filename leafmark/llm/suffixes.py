"""Op 4: removal of every byte covered by a 200-byte string that stands elsewhere too.

Suffixes are sorted where repeats can be: at anchors. Each 200-byte window has one
anchor in it, chosen by its content alone, so equal windows meet in the group of
their common anchor. A group's suffixes, and its prefixes read backwards, are put in
order by deep-shallow sorting: multikey quicksort down to a shallow depth, then a
blind trie for each set that still agrees. Neighbours' common lengths to both sides
then tell how far each member's repeats reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.anchors import anchors
from leafmark.llm.arrow import map_rows
from leafmark.storage import materialize, table

LENGTH = 200
GRAM = 64
#: Bytes that multikey quicksort compares before the rest goes to a blind trie.
SHALLOW = 80
LETTER = 8
#: A group with more members is dealt by what its windows share, in ranges of so many window starts.
BIG, RANGE = 20_000, 16
#: And one with yet more, by each window.
HUGE = 1_000_000
#: Distinct contexts up to which pairs are compared one by one.
FEW = 24
#: The part of members whose contexts a task has met twice, and bytes of contexts that it holds to find such.
SETTLED, HELD = -2, 16_000_000
#: The share of all shared places, one in so many, beyond which an anchor's rows are not shuffled by it.
HOT = 500
#: Texts a task remembers to tell exact copies.
SEEN = 400_000


# deep-shallow sorting ---------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    x, y = a[:n], b[:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "down")

    def __init__(self, depth: int) -> None:
        self.depth, self.down = depth, {}


def blind_trie(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """Sorted order of distinct strings and neighbours' common lengths.

    The trie keeps branching places and bytes only. A string first goes down
    blindly by its bytes at those places, is compared with the one leaf reached,
    and is put in at the first difference.
    """
    root: _Node | int = members[0]
    letter = lambda s, d: s[d] if d < len(s) else -1
    for m in members[1:]:
        s, at = strings[m], root
        while isinstance(at, _Node):
            at = _step(at, letter(s, at.depth))
        shared = common(s, strings[at])
        above, now = None, root
        while isinstance(now, _Node) and now.depth < shared:
            above, now = now, now.down[letter(s, now.depth)]
        if isinstance(now, _Node) and now.depth == shared:
            now.down[letter(s, shared)] = m
            continue
        node = _Node(shared)
        node.down[letter(s, shared)] = m
        node.down[letter(strings[at], shared)] = now
        if above is None:
            root = node
        else:
            above.down[letter(s, above.depth)] = node
    order, lengths = [], []
    stack: list[tuple[_Node | int, int]] = [(root, -1)]
    while stack:
        now, shared = stack.pop()
        if isinstance(now, _Node):
            keys = sorted(now.down, reverse=True)
            stack += [(now.down[k], now.depth) for k in keys[:-1]]
            stack.append((now.down[keys[-1]], shared))
        else:
            order.append(now)
            lengths.append(shared)
    return order, lengths[1:]


def _step(node: _Node, key: int) -> _Node | int:
    return node.down[key] if key in node.down else next(iter(node.down.values()))


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Sorted order of distinct strings that agree in their first depth bytes, and neighbours' common lengths."""
    order: list[int] = []
    lengths: list[int] = []
    stack = [(list(range(len(strings))), depth)]
    while stack:
        members, d = stack.pop()
        if len(members) > 1 and d < shallow:
            pivot = strings[members[len(members) // 2]][d : d + LETTER]
            parts: tuple[list[int], list[int], list[int]] = ([], [], [])
            for m in members:
                x = strings[m][d : d + LETTER]
                parts[1 if x == pivot else 2 if x > pivot else 0].append(m)
            stack += [(p, e) for p, e in ((parts[2], d), (parts[1], d + LETTER), (parts[0], d)) if p]
            continue
        own, between = blind_trie(strings, members) if len(members) > 1 else (members, [])
        if order:
            lengths.append(common(strings[order[-1]], strings[own[0]]))
        order += own
        lengths += between
    return order, lengths


# repeats of one group -----------------------------------------------------------


def reaches(lefts: list[bytes], rights: list[bytes], length: int = LENGTH, shared: int = 0) -> list[tuple[int, int] | None]:
    """How many bytes to the left and right of its anchor each distinct context repeats; None if it doesn't.

    lefts are read backwards; rights have length bytes at most. A repeat with another context counts if it has
    length bytes in all.
    """
    n = len(lefts)
    out: list[tuple[int, int] | None] = [None] * n
    if n < 2:
        return out
    if n == 2:
        a, b = common(lefts[0], lefts[1]), common(rights[0], rights[1])
        return [(a, b)] * 2 if a + b >= length else out
    # Equal strings on one side are one entry of that side's order.
    sides = []
    for strings, depth in ((lefts, 0), (rights, shared)):
        kinds = list(dict.fromkeys(strings))
        order, lcp = deep_shallow(kinds, depth)
        rank = {kinds[k]: i for i, k in enumerate(order)}
        sides.append(([rank[s] for s in strings], [len(kinds[k]) for k in order], lcp))
    (left_rank, left_size, left_lcp), (right_rank, right_size, right_lcp) = sides
    if n <= FEW:
        far = lambda i, j, size, lcp: size[i] if i == j else min(lcp[min(i, j) : max(i, j)])
        for i in range(n):
            best_l = best_r = -1
            for j in range(n):
                if i != j:
                    a = far(left_rank[i], left_rank[j], left_size, left_lcp)
                    b = far(right_rank[i], right_rank[j], right_size, right_lcp)
                    if a + b >= length:
                        best_l, best_r = max(best_l, a), max(best_r, b)
            if best_l >= 0:
                out[i] = best_l, best_r
        return out
    # Many contexts: for each split of the window, equal pairs of classes to both sides.
    lr, rr = np.array(left_rank), np.array(right_rank)
    ls, rs, ll, rl = np.array(left_size), np.array(right_size), np.array(left_lcp, np.int64), np.array(right_lcp, np.int64)
    best = np.full((n, 2), -1)
    for a in range(min(int(ls.max()), length) + 1):
        b = length - a
        fits = (ls[lr] >= a) & (rs[rr] >= b)
        if fits.sum() < 2:
            continue
        left_class = np.concatenate([[0], np.cumsum(ll < a)])[lr[fits]]
        right_class = np.concatenate([[0], np.cumsum(rl < b)])[rr[fits]]
        _, inverse, counts = np.unique(left_class * np.int64(n + 1) + right_class, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(fits)[counts[inverse] > 1]
        best[hit, 0] = a
        best[hit, 1] = np.maximum(best[hit, 1], b)
    for i in np.flatnonzero(best[:, 0] >= 0):
        out[i] = int(best[i, 0]), int(best[i, 1])
    return out


def covered(members: Iterable[tuple[int | None, list[int], int, bytes]], length: int = LENGTH, shared: int = 0) -> Iterator[tuple[int, int, int]]:
    """Repeated stretches (text, start, end) of a group of (text, anchor's places, bytes before it, context).

    A member without a text says that its context is known to stand several times.
    """
    contexts: dict[tuple[int, bytes], list[tuple[int | None, list[int]]]] = {}
    for uid, places, left, context in members:
        contexts.setdefault((left, context), []).append((uid, places))
    keys = list(contexts)
    found = reaches([c[:left][::-1] for left, c in keys], [c[left:] for left, c in keys], length, shared) if len(keys) > 1 else [None]
    for (left, context), reach in zip(keys, found, strict=True):
        own = contexts[left, context]
        if len(own) > 1 or own[0][0] is None or len(own[0][1]) > 1:
            reach = left, len(context) - left
        if reach:
            for uid, places in own:
                for p in places:
                    yield uid, p - reach[0], p + reach[1]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


# the corpus ----------------------------------------------------------------------

#: data is zstd-compressed, as it is dealt out twice; spots hold place << 16 | least << 8 | most of each anchor.
MARKED = "uid bigint, doc_id bigint, n_bytes bigint, sha256 string, copy_of bigint, data binary, hashes array<bigint>, spots array<bigint>"


def _packed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpacked(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def mark(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Each row's bytes and anchors; a text equal to one that the task has met refers to that instead."""

    if length - gram > 255:
        raise ValueError("an anchor's distances do not fit a byte")

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        from pyspark import TaskContext

        seen: dict[bytes, int] = {}
        first = TaskContext.get().partitionId() << 40
        for i, (doc_id, text) in enumerate(each):
            data = (text or "").encode()
            digest = hashlib.sha256(data)
            head = (first + i, doc_id, len(data), digest.hexdigest())
            if len(data) < length:
                yield *head, None, _packed(data), None, None
            elif (other := seen.get(digest.digest())) is not None:
                yield *head, other, None, None, None
            else:
                if len(seen) >= SEEN:
                    seen.clear()
                seen[digest.digest()] = first + i
                hashes, place, least, most = anchors(data, length, gram)
                yield *head, None, _packed(data), hashes.tolist(), (place << 16 | least << 8 | most).tolist()

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, MARKED, out_rows=500)


def _window_key(core: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(core, digest_size=8).digest(), "big", signed=True)


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """Members of anchors' groups: texts has uid, data and found (h, spot, n)."""

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[tuple, list[tuple[int, list[int]]]] = {}
        size = 0

        def flush() -> Iterator[tuple]:
            for (key, part, left, context), members in held.items():
                if len(members) == 1:
                    yield key, part, *members[0], left, len(context), context
                    continue
                # Met twice here: all of it is repeated whatever else there is. The others need to know
                # the context once; its members are spread by their own numbers.
                yield key, part, None, [], left, len(context), context
                for uid, places in members:
                    yield uid, SETTLED, uid, places, left, len(context), None

        for uid, data, found in each:
            data = _unpacked(data)
            own: dict[tuple, list[int]] = {}
            for a in found:
                h, spot, n = a["h"], a["spot"], a["n"]
                p, least, most = spot >> 16, spot >> 8 & 255, spot & 255
                if n <= BIG:
                    own.setdefault((h, -1, most, data[p - most : p + length - least]), []).append(p)
                    continue
                step = RANGE if n <= HUGE else 1
                for low in range(least - least % step, most + 1, step):
                    high = low + step - 1  # window starts low to high bytes before the anchor
                    a0, a1 = max(low, least), min(high, most)
                    core = data[p - low : p + length - high]
                    context = data[p - a1 : p + length - a0]
                    own.setdefault((_window_key(core), low, a1, context), []).append(p)
            for k, places in own.items():
                if k not in held:
                    size += len(k[3]) + 200
                held.setdefault(k, []).append((uid, places))
                size += 40
            if size > HELD:
                yield from flush()
                held.clear()
                size = 0
        yield from flush()

    return map_rows(texts, rows, "key bigint, part int, uid bigint, places array<int>, left int, size int, context binary", out_rows=5000)


def repeats(marked: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Repeated stretches (uid, start, end), perhaps overlapping, of the marked texts."""
    long = marked.where("hashes IS NOT NULL")
    each = long.select("uid", F.explode(F.arrays_zip("hashes", "spots")).alias("a")).select("uid", F.col("a.hashes").alias("h"), F.col("a.spots").alias("spot"))
    shared = materialize(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    # The rows of an anchor that stands all over would land in one task. No more than HOT anchors
    # can have over a HOT-th of all places, so these are few whatever the input, and are broadcast.
    places = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot, calm = F.broadcast(shared.where(F.col("n") * HOT > places)), shared.where(F.col("n") * HOT <= places)
    met = each.join(hot, "h").unionByName(each.join(hot, "h", "left_anti").join(calm, "h"))
    found = met.groupBy("uid").agg(F.collect_list(F.struct("h", "spot", "n")).alias("found"))
    texts = long.select("uid", "data").join(found, "uid").select("uid", "data", "found")
    dealt = _contexts(texts, length).repartition("key", "part").sortWithinPartitions("key", "part")

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for (_, part), members in groupby(each, key=lambda r: r[:2]):
            if part == SETTLED:
                for _, _, uid, places, left, size, _ in members:
                    yield from ((uid, p - left, p - left + size) for p in places)
            else:
                yield from covered(((uid, places, left, context) for _, _, uid, places, left, _, context in members), length, gram if part == -1 else 0)

    return map_rows(dealt, rows, "uid bigint, start bigint, stop bigint", out_rows=10_000)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """What is left of every row of docs (doc_id, text) without its repeated bytes.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else,
    in the same text or another; all is judged on the input. A null text counts as
    empty. Every row is a document, also rows of one doc_id. Texts shorter than
    length stay whole. Other columns are ignored; an empty table gives no row.
    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for,
    kept (binary).
    """
    marked = materialize(mark(docs, length, gram), "marked")
    copies = marked.where("copy_of IS NOT NULL")
    spans = repeats(marked, length, gram).unionByName(copies.select(F.col("copy_of").alias("uid"), F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    listed = materialize(spans.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans")
    hit = marked.where("hashes IS NOT NULL").select("uid", "doc_id", "data").join(listed, "uid").select("doc_id", "data", "spans")

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, data, found in each:
            data = _unpacked(data)
            own = merged([(s["start"], s["stop"]) for s in found])
            kept, at = [], 0
            for s, e in own:
                kept.append(data[at:s])
                at = e
            rest = b"".join([*kept, data[at:]])
            out = (doc_id, len(data), len(data) - len(rest), len(own), hashlib.sha256(rest).hexdigest())
            yield (*out, rest) if with_text else out

    kinds = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")
    zero = F.lit(0).cast("long")
    calm = marked.where("copy_of IS NULL").join(listed.select("uid"), "uid", "left_anti")
    calm = calm.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha256").alias("kept_sha256"), *(["data"] if with_text else []))
    if with_text:
        calm = map_rows(calm, lambda each: ((*r[:-1], _unpacked(r[-1])) for r in each), kinds)
    gone = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), *([F.lit(b"").alias("kept")] if with_text else []))
    return map_rows(hit, rows, kinds).unionByName(calm).unionByName(gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: repeated bytes of all documents."""
    return remove_repeats(table(spark, sf_dir, "documents"))
