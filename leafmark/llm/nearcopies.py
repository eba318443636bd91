"""The pipeline's near-copy stage: one document of each group linked at a Jaccard similarity of 0.8 or more.

Similarity is of the sets of five-word shingles. The Gray-order index over SimHash
fingerprints proposes links first. At 0.8 two fingerprints of 64 bits differ in about
10 bits, some pairs in 16, where no bucket of agreeing bits is left to search by. So
what lies beyond the index's radius comes from a prefix filter, which loses none: in
any order of all shingles, two sets this alike share one of the first fifth of each.
The order puts common shingles last. Each link is held against the exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm import simhash
from leafmark.llm.arrow import map_rows
from leafmark.llm.components import connected
from leafmark.llm.simhash import SEED, _first_rows
from leafmark.storage import materialize

SHINGLE = 5
#: Differing bits up to which the index proposes a link.
RADIUS = 3
#: Shingles of a batch that leaves a task.
OUT_SHINGLES = 100_000
#: Texts sampled for common shingles, how many must have one, and how many are told. Only speed hangs on these.
SAMPLE, OFTEN, COMMON = 8_000, 4, 50_000
#: Nodes of a shingle up to which all are paired.
FEW = 48
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def text_key(words: list[bytes]) -> int:
    """A signed 64-bit hash of a whole text's words, its node in the graph of links."""
    import xxhash

    key = xxhash.xxh64_intdigest(b" ".join(words), SEED)
    return key - (1 << 64) if key >> 63 else key


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of all runs of size words, or of all words if they are fewer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    own = np.array([digest(w, SEED) for w in words], np.uint64)
    size = min(size, len(own))
    count = len(own) - size + 1 if size else 1
    out = np.full(count, size + 1, np.uint64)
    for i in range(size):
        out = (out ^ own[i : i + count]) * _MIX[0]
        out ^= out >> np.uint64(29)
        out *= _MIX[1]
        out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def _keys(docs: DataFrame) -> DataFrame:
    """(doc_id, k, fp): each row's node and fingerprint."""

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in each:
            yield doc_id, text_key(words_of(text)), simhash._signed(simhash.fingerprint(text, SHINGLE))

    return map_rows(docs, rows, "doc_id bigint, k bigint, fp bigint")


def proposed(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (u, v) of nodes that the Gray-order index joins: fingerprints within the radius, or through others."""
    prints = materialize(classes.groupBy("fp").agg(F.min("k").alias("rep")), "prints")
    same = classes.select("fp", "k").join(prints, "fp").select(F.col("rep").alias("u"), F.col("k").alias("v"))
    return same.unionByName(simhash.links(prints, radius)).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def common_shingles(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Shingles that stand in several of a sample of about SAMPLE texts, at most COMMON, sorted."""
    spread = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30))
    share = int(min(1.0, SAMPLE / max(1, n_docs)) * (1 << 30))

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for (text,) in each:
            yield from ((h,) for h in shingles(words_of(text)).tolist())

    some = map_rows(docs.where(spread < share).select("text"), rows, "h bigint")
    found = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(COMMON)
    return np.array(sorted(r["h"] for r in found.collect()), np.int64)


def prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(h, k, n, c, listed): the first n - ceil(0.8 n) + 1 of each row's n shingles, in order of their hashes, the c common ones last, and whether h is one of them."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        held: list[tuple[np.ndarray, int, int, int]] = []

        def out() -> pa.RecordBatch:
            sizes = [len(r[0]) for r in held]
            columns = [np.concatenate([r[0] for r in held]), *(np.repeat(np.array([r[i] for r in held], np.int64), sizes) for i in (1, 2, 3))]
            columns.append(np.concatenate([np.arange(len(h)) >= n - c for h, _, n, c in held]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "k", "n", "c", "listed"])

        rows = 0
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                own = shingles(words)
                n, c = len(own), 0
                if len(common):
                    last = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
                    own, c = np.concatenate([own[~last], own[last]]), int(last.sum())
                held.append((own[: n - (4 * n + 4) // 5 + 1], text_key(words), n, c))
                rows += len(held[-1][0])
                if rows >= OUT_SHINGLES:
                    yield out()
                    rows = 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "h bigint, k bigint, n bigint, c bigint, listed boolean")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """The pairs (u, v) of nodes whose sets have a similarity of 0.8 or more."""

    def rows(each: Iterator[tuple]) -> Iterator[tuple]:
        for (text,) in each:
            words = words_of(text)
            yield text_key(words), shingles(words).tolist()

    nodes = pairs.select(F.col("u").alias("k")).unionByName(pairs.select(F.col("v").alias("k"))).distinct()
    # Written, so that a small one is known to be small and texts need not be shuffled.
    wanted = materialize(classes.join(nodes, "k", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), f"wanted_{name}")
    sets = map_rows(docs.join(wanted, "doc_id", "left_semi").select("text"), rows, "k bigint, hs array<bigint>", out_rows=200)
    sets = materialize(sets.dropDuplicates(["k"]), f"sets_{name}")
    left, right = sets.select(F.col("k").alias("u"), F.col("hs").alias("hu")), sets.select(F.col("k").alias("v"), F.col("hs").alias("hv"))
    common = F.size(F.array_intersect("hu", "hv"))
    # i / (nu + nv - i) >= 4 / 5
    return pairs.join(left, "u").join(right, "v").where(common * 9 >= (F.size("hu") + F.size("hv")) * 4).select("u", "v")


#: Sizes of two sets of a similarity of 0.8 or more; and that two sets meeting at a common shingle have enough
#: common ones. All uncommon shingles of such sets are among their first, so what shares one of those meets there.
_LIKE = "5 * nu >= 4 * nv AND 5 * nv >= 4 * nu"
_ENOUGH = "(NOT listed OR 9 * least(cu, cv) >= 4 * (nu + nv))"
#: Shingles two sets may share beyond the first ones that they share: all that follows the first of the set whose
#: first ones end first, or, if a common one is among those, all common ones.
_BEYOND = "greatest((4 * greatest(nu, nv) + 4) div 5 - 1, least(cu, cv))"
#: That two sets with wu and wv shingles of many nodes among their first may be alike and meet at those alone.
#: What also meets at a shingle of few nodes is found there.
_ALONE = f"9 * (least(wu, wv) + {_BEYOND}) >= 4 * (nu + nv)"


def _hubs(hot: DataFrame) -> DataFrame:
    """Pairs (u, v): each node of a shingle of many with those of its nodes that lie most in common shingles, one for each range of sizes.

    Copies with changes here and there are often too far from each other, yet near the text they were made
    of, which has fewest shingles of its own.
    """
    band = F.floor(F.log("n") / F.log(F.lit(1.25)))
    hubs = hot.groupBy("h", band.alias("band")).agg(F.max(F.struct((F.col("c") / F.col("n")).alias("share"), "n", "k", "c", "w")).alias("hub"))
    hubs = hubs.select("h", *(F.col(f"hub.{a}").alias(b) for a, b in (("k", "u"), ("n", "nu"), ("c", "cu"), ("w", "wu"))))
    rows = hot.select("h", "listed", *(F.col(a).alias(b) for a, b in (("k", "v"), ("n", "nv"), ("c", "cv"), ("w", "wv")))).join(hubs, "h")
    return rows.where(f"u <> v AND {_LIKE} AND {_ENOUGH} AND {_ALONE}").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _paired(rows: DataFrame, also: str = "") -> DataFrame:
    """(u, v, nu, nv, cu, cv, wu, wv): two nodes that meet at a shingle and may be alike, once for each such shingle."""
    left, right = (rows.select("h", "listed", *(F.col(c).alias(f"{c}{side}") for c in rows.columns if c not in ("h", "listed"))) for side in "uv")
    left, right = left.withColumnRenamed("ku", "u"), right.drop("listed").withColumnRenamed("kv", "v")
    return left.join(right, "h").where(f"u < v AND {_LIKE} AND {_ENOUGH}{also}").select("u", "v", "nu", "nv", "cu", "cv", "wu", "wv")


def near_links(docs: DataFrame, classes: DataFrame, n_docs: int) -> DataFrame:
    """Links (u, v) of nodes that join the same groups as all pairs of a similarity of 0.8 or more would.

    docs: n_docs rows of doc_id (not null) and text. classes: each node k once, with its fingerprint fp and the doc_id of a row, rep.

    The index's proposals are verified first. The nodes of a shingle are paired with each other if they are few. Of more, each is
    first held against a few hubs; what that joins needs no further link, so pairs are
    made of nodes in different groups only, and a large group of copies gives as many
    links as it has members. Of those, only nodes with so many such shingles among their first that they can be alike
    without meeting at a shingle of few nodes are paired.
    """
    spread, alone = Window.partitionBy("h"), prefixes(docs, common_shingles(docs, n_docs))
    some = alone.withColumns({"a": F.min("k").over(spread), "b": F.max("k").over(spread)}).where("a <> b")
    return _links(docs, classes, materialize(some.select("h", "k", "n", "c", "listed").distinct(), "prefixes"))


def _links(docs: DataFrame, classes: DataFrame, some: DataFrame) -> DataFrame:
    """near_links from the first shingles that several nodes have."""
    spread = Window.partitionBy("h")
    large = materialize(some.groupBy("h").agg(F.count("*").alias("size")).where(F.col("size") > FEW).select("h"), "large")
    hot = some.join(large, "h", "left_semi")
    many = materialize(hot.groupBy("k").agg(F.count("*").alias("w")), "many")
    hot = materialize(hot.join(many, "k"), "hot")
    calm = some.join(large, "h", "left_anti").join(many, "k", "left").fillna(0, "w")
    stars = materialize(_hubs(hot).unionByName(proposed(classes)).distinct(), "stars")
    first = materialize(_verified(docs, classes, stars, "stars"), "first_links")
    group = connected(first).select(F.col("node").alias("k"), "component")
    grouped = hot.join(group, "k", "left").select("h", "k", "n", "c", "w", "listed", F.coalesce("component", "k").alias("g"))
    grouped = materialize(grouped.withColumns({"a": F.min("g").over(spread), "b": F.max("g").over(spread)}).where("a <> b").select("h", "k", "n", "c", "w", "listed", "g"), "grouped")

    pairs = _paired(calm).unionByName(_paired(grouped, f" AND gu <> gv AND {_ALONE}"))
    pairs = pairs.groupBy(*pairs.columns).agg(F.count("*").alias("c"))
    # What two prefixes do not have in common, all that follows has to make up for; and meetings left out above may have been any.
    most = F.col("c") + F.expr(f"IF({_ALONE}, 0, least(wu, wv)) + {_BEYOND}")
    pairs = materialize(pairs.where(most * 9 >= (F.col("nu") + F.col("nv")) * 4).select("u", "v"), "pairs")
    return first.unionByName(_verified(docs, classes, pairs, "pairs"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without those that are not the first of their group of near copies; columns as they were.

    Texts of the same words are copies whatever their length. Of rows of one doc_id
    the smallest stays, and their groups are one. Rows with a null doc_id all stay.
    """
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = materialize(_keys(known), "keys")
    classes = materialize(marked.groupBy("k").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp")), "classes")
    found = near_links(known, classes, marked.count())
    # Texts of one doc_id are linked.
    least = marked.groupBy("doc_id").agg(F.min("k").alias("v"), F.max("k").alias("most")).where("v <> most").select("doc_id", "v")
    again = marked.join(least, "doc_id").select(F.col("k").alias("u"), "v")
    joined = connected(found.unionByName(again))
    named = classes.join(joined, F.col("k") == F.col("node"), "left").select("rep", F.coalesce("component", "k").alias("component"))
    return _first_rows(docs, named.groupBy("component").agg(F.min("rep").alias("doc_id")).select("doc_id"))
