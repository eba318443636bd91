"""Fusing candidates: one survivor for each cluster, overlaps made small, the weak left out, the rest in reading order.

Candidates have page, id, r (a rectangle), field_type, the four confidence axes, label,
canonical_key, group_id, sources (array), contexts (array) and evidence (array of kind, score, detail).
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions import rects as R
from leafmark.operators import cluster, decide, spatial
from leafmark.operators.grouped import by_group
from leafmark.storage import materialize

#: How specific a field type is; the most specific of a cluster stays (fixed values).
SPECIFIC = {
    "unknown": 0, "text": 10, "multiline_text": 20, "button": 25, "number": 30, "currency": 32, "email": 34, "phone": 36, "date": 38, "choice": 40,
    "listbox": 42, "comb": 50, "signature": 55, "checkbox": 60, "radio": 65,
}
#: The bucket that evidence of a kind counts for (fixed values).
BUCKET_OF = {
    "vector_line": "geometric", "vector_rect": "geometric", "vector_circle": "geometric", "existing_widget": "geometric", "checkbox_glyph": "geometric", "table_cell": "geometric", "comb_cell": "geometric",
    "blank_region": "blank_region", "label_link": "nearby_label", "layout": "layout", "repeat": "repeated", "pattern": "semantic", "native_text": "semantic", "ocr_text": "semantic", "model": "model",
}
#: Kinds of evidence that come with the page's own coordinates (fixed values).
EXACT = ("vector_line", "vector_rect", "vector_circle", "table_cell", "comb_cell", "checkbox_glyph", "existing_widget")
DEDUPE_IOU, MAX_IOU, PASSES, LEAST_OVERALL = 0.55, 0.10, 8, 0.35
#: Least width and height of a field, and side of a mark (fixed values).
LEAST_WIDTH, LEAST_HEIGHT, LEAST_MARK = 40.0, 9.0, 5.0
AXES = tuple(decide.AXES)


def snap_tolerance(merge_tolerance: float = 1.5) -> float:
    return max(4.0, 2.0 * merge_tolerance)


def has_exact_geometry(evidence: Column) -> Column:
    return F.exists(evidence, lambda e: e["kind"].isin(*EXACT))


def bucket_scores(evidence: Column) -> dict[str, Column]:
    """The best score of the evidence in each bucket, 0 where there is none."""
    buckets = F.create_map(*(F.lit(x) for kv in BUCKET_OF.items() for x in kv))
    best = lambda name: F.coalesce(F.array_max(F.transform(F.filter(evidence, lambda e: F.try_element_at(buckets, e["kind"]) == name), lambda e: e["score"].cast("double"))), F.lit(0.0))
    return {name: best(name) for name in decide.SCORE_WEIGHTS}


def fused(evidence: Column) -> Column:
    return decide.fused_score(bucket_scores(evidence))


def score_candidates(df: DataFrame) -> DataFrame:
    """semantic_type raised to the fused score of the evidence."""
    return df.withColumn("semantic_type", F.greatest(F.coalesce("semantic_type", F.lit(0.0)), fused(F.col("evidence"))))


def reading_order() -> list[Column]:
    return [F.col("page"), F.desc(F.col("r")["y1"]), F.col("r")["x0"], F.col("r")["x1"], F.col("id")]


def rank(df: DataFrame) -> DataFrame:
    """Strongest first, then in reading order, a place on each page."""
    order = Window.partitionBy("page").orderBy(F.desc("score"), *reading_order()[1:])
    return df.withColumn("score", fused(F.col("evidence"))).withColumn("place", F.row_number().over(order))


def _first(value: Column, order: Column) -> Column:
    """The non-null value of the row that comes first."""
    return F.min(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))["v"]


def merge_clusters(df: DataFrame, key: str = "cluster") -> DataFrame:
    """One candidate for each cluster of a page.

    The rectangle and id are those of the member placed best; the type is the most
    specific; label, key and group the first there are; sources, contexts and evidence
    the distinct ones of all; the axes the largest, geometry raised by independent
    witnesses (a noisy-or over distinct sets of evidence kinds).
    """
    place = F.struct((-F.coalesce("geometry", F.lit(0.0))).alias("g"), (-F.col("r")["y1"]).alias("y"), F.col("r")["x0"].alias("x0"), F.col("r")["x1"].alias("x1"), F.col("id").alias("id"))
    specific = F.create_map(*(F.lit(x) for kv in SPECIFIC.items() for x in kv))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["kind"]))), ",")
    marked = df.withColumns({"_place": place, "_specific": F.coalesce(F.try_element_at(specific, F.col("field_type")), F.lit(0)), "_signature": F.when(kinds == "", F.array_join(F.array_sort("sources"), ",")).otherwise(kinds)})
    seen = F.transform("evidence", lambda e: F.struct(e["kind"].alias("kind"), F.round(e["score"], 3).alias("score"), e["detail"].alias("detail")))
    merged = marked.where(F.col("page").isNotNull() & F.col(key).isNotNull()).groupBy("page", key).agg(
        F.min("_place")["id"].alias("id"),
        F.min(F.struct(F.col("_place"), F.col("r")))["r"].alias("r"),
        F.min(F.struct((-F.col("_specific")).alias("s"), F.col("_place"), F.col("field_type").alias("t")))["t"].alias("field_type"),
        *(_first(F.col(c), F.col("_place")).alias(c) for c in ("label", "canonical_key", "group_id")),
        *(F.max(F.coalesce(c, F.lit(0.0))).alias(c) for c in AXES if c != "geometry"),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("sources", "contexts")),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(seen)))).alias("evidence"),
        F.count("*").alias("members"),
        F.collect_list(F.struct("_signature", "geometry")).alias("_seen"),
    )
    best = F.transform(F.array_sort(F.array_distinct(F.col("_seen")["_signature"])), lambda n: F.array_max(F.transform(F.filter("_seen", lambda w: w["_signature"].eqNullSafe(n)), lambda w: w["geometry"])))
    told = F.filter(best, lambda g: g.isNotNull())
    rest = F.aggregate(told, F.lit(1.0), lambda x, g: x * (1 - g))
    raised = F.when(F.size(best) < 2, F.array_max(told)).otherwise(F.greatest(F.array_max(told), F.least(F.lit(decide.NOISY_CAP), 1 - rest)))
    return merged.withColumn("geometry", raised).drop("_seen")


Box = tuple[float, float, float, float]


def remainder(loser: Box, winner: Box) -> Box | None:
    """The largest strip of a rectangle to the left or right of, below or above another; ties by coordinates."""
    x0, y0, x1, y1 = loser
    strips = [(x0, y0, min(x1, winner[0]), y1), (max(x0, winner[2]), y0, x1, y1), (x0, y0, x1, min(y1, winner[1])), (x0, max(y0, winner[3]), x1, y1)]
    left = [s for s in strips if s[2] - s[0] > 1e-6 and s[3] - s[1] > 1e-6]
    return min(left, key=lambda s: (-(s[2] - s[0]) * (s[3] - s[1]), *s)) if left else None


def overlap(a: Box, b: Box) -> float:
    """IoU of two rectangles."""
    common = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / union if union > 1e-6 else 0.0


def usable(r: Box, kind: str | None) -> bool:
    """True if what is left of a field is still one."""
    w, h = r[2] - r[0] + 1e-6, r[3] - r[1] + 1e-6
    return min(w, h) >= LEAST_MARK if kind in ("checkbox", "radio") else w >= LEAST_WIDTH and h >= LEAST_HEIGHT


def cut_down(r: Box, kind: str | None, kept: list[Box], most: float) -> Box | None:
    """A rectangle without what accepted ones cover, as far as they overlap too much; None if no field is left."""
    for _ in range(PASSES):
        hit = False
        for other in kept:
            if overlap(r, other) > most + 1e-6:
                cut = remainder(r, other)
                if cut is None or not usable(cut, kind):
                    return None
                r, hit = cut, True
        if not hit:
            break
    r = tuple(round(x, 3) for x in r)
    return None if any(overlap(r, other) > most + 1e-6 for other in kept) else r


def suppress_overlaps(df: DataFrame, most: float = MAX_IOU) -> DataFrame:
    """page, id, r of a page's candidates after no two overlap by more than an IoU.

    Strongest first (score, then reading order): a later one that overlaps an accepted
    one gives up what it covers, and goes if what is left is no usable field. A page is
    decided in one task, as each decision hangs on those before it.
    """
    kinds = dict(df.dtypes)

    def decide_page(rows: list[tuple]) -> list[tuple]:
        kept, out = [], []
        for page, i, _, kind, *r in rows:
            left = cut_down(tuple(r), kind, kept, most)
            if left is not None:
                kept.append(left)
                out.append((page, i, *left))
        return out

    flat = df.select("page", "id", "score", "field_type", *(F.col("r")[e].cast("double").alias(e) for e in cluster.EDGES))
    found = by_group(flat, ["page"], [F.desc("score"), F.desc("y1"), "x0", "x1", "id"], decide_page, f"page {kinds['page']}, id {kinds['id']}, x0 double, y0 double, x1 double, y1 double")
    return found.select("page", "id", R.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("r"))


def _page_clusters(ids: list, boxes: list[Box | None]) -> list:
    """For each candidate of a page its cluster as ``cluster.components`` has it."""
    area = lambda r: abs(r[2] - r[0]) * abs(r[3] - r[1])
    lead = {i: i for i in ids}

    def root(x: object) -> object:
        while lead[x] != x:
            lead[x] = x = lead[lead[x]]
        return x

    at = sorted((k for k, r in enumerate(boxes) if r is not None), key=lambda k: boxes[k][0])
    for n, i in enumerate(at):
        a = boxes[i]
        for j in at[n + 1 :]:
            b = boxes[j]
            if b[0] > a[2]:
                break
            common = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
            union = area(a) + area(b) - common
            if ids[i] != ids[j] and union > R.EPS and common / union > DEDUPE_IOU:
                low, high = sorted((root(ids[i]), root(ids[j])))
                lead[high] = low
    return [root(i) for i in ids]


def _page_fields(ids: list, scores: list, kinds: list, strong: list[bool], boxes: list[Box]) -> list[dict | None]:
    """For each candidate of a page what ``suppress_overlaps`` leaves of it and its place; None for those that go."""
    kept, left = [], {}
    for k in sorted(range(len(ids)), key=lambda k: (-scores[k], -boxes[k][3], boxes[k][0], boxes[k][2], ids[k])):
        r = cut_down(boxes[k], kinds[k], kept, MAX_IOU)
        if r is not None:
            kept.append(r)
            left[k] = r
    out: list[dict | None] = [None] * len(ids)
    for place, (k, r) in enumerate(sorted(((k, r) for k, r in left.items() if strong[k]), key=lambda x: (-x[1][3], x[1][0], x[1][2], ids[x[0]]))):
        out[k] = dict(zip(cluster.EDGES, r, strict=True)) | {"order": place}
    return out


def _lists(kind: str, f: Callable[..., list]) -> Callable[..., Column]:
    """A Column function of a page's lists, from a Python function of lists of one page; only these lists go through Arrow."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    made = to_arrow_type(_parse_datatype_string(kind))
    return F.arrow_udf(lambda *columns: pa.array([f(*page) for page in zip(*(c.to_pylist() for c in columns), strict=True)], made), kind)


def _boxes(edges: tuple[list, ...]) -> list[Box | None]:
    return [None if None in r else r for r in zip(*edges, strict=True)]


def _edges(g: Column) -> list[Column]:
    return [g["r"][e] for e in cluster.EDGES]


def _listed(rows: DataFrame) -> DataFrame:
    return rows.where("page IS NOT NULL").groupBy("page").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "page"))).alias("g"))


def _with(pages: DataFrame, found: Column) -> DataFrame:
    """Each candidate c of each page beside what was found for it."""
    both = F.arrays_zip(F.col("g").alias("c"), found.alias("found"))
    return pages.select("page", F.explode(both).alias("m")).select("page", F.col("m")["c"].alias("c"), F.col("m")["found"].alias("found"))


def _strong(least: float) -> Column:
    return decide.overall_confidence({a: F.col(a) for a in AXES}) + 1e-6 >= least


def _fuse_pages(candidates: DataFrame, least: float) -> DataFrame:
    """``fuse`` where a page is a list in a row: candidates are shuffled twice, to their page and to be merged on it."""
    g = F.col("g")
    clusters = _lists(f"array<{dict(candidates.dtypes)['id']}>", lambda ids, *edges: _page_clusters(ids, _boxes(edges)))
    fields = _lists("array<struct<x0:double,y0:double,x1:double,y1:double,order:int>>", lambda ids, scores, kinds, strong, *edges: _page_fields(ids, scores, kinds, strong, _boxes(edges)))
    named = _with(_listed(candidates), clusters(g["id"], *_edges(g))).select("page", "c.*", F.col("found").alias("cluster")).repartition("page")
    scored = score_candidates(merge_clusters(named)).withColumns({"score": fused(F.col("evidence")), "_strong": F.coalesce(_strong(least), F.lit(False))})
    kept = _with(_listed(scored), fields(g["id"], g["score"], g["field_type"], g["_strong"], *_edges(g))).where("found IS NOT NULL")
    own = (F.col("c")[c].alias(c) for c in scored.columns if c not in ("page", "id", "r", "_strong"))
    return kept.select("page", "c.id", *own, F.struct(*(F.col("found")[e].alias(e) for e in cluster.EDGES)).alias("r"), F.col("found")["order"].alias("order"))


def _fuse_crowded(candidates: DataFrame, least: float) -> DataFrame:
    """``fuse`` where a page may be too large for a list of whole candidates; what is used twice is kept."""
    clusters = cluster.components(candidates.select("page", "id", "r"), DEDUPE_IOU)
    merged = score_candidates(merge_clusters(candidates.join(clusters, ["page", "id"])))
    scored = materialize(merged.withColumn("score", fused(F.col("evidence"))), "scored")
    kept = scored.drop("r").join(suppress_overlaps(scored), ["page", "id"])
    order = Window.partitionBy("page").orderBy(*reading_order()[1:])
    return kept.where(_strong(least)).withColumn("order", F.row_number().over(order) - 1)


def fuse(candidates: DataFrame, least: float = LEAST_OVERALL) -> DataFrame:
    """Clusters merged, scored, overlaps suppressed, weak ones left out, numbered in reading order within the page."""
    few = spatial.most_on_a_page(candidates) <= spatial.FEW
    return (_fuse_pages if few else _fuse_crowded)(candidates, least)


def resolve_options(scores: DataFrame, limit: int = 12) -> DataFrame:
    """The keys to choose from for each candidate: at most limit by falling score, then by key."""
    order = Window.partitionBy("page", "id").orderBy(F.desc("score"), "canonical_key")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
