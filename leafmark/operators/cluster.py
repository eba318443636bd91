"""Greedy and transitive operators over a page's rectangles.

Which rectangles touch at all is found by range joins. The decisions, which hang on their
order, are then made page by page over those pairs alone, never over all pairs of a page.
Every sort ends in the id.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.functions import rects as R
from leafmark.operators.grouped import by_group
from leafmark.operators.spatial import among, range_join

EDGES = ["x0", "y0", "x1", "y1"]


def _kinds(df: DataFrame) -> tuple[str, str]:
    kinds = dict(df.dtypes)
    return kinds["page"], kinds["id"]


def components(rects: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Transitive clusters of a page's rectangles whose IoU exceeds the threshold: page, id, cluster (its smallest id)."""
    page_kind, id_kind = _kinds(rects)
    near = among(rects, (F.col("a.id") < F.col("b.id")) & (R.iou(F.col("a.r"), F.col("b.r")) > threshold))
    links = near.select("page", F.col("a.id").alias("id"), F.col("b.id").alias("other"))
    rows = rects.select("page", "id", F.col("id").alias("other")).unionByName(links)

    def label(page: list[tuple]) -> list[tuple]:
        lead: dict = {}

        def root(x: object) -> object:
            lead.setdefault(x, x)
            while lead[x] != x:
                lead[x] = x = lead[lead[x]]
            return x

        for _, a, b in page:
            low, high = sorted((root(a), root(b)))
            lead[high] = low
        return [(page[0][0], x, root(x)) for x in sorted(lead)]

    return by_group(rows, ["page"], ["id", "other"], label, f"page {page_kind}, id {id_kind}, cluster {id_kind}")


def suppress(rects: DataFrame, threshold: float = 0.80, limit: int = 200) -> DataFrame:
    """Largest first, drops a rectangle inside a kept one or with a larger IoU than the threshold; at most limit a page."""
    page_kind, id_kind = _kinds(rects)
    a, b = F.col("a.r"), F.col("b.r")
    larger = F.struct((-R.area(a)).alias("s"), F.col("a.id").alias("i")) < F.struct((-R.area(b)).alias("s"), F.col("b.id").alias("i"))
    near = among(rects, larger & (R.contains(a, b) | (R.iou(a, b) > threshold)))
    none = F.lit(None).cast(id_kind).alias("over")
    rows = rects.select("page", "id", (-R.area(F.col("r"))).alias("size"), none)
    rows = rows.unionByName(near.select("page", F.col("b.id").alias("id"), (-R.area(F.col("b.r"))).alias("size"), F.col("a.id").alias("over")))

    def pick(page: list[tuple]) -> list[tuple]:
        kept: set = set()
        for (i, _), own in groupby(page, key=itemgetter(1, 2)):
            if len(kept) < limit and not any(r[3] is not None and r[3] in kept for r in own):
                kept.add(i)
        return [(page[0][0], r[1]) for r in page if r[3] is None and r[1] in kept]

    return by_group(rows, ["page"], ["size", "id", "over"], pick, f"page {page_kind}, id {id_kind}")


def greedy_match(pred: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One-to-one pairs by falling IoU from the threshold on, page by page: page, pred_id, truth_id, iou."""
    page_kind, id_kind = _kinds(pred)
    iou = R.iou(F.col("a.r"), F.col("b.r"))
    near = range_join(pred, truth, iou >= threshold).select("page", F.col("a.id").alias("pred_id"), F.col("b.id").alias("truth_id"), iou.alias("iou"))

    def pair(page: list[tuple]) -> list[tuple]:
        left, right, out = set(), set(), []
        for row in page:
            if row[1] not in left and row[2] not in right:
                left.add(row[1])
                right.add(row[2])
                out.append(row)
        return out

    return by_group(near, ["page"], [F.desc("iou"), "pred_id", "truth_id"], pair, f"page {page_kind}, pred_id {id_kind}, truth_id {id_kind}, iou double")
