"""Joins over rectangles: overlap, containment, adjacency and nearest neighbours.

Where the largest page has few rectangles, as counted first, rows meet on the page; those
of one table as the page's list, so they are shuffled once and sorted never. Else
they meet on a page and a grid cell, so a page that holds a large share of all rectangles
is spread over many keys. A pair is kept in the one cell that holds the lower corner of
the two rectangles' common box, so nothing needs to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions import rects as R

CELL = 256.0
#: Rectangles of a page up to which all its pairs are tried.
FEW = 256


def _cells(df: DataFrame, box: Column, cell: float, prefix: str) -> DataFrame:
    at = lambda v: F.floor(v / cell).cast("int")
    df = df.withColumns({f"{prefix}cx0": at(box["x0"]), f"{prefix}cy0": at(box["y0"])})
    df = df.withColumn("cx", F.explode(F.sequence(F.col(f"{prefix}cx0"), F.greatest(F.col(f"{prefix}cx0"), at(box["x1"])))))
    return df.withColumn("cy", F.explode(F.sequence(F.col(f"{prefix}cy0"), F.greatest(F.col(f"{prefix}cy0"), at(box["y1"])))))


def _near(a: Column, b: Column, dx: float, dy: float) -> Column:
    """True if two boxes come within reach of each other; touching counts."""
    return (a["x0"] - dx <= b["x1"]) & (b["x0"] <= a["x1"] + dx) & (a["y0"] - dy <= b["y1"]) & (b["y0"] <= a["y1"] + dy)


def most_on_a_page(rects: DataFrame) -> int:
    """Rectangles of the largest page."""
    return rects.where("page IS NOT NULL").groupBy("page").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def range_join(left: DataFrame, right: DataFrame, keep: Column, reach: tuple[float, float] = (0.0, 0.0), cell: float = CELL) -> DataFrame:
    """Pairs a, b of rows of one page whose boxes come within reach and that pass ``keep``.

    Both tables have page and r (a rectangle); the result has structs a and b. Rows
    with a null page or rectangle pair with nothing.
    """
    few = most_on_a_page(left) <= FEW and (right is left or most_on_a_page(right) <= FEW)
    one = lambda df, name: df.where(" AND ".join(f"r.{e} IS NOT NULL" for e in R.EDGES)).select("page", F.struct(*(R.whole("r") if c == "r" else c for c in df.columns)).alias(name))
    near = _near(F.col("a.r"), F.col("b.r"), *reach)
    if few and right is left:
        pages = one(left, "a").groupBy("page").agg(F.collect_list("a").alias("g")).where("page IS NOT NULL")
        met = pages.select("page", "g", F.explode("g").alias("a")).select("page", "a", F.explode("g").alias("b"))
        return met.where(near & keep)
    if few:
        return one(left, "a").repartition("page").join(one(right, "b").repartition("page"), "page").where(near & keep).select("page", "a", "b")
    (dx, dy), r = reach, F.col("a.r")
    box = F.struct((r["x0"] - dx).alias("x0"), (r["y0"] - dy).alias("y0"), (r["x1"] + dx).alias("x1"), (r["y1"] + dy).alias("y1"))
    a, b = _cells(one(left, "a"), box, cell, "a"), _cells(one(right, "b"), F.col("b.r"), cell, "b")
    met = a.join(b, ["page", "cx", "cy"])
    once = (F.col("cx") == F.greatest("acx0", "bcx0")) & (F.col("cy") == F.greatest("acy0", "bcy0"))
    return met.where(once & near & keep).select("page", "a", "b")


def among(rects: DataFrame, keep: Column, reach: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """``range_join`` of rectangles with themselves, by page, id and r alone."""
    rows = rects.select("page", "id", "r")
    return range_join(rows, rows, keep, reach)


def overlap_pairs(rects: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Pairs of a page's rectangles (a before b by id) whose IoU exceeds the threshold."""
    found = among(rects, (F.col("a.id") < F.col("b.id")) & (R.iou(F.col("a.r"), F.col("b.r")) > threshold))
    return found.select("page", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), R.iou(F.col("a.r"), F.col("b.r")).alias("iou"))


def containing_pairs(outer: DataFrame, inner: DataFrame, share: float = 1.0) -> DataFrame:
    """Pairs (a, b), not the same row, where a covers at least a share of b."""
    keep = (F.col("a.id") != F.col("b.id")) & (R.contains(F.col("a.r"), F.col("b.r")) if share >= 1 else R.coverage(F.col("a.r"), F.col("b.r")) >= share)
    found = among(outer, keep) if inner is outer else range_join(outer.select("page", "id", "r"), inner.select("page", "id", "r"), keep)
    return found.select("page", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


#: Shares of the smaller extent that two rectangles have in common in a row, and in a column (fixed values).
ROW_SHARE, COLUMN_SHARE = 0.40, 0.30


def relation(a: Column, b: Column, max_gap: float, vertical_gap: float) -> Column:
    """How a stands to b: struct(kind, gap), rows before columns; null if they are unrelated."""
    in_row = R.vertical_overlap(a, b) >= ROW_SHARE * F.least(R.height(a), R.height(b))
    in_column = R.horizontal_overlap(a, b) >= COLUMN_SHARE * F.least(R.width(a), R.width(b))
    out = None
    for kind, test, gap, most in (
        ("left_of", in_row, b["x0"] - a["x1"], max_gap),
        ("right_of", in_row, a["x0"] - b["x1"], max_gap),
        ("above", in_column, a["y0"] - b["y1"], vertical_gap),
        ("below", in_column, b["y0"] - a["y1"], vertical_gap),
    ):
        hit = test & (gap >= -R.EPS) & (gap < most)
        value = F.struct(F.lit(kind).alias("kind"), F.greatest(F.lit(0.0), gap).alias("gap"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def adjacency(rects: DataFrame, max_gap: float = R.LABEL_DISTANCE, vertical_gap: float = 30.0, top: int = 12) -> DataFrame:
    """The strongest neighbours of each rectangle by relation: src, dst, kind, weight, place."""
    rel = relation(F.col("a.r"), F.col("b.r"), max_gap, vertical_gap)
    found = among(rects, (F.col("a.id") != F.col("b.id")) & rel.isNotNull(), (max_gap, vertical_gap))
    found = found.select("page", F.col("a.id").alias("src"), F.col("b.id").alias("dst"), rel["kind"].alias("kind"), rel["gap"].alias("gap"))
    scale = F.when(F.col("kind").isin("left_of", "right_of"), R.decay_weight(F.col("gap"), max_gap)).otherwise(R.decay_weight(F.col("gap"), vertical_gap))
    found = found.withColumn("weight", scale)
    order = Window.partitionBy("page", "src", "kind").orderBy(F.desc("weight"), "dst")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def nearest(fields: DataFrame, labels: DataFrame, direction: str, limit: float) -> DataFrame:
    """For each field the closest label to its left, right, above or below within a limit.

    A label may reach 1.5 points into the field sideways, 1 upwards or downwards.
    Ties go to the label further left, then to the smaller id. Fields without one
    are not returned.
    """
    f, s = F.col("a.r"), F.col("b.r")
    gap, slack, side = {
        "left": (f["x0"] - s["x1"], 1.5, True),
        "right": (s["x0"] - f["x1"], 1.5, True),
        "above": (s["y0"] - f["y1"], 1.0, False),
        "below": (f["y0"] - s["y1"], 1.0, False),
    }[direction]
    shared = R.vertical_overlap(f, s) >= 0.2 * F.least(R.height(f), R.height(s)) if side else R.horizontal_overlap(f, s) >= 0.15 * F.least(R.width(f), R.width(s))
    keep = (F.col("a.id") != F.col("b.id")) & (gap >= -slack) & (gap <= limit) & shared
    reach = (limit, 0.0) if side else (0.0, limit)
    found = among(fields, keep, reach) if labels is fields else range_join(fields.select("page", "id", "r"), labels.select("page", "id", "r"), keep, reach)
    best = found.groupBy("page", F.col("a.id").alias("field_id")).agg(F.min(F.struct(gap.alias("gap"), s["x0"].alias("x0"), F.col("b.id").alias("label_id"))).alias("m"))
    return best.select("page", "field_id", F.col("m.label_id").alias("label_id"), F.greatest(F.lit(0.0), F.col("m.gap")).alias("gap"))


def mutual_nearest(pairs: DataFrame, left: str, right: str, gap: str) -> DataFrame:
    """Pairs that are each other's closest."""
    by_left = Window.partitionBy("page", left).orderBy(gap, right)
    by_right = Window.partitionBy("page", right).orderBy(gap, left)
    ranked = pairs.withColumns({"rank_left": F.row_number().over(by_left), "rank_right": F.row_number().over(by_right)})
    return ranked.where("rank_left = 1 AND rank_right = 1").drop("rank_left", "rank_right")


def unclaimed(rects: DataFrame, claims: DataFrame, max_iou: float = 0.05, max_share: float = 0.25) -> DataFrame:
    """Rectangles that no claim overlaps by more than an IoU or a share of their area."""
    taken = (F.col("a.id") != F.col("b.id")) & ((R.iou(F.col("a.r"), F.col("b.r")) > max_iou) | (R.coverage(F.col("b.r"), F.col("a.r")) > max_share))
    hit = range_join(rects.select("page", "id", "r"), claims.select("page", "id", "r"), taken).select("page", F.col("a.id").alias("id")).distinct()
    return rects.join(hit, ["page", "id"], "left_anti")
