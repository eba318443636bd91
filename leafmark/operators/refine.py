"""Operators that refine candidates: size bounds, snapping, conflicts, merged readings, rule segments, boxes of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions import rects as R
from leafmark.operators import spatial

#: Least and largest width and height in points by field type: our own bounds.
SIZE_BOUNDS = {"text": (24.0, 560.0, 9.0, 60.0), "checkbox": (5.0, 22.0, 5.0, 22.0), "signature": (60.0, 560.0, 12.0, 72.0), "date": (40.0, 220.0, 9.0, 30.0)}


def bounded(r: Column, kind: Column) -> Column:
    """The rectangle within its type's size: wider or narrower about its centre, higher or lower from its top edge."""
    out = r
    for name, (w0, w1, h0, h1) in SIZE_BOUNDS.items():
        w, h = F.least(F.greatest(R.width(r), F.lit(w0)), F.lit(w1)), F.least(F.greatest(R.height(r), F.lit(h0)), F.lit(h1))
        mid = R.center_x(r)
        out = F.when(kind == name, R.rect(mid - w / 2, r["y1"] - h, mid + w / 2, r["y1"])).otherwise(out)
    return out


def snapped(candidates: DataFrame, shapes: DataFrame, tolerance: float = 4.0) -> DataFrame:
    """Candidates with each edge moved to the nearest edge of a shape within the tolerance; ties to the smaller one.

    Only shapes that come within the tolerance of the candidate lend their edges.
    """
    met = spatial.range_join(candidates, shapes, F.lit(True), (tolerance, tolerance))
    best = []
    for edge in ("x0", "y0", "x1", "y1"):
        low = edge[0]
        near = [F.when(F.abs(F.col("b.r")[e] - F.col("a.r")[edge]) <= tolerance, F.struct(F.abs(F.col("b.r")[e] - F.col("a.r")[edge]).alias("d"), F.col("b.r")[e].alias("v"))) for e in (f"{low}0", f"{low}1")]
        best.append(F.min(F.when(near[0].isNull(), near[1]).when(near[1].isNull(), near[0]).otherwise(F.least(*near))).alias(edge))
    found = met.groupBy("page", F.col("a.id").alias("id")).agg(*best)
    joined = candidates.join(found, ["page", "id"], "left")
    edges = [F.coalesce(F.col(e)["v"], F.col("r")[e]) for e in ("x0", "y0", "x1", "y1")]
    sound = (edges[2] > edges[0]) & (edges[3] > edges[1])
    return joined.select(*(F.when(sound, R.rect(*edges)).otherwise(F.col("r")).alias("r") if c == "r" else F.col(c) for c in candidates.columns))


def resolve_conflicts(claims: DataFrame, margin: float = 0.08) -> DataFrame:
    """Claims of one key on a page: those that trail the best by the margin or more are demoted.

    claims: page, id, key, score. Adds demoted. Equal best claims all stay.
    """
    top = F.max("score").over(Window.partitionBy("page", "key"))
    return claims.withColumn("demoted", F.col("key").isNotNull() & (top - F.col("score") >= margin))


def merge_words(base: DataFrame, improved: DataFrame, least: float = 0.3) -> DataFrame:
    """Words with their best overlapping re-reading: page, id, text, confidence, other.

    Both have page, id, r, text, confidence. The surer reading wins and the loser
    is kept as other; a re-reading that overlaps no word is a word of its own.
    """
    iou = R.iou(F.col("a.r"), F.col("b.r"))
    met = spatial.range_join(base, improved, iou > least)
    pairs = met.select("page", F.col("a.id").alias("id"), F.col("b.id").alias("new_id"), iou.alias("iou"), F.col("b.text").alias("new_text"), F.col("b.confidence").alias("new_confidence"))
    best = pairs.groupBy("page", "id").agg(F.min(F.struct((-F.col("iou")).alias("i"), "new_id", "new_text", "new_confidence")).alias("m"))
    joined = base.join(best, ["page", "id"], "left")
    better = F.coalesce(F.col("m.new_confidence") > F.col("confidence"), F.lit(False))
    kept = joined.select(
        "page", "id", F.when(better, F.col("m.new_text")).otherwise(F.col("text")).alias("text"), F.when(better, F.col("m.new_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(better, F.col("text")).otherwise(F.col("m.new_text")).alias("other"),
    )
    alone = improved.join(pairs.select("page", F.col("new_id").alias("id")).distinct(), ["page", "id"], "left_anti")
    return kept.unionByName(alone.select("page", "id", "text", "confidence", F.lit(None).cast("string").alias("other")))


def rule_segments(rules: DataFrame, spans: DataFrame, least: float = 24.0, slack: float = 2.0) -> DataFrame:
    """Stretches of horizontal rules that no text stands on: page, id, x0, x1, at least so long.

    A span stands on a rule if its lower edge is within the slack of the rule's upper one.
    """
    on = F.abs(F.col("b.r.y0") - F.col("a.r.y1")) <= slack
    met = spatial.range_join(rules, spans, on, (0.0, slack))
    cuts = met.select("page", F.col("a.id").alias("id"), F.col("b.r.x0").alias("x0"), F.col("b.r.x1").alias("x1"))
    ends = rules.select("page", "id", F.explode(F.array(F.struct(F.col("r.x0").alias("x0"), F.col("r.x0").alias("x1")), F.struct(F.col("r.x1").alias("x0"), F.col("r.x1").alias("x1")))).alias("e"))
    marks = cuts.unionByName(ends.select("page", "id", "e.x0", "e.x1"))
    order = Window.partitionBy("page", "id").orderBy("x0", "x1")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = marks.select("page", "id", reach.alias("start"), F.col("x0").alias("stop")).join(rules.select("page", "id", F.col("r.x0").alias("low"), F.col("r.x1").alias("high")), ["page", "id"])
    out = gaps.select("page", "id", F.greatest("start", "low").alias("x0"), F.least("stop", "high").alias("x1"))
    return out.where(F.col("x1") - F.col("x0") >= least)


def boxes_from_rules(across: DataFrame, upright: DataFrame, tolerance: float = 2.0, least: float = 4.0) -> DataFrame:
    """Boxes of two horizontal and two upright rules whose ends meet: page, x0, y0, x1, y1.

    Horizontals pair by ends that agree, then an upright has to close each side.
    """
    t = F.lit(tolerance)
    h = across.select("page", F.col("r.x0").alias("x0"), F.col("r.x1").alias("x1"), R.center_y(F.col("r")).alias("y"), F.floor(F.col("r.x0") / (4 * tolerance)).alias("cell"))
    near = h.select("page", F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("y").alias("top"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    pairs = h.join(near, ["page", "cell"]).where((F.abs(F.col("x0") - F.col("u0")) <= t) & (F.abs(F.col("x1") - F.col("u1")) <= t) & (F.col("top") - F.col("y") >= least))
    pairs = pairs.select("page", "x0", "x1", "y", "top")
    v = upright.select("page", R.center_x(F.col("r")).alias("x"), F.col("r.y0").alias("v0"), F.col("r.y1").alias("v1"))
    for side in ("x0", "x1"):
        closed = (pairs["page"] == v["page"]) & (F.abs(v["x"] - pairs[side]) <= t) & (F.abs(v["v0"] - pairs["y"]) <= t) & (F.abs(v["v1"] - pairs["top"]) <= t)
        pairs = pairs.join(v, closed, "left_semi")
    return pairs.select("page", "x0", F.col("y").alias("y0"), "x1", F.col("top").alias("y1")).distinct()
