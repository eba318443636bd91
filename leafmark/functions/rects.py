"""Rectangle geometry as Column expressions.

A rectangle is a struct of doubles x0, y0, x1, y1 in points with y upwards. Every
function takes and returns Columns, so all of it stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6
#: Label search distance in points: the scale of a neighbour's decaying weight.
LABEL_DISTANCE = 120.0


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A rectangle from its four edges; null if any is."""
    parts = [c.cast("double") for c in (x0, y0, x1, y1)]
    whole = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull() & parts[3].isNotNull()
    return F.when(whole, F.struct(*(p.alias(n) for p, n in zip(parts, ("x0", "y0", "x1", "y1"), strict=True))))


EDGES = ("x0", "y0", "x1", "y1")


def whole(r: str) -> Column:
    """A rectangle column that has all its edges, as a struct that cannot be null: expressions on it are a third as long."""
    return F.struct(*(F.coalesce(F.col(r)[e].cast("double"), F.lit(0.0)).alias(e) for e in EDGES)).alias(r)


def normalized(r: Column) -> Column:
    return rect(F.least(r["x0"], r["x1"]), F.least(r["y0"], r["y1"]), F.greatest(r["x0"], r["x1"]), F.greatest(r["y0"], r["y1"]))


def from_points(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return normalized(rect(ax, ay, bx, by))


def from_list(v: Column) -> Column:
    return rect(F.get(v, 0), F.get(v, 1), F.get(v, 2), F.get(v, 3))


def as_list(r: Column) -> Column:
    return F.array(r["x0"], r["y0"], r["x1"], r["y1"])


def width(r: Column) -> Column:
    return F.abs(r["x1"] - r["x0"])


def height(r: Column) -> Column:
    return F.abs(r["y1"] - r["y0"])


def area(r: Column) -> Column:
    return width(r) * height(r)


def center_x(r: Column) -> Column:
    return (r["x0"] + r["x1"]) / 2


def center_y(r: Column) -> Column:
    return (r["y0"] + r["y1"]) / 2


def inflated(r: Column, dx: float | Column, dy: float | Column | None = None) -> Column:
    dy = dx if dy is None else dy
    return rect(r["x0"] - dx, r["y0"] - dy, r["x1"] + dx, r["y1"] + dy)


def translated(r: Column, dx: float | Column, dy: float | Column) -> Column:
    return rect(r["x0"] + dx, r["y0"] + dy, r["x1"] + dx, r["y1"] + dy)


def scaled(r: Column, sx: float | Column, sy: float | Column | None = None) -> Column:
    sy = sx if sy is None else sy
    return rect(r["x0"] * sx, r["y0"] * sy, r["x1"] * sx, r["y1"] * sy)


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def horizontal_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))


def vertical_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def intersects(a: Column, b: Column) -> Column:
    """Closed rectangles share a point; touching counts."""
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def intersection(a: Column, b: Column) -> Column:
    inner = rect(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))
    return F.when(intersects(a, b), inner)


def overlap_area(a: Column, b: Column) -> Column:
    return horizontal_overlap(a, b) * vertical_overlap(a, b)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is next to nothing."""
    i = overlap_area(a, b)
    u = area(a) + area(b) - i
    return F.when(u <= EPS, F.lit(0.0)).otherwise(i / u)


def contains_point(r: Column, x: Column, y: Column) -> Column:
    return (r["x0"] <= x) & (x <= r["x1"]) & (r["y0"] <= y) & (y <= r["y1"])


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (b["x1"] <= a["x1"]) & (b["y1"] <= a["y1"])


def coverage(a: Column, b: Column) -> Column:
    """The share of b that a covers."""
    return F.when(area(b) <= EPS, F.lit(0.0)).otherwise(overlap_area(a, b) / area(b))


def clamp(r: Column, page: Column) -> Column:
    """The rectangle with each edge moved into the page."""
    inside = lambda v, low, high: F.least(F.greatest(v, low), high)
    return rect(inside(r["x0"], page["x0"], page["x1"]), inside(r["y0"], page["y0"], page["y1"]), inside(r["x1"], page["x0"], page["x1"]), inside(r["y1"], page["y0"], page["y1"]))


def rounded(r: Column, digits: int = 3) -> Column:
    return rect(*(F.bround(r[n], digits) for n in ("x0", "y0", "x1", "y1")))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(bx - ax, by - ay)


def decay_weight(gap: Column, scale: float = LABEL_DISTANCE) -> Column:
    """1 / (1 + gap / scale) within [1e-6, 1]; 1 where the scale is next to nothing."""
    if scale <= EPS:
        return F.lit(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-6), 1.0 / (1.0 + F.greatest(F.lit(0.0), gap) / scale)))


def hull(prefix: Column) -> list[Column]:
    """Aggregates x0, y0, x1, y1 of the smallest rectangle around all; null over no row."""
    return [F.min(prefix["x0"]).alias("x0"), F.min(prefix["y0"]).alias("y0"), F.max(prefix["x1"]).alias("x1"), F.max(prefix["y1"]).alias("y1")]


# affine maps -------------------------------------------------------------------


def matrix(a, b, c, d, e, f) -> Column:
    names = "abcdef"
    return F.struct(*((v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for v, n in zip((a, b, c, d, e, f), names, strict=True)))


def concat(m: Column, n: Column) -> Column:
    """m first, then n."""
    return matrix(
        m["a"] * n["a"] + m["b"] * n["c"], m["a"] * n["b"] + m["b"] * n["d"],
        m["c"] * n["a"] + m["d"] * n["c"], m["c"] * n["b"] + m["d"] * n["d"],
        m["e"] * n["a"] + m["f"] * n["c"] + n["e"], m["e"] * n["b"] + m["f"] * n["d"] + n["f"],
    )


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def transform_rect(m: Column, r: Column) -> Column:
    """The hull of the four mapped corners."""
    corners = [apply(m, r[x], r[y]) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return rect(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def inverted(m: Column) -> Column:
    """The inverse map; null where there is none."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    back = matrix(
        m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det,
        (m["c"] * m["f"] - m["d"] * m["e"]) / det, (m["b"] * m["e"] - m["a"] * m["f"]) / det,
    )
    return F.when(F.abs(det) > 1e-12, back)


def rotation(degrees: Column) -> Column:
    t = F.radians(degrees)
    return matrix(F.cos(t), F.sin(t), -F.sin(t), F.cos(t), 0, 0)


# units -------------------------------------------------------------------------

POINTS_PER_INCH = 72.0
MM_PER_INCH = 25.4


def pt_to_px(v: Column, dpi: float) -> Column:
    return v * (dpi / POINTS_PER_INCH)


def px_to_pt(v: Column, dpi: float) -> Column:
    return v * (POINTS_PER_INCH / dpi)


def mm_to_pt(v: Column) -> Column:
    return v * (POINTS_PER_INCH / MM_PER_INCH)


def pt_to_mm(v: Column) -> Column:
    return v * (MM_PER_INCH / POINTS_PER_INCH)


def inch_to_pt(v: Column) -> Column:
    return v * POINTS_PER_INCH


def pt_to_inch(v: Column) -> Column:
    return v / POINTS_PER_INCH


def user_to_pixel(x: Column, y: Column, page: Column, turn: Column, scale: float) -> tuple[Column, Column]:
    """Pixel place of a point on a page turned by 0, 90, 180 or 270 degrees, y downwards."""
    u, v = x - page["x0"], y - page["y0"]
    w, h = width(page), height(page)
    px = F.when(turn == 90, v).when(turn == 180, w - u).when(turn == 270, h - v).otherwise(u)
    py = F.when(turn == 90, u).when(turn == 180, v).when(turn == 270, w - u).otherwise(h - v)
    return px * scale, py * scale
