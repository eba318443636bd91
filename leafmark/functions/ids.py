"""Identifiers that follow from what they name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmark.functions import rects as R


def canonical(c: Column) -> Column:
    """A value as text that is the same for equal values; null has a text of its own."""
    return F.coalesce(c.cast("string"), F.lit("~"))


def stable_id(*parts: Column, prefix: str = "", length: int = 16) -> Column:
    """The first hexadecimal digits of a hash of the parts, after a prefix if one is given."""
    if not 1 <= length <= 64:
        raise ValueError("an id has 1 to 64 digits")
    digest = F.substring(F.sha2(F.concat_ws("|", *map(canonical, parts)), 256), 1, length)
    return F.concat(F.lit(f"{prefix}_"), digest) if prefix else digest


def candidate_id(page: Column, r: Column, kind: Column, prefix: str = "fc") -> Column:
    """The id of a candidate: equal for equal kinds on one page whose edges agree to a thousandth of a point."""
    edge = lambda e: F.round(R.normalized(r)[e] * 1000).cast("long")
    return stable_id(page, edge("x0"), edge("y0"), edge("x1"), edge("y1"), kind, prefix=prefix)
