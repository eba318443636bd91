"""Rectangles of one table meet on their page with one shuffle, and greedy operators shuffle a row once more."""

import random

import pytest
from pyspark.sql import functions as F

from leafmark.functions import rects as R
from leafmark.operators import cluster, spatial


def rects(spark, n=120, pages=3):
    r = random.Random(7)
    rows = []
    for i in range(n):
        x, y = r.randrange(60), r.randrange(60)
        rows.append((i % pages if i % 17 else None, f"r{i:03}", None if i % 13 == 0 else (float(x), float(y), x + r.randrange(1, 30) * 1.0, None if i % 29 == 0 else y + r.randrange(1, 30) * 1.0)))
    return spark.createDataFrame(rows, "page int, id string, r struct<x0 double, y0 double, x1 double, y1 double>")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("find", [spatial.overlap_pairs, spatial.adjacency, lambda d: spatial.containing_pairs(d, d), lambda d: spatial.nearest(d, d, "left", 120.0)])
def test_one_table_meets_itself_with_one_shuffle(spark, find):
    """Both sides of a join were shuffled and sorted, and both read the input."""
    shown = plan(find(rects(spark)))
    assert shown.count("Exchange hashpartitioning(page") == 1 and "Join" not in shown


def test_greedy_operators_join_nothing(spark):
    """Largest first: what lies over a rectangle came by a join, another shuffle of every row and one of the pairs."""
    assert "Join" not in plan(cluster.suppress(rects(spark)))


def test_pages_and_cells_give_the_pairs_of_all_against_all(spark, monkeypatch):
    df = rects(spark).cache()
    whole = [r for r in df.collect() if r.page is not None and r.r and r.r.y1 is not None]
    touch = lambda a, b, dx, dy: a.x0 - dx <= b.x1 and b.x0 <= a.x1 + dx and a.y0 - dy <= b.y1 and b.y0 <= a.y1 + dy
    want = sorted((a.id, b.id) for a in whole for b in whole if a.page == b.page and a.id != b.id and touch(a.r, b.r, 5.0, 2.0))
    keep = F.col("a.id") != F.col("b.id")
    for few in (256, 1):
        monkeypatch.setattr(spatial, "FEW", few)
        for other in (df, df.where("id >= ''")):
            got = sorted((r.a.id, r.b.id) for r in spatial.range_join(df, other, keep, (5.0, 2.0), 16.0).collect())
            assert got == want != []


def test_suppress_as_one_by_one(spark):
    df = rects(spark).where("r.y1 IS NOT NULL AND page IS NOT NULL").cache()
    for limit in (200, 5):
        want = []
        for page in range(3):
            own = sorted((r for r in df.collect() if r.page == page), key=lambda r: (-(r.r.x1 - r.r.x0) * (r.r.y1 - r.r.y0), r.id))
            kept = []
            for r in own:
                inside = lambda k: k.r.x0 <= r.r.x0 and k.r.y0 <= r.r.y0 and r.r.x1 <= k.r.x1 and r.r.y1 <= k.r.y1  # noqa: B023, E731
                if len(kept) < limit and not any(inside(k) for k in kept):
                    kept.append(r)
            want += [(page, r.id) for r in kept]
        assert sorted(map(tuple, cluster.suppress(df, 1.0, limit).collect())) == sorted(want)
    assert df.select(R.area(F.col("r"))).count() > 0
