"""Fusing shuffles candidates twice, and crowded pages give what other pages give."""

import random

import pytest
from pyspark.sql import functions as F

from leafmark.operators import fuse, spatial


@pytest.fixture(scope="module")
def candidates(spark):
    r, rows = random.Random(3), []
    for i in range(150):
        x, y, kind = r.randrange(120), r.randrange(60), r.choice(list(fuse.BUCKET_OF))
        wide, high = r.choice([(60, 20), (80, 30), (10, 10)])
        rows.append((i % 4, f"c{i:03}", (float(x), float(y), float(x + wide), float(y + high)), r.choice(list(fuse.SPECIFIC)), None if i % 19 == 0 else r.random(), r.random(), 0.5, 0.4, None, f"k{i % 3}" if i % 2 else None, None, [kind], [], [(kind, r.random(), "")] if i % 11 else []))
    return spark.createDataFrame(rows, "page int, id string, r struct<x0 double, y0 double, x1 double, y1 double>, field_type string, geometry double, label_link double, semantic_type double, autofill_value double, label string, canonical_key string, group_id string, sources array<string>, contexts array<string>, evidence array<struct<kind string, score double, detail string>>").cache()


def test_candidates_are_shuffled_twice(candidates):
    """Each join of candidates with what follows from them made and shuffled all of them anew."""
    shown = fuse.fuse(candidates)._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Exchange hashpartitioning") == 2 and "Join" not in shown


def test_crowded_pages_give_the_same(candidates, monkeypatch):
    rows = lambda df: sorted(str(sorted(r.asDict(True).items())) for r in df.withColumn("geometry", F.round("geometry", 9)).collect())
    got = rows(fuse.fuse(candidates))
    monkeypatch.setattr(spatial, "FEW", 1)
    want = rows(fuse.fuse(candidates))
    assert got == want and 4 < len(got) < 150
