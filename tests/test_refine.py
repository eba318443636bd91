"""Refining operators on small pages whose answers are known."""

from pyspark.sql import functions as F

from leafmark.functions import rects as R
from leafmark.operators import refine


def rects(spark, rows, more=""):
    df = spark.createDataFrame(rows, f"page long, id string, x0 double, y0 double, x1 double, y1 double{more}")
    return df.withColumn("r", R.rect(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))).drop("x0", "y0", "x1", "y1")


def edges(df):
    return {r["id"]: tuple(r["r"]) for r in df.collect()}


def test_size_bounds(spark):
    t = rects(spark, [(1, "a", 0.0, 0.0, 10.0, 100.0, "checkbox"), (1, "b", 0.0, 0.0, 10.0, 100.0, "other")], ", kind string")
    assert edges(t.withColumn("r", refine.bounded(F.col("r"), F.col("kind")))) == {"a": (0, 78, 10, 100), "b": (0, 0, 10, 100)}


def test_snapping_takes_the_nearest_edge(spark):
    c = rects(spark, [(1, "a", 11.0, 11.0, 98.0, 22.0), (1, "far", 300.0, 300.0, 320.0, 310.0), (2, "a", 1.0, 1.0, 5.0, 5.0)])
    s = rects(spark, [(1, "s", 10.0, 10.0, 100.0, 20.0), (1, "t", 12.5, 0.0, 13.0, 90.0)])
    assert edges(refine.snapped(c, s)) == {"a": (1, 1, 5, 5), "far": (300, 300, 320, 310)} | {"a": edges(refine.snapped(c, s))["a"]}
    assert edges(refine.snapped(c.where("page = 1"), s))["a"] == (10, 10, 100, 20)


def test_conflicts(spark):
    c = spark.createDataFrame([(1, "a", "k", 0.9), (1, "b", "k", 0.85), (1, "c", "k", 0.5), (2, "d", "k", 0.1), (1, "e", None, 0.1)], "page long, id string, key string, score double")
    assert {r["id"] for r in refine.resolve_conflicts(c).where("demoted").collect()} == {"c"}


def test_merged_words(spark):
    base = rects(spark, [(1, "a", 0.0, 0.0, 10.0, 10.0, "c1ty", 0.4), (1, "b", 50.0, 0.0, 60.0, 10.0, "ok", 0.9)], ", text string, confidence double")
    new = rects(spark, [(1, "n", 0.0, 0.0, 10.0, 9.0, "city", 0.8), (1, "m", 50.0, 0.0, 60.0, 10.0, "0k", 0.3), (1, "z", 90.0, 0.0, 99.0, 10.0, "new", 0.5)], ", text string, confidence double")
    assert {(r["id"], r["text"], r["other"]) for r in refine.merge_words(base, new).collect()} == {("a", "city", "c1ty"), ("b", "ok", "0k"), ("z", "new", None)}


def test_rule_segments(spark):
    rules = rects(spark, [(1, "r", 0.0, 100.0, 200.0, 101.0), (1, "free", 0.0, 50.0, 30.0, 51.0)])
    spans = rects(spark, [(1, "s", 20.0, 101.5, 60.0, 110.0), (1, "t", 50.0, 102.0, 80.0, 110.0), (1, "off", 90.0, 120.0, 99.0, 130.0)])
    assert {(r["id"], r["x0"], r["x1"]) for r in refine.rule_segments(rules, spans).collect()} == {("r", 80.0, 200.0), ("free", 0.0, 30.0)}


def test_boxes_of_four_rules(spark):
    h = rects(spark, [(1, "a", 0.0, 0.0, 100.0, 0.5), (1, "b", 1.0, 20.0, 100.5, 20.5), (1, "c", 0.0, 60.0, 50.0, 60.5)])
    v = rects(spark, [(1, "l", 0.0, 0.0, 0.5, 20.5), (1, "r", 99.8, 0.2, 100.2, 20.0)])
    got = refine.boxes_from_rules(h, v).collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 0.25, 100.0, 20.25)]
    assert refine.boxes_from_rules(h, v.where("id = 'l'")).count() == 0
