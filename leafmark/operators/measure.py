"""Quality measures: recall and precision, type scores, deciles, calibration, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.operators.runs import numbered


def recall_precision(df: DataFrame, pred: str, truth: str, key: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, recall, precision and f1 of a boolean prediction; a rate over nothing is 1 if nothing was missed or wrong, else 0."""
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    p, t = F.col(pred), F.col(truth)
    out = df.groupBy(*(key or [])).agg(hit(p & t).alias("tp"), hit(p & ~t).alias("fp"), hit(~p & t).alias("fn"))
    rate = lambda good, bad: F.when(good + bad > 0, good / (good + bad)).otherwise(1.0)
    out = out.withColumns({"recall": rate(F.col("tp"), F.col("fn")), "precision": rate(F.col("tp"), F.col("fp"))})
    both = F.col("recall") + F.col("precision")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("recall") * F.col("precision") / both).otherwise(0.0))


def macro_f1(pairs: DataFrame, pred: str, truth: str) -> DataFrame:
    """Per label tp, fp, fn and f1 over matched pairs."""
    both = pairs.select(F.explode(F.array(F.struct(F.col(pred).alias("label"), F.lit("p").alias("side")), F.struct(F.col(truth).alias("label"), F.lit("t").alias("side")))).alias("x"), (F.col(pred) == F.col(truth)).alias("ok"))
    out = both.groupBy(F.col("x.label").alias("label")).agg(
        F.sum(F.when(F.col("ok") & (F.col("x.side") == "p"), 1).otherwise(0)).cast("long").alias("tp"),
        F.sum(F.when(~F.col("ok") & (F.col("x.side") == "p"), 1).otherwise(0)).cast("long").alias("fp"),
        F.sum(F.when(~F.col("ok") & (F.col("x.side") == "t"), 1).otherwise(0)).cast("long").alias("fn"),
    )
    return out.withColumn("f1", F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))


def deciles(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Nine deciles, each the value at place floor(n * d / 10) of the sorted values."""
    ranked = numbered(df.select(*key, value), [value], key)
    picks = F.explode(F.sequence(F.lit(1), F.lit(9)))
    named = ranked.withColumn("d", picks).where(F.col("at") == F.floor(F.col("n") * F.col("d") / 10))
    return named.groupBy(*key).pivot("d", list(range(1, 10))).agg(F.first(value)).select(*key, *(F.col(str(d)).alias(f"d{d}") for d in range(1, 10)))


def edge_errors(df: DataFrame, kind: str, errors: list[str]) -> DataFrame:
    """Mean signed error of each edge by kind and over all (kind null): the learned calibration."""
    return df.rollup(kind).agg(F.count("*").alias("n"), *(F.avg(e).alias(e) for e in errors))


def otsu(bins: DataFrame, key: list[str]) -> DataFrame:
    """Per key the threshold of a 256-bin histogram (bin, n) with the largest between-class variance; the middle of a plateau."""
    order = Window.partitionBy(*key).orderBy("bin")
    whole = Window.partitionBy(*key)
    below = order.rowsBetween(Window.unboundedPreceding, 0)
    run = bins.withColumns({
        "w0": F.sum("n").over(below), "s0": F.sum(F.col("n") * F.col("bin")).over(below),
        "w": F.sum("n").over(whole), "s": F.sum(F.col("n") * F.col("bin")).over(whole),
    })
    # Between-class variance times the square of the total, over w0 * w1: kept whole until the last division.
    lever = F.col("s0").cast("double") * F.col("w") - F.col("s").cast("double") * F.col("w0")
    spread = lever * lever / (F.col("w0").cast("double") * (F.col("w") - F.col("w0")))
    scored = run.where("w0 > 0 AND w0 < w").withColumn("spread", spread)
    best = scored.withColumn("top", F.max("spread").over(whole)).where("spread = top")
    return best.groupBy(*key).agg(F.floor((F.min("bin") + F.max("bin")) / 2).cast("long").alias("threshold"))


def thinned(df: DataFrame, order: list, limit: int, key: list[str] | None = None) -> DataFrame:
    """At most limit rows per key, evenly spaced in order and the same on every run."""
    ranked = numbered(df, order, key)
    keep = (F.col("n") <= limit) | (F.floor(F.col("at") * limit / F.col("n")) != F.floor((F.col("at") - 1) * limit / F.col("n")))
    return ranked.where(keep).drop("at", "n")
