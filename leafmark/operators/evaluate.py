"""Measures of detected fields against the truth, one row each, and their differences between runs.

Matched fields come from ``cluster.greedy_match``: page, pred_id, truth_id, iou.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import rects as R


def share(hit: Column) -> Column:
    """The share of rows for which a condition holds; 0 of no rows."""
    return F.coalesce(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), F.lit(0.0))


def same_label(a: Column, b: Column) -> Column:
    """True if two labels are equal but for case and blanks around them."""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def association(matches: DataFrame) -> DataFrame:
    """Shares of matches with the same label and with the same key. matches: pred_label, truth_label, pred_key, truth_key."""
    return matches.agg(share(same_label(F.col("pred_label"), F.col("truth_label"))).alias("label_association"), share(F.col("pred_key") == F.col("truth_key")).alias("canonical_accuracy"))


def geometry(matches: DataFrame) -> DataFrame:
    """Mean and median IoU, mean distance of centres and mean absolute error of each edge. matches: iou, p, t (rectangles)."""
    p, t = F.col("p"), F.col("t")
    centre = F.sqrt(F.pow(R.center_x(p) - R.center_x(t), 2) + F.pow(R.center_y(p) - R.center_y(t), 2))
    edges = (F.avg(F.abs(p[e] - t[e])).alias(f"error_{e}") for e in ("x0", "y0", "x1", "y1"))
    return matches.agg(F.count("*").alias("matches"), F.avg("iou").alias("mean_iou"), F.median("iou").alias("median_iou"), F.avg(centre).alias("mean_center_error"), *edges)


def exact_match(fills: DataFrame, expected: DataFrame) -> DataFrame:
    """How many filled values were expected, how many are right, and their share. fills: key, value. expected: key, value."""
    both = fills.select("key", F.col("value").alias("got")).join(expected.select("key", F.col("value").alias("want")), "key")
    right = F.coalesce(F.col("got") == F.col("want"), F.lit(False))
    return both.agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), share(right).alias("exact_match_rate"))


def repeat_consistency(values: DataFrame, group: str, value: str) -> DataFrame:
    """The share of groups with at most one distinct value that is not null; 1 if there is no group."""
    kinds = values.groupBy(group).agg(F.count_distinct(value).alias("kinds"))
    return kinds.agg(F.coalesce(F.avg((F.col("kinds") <= 1).cast("double")), F.lit(1.0)).alias("repeat_consistency"))


def edit_distance(a: list, b: list) -> int:
    """Edits that turn one sequence into another."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def error_rates(readings: DataFrame) -> DataFrame:
    """id, char_edits, cer, word_edits and wer of each reading. readings: id, read, truth.

    Over an empty truth a rate is 0 if nothing was read, else 1. Words go through Python, an Arrow batch at a time.
    """
    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(r.split(), t.split()) for r, t in zip(batch["read"], batch["truth"], strict=True)]
            yield batch.assign(word_edits=[edit_distance(r, t) for r, t in pairs], n_read=[len(r) for r, _ in pairs], n_truth=[len(t) for _, t in pairs])

    plain = readings.select("id", F.coalesce("read", F.lit("")).alias("read"), F.coalesce("truth", F.lit("")).alias("truth"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    found = plain.mapInPandas(words, f"{fields}, word_edits bigint, n_read bigint, n_truth bigint")
    rate = lambda edits, n, got: F.when(n > 0, edits / n).when(got > 0, 1.0).otherwise(0.0)
    chars = F.levenshtein("read", "truth").cast("long")
    return found.select("id", chars.alias("char_edits"), rate(chars, F.length("truth"), F.length("read")).alias("cer"), "word_edits", rate(F.col("word_edits"), F.col("n_truth"), F.col("n_read")).alias("wer"))


def evaluate(*measures: DataFrame) -> DataFrame:
    """One row of all measures, each a table of one row."""
    out = measures[0]
    for m in measures[1:]:
        out = out.crossJoin(F.broadcast(m))
    return out


def compare(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """metric, ours, theirs and their difference, for the numbers that both rows have."""
    names = [c for c in ours.columns if c in theirs.columns]
    long = lambda df, v: df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(v)) for c in names))).alias("m")).select("m.*")
    return long(ours, "ours").join(long(theirs, "theirs"), "metric").withColumn("delta", F.col("ours") - F.col("theirs"))
