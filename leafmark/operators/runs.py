"""Operators over ordered rows: unions of intervals, gaps, chains, anchored runs and combs.

Those whose result follows from a running aggregate are windows. Runs anchored at
their first member depend on each earlier decision, so they go through a Python
function, one page at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.operators.grouped import by_group
from leafmark.storage import materialize


def numbered(df: DataFrame, order: list, key: list[str] | None = None) -> DataFrame:
    """Adds at, each row's place from 0 in the order within its key, and n, the key's rows.

    No task sees a whole key: rows are dealt in ranges of (key, order), numbered within
    each range, and moved on by the sizes of the ranges before. Only those sizes, a row
    for each range, and the keys' first places meet in one place.
    """
    key = key or []
    by = [*(F.col(k) for k in key), *(F.col(o) if isinstance(o, str) else o for o in order)]
    ranges = materialize(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1
    placed = ranges.withColumn("_own", own).join(starts, "_range").withColumn("at", F.col("_start") + F.col("_own")).drop("_range", "_own", "_start")
    if not key:
        return placed.crossJoin(F.broadcast(sizes.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("n"))))
    first = placed.groupBy(*key).agg(F.min("at").alias("_first"), F.count("*").alias("n"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    joined = placed.alias("a").join(first.alias("b"), same)
    return joined.select(*(F.col(f"a.{c}") for c in df.columns), (F.col("a.at") - F.col("b._first")).alias("at"), F.col("b.n").alias("n"))


def interval_union(df: DataFrame, key: list[str], low: str, high: str, gap: float | Column = 0.0) -> DataFrame:
    """Per key, the union of intervals, joined over gaps of at most gap: low, high, members."""
    order = Window.partitionBy(*key).orderBy(low, high)
    reach = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(low) - reach > gap), 1).otherwise(0)
    runs = df.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*key, "run").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("members"))


def line_gaps(bands: DataFrame, key: list[str], top: str, bottom: str, ratio: float = 1.6) -> DataFrame:
    """Gaps between consecutive bands (downwards) larger than ratio times the median band height."""
    whole = Window.partitionBy(*key)
    order = Window.partitionBy(*key).orderBy(F.desc(top), F.desc(bottom))
    typical = F.percentile(F.col(top) - F.col(bottom), 0.5).over(whole)
    gap = F.lag(bottom).over(order) - F.col(top)
    return bands.withColumns({"gap": gap, "typical": typical}).where(F.col("gap") > ratio * F.col("typical"))


def reading_chain(df: DataFrame, key: list[str], order: list, item: str) -> DataFrame:
    """Each item with the one that follows it."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("following", F.lead(item).over(w)).where("following IS NOT NULL")


def anchored_runs(df: DataFrame, key: list[str], value: str, tolerance: float, ties: list[str]) -> DataFrame:
    """Numbers runs of ascending values, each begun by the first value too far from the last run's first.

    Adds run, from 0 in each key. Null values are dropped.
    """

    names = [c for c in df.columns if c not in key]
    at = len(key) + names.index(value)

    def label(rows: list[tuple]) -> list[tuple]:
        out, head, run = [], None, -1
        for r in rows:
            if head is None or r[at] - head > tolerance:
                head, run = r[at], run + 1
            out.append((*r, run))
        return out

    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in [*key, *names])
    return by_group(df.where(F.col(value).isNotNull()), key, [value, *ties], label, f"{fields}, run bigint").select(*df.columns, "run")


def comb_runs(cells: DataFrame, tolerance: float = 2.0, least: int = 3) -> DataFrame:
    """Runs of at least three cells of a row that are equally wide and equally spaced: page, row, first, cells.

    cells has page, row, id, x0, x1. A cell belongs to one run; runs grow to the right
    while width and pitch stay within the tolerance of the run's first two.
    """

    def find(row: list[tuple]) -> list[tuple]:
        out, run, pitch = [], [], None

        def close() -> None:
            if len(run) >= least:
                out.append((row[0][0], row[0][1], run[0][2], len(run)))

        for c in row:
            _, _, _, x0, x1 = c
            fits = bool(run) and abs((x1 - x0) - (run[0][4] - run[0][3])) <= tolerance and x0 > run[-1][3]
            step = x0 - run[-1][3] if run else 0.0
            if fits and (pitch is None or abs(step - pitch) <= tolerance):
                pitch = step if pitch is None else pitch
                run.append(c)
            else:
                close()
                run, pitch = [c], None
        close()
        return out

    kinds = dict(cells.dtypes)
    return by_group(cells.select("page", "row", "id", "x0", "x1"), ["page", "row"], ["x0", "x1", "id"], find, f"page {kinds['page']}, row {kinds['row']}, first {kinds['id']}, cells bigint")
