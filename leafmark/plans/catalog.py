"""Queries over the driver's tables, each beside the SQL that it is held against.

The tables hold no forms, so operators run on fixed projections of them: rectangles
from lineitem, lines and words from documents, votes and evidence from events, vaults
and fields from customer and orders. Doubles are compared as whole millionths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.functions import rects as R
from leafmark.functions import text as T
from leafmark.functions import values as V
from leafmark.operators import cluster, decide, measure, runs, spatial
from leafmark.storage import table

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        CATALOG[f.__name__] = (f, sql)
        return f

    return add


def all_queries() -> dict[str, tuple[Query, str | None]]:
    """The whole catalogue."""
    from leafmark.plans import catalog_detect, catalog_forms, catalog_schema, catalog_text  # noqa: F401  add their own

    return CATALOG


def millionths(c: Column) -> Column:
    return F.floor(c * 1e6 + 0.5).cast("long")


# projections -------------------------------------------------------------------------


def rect_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, id, r and a type from lineitem."""
    t = table(spark, sf_dir, "lineitem")
    x0, y0 = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") % 90 * 8).cast("double")
    r = R.rect(x0, y0, x0 + 20 + 8 * F.col("l_quantity"), y0 + 40 + 20 * F.col("l_linenumber"))
    name = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"))
    return t.select(F.col("l_orderkey").alias("page"), name.alias("id"), r.alias("r"), F.col("l_returnflag").alias("kind"))


RECTS = """rects AS (
  SELECT l_orderkey AS page, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS id, l_returnflag AS kind,
         (l_partkey % 500)::DOUBLE AS x0, (l_suppkey % 90 * 8)::DOUBLE AS y0,
         (l_partkey % 500)::DOUBLE + 20 + 8 * l_quantity AS x1, (l_suppkey % 90 * 8)::DOUBLE + 40 + 20 * l_linenumber AS y1
  FROM lineitem)"""
PAIRS = f"""WITH {RECTS}, pairs AS (
  SELECT a.page, a.id AS a_id, b.id AS b_id,
         greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i,
         (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb
  FROM rects a JOIN rects b ON a.page = b.page AND a.id < b.id)"""


@query(f"""WITH {RECTS} SELECT page, id, x1 - x0 AS width, y1 - y0 AS height, (x1 - x0) * (y1 - y0) AS area, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM rects""")
def rect_metrics(spark, sf_dir):
    r = F.col("r")
    return rect_rows(spark, sf_dir).select("page", "id", R.width(r).alias("width"), R.height(r).alias("height"), R.area(r).alias("area"), R.center_x(r).alias("cx"), R.center_y(r).alias("cy"))


@query(f"""WITH {RECTS} SELECT page, id, least(greatest(x0 - 2, 0), 612) AS x0, least(greatest(y0 - 3, 0), 792) AS y0,
  least(greatest(x1 + 2, 0), 612) AS x1, least(greatest(y1 + 3, 0), 792) AS y1 FROM rects""")
def rect_inflate_clamp(spark, sf_dir):
    page = R.rect(F.lit(0), F.lit(0), F.lit(612), F.lit(792))
    out = rect_rows(spark, sf_dir).select("page", "id", R.clamp(R.inflated(F.col("r"), 2.0, 3.0), page).alias("r"))
    return out.select("page", "id", "r.x0", "r.y0", "r.x1", "r.y1")


@query(f"""WITH {RECTS} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM rects GROUP BY page""")
def rect_union_hull(spark, sf_dir):
    return rect_rows(spark, sf_dir).groupBy("page").agg(*R.hull(F.col("r")), F.count("*").alias("n"))


@query(PAIRS + """ SELECT page, a_id, b_id, floor(i / (sa + sb - i) * 1e6 + 0.5)::BIGINT AS iou_millionths FROM pairs WHERE i / (sa + sb - i) > 0.5""")
def rect_iou_pairs(spark, sf_dir):
    return spatial.overlap_pairs(rect_rows(spark, sf_dir), 0.5).select("page", "a_id", "b_id", millionths(F.col("iou")).alias("iou_millionths"))


@query(PAIRS + """ SELECT page, count(*) AS overlaps, max(floor(i / (sa + sb - i) * 1e6 + 0.5)::BIGINT) AS worst FROM pairs WHERE i / (sa + sb - i) > 0.1 GROUP BY page""")
def rect_overlap_check(spark, sf_dir):
    """Pages whose rectangles overlap, with how many pairs do and the worst of them."""
    found = spatial.overlap_pairs(rect_rows(spark, sf_dir))
    return found.groupBy("page").agg(F.count("*").alias("overlaps"), F.max(millionths(F.col("iou"))).alias("worst"))


@query(f"""WITH {RECTS} SELECT a.page, a.id AS a_id, b.id AS b_id FROM rects a JOIN rects b ON a.page = b.page AND a.id <> b.id
  AND a.x0 <= b.x0 AND a.y0 <= b.y0 AND b.x1 <= a.x1 AND b.y1 <= a.y1""")
def rect_containment(spark, sf_dir):
    rows = rect_rows(spark, sf_dir)
    return spatial.containing_pairs(rows, rows)


@query(f"""WITH {RECTS} SELECT page, count(*) AS outside FROM rects WHERE x0 < 0 OR y0 < 0 OR x1 > 612 OR y1 > 792 GROUP BY page""")
def page_bounds_check(spark, sf_dir):
    page = R.rect(F.lit(0), F.lit(0), F.lit(612), F.lit(792))
    return rect_rows(spark, sf_dir).where(~R.contains(page, F.col("r"))).groupBy("page").agg(F.count("*").alias("outside"))


RELATED = f"""WITH {RECTS}, met AS (
  SELECT a.page, a.id AS src, b.id AS dst,
    least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.4 * least(a.y1 - a.y0, b.y1 - b.y0) AS in_row,
    least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.3 * least(a.x1 - a.x0, b.x1 - b.x0) AS in_col,
    b.x0 - a.x1 AS gl, a.x0 - b.x1 AS gr, a.y0 - b.y1 AS ga, b.y0 - a.y1 AS gb
  FROM rects a JOIN rects b ON a.page = b.page AND a.id <> b.id),
rel AS (
  SELECT page, src, dst,
    CASE WHEN in_row AND gl >= -1e-6 AND gl < 120 THEN 'left_of' WHEN in_row AND gr >= -1e-6 AND gr < 120 THEN 'right_of'
         WHEN in_col AND ga >= -1e-6 AND ga < 30 THEN 'above' WHEN in_col AND gb >= -1e-6 AND gb < 30 THEN 'below' END AS kind, gl, gr, ga, gb
  FROM met),
weighed AS (
  SELECT page, src, dst, kind, CASE kind WHEN 'left_of' THEN 1 / (1 + greatest(0, gl) / 120.0) WHEN 'right_of' THEN 1 / (1 + greatest(0, gr) / 120.0)
    WHEN 'above' THEN 1 / (1 + greatest(0, ga) / 30.0) ELSE 1 / (1 + greatest(0, gb) / 30.0) END AS weight
  FROM rel WHERE kind IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY page, src, kind ORDER BY weight DESC, dst) AS place FROM weighed)"""


@query(RELATED + " SELECT page, src, dst, kind, floor(weight * 1e6 + 0.5)::BIGINT AS weight_millionths, place FROM ranked WHERE place <= 12")
def spatial_adjacency_top12(spark, sf_dir):
    out = spatial.adjacency(rect_rows(spark, sf_dir))
    return out.select("page", "src", "dst", "kind", millionths(F.col("weight")).alias("weight_millionths"), F.col("place").cast("long").alias("place"))


@query(RELATED + " SELECT kind, count(*) AS edges, count(DISTINCT page) AS pages FROM ranked WHERE place <= 12 GROUP BY kind")
def spatial_relation_counts(spark, sf_dir):
    return spatial.adjacency(rect_rows(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("edges"), F.count_distinct("page").alias("pages"))


def _nearest_sql(direction: str) -> str:
    gap, slack, limit, share = {
        "left": ("f.x0 - s.x1", 1.5, 120, "least(f.y1, s.y1) - greatest(f.y0, s.y0) >= 0.2 * least(f.y1 - f.y0, s.y1 - s.y0)"),
        "above": ("s.y0 - f.y1", 1.0, 40, "least(f.x1, s.x1) - greatest(f.x0, s.x0) >= 0.15 * least(f.x1 - f.x0, s.x1 - s.x0)"),
    }[direction]
    return f"""WITH {RECTS}, near AS (
  SELECT f.page, f.id AS field_id, s.id AS label_id, {gap} AS gap, s.x0 AS lx FROM rects f JOIN rects s ON f.page = s.page AND f.id <> s.id
  AND {gap} BETWEEN -{slack} AND {limit} AND {share})
SELECT page, field_id, label_id, greatest(0, gap) AS gap FROM near QUALIFY row_number() OVER (PARTITION BY page, field_id ORDER BY gap, lx, label_id) = 1"""


@query(_nearest_sql("left"))
def nearest_label_left(spark, sf_dir):
    rows = rect_rows(spark, sf_dir)
    return spatial.nearest(rows, rows, "left", 120.0)


@query(_nearest_sql("above"))
def nearest_label_above(spark, sf_dir):
    rows = rect_rows(spark, sf_dir)
    return spatial.nearest(rows, rows, "above", 40.0)


@query(f"""WITH near AS ({_nearest_sql("left")}) SELECT page, field_id, label_id, gap FROM near
  QUALIFY row_number() OVER (PARTITION BY page, label_id ORDER BY gap, field_id) = 1""")
def mutual_nearest_match(spark, sf_dir):
    return spatial.mutual_nearest(nearest_label_left(spark, sf_dir), "field_id", "label_id", "gap")


@query(f"""WITH {RECTS} SELECT page, id FROM rects a WHERE NOT EXISTS (SELECT 1 FROM rects b WHERE b.page = a.page AND b.id <> a.id AND b.kind = 'R'
  AND (CASE WHEN (a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) <= 1e-6 THEN 0 ELSE greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0)) * greatest(0, least(a.y1,b.y1)-greatest(a.y0,b.y0))
    / ((a.x1-a.x0)*(a.y1-a.y0) + (b.x1-b.x0)*(b.y1-b.y0) - greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0)) * greatest(0, least(a.y1,b.y1)-greatest(a.y0,b.y0))) END > 0.05
   OR greatest(0, least(a.x1,b.x1)-greatest(a.x0,b.x0)) * greatest(0, least(a.y1,b.y1)-greatest(a.y0,b.y0)) / ((a.x1-a.x0)*(a.y1-a.y0)) > 0.25))""")
def anti_claimed_rects(spark, sf_dir):
    rows = rect_rows(spark, sf_dir)
    return spatial.unclaimed(rows, rows.where("kind = 'R'")).select("page", "id")


@query(f"""WITH {RECTS} SELECT a.page, a.id, count(*) AS crossings FROM rects a JOIN rects b ON a.page = b.page AND a.id <> b.id
  AND b.x0 <= a.x1 AND a.x0 <= b.x1 AND b.y0 <= a.y1 AND a.y0 <= b.y1 GROUP BY a.page, a.id HAVING count(*) >= 2""")
def semi_grid_rules(spark, sf_dir):
    rows = rect_rows(spark, sf_dir)
    met = spatial.range_join(rows, rows, F.col("a.id") != F.col("b.id"))
    return met.groupBy("page", F.col("a.id").alias("id")).agg(F.count("*").alias("crossings")).where("crossings >= 2")


@query(f"""WITH {RECTS}, marked AS (
  SELECT *, max(x1) OVER (PARTITION BY page ORDER BY x0, x1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rects),
runs AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 - reach > 24 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x0, x1, id ROWS UNBOUNDED PRECEDING) AS run FROM marked)
SELECT page, min(x0) AS x0, max(x1) AS x1, count(*) AS members FROM runs GROUP BY page, run""")
def interval_union_columns(spark, sf_dir):
    flat = rect_rows(spark, sf_dir).select("page", "r.x0", "r.x1")
    return runs.interval_union(flat, ["page"], "x0", "x1", 24.0).drop("run")


@query(f"""WITH {RECTS}, bands AS (SELECT DISTINCT page, y0, y1 FROM rects), g AS (
  SELECT page, y1, lag(y0) OVER (PARTITION BY page ORDER BY y1 DESC, y0 DESC) - y1 AS gap, quantile_cont(y1 - y0, 0.5) OVER (PARTITION BY page) AS typical FROM bands)
SELECT page, y1 AS top, gap FROM g WHERE gap > 1.6 * typical""")
def line_gaps_lag(spark, sf_dir):
    bands = rect_rows(spark, sf_dir).select("page", "r.y0", "r.y1").distinct()
    return runs.line_gaps(bands, ["page"], "y1", "y0").select("page", F.col("y1").alias("top"), "gap")


@query(f"""WITH {RECTS}, n AS (SELECT page, id AS src, lead(id) OVER (PARTITION BY page ORDER BY y1 DESC, x0, id) AS dst FROM rects) SELECT * FROM n WHERE dst IS NOT NULL""")
def reading_order_lead(spark, sf_dir):
    flat = rect_rows(spark, sf_dir).select("page", "id", "r.y1", "r.x0")
    return runs.reading_chain(flat, ["page"], [F.desc("y1"), "x0", "id"], "id").select("page", F.col("id").alias("src"), F.col("following").alias("dst"))


@query(f"""WITH RECURSIVE {RECTS}, s AS (SELECT page, id, y0, row_number() OVER (PARTITION BY page ORDER BY y0, id) AS k FROM rects),
walk AS (SELECT page, id, y0, k, y0 AS head, 0::BIGINT AS run FROM s WHERE k = 1
  UNION ALL SELECT s.page, s.id, s.y0, s.k, CASE WHEN s.y0 - w.head > 24 THEN s.y0 ELSE w.head END, CASE WHEN s.y0 - w.head > 24 THEN w.run + 1 ELSE w.run END
  FROM walk w JOIN s ON s.page = w.page AND s.k = w.k + 1)
SELECT page, id, run FROM walk""")
def lines_anchored_runs(spark, sf_dir):
    flat = rect_rows(spark, sf_dir).select("page", "id", "r.y0")
    return runs.anchored_runs(flat, ["page"], "y0", 24.0, ["id"]).select("page", "id", "run")


@query(None)
def comb_runs(spark, sf_dir):
    cells = rect_rows(spark, sf_dir).select("page", (F.col("r.y0") / 240).cast("long").alias("row"), "id", "r.x0", "r.x1")
    return runs.comb_runs(cells, 60.0, 3)


@query(PAIRS.replace("WITH rects", "WITH RECURSIVE rects") + """, near AS (SELECT page, a_id, b_id FROM pairs WHERE i / (sa + sb - i) > 0.55),
linked AS (SELECT page, a_id, b_id FROM near UNION ALL SELECT page, b_id, a_id FROM near),
walk AS (SELECT page, id, id AS hop FROM rects UNION SELECT w.page, w.id, b.b_id FROM walk w JOIN linked b ON b.page = w.page AND b.a_id = w.hop)
SELECT page, id, min(hop) AS cluster FROM walk GROUP BY page, id""")
def dedupe_components(spark, sf_dir):
    return cluster.components(rect_rows(spark, sf_dir))


@query(None)
def suppress_greedy(spark, sf_dir):
    return cluster.suppress(rect_rows(spark, sf_dir))


@query(None)
def greedy_match_iou(spark, sf_dir):
    rows = rect_rows(spark, sf_dir)
    moved = rows.withColumn("r", R.translated(F.col("r"), 6.0, -4.0))
    return cluster.greedy_match(moved, rows).withColumn("iou", millionths(F.col("iou")))


# evidence, votes -----------------------------------------------------------------------


def evidence(spark, sf_dir) -> DataFrame:
    """candidate, kind and score from events; a score is in thousandths, so sums are whole."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("candidate"), F.col("event_type").alias("kind"), F.floor(F.least(F.lit(1.0), F.col("value") / 500) * 1000).cast("long").alias("score"), F.get_json_object("props", "$.k").cast("int").alias("k"), "event_id", "ts")


EVIDENCE = """e AS (SELECT user_id AS candidate, event_type AS kind, floor(least(1.0, value / 500) * 1000)::BIGINT AS score,
  (props ->> '$.k')::INT AS k, event_id, ts FROM events)"""


@query(f"""WITH {EVIDENCE} SELECT candidate, max(score) FILTER (k % 7 = 0) AS geometric, max(score) FILTER (k % 7 = 1) AS blank_region, max(score) FILTER (k % 7 = 2) AS nearby_label,
  max(score) FILTER (k % 7 = 3) AS layout, max(score) FILTER (k % 7 = 4) AS repeated, max(score) FILTER (k % 7 = 5) AS semantic, max(score) FILTER (k % 7 = 6) AS model FROM e GROUP BY candidate""")
def evidence_buckets(spark, sf_dir):
    names = list(decide.SCORE_WEIGHTS)
    return evidence(spark, sf_dir).groupBy("candidate").agg(*(F.max(F.when(F.col("k") % 7 == i, F.col("score"))).alias(n) for i, n in enumerate(names)))


@query(f"""WITH {EVIDENCE}, b AS (SELECT candidate, max(score) FILTER (k % 7 = 0) AS g, max(score) FILTER (k % 7 = 1) AS l, max(score) FILTER (k % 7 = 2) AS s,
  max(score) FILTER (k % 7 = 3) AS p, max(score) FILTER (k % 7 = 4) AS o, max(score) FILTER (k % 7 = 5) AS i, max(score) FILTER (k % 7 = 6) AS c FROM e GROUP BY candidate)
SELECT candidate, floor((0.0::DOUBLE + 0.30::DOUBLE * (coalesce(g, 0) / 1000.0::DOUBLE) + 0.20::DOUBLE * (coalesce(l, 0) / 1000.0::DOUBLE) + 0.15::DOUBLE * (coalesce(s, 0) / 1000.0::DOUBLE)
  + 0.10::DOUBLE * (coalesce(p, 0) / 1000.0::DOUBLE) + 0.10::DOUBLE * (coalesce(o, 0) / 1000.0::DOUBLE) + 0.10::DOUBLE * (coalesce(i, 0) / 1000.0::DOUBLE) + 0.05::DOUBLE * (coalesce(c, 0) / 1000.0::DOUBLE)) * 1e4 + 0.5)::BIGINT AS score FROM b""")
def fused_score(spark, sf_dir):
    b = evidence_buckets(spark, sf_dir)
    score = decide.fused_score({n: F.col(n) / 1000 for n in decide.SCORE_WEIGHTS})
    return b.select("candidate", F.floor(score * 1e4 + 0.5).cast("long").alias("score"))


@query(f"""WITH {EVIDENCE}, b AS (SELECT candidate, coalesce(max(score) FILTER (k % 4 = 0), 0) / 1000.0::DOUBLE AS a0, coalesce(max(score) FILTER (k % 4 = 1), 0) / 1000.0::DOUBLE AS a1,
  coalesce(max(score) FILTER (k % 4 = 2), 0) / 1000.0::DOUBLE AS a2, coalesce(max(score) FILTER (k % 4 = 3), 0) / 1000.0::DOUBLE AS a3 FROM e GROUP BY candidate), w AS (
SELECT candidate, CASE WHEN a0 > 0 THEN 0.35 ELSE 0 END + CASE WHEN a1 > 0 THEN 0.25 ELSE 0 END + CASE WHEN a2 > 0 THEN 0.25 ELSE 0 END + CASE WHEN a3 > 0 THEN 0.15 ELSE 0 END AS w,
  CASE WHEN a0 > 0 THEN 0.35 * ln(a0) ELSE 0 END + CASE WHEN a1 > 0 THEN 0.25 * ln(a1) ELSE 0 END + CASE WHEN a2 > 0 THEN 0.25 * ln(a2) ELSE 0 END + CASE WHEN a3 > 0 THEN 0.15 * ln(a3) ELSE 0 END AS s FROM b)
SELECT candidate, floor(CASE WHEN w > 0 THEN exp(s / w) ELSE 0 END * 1e4 + 0.5)::BIGINT AS overall FROM w""")
def confidence_overall(spark, sf_dir):
    e = evidence(spark, sf_dir)
    b = e.groupBy("candidate").agg(*((F.coalesce(F.max(F.when(F.col("k") % 4 == i, F.col("score"))), F.lit(0)) / 1000).alias(n) for i, n in enumerate(decide.AXES)))
    return b.select("candidate", F.floor(decide.overall_confidence({n: F.col(n) for n in decide.AXES}) * 1e4 + 0.5).cast("long").alias("overall"))


@query(f"""WITH {EVIDENCE}, best AS (SELECT candidate, kind, k % 3 AS sig, max(score) / 1000.0::DOUBLE AS s FROM e GROUP BY candidate, kind, k % 3)
SELECT candidate, count(*) AS signatures, floor(greatest(max(s), least(0.999, 1 - product(1 - s))) * 1e5 + 0.5)::BIGINT AS combined FROM best GROUP BY candidate""")
def noisy_or_by_group(spark, sf_dir):
    e = evidence(spark, sf_dir).select("candidate", "kind", (F.col("k") % 3).alias("sig"), (F.col("score") / 1000).alias("s"))
    out = decide.noisy_or(e, ["candidate"], ["kind", "sig"], "s")
    return out.select("candidate", "signatures", F.floor(F.col("combined") * 1e5 + 0.5).cast("long").alias("combined"))


def votes(spark, sf_dir) -> DataFrame:
    """question, member, answer and confidence (whole thousandths) from events."""
    e = evidence(spark, sf_dir)
    answer = F.when(F.col("k") % 5 == 4, "unknown").otherwise(F.concat(F.lit("a"), (F.col("k") % 5).cast("string")))
    return e.select(F.col("candidate").alias("question"), F.col("kind").alias("member"), answer.alias("answer"), F.col("score").alias("confidence"))


VOTES = EVIDENCE + """, v AS (SELECT candidate AS question, kind AS member, CASE WHEN k % 5 = 4 THEN 'unknown' ELSE 'a' || (k % 5) END AS answer, score AS confidence FROM e),
tally AS (SELECT question, answer, sum(confidence) AS weight, max(confidence) AS best, count(*) AS n FROM v GROUP BY question, answer),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY answer = 'unknown', weight DESC, best DESC, answer) AS place FROM tally),
verdict AS (SELECT question, sum(weight) AS total, sum(n) AS votes, count(*) FILTER (answer <> 'unknown') AS answers,
  max(answer) FILTER (place = 1 AND answer <> 'unknown') AS answer, max(weight) FILTER (place = 1) AS w, max(n) FILTER (place = 1) AS wn FROM ranked GROUP BY question),
final AS (SELECT question, votes, answers, CASE WHEN total > 0 THEN answer END AS answer,
  CASE WHEN answer IS NULL OR total = 0 THEN 0 ELSE w / total::DOUBLE END AS consensus,
  CASE WHEN answer IS NULL OR total = 0 THEN 0 ELSE w / wn::DOUBLE * (w / total::DOUBLE) END AS confidence,
  CASE WHEN answer IS NULL OR total = 0 THEN 0 ELSE votes - wn END AS dissent FROM verdict)"""


@query(f"WITH {VOTES} SELECT question, votes::BIGINT AS votes, answers, answer, floor(consensus * 1e6 + 0.5)::BIGINT AS consensus, floor(confidence * 1e3 + 0.5)::BIGINT AS confidence, dissent::BIGINT AS dissent FROM final")
def vote_consensus(spark, sf_dir):
    out = decide.tally(votes(spark, sf_dir))
    return out.select("question", "votes", "answers", "answer", millionths(F.col("consensus")).alias("consensus"), F.floor(F.col("confidence") * 1e3 + 0.5).cast("long").alias("confidence"), F.col("dissent").cast("long").alias("dissent"))


@query(f"WITH {VOTES} SELECT question, member, count(DISTINCT answer) AS answers FROM v GROUP BY question, member HAVING count(DISTINCT answer) > 1")
def vote_contradictions(spark, sf_dir):
    return decide.contradictions(votes(spark, sf_dir))


@query(f"WITH {VOTES} SELECT question, count(*) AS votes FROM v WHERE question IN (SELECT question FROM final WHERE confidence < 200) GROUP BY question")
def vote_round_two(spark, sf_dir):
    return decide.second_round(votes(spark, sf_dir), 200).groupBy("question").agg(F.count("*").alias("votes"))


# repeats, filling ------------------------------------------------------------------------


def form_fields(spark, sf_dir) -> DataFrame:
    """Fields from orders: some have a key, the others a label only."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("page"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("person."), F.lower(F.substring("o_orderpriority", 1, 1)))).alias("canonical_key"),
                    F.concat(F.lower("o_orderstatus"), (F.col("o_custkey") % 300).cast("string")).alias("label"), "o_custkey", F.floor("o_totalprice").cast("long").alias("price"), "o_orderpriority")


FIELDS = """f AS (SELECT o_orderkey AS id, o_custkey % 40 AS page, CASE WHEN o_orderstatus = 'F' THEN 'person.' || lower(substr(o_orderpriority, 1, 1)) END AS canonical_key,
  lower(o_orderstatus) || (o_custkey % 300) AS label, o_custkey, floor(o_totalprice)::BIGINT AS price, o_orderpriority FROM orders)"""


@query(f"""WITH {FIELDS} SELECT CASE WHEN canonical_key IS NOT NULL THEN 'key' ELSE 'label' END AS kind, coalesce(canonical_key, label) AS name, count(*) AS members,
  count(DISTINCT page) AS pages, min(id) AS first_id FROM f GROUP BY 1, 2 HAVING count(*) >= 2""")
def repeat_groups(spark, sf_dir):
    return decide.repeat_groups(form_fields(spark, sf_dir))


@query(f"""WITH {FIELDS} SELECT label, list_sort(list(DISTINCT o_orderpriority)) AS found FROM f GROUP BY label HAVING count(DISTINCT o_orderpriority) >= 2""")
def repeat_consistency(spark, sf_dir):
    return decide.inconsistent(form_fields(spark, sf_dir), "label", "o_orderpriority")


@query(f"""WITH {FIELDS}, fill AS (SELECT id AS field, label, CASE WHEN price % 5 = 0 THEN NULL ELSE o_orderpriority END AS value, price % 1000 AS confidence, CASE WHEN price % 3 = 0 THEN 'filled' ELSE 'low_confidence' END AS status FROM f),
win AS (SELECT label, value AS winner_value, max(confidence) OVER (PARTITION BY label) AS group_confidence FROM fill WHERE value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY status <> 'filled', confidence DESC, field) = 1)
SELECT field, label, winner_value, group_confidence FROM fill LEFT JOIN win USING (label)""")
def repeat_propagate(spark, sf_dir):
    f = form_fields(spark, sf_dir)
    fills = f.select(F.col("id").alias("field"), "label", F.when(F.col("price") % 5 != 0, F.col("o_orderpriority")).alias("value"), (F.col("price") % 1000).alias("confidence"), F.when(F.col("price") % 3 == 0, "filled").otherwise("low_confidence").alias("status"))
    return decide.propagate(fills, "label").select("field", "label", "winner_value", "group_confidence")


@query(f"""WITH {FIELDS}, g AS (SELECT label, count(*) AS n FROM f GROUP BY label HAVING count(*) >= 2) SELECT label, n, round(100 * least(0.95, 0.6 + 0.1 * (n - 2)))::BIGINT AS score FROM g""")
def repeat_score(spark, sf_dir):
    g = form_fields(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")).where("n >= 2")
    return g.select("label", "n", F.round(100 * decide.repeat_score(F.col("n"))).cast("long").alias("score"))


def vault(spark, sf_dir) -> DataFrame:
    """One entry per customer, with a confidence in hundredths from the balance."""
    c = table(spark, sf_dir, "customer")
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.floor("c_acctbal") + 1000) / 11000))
    return c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"), conf.alias("confidence"), F.col("c_mktsegment").alias("segment"))


VAULT = "vault AS (SELECT c_custkey AS key, c_name AS value, least(1.0, greatest(0.0, (floor(c_acctbal) + 1000) / 11000)) AS confidence, c_mktsegment AS segment FROM customer)"
STATUS = f"""WITH {FIELDS}, {VAULT}, s AS (SELECT id AS field, CASE WHEN o_orderpriority LIKE '1%' THEN 'signature' ELSE 'text' END AS field_type,
  CASE WHEN price % 7 = 0 THEN NULL ELSE o_custkey END AS canonical_key FROM f), r AS (
SELECT field, CASE WHEN field_type = 'signature' THEN 'policy_blocked' WHEN v.key IS NULL THEN 'unavailable' WHEN v.segment = 'MACHINERY' THEN 'policy_blocked'
  WHEN v.value IS NULL OR trim(v.value) = '' THEN 'invalid' WHEN v.confidence < 0.9 THEN 'low_confidence' ELSE 'filled' END AS status, v.value AS raw FROM s LEFT JOIN vault v ON v.key = s.canonical_key)"""


def _filled(spark, sf_dir) -> DataFrame:
    f = form_fields(spark, sf_dir)
    fields = f.select(F.col("id").alias("field"), F.when(F.col("o_orderpriority").startswith("1"), "signature").otherwise("text").alias("field_type"), F.when(F.col("price") % 7 != 0, F.col("o_custkey")).alias("canonical_key"))
    return decide.autofill(fields, vault(spark, sf_dir), valid=V.check_nonempty(F.col("value"))["ok"], blocked=F.coalesce(F.col("segment") == "MACHINERY", F.lit(False)))


@query(STATUS + " SELECT field, status, CASE WHEN status = 'filled' THEN raw END AS value FROM r")
def autofill_status(spark, sf_dir):
    return _filled(spark, sf_dir).select("field", "status", "value")


@query(STATUS + " SELECT status, count(*) AS n FROM r GROUP BY status")
def autofill_summary(spark, sf_dir):
    return _filled(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {VAULT}, a AS (SELECT key, value, confidence FROM vault WHERE key % 3 <> 0), b AS (SELECT key, value || '*' AS value, 1 - confidence AS confidence FROM vault WHERE key % 2 = 0)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL OR coalesce(b.confidence > a.confidence, false) THEN b.value ELSE a.value END AS value,
  CASE WHEN a.key IS NULL OR coalesce(b.confidence > a.confidence, false) THEN 'other' ELSE 'self' END AS origin FROM a FULL JOIN b ON a.key = b.key""")
def vault_merge_prefer(spark, sf_dir):
    v = vault(spark, sf_dir)
    a = v.where("key % 3 <> 0").select("key", "value", "confidence")
    b = v.where("key % 2 = 0").select("key", F.concat("value", F.lit("*")).alias("value"), (1 - F.col("confidence")).alias("confidence"))
    return decide.merge_vaults(a, b).select("key", "value", "origin")


@query(f"""WITH {VAULT} SELECT o.o_orderkey AS field, coalesce(s.value, e.value) AS value, CASE WHEN s.key IS NOT NULL THEN 'scoped' WHEN e.key IS NOT NULL THEN 'exact' END AS step
FROM orders o LEFT JOIN vault s ON s.key = o.o_custkey + 7 AND s.segment = 'BUILDING' LEFT JOIN vault e ON e.key = o.o_custkey AND e.segment <> 'MACHINERY'""")
def vault_resolve_scoped(spark, sf_dir):
    o, v = table(spark, sf_dir, "orders"), vault(spark, sf_dir)
    s = v.where("segment = 'BUILDING'").select(F.col("key").alias("sk"), F.col("value").alias("sv"))
    e = v.where("segment <> 'MACHINERY'").select(F.col("key").alias("ek"), F.col("value").alias("ev"))
    out = o.join(s, F.col("sk") == F.col("o_custkey") + 7, "left").join(e, F.col("ek") == F.col("o_custkey"), "left")
    return out.select(F.col("o_orderkey").alias("field"), F.coalesce("sv", "ev").alias("value"), F.when(F.col("sk").isNotNull(), "scoped").when(F.col("ek").isNotNull(), "exact").alias("step"))


@query(f"WITH {VAULT} SELECT key, CASE WHEN segment = 'MACHINERY' THEN '[redacted]' ELSE value END AS value, segment FROM vault")
def vault_redact(spark, sf_dir):
    return vault(spark, sf_dir).select("key", F.when(F.col("segment") == "MACHINERY", "[redacted]").otherwise(F.col("value")).alias("value"), "segment")


@query(f"WITH {VAULT} SELECT segment, count(*) AS entries, count(*) FILTER (confidence >= 0.9) AS sure FROM vault GROUP BY segment")
def vault_stats(spark, sf_dir):
    return vault(spark, sf_dir).groupBy("segment").agg(F.count("*").alias("entries"), F.count_if(F.col("confidence") >= 0.9).alias("sure"))
