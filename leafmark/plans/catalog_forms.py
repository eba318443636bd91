"""The catalogue's queries on forms: written from customers, scanned, detected, and read back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.functions import rects as R
from leafmark.operators import cluster, labels, spatial
from leafmark.plans.catalog import query
from leafmark.sources import pdf
from leafmark.storage import dealt, materialize, table


def form_files(spark, sf_dir) -> DataFrame:
    """A form for each customer as (path, content): three live fields and one drawn blank."""
    rows = dealt(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), "c_name", "c_mktsegment"), "path")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [pdf.write_form([("Full name:", "underline", n), ("Segment:", "boxed", s), ("I agree", "checkbox", "Yes"), ("Notes:", "boxed", None)]) for n, s in zip(b["c_name"], b["c_mktsegment"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "content": made})

    return rows.mapInPandas(write, "path string, content binary")


@query("SELECT c_custkey::VARCHAR AS path, kind, n FROM customer, (VALUES ('span', 4), ('line', 1), ('rect', 3), ('widget', 3)) AS v(kind, n)")
def pdf_synth_scan(spark, sf_dir):
    return pdf.evidence(form_files(spark, sf_dir)).groupBy("path", "kind").agg(F.count("*").alias("n"))


@query("SELECT c_custkey::VARCHAR AS path, text, y FROM customer, (VALUES ('Full name:', 720), ('Segment:', 684), ('I agree', 648), ('Notes:', 612)) AS v(text, y)")
def pdf_spans(spark, sf_dir):
    found = pdf.evidence(form_files(spark, sf_dir)).where("kind = 'span'")
    return found.select("path", "text", F.round(F.col("y0") + 2).cast("long").alias("y"))


@query("SELECT c_custkey::VARCHAR AS path, type, n FROM customer, (VALUES ('text', 3), ('checkbox', 1)) AS v(type, n)")
def detect_fields(spark, sf_dir):
    return pdf.detect_fields(pdf.evidence(form_files(spark, sf_dir))).groupBy("path", "type").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey::VARCHAR AS path, name, value, true AS same FROM (SELECT c_custkey, 'Full name:' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'Segment:', c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'I agree', 'Yes' FROM customer)""")
def pdf_roundtrip(spark, sf_dir):
    """Fields as written against fields as read back; a field on one side only is not the same."""
    c = table(spark, sf_dir, "customer")
    want = c.select(F.col("c_custkey").cast("string").alias("path"), F.explode(F.create_map(F.lit("Full name:"), F.col("c_name"), F.lit("Segment:"), F.col("c_mktsegment"), F.lit("I agree"), F.lit("Yes"))).alias("name", "value"))
    got = pdf.evidence(form_files(spark, sf_dir)).where("kind = 'widget'").select("path", F.split("text", "=", 2)[0].alias("name"), F.split("text", "=", 2)[1].alias("read"))
    both = want.join(got, ["path", "name"], "full_outer")
    return both.select("path", "name", "value", F.col("value").eqNullSafe(F.col("read")).alias("same"))


@query("SELECT c_custkey::VARCHAR AS path, field_y, label FROM customer, (VALUES (717, 'Full name:'), (681, 'Segment:'), (609, 'Notes:'), (646, 'I agree')) AS v(field_y, label)")
def link_form_labels(spark, sf_dir):
    """Each detected field with the text to its left that is nearest."""
    found = materialize(pdf.evidence(form_files(spark, sf_dir)), "evidence")
    page = F.concat_ws("/", "path", "page")
    fields = pdf.detect_fields(found).select(page.alias("page"), F.concat(F.lit("f"), F.col("r.y0").cast("long").cast("string")).alias("id"), F.expr("struct(double(r.x0) as x0, double(r.y0) as y0, double(r.x1) as x1, double(r.y1) as y1)").alias("r"))
    spans = found.where("kind = 'span'").select(page.alias("page"), F.col("text").alias("id"), R.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("r"))
    near = spatial.nearest(fields, spans, "left", 160.0)
    return near.select(F.split("page", "/")[0].alias("path"), F.substring("field_id", 2, 9).cast("long").alias("field_y"), F.col("label_id").alias("label"))


@query("SELECT c_custkey::VARCHAR AS path, label, key AS canonical_key FROM customer, (VALUES ('Full name:', 'person.name.full'), ('Segment:', NULL), ('I agree', NULL), ('Notes:', NULL)) AS v(label, key)")
def canonical_keys(spark, sf_dir):
    spans = pdf.evidence(form_files(spark, sf_dir)).where("kind = 'span'").select("path", F.col("text").alias("label"))
    return labels.lookup(spans, "label")


@query("SELECT c_custkey::VARCHAR AS path, 3::BIGINT AS tp, 0::BIGINT AS missed FROM customer")
def detection_recall(spark, sf_dir):
    """Live fields that a detected candidate covers at IoU 0.5 or more, matched one to one."""
    found = materialize(pdf.evidence(form_files(spark, sf_dir)), "evidence")
    box = R.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    truth = found.where("kind = 'widget'").select(F.col("path").alias("page"), F.col("text").alias("id"), box.alias("r"))
    pred = pdf.detect_fields(found).select(F.col("path").alias("page"), F.concat_ws("-", "type", F.col("r.y0").cast("string")).alias("id"), F.expr("struct(double(r.x0) as x0, double(r.y0) as y0, double(r.x1) as x1, double(r.y1) as y1)").alias("r"))
    hits = cluster.greedy_match(pred, truth, 0.5).groupBy("page").agg(F.count("*").alias("tp"))
    return truth.groupBy("page").agg(F.count("*").alias("n")).join(hits, "page", "left").select(F.col("page").alias("path"), F.coalesce("tp", F.lit(0)).alias("tp"), (F.col("n") - F.coalesce("tp", F.lit(0))).alias("missed"))
