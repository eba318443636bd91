"""OCR tables in, values out, and text fitted into rectangles."""

import pytest
from pyspark.sql import functions as F

from leafmark.functions import layout
from leafmark.sources import exchange


def test_tsv_words_and_lines(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "a.tsv").write_text(head + '1\t1\t0\t0\t0\t0\t0\t0\t100\t100\t-1\t\n5\t1\t1\t1\t1\t2\t40\t10\t20\t10\t91\tna"me\n5\t1\t1\t1\t1\t1\t10\t10\t20\t12\t55.5\tFull\n5\t1\t1\t1\t1\t3\tx\t10\t20\t10\t90\tbad\n5\t1\t1\t1\t1\t4\t80\t10\t5\t10\t90\t \n')
    w = exchange.words(exchange.read_tsv(spark, f"{tmp_path}/a.tsv"), 100.0)
    line = exchange.line_spans(w).first()
    assert (line["text"], line["x0"], line["y0"], line["x1"], line["y1"], line["confidence"], line["size"]) == ('Full na"me', 10, 78, 60, 90, 0.555, 11)
    report = exchange.confidence_report(w).first()
    assert (report["words"], report["b5"], report["b9"]) == (2, 1, 1)


def test_values_out(spark, tmp_path):
    v = spark.createDataFrame([("p", "b", "x (1)"), ("p", "a", 'say "hi"'), ("p", "c", None)], "path string, name string, value string")
    exchange.write_json(v, f"{tmp_path}/j")
    exchange.write_csv(v, f"{tmp_path}/c")
    exchange.write_xml(v, f"{tmp_path}/x")
    rows = sorted(map(tuple, v.collect()), key=str)
    assert sorted(map(tuple, spark.read.schema(v.schema).json(f"{tmp_path}/j").collect()), key=str) == rows
    assert sorted(map(tuple, spark.read.schema(v.schema).option("header", True).option("escape", '"').csv(f"{tmp_path}/c").collect()), key=str) == rows
    assert sorted(map(tuple, spark.read.schema(v.schema).format("xml").option("rowTag", "field").load(f"{tmp_path}/x").collect()), key=str) == rows
    text = exchange.fdf(v).first()["fdf"]
    assert text.index("/T (a)") < text.index("/T (b) /V (x \\(1\\))") and "/T (c)" not in text


def test_layout(spark):
    r = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(100.0).alias("x1"), F.lit(14.0).alias("y1"))
    row = spark.range(1).select(layout.fit_size(F.lit("x" * 20), r, "Courier").alias("s"), layout.max_chars(F.lit(60.0), F.lit(10.0), "Courier").alias("n"), layout.comb_cells(F.lit("abc"), r, 2).alias("c"), layout.field_flags(required=F.lit(True), comb=F.lit(True), multiline=F.lit(False)).alias("f")).first()
    assert row["s"] == 8.0 and row["n"] == 10 and [(c["char"], c["x"]) for c in row["c"]] == [("a", 25.0), ("b", 75.0)] and row["f"] == (1 << 24) + 2
    assert layout.wrap("one two threefour", 7) == ["one two", "threefo", "ur"] and layout.wrap(None, 5) == [""]


@pytest.mark.parametrize("most", [1, 3, 8])
def test_wrap_loses_nothing(most):
    text = "a bb ccc dddd eeeee"
    assert "".join(layout.wrap(text, most)).replace(" ", "") == text.replace(" ", "") and max(map(len, layout.wrap(text, most))) <= most
