"""Word tables from OCR engines in, field values out: TSV, JSON, CSV, XML and FDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an engine's TSV, all read as text (fixed values).
TSV = "level string, page_num string, block_num string, par_num string, line_num string, word_num string, left string, top string, width string, height string, conf string, text string"


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(TSV).csv(path)


def words(tsv: DataFrame, page_height: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Words of a TSV table: page, line, text, r and confidence in 0 to 1; y upwards from the page's height.

    Rows above word level, blank words, and numbers that do not parse are dropped.
    """
    n = lambda c: F.col(c).try_cast("double")
    out = tsv.where((F.col("level") == "5") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    out = out.select(
        n("page_num").cast("int").alias("page"), F.concat_ws("-", "block_num", "par_num", "line_num").alias("line"), n("word_num").cast("int").alias("word"), F.col("text"),
        F.struct((n("left") / scale).alias("x0"), (page_height - (n("top") + n("height")) / scale).alias("y0"), ((n("left") + n("width")) / scale).alias("x1"), (page_height - n("top") / scale).alias("y1")).alias("r"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), n("conf") / 100)).alias("confidence"),
    )
    return out.where(F.col("page").isNotNull() & F.col("r.x0").isNotNull() & F.col("r.y0").isNotNull())


def line_spans(found: DataFrame) -> DataFrame:
    """A span for each line of words: joined text, hull, least confidence and median height."""
    ordered = F.array_sort(F.collect_list(F.struct("word", "text")))
    return found.groupBy("page", "line").agg(
        F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"),
        F.min("r.x0").alias("x0"), F.min("r.y0").alias("y0"), F.max("r.x1").alias("x1"), F.max("r.y1").alias("y1"),
        F.min("confidence").alias("confidence"), F.percentile(F.col("r.y1") - F.col("r.y0"), 0.5).alias("size"),
    )


def confidence_report(found: DataFrame) -> DataFrame:
    """Per page the number of words and the least, mean, median and largest confidence, and ten equal buckets of it."""
    bucket = F.least(F.floor(F.col("confidence") * 10), F.lit(9))
    counts = [F.count_if(bucket == i).alias(f"b{i}") for i in range(10)]
    return found.groupBy("page").agg(F.count("*").alias("words"), F.min("confidence").alias("least"), F.avg("confidence").alias("mean"), F.percentile("confidence", 0.5).alias("median"), F.max("confidence").alias("most"), *counts)


# values out --------------------------------------------------------------------------


def write_json(values: DataFrame, path: str) -> None:
    values.write.json(path)


def write_csv(values: DataFrame, path: str) -> None:
    values.write.option("header", True).option("escape", '"').csv(path)


def write_xml(values: DataFrame, path: str, row: str = "field", root: str = "fields") -> None:
    values.write.format("xml").option("rowTag", row).option("rootTag", root).save(path)


def pdf_text(c: Column) -> Column:
    """A string as a PDF literal: brackets and backslashes escaped."""
    return F.concat(F.lit("("), F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\()])", r"\\$1"), F.lit(")"))


def fdf(values: DataFrame, key: str = "path") -> DataFrame:
    """An FDF document per key from (key, name, value): fields in order of name; a null value is left out."""
    field = F.concat(F.lit("<< /T "), pdf_text(F.col("name")), F.lit(" /V "), pdf_text(F.col("value")), F.lit(" >>"))
    listed = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("name", field.alias("f")))))
    body = values.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["f"]), "\n").alias("body"))
    return body.select(key, F.concat(F.lit("%FDF-1.2\n1 0 obj\n<< /FDF << /Fields [\n"), "body", F.lit("\n] >> >>\nendobj\ntrailer\n<< /Root 1 0 R >>\n%%EOF\n")).alias("fdf"))
