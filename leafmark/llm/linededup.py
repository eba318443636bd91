"""Op 5: removal of runs of lines that an earlier document, or the same one earlier, already has.

DataFrame operations only. Line hashes are winnowed: of each WINDOW lines in a row the
one with the smallest hash is a fingerprint, so any run of that many equal lines shares
one at the same place. A line of LONG words or more is one by itself. Fingerprints that
stand once are dropped; the positions of the others are extended by a line to each side
and joined to the first place of the extended run, and the lines of every later one go.
A longer run is extended from fingerprint to fingerprint.

So a line goes exactly if it lies in a run of two lines or more that also starts earlier,
or is long and stands earlier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.storage import materialize, table

WINDOW = 2
#: Words from which a line alone is a run.
LONG = 25
NO_ID = -(1 << 63)
_BLANK = r"^[ \t\n\x0B\f\r]*$"
_LONG = r"^[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){%d}[^\x20\x09-\x0D]" % (LONG - 1)


def _named(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f reads it."""
    return F.transform(F.array(value), f)[0]


def _keyed(docs: DataFrame) -> DataFrame:
    """Each document's key (d, t): its doc_id, null as the least, and a hash of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({"d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "t": F.xxhash64(text)})


def lines(docs: DataFrame) -> DataFrame:
    """(d, t, at, h, w): places and hashes of the lines that are not blank, and whether they are long."""
    numbered = F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    told = F.transform(F.filter(numbered, lambda r: ~r["x"].rlike(_BLANK)), lambda r: F.struct(r["i"].alias("i"), F.xxhash64(r["x"]).alias("h"), r["x"].rlike(_LONG).alias("w")))
    return _keyed(docs.select("doc_id", "text")).select("d", "t", told.alias("r")).select("d", "t", F.col("r.i").alias("at"), F.col("r.h").alias("h"), F.col("r.w").alias("w"))


def fingerprints(found: DataFrame) -> DataFrame:
    """(d, t, g, key, a, b): each fingerprint g, extended by the line before and by the line after it, as a run
    (key) with the places of its first and last line; and the lines that are long, each by itself.

    A fingerprint is the smallest hash of a window, the last of equals.
    """
    back = F.transform("h", lambda h, i: F.struct(h.alias("g"), (-i).alias("back")))
    least = _let(back, lambda hs: F.when(F.size(hs) >= WINDOW, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(hs) - (WINDOW - 1)), lambda i: -F.array_min(F.slice(hs, i, WINDOW))["back"]))).otherwise(F.array().cast("array<int>")))

    def run(p: Column, start: Column, end: Column) -> Column:
        key = F.when(start == end, F.xxhash64(F.lit(1), F.get("h", start))).otherwise(F.xxhash64(F.get("h", start), F.get("h", end)))
        made = F.struct(F.get("h", p).alias("g"), key.alias("key"), F.get("at", start).alias("a"), F.get("at", end).alias("b"))
        return F.when((start >= 0) & (end < F.size("h")), made)

    long = F.filter(F.transform("w", lambda w, i: F.when(w, i)), lambda p: p.isNotNull())
    runs = F.concat(F.transform(least, lambda p: run(p, p - 1, p)), F.transform(least, lambda p: run(p, p, p + 1)), F.transform(long, lambda p: run(p, p, p)))
    return found.select("d", "t", F.explode(runs).alias("m")).where("m IS NOT NULL").select("d", "t", "m.*")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(d, t, gone): places of the lines to delete, for documents that have any."""
    marks = materialize(fingerprints(materialize(lines(docs), "lines")), "fingerprints")
    several = marks.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    runs = materialize(marks.join(several, "g", "left_semi").select("key", "d", "t", "a", "b"), "runs")
    place = F.struct("d", "t", "a")
    first = runs.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    later = runs.join(first, "key").where(place > F.col("first"))
    return later.groupBy("d", "t").agg(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b")))).alias("gone"))


def _rest() -> Column:
    """The text without the lines in gone."""
    kept = _let(F.split("text", "\n", -1), lambda xs: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(xs) - 1), F.col("gone")), lambda i: F.get(xs, i)), "\n"))
    return F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)


def dedupe(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text) as doc_id, n_lines, n_removed, text.

    Documents are ordered by doc_id (null first), rows of one doc_id by a hash of
    their texts; rows equal in both are one document and come out alike. A line is
    deleted if it lies in a run of two lines or more that starts earlier too, in this
    document or one before, or has LONG words and stands earlier; all is judged on the
    input. Blank lines neither match nor go. A null text has no line and stays
    null. An empty table gives no row. Other columns are ignored.
    """
    gone = repeated_lines(docs)
    left = _keyed(docs.select("doc_id", "text")).join(gone, ["d", "t"], "left")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return left.select("doc_id", n_lines.alias("n_lines"), removed.alias("n_removed"), _rest().alias("text"))


def stage(docs: DataFrame) -> DataFrame:
    """docs with the same columns, without repeated lines; a document that they leave without a word goes.

    n_chars, where there is one, follows the text.
    """
    gone = repeated_lines(docs)
    rows = _keyed(docs.select("doc_id", "text", F.struct(*(_named(c).alias(c) for c in docs.columns)).alias("row")))
    left = rows.join(gone, ["d", "t"], "left").withColumn("kept", _rest())
    left = left.where(F.col("gone").isNull() | ~F.col("kept").rlike(_BLANK))
    kinds = dict(docs.dtypes)
    own = {"text": F.col("kept"), "n_chars": F.when(F.col("gone").isNull(), F.col("row")["n_chars"] if "n_chars" in kinds else None).otherwise(F.length("kept"))}
    return left.select(*(own[c].cast(kinds[c]).alias(c) if c in own else F.col("row").getField(c).alias(c) for c in docs.columns))


#: The same rows in DuckDB's SQL, straight from the definition, for tables whose doc_id is unique.
SQL = r"""
WITH raw AS (
  SELECT doc_id AS d, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i
  FROM documents),
told AS (
  SELECT d, i, row_number() OVER (PARTITION BY d ORDER BY i) AS pos, md5(x) AS h,
         regexp_matches(x, '^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+[\x20\x09-\x0D]+){24}[^\x20\x09-\x0D]') AS long
  FROM raw WHERE NOT regexp_full_match(x, '[\x20\x09-\x0D]*')),
runs AS (
  SELECT d, pos, 1 AS n, h AS k FROM told WHERE long
  UNION ALL SELECT d, pos, 2, h || h2
  FROM (SELECT d, pos, h, lead(h) OVER (PARTITION BY d ORDER BY pos) AS h2 FROM told) WHERE h2 IS NOT NULL),
later AS (
  SELECT d, pos, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, pos) AS place FROM runs) WHERE place > 1),
gone AS (
  SELECT DISTINCT a.d, a.i FROM told a JOIN (SELECT d, pos + unnest(range(n)) AS pos FROM later) b ON a.d = b.d AND a.pos = b.pos)
SELECT c.doc_id, CASE WHEN c.text IS NULL THEN 0 ELSE r.n_lines END AS n_lines, r.n_removed,
       CASE WHEN r.n_removed = 0 THEN c.text ELSE r.kept END AS text
FROM documents c JOIN (
  SELECT d, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(x, chr(10) ORDER BY raw.i) FILTER (g.i IS NULL), '') AS kept
  FROM raw LEFT JOIN gone g USING (d, i) GROUP BY d) r ON r.d = c.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents without their repeated lines."""
    return dedupe(table(spark, sf_dir, "documents"))
