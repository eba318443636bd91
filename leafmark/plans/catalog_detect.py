"""The catalogue's queries on detectors: a page of each kind for every customer, written, read and detected.

Where things stand on a page follows from the customer's key, so SQL computes the same truth.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.operators import detectors
from leafmark.plans.catalog import query
from leafmark.sources import pdf
from leafmark.storage import dealt, table

LABELS = ("Given name", "Town", "Employer", "Job title", "Policy", "Reference")


def rows_of(k: int) -> list[tuple[int, str, float]]:
    """Number, label and height of each row of a customer's page: three to six."""
    return [(i, LABELS[i], 700.0 - 36 * i) for i in range(3 + k % 4)]


def underline(k: int) -> list[tuple]:
    return [x for _, label, y in rows_of(k) for x in (("text", 72, y, 10, f"{label}:"), ("line", 150 + k % 40, y - 3, 420, y - 3))]


def boxed(k: int) -> list[tuple]:
    return [x for i, label, y in rows_of(k) for x in (("text", 72, y, 10, f"{label}:"), ("rect", 150 + k % 40, y - 4, 200, 18 if i else 30))]


def checkbox(k: int) -> list[tuple]:
    return [x for i, label, y in rows_of(k) for x in (("rect", 72 + k % 40, y, 8 + i, 8 + i), ("text", 100 + k % 40, y + 1, 10, label))]


def radio(k: int) -> list[tuple]:
    return [("text", 72, 700, 10, "Choose one:"), *(x for i, label, _ in rows_of(k) for x in (("circle", 150 + 80 * i + k % 9, 704, 5), ("text", 160 + 80 * i + k % 9, 700, 10, label)))]


def comb(k: int) -> list[tuple]:
    return [x for i, label, y in rows_of(k) for x in (("text", 72, y, 10, f"{label}:"), *(("rect", 150 + k % 40 + 14 * j, y - 4, 14, 16) for j in range(3 + i + k % 3)))]


def date_box(k: int) -> list[tuple]:
    sizes, mark, x, out = ((2, 2, 4), (4, 2, 2), (2, 2, 2))[k % 3], "/-"[k % 2], 150 + k % 40, [("text", 72, 700, 10, "Started:")]
    for g, n in enumerate(sizes):
        out += [("rect", x + 14 * j, 696, 14, 16) for j in range(n)]
        x += 14 * n
        if g < 2:
            out.append(("text", x + 3, 700, 10, mark))
            x += 12
    return out


def signature(k: int) -> list[tuple]:
    return [("line", 72, 500, 260 + k % 60, 500), ("text", 72, 486, 10, "Signature of applicant"), ("line", 380, 500, 500, 500), ("text", 380, 486, 10, "Date")]


def grid(k: int) -> list[tuple]:
    cells = [("rect", 72 + 120 * c, 700 - 20 * r, 120, 20) for r in range(3 + k % 4) for c in range(3)]
    return [*cells, *(("text", 76 + 120 * c, 706, 10, LABELS[c]) for c in range(3))]


def colon(k: int) -> list[tuple]:
    return [x for i, label, y in rows_of(k) for x in ((("text", 72, y, 10, f"{label}:"),) if i % 2 else (("text", 72, y, 10, f"{label} {'.' * (8 + k % 20)}"),))]


def free(k: int) -> list[tuple]:
    return [("text", 72, 700, 10, "Remarks"), ("text", 72, 600 - k % 50, 10, "Thank you for your time")]


def detected(spark, sf_dir, draw: Callable[[int], list[tuple]]) -> DataFrame:
    """Candidates of a drawn page for each customer, boxes in whole hundredths."""
    keys = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["c_custkey"].astype(str), "content": [pdf.write_drawing(draw(int(k))) for k in b["c_custkey"]]})

    found = detectors.detect_files(keys.mapInPandas(write, "path string, content binary"))
    edges = (F.round(F.col(e) * 100).cast("long").alias(e) for e in ("x0", "y0", "x1", "y1"))
    return found.select(F.col("path").cast("long").alias("k"), "detector", "field_type", "label", *edges, *(F.col(c) for c in ("group_id", "cells", "hint")))


_ROWS = "r AS (SELECT c_custkey AS k, i, ['" + "', '".join(LABELS) + "'][i + 1] AS label, 700 - 36 * i AS y, 150 + c_custkey % 40 AS x FROM customer, range(6) AS t(i) WHERE i < 3 + c_custkey % 4)"


@query(f"WITH {_ROWS} SELECT k, 'underline' AS detector, 'text' AS field_type, label, x * 100 AS x0, (y - 3) * 100 AS y0, 42000::BIGINT AS x1, (y + 9) * 100 AS y1 FROM r")
def detect_underlines(spark, sf_dir):
    return detected(spark, sf_dir, underline).drop("group_id", "cells", "hint")


@query(f"WITH {_ROWS} SELECT k, 'box' AS detector, CASE WHEN i = 0 THEN 'multiline_text' ELSE 'text' END AS field_type, label, x * 100 AS x0, (y - 4) * 100 AS y0, (x + 200) * 100 AS x1, (y - 4 + CASE WHEN i = 0 THEN 30 ELSE 18 END) * 100 AS y1 FROM r")
def detect_boxes(spark, sf_dir):
    return detected(spark, sf_dir, boxed).drop("group_id", "cells", "hint")


@query(f"WITH {_ROWS} SELECT k, 'checkbox' AS detector, 'checkbox' AS field_type, label, (x - 78) * 100 AS x0, y * 100 AS y0, (x - 70 + i) * 100 AS x1, (y + 8 + i) * 100 AS y1 FROM r")
def detect_checkboxes(spark, sf_dir):
    return detected(spark, sf_dir, checkbox).drop("group_id", "cells", "hint")


@query(f"WITH {_ROWS} SELECT k, 'radio_group' AS detector, 'radio' AS field_type, label, (145 + 80 * i + k % 9) * 100 AS x0, 69900::BIGINT AS y0, (155 + 80 * i + k % 9) * 100 AS x1, 70900::BIGINT AS y1, 'Choose one@699' AS group_id FROM r")
def detect_radios(spark, sf_dir):
    return detected(spark, sf_dir, radio).drop("cells", "hint")


@query(f"WITH {_ROWS} SELECT k, 'comb' AS detector, 'comb' AS field_type, label, x * 100 AS x0, (y - 4) * 100 AS y0, (x + 14 * (3 + i + k % 3)) * 100 AS x1, (y + 12) * 100 AS y1, 3 + i + k % 3 AS cells FROM r")
def detect_combs(spark, sf_dir):
    return detected(spark, sf_dir, comb).drop("group_id", "hint")


@query("""SELECT c_custkey AS k, 'date_box' AS detector, 'date' AS field_type, 'Started' AS label, (150 + c_custkey % 40) * 100 AS x0, 69600::BIGINT AS y0, (174 + c_custkey % 40 + 14 * cells) * 100 AS x1, 71200::BIGINT AS y1, cells::BIGINT AS cells,
  replace(hint, '/', CASE WHEN c_custkey % 2 = 1 THEN '-' ELSE '/' END) AS hint FROM customer JOIN (VALUES (0, 8, 'MM/DD/YYYY'), (1, 8, 'YYYY/MM/DD'), (2, 6, 'MM/DD/YY')) AS v(m, cells, hint) ON c_custkey % 3 = m""")
def detect_dates(spark, sf_dir):
    return detected(spark, sf_dir, date_box).drop("group_id")


@query("""SELECT c_custkey AS k, 'signature_line' AS detector, 'signature' AS field_type, 'Signature of applicant' AS label, 7200::BIGINT AS x0, 50000::BIGINT AS y0, (260 + c_custkey % 60) * 100 AS x1, 51800::BIGINT AS y1 FROM customer
UNION ALL SELECT c_custkey, 'underline', 'date', 'Date', 38000, 50000, 50000, 51200 FROM customer""")
def detect_signatures(spark, sf_dir):
    return detected(spark, sf_dir, signature).drop("group_id", "cells", "hint")


@query(f"""SELECT c_custkey AS k, 'table_cell' AS detector, 'text' AS field_type, ['{"', '".join(LABELS)}'][c + 1] AS label, (72 + 120 * c) * 100 AS x0, (700 - 20 * r) * 100 AS y0, (192 + 120 * c) * 100 AS x1, (720 - 20 * r) * 100 AS y1
FROM customer, range(1, 6) AS t(r), range(3) AS u(c) WHERE r < 3 + c_custkey % 4""")
def detect_tables(spark, sf_dir):
    return detected(spark, sf_dir, grid).drop("group_id", "cells", "hint")


@query(f"""WITH {_ROWS} SELECT k, 'colon_run' AS detector, 'text' AS field_type, label, CASE WHEN i % 2 = 1 THEN 7200 + 500 * (length(label) + 1) + 400 ELSE 7200 + 500 * (length(label) + 1) END AS x0, (y - 2) * 100 AS y0,
  CASE WHEN i % 2 = 1 THEN 53600 ELSE 7200 + 500 * (length(label) + 9 + k % 20) END AS x1, (y + 8) * 100 AS y1 FROM r""")
def detect_colon_runs(spark, sf_dir):
    return detected(spark, sf_dir, colon).drop("group_id", "cells", "hint")


@query("""SELECT c_custkey AS k, 'free_text' AS detector, 'multiline_text' AS field_type, 'Remarks' AS label, 7200::BIGINT AS x0, (610 - c_custkey % 50) * 100 AS y0, 54000::BIGINT AS x1, 69600::BIGINT AS y1 FROM customer""")
def detect_free_text(spark, sf_dir):
    """Room between two texts; what is below the last one is over the share of a page that counts."""
    return detected(spark, sf_dir, free).where("label = 'Remarks'").drop("group_id", "cells", "hint")
