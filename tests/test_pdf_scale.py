"""Pages are dealt to many tasks, detected where they are read, and written and read once a query."""

import pytest

from leafmark.operators import detectors
from leafmark.plans import catalog_detect, catalog_forms
from leafmark.sources import pdf
from leafmark.storage import table

SF = "/root/testdata/sf0.001"
DRAWN = ("underline", "boxed", "checkbox", "radio", "comb", "date_box", "signature", "grid", "colon", "free")


def test_a_small_file_of_keys_becomes_many_tasks(spark):
    """A file of customers is one split; their pages were written and read in one task."""
    assert table(spark, SF, "customer").rdd.getNumPartitions() == 1
    assert catalog_forms.form_files(spark, SF).rdd.getNumPartitions() >= 4
    assert catalog_detect.detected(spark, SF, catalog_detect.boxed).rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("query", [catalog_forms.link_form_labels, catalog_forms.detection_recall])
def test_files_are_written_once_a_query(spark, query, monkeypatch):
    """What follows reads the evidence that was kept; files were written and read up to eight times."""
    made = []
    plain = pdf.each_file
    monkeypatch.setattr(pdf, "each_file", lambda *a: made.append(plain(*a)) or made[-1])
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(made) == 1 and "customer" not in plan and "c_custkey" not in plan


def test_files_give_the_candidates_of_their_evidence(spark):
    """Detecting while reading needs no shuffle and gives what ``detect`` gives of the table of evidence."""
    files = [(f"{name}{k}", bytearray(pdf.write_drawing(getattr(catalog_detect, name)(k)))) for name in DRAWN for k in (0, 1, 2, 3, 77)]
    files += [("form", bytearray(pdf.write_form([("Full name:", "underline", "Ann"), ("City", "boxed", None), ("Agree", "checkbox", "Yes")]))), ("bad", bytearray(b"no form")), ("none", None)]
    df = spark.createDataFrame(files, "path string, content binary")
    found = detectors.detect_files(df)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = detectors.detect(pdf.evidence(df))
    assert found.schema == want.schema and sorted(map(str, found.collect())) == sorted(map(str, want.collect())) != []


def test_comments_and_blanks_before_values():
    """Blanks are taken as a whole: what a comment says is no value."""
    r = pdf.Reader(b"%abc 1 2\n<</A 1/B#20c[1 0 R 2.5(x\\)y)]>>% end")
    assert r.value() == {"A": 1, "B c": [pdf.Ref(1), 2.5, ("text", b"x)y")]}
    with pytest.raises(EOFError):
        r.value()
