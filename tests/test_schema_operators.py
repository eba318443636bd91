"""Profiles, fusing, checks, vaults, answers and measures on small tables and against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from leafmark.functions import answers, ids
from leafmark.functions import rects as R
from leafmark.functions import values as V
from leafmark.operators import cluster, detectors, evaluate, fuse, runs, vault, verify
from leafmark.operators.grouped import by_group


def boxes(spark, rows):
    return spark.createDataFrame(rows, "page int, id string, x0 double, y0 double, x1 double, y1 double").select("page", "id", R.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("r"))


def random_boxes(seed, n=60):
    r = random.Random(seed)
    return [(r.randrange(3), f"b{i:03d}", x := float(r.randrange(0, 200)), y := float(r.randrange(0, 200)), x + r.randrange(5, 120), y + r.randrange(5, 90)) for i in range(n)]


def iou(a, b):
    return fuse.overlap(a[2:], b[2:])


@pytest.mark.parametrize("few", [256, 1])
def test_page_decisions_match_plain_versions(spark, few, monkeypatch):
    """Clusters, suppression and matching, with pages joined whole and through grid cells."""
    from leafmark.operators import spatial

    monkeypatch.setattr(spatial, "FEW", few)
    rows = random_boxes(1)
    table = boxes(spark, rows)
    lead = {(x[0], x[1]): x[1] for x in rows}
    for _ in rows:
        for a, b in itertools.combinations(rows, 2):
            if a[0] == b[0] and iou(a, b) > 0.3:
                lead[a[0], a[1]] = lead[b[0], b[1]] = min(lead[a[0], a[1]], lead[b[0], b[1]])
    assert {(x["page"], x["id"]): x["cluster"] for x in cluster.components(table, 0.3).collect()} == lead
    kept = []
    for a in sorted(rows, key=lambda x: (-(x[4] - x[2]) * (x[5] - x[3]), x[1])):
        own = [b for b in kept if b[0] == a[0]]
        if len(own) < 12 and not any(iou(a, b) > 0.5 or (b[2] <= a[2] and b[3] <= a[3] and b[4] >= a[4] and b[5] >= a[5]) for b in own):
            kept.append(a)
    assert {x["id"] for x in cluster.suppress(table, 0.5, 12).collect()} == {b[1] for b in kept}
    other = random_boxes(2)
    pairs, left, right, want = sorted(((-iou(a, b), a[1], b[1], a[0]) for a in rows for b in other if a[0] == b[0] and iou(a, b) >= 0.2)), set(), set(), set()
    for s, a, b, page in pairs:
        if (page, a) not in left and (page, b) not in right:
            left.add((page, a))
            right.add((page, b))
            want.add((page, a, b, round(-s, 9)))
    assert {(x["page"], x["pred_id"], x["truth_id"], round(x["iou"], 9)) for x in cluster.greedy_match(table, boxes(spark, other), 0.2).collect()} == want


def candidates(spark, rows):
    r = random.Random(5)
    more = [(*x, r.choice(["text", "checkbox", "date"]), r.random(), r.choice(["vector_line", "blank_region", "model"])) for x in rows]
    df = spark.createDataFrame(more, "page int, id string, x0 double, y0 double, x1 double, y1 double, field_type string, geometry double, kind string")
    empty = F.array().cast("array<string>")
    return df.select(
        "page", "id", R.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("r"), "field_type", "geometry", F.lit(0.4).alias("label_link"), F.lit(0.5).alias("semantic_type"), F.lit(0.0).alias("autofill_value"),
        F.when(F.col("geometry") > 0.5, F.col("id")).alias("label"), F.lit(None).cast("string").alias("canonical_key"), F.lit(None).cast("string").alias("group_id"), F.array("kind").alias("sources"), empty.alias("contexts"),
        F.array(F.struct(F.col("kind"), F.col("geometry").alias("score"), F.lit("").alias("detail"))).alias("evidence"),
    )


def test_fused_candidates_do_not_overlap(spark):
    out = fuse.fuse(candidates(spark, random_boxes(3, 80)), 0.0).collect()
    assert out
    for a, b in itertools.combinations(out, 2):
        if a["page"] == b["page"]:
            assert fuse.overlap(tuple(a["r"]), tuple(b["r"])) <= fuse.MAX_IOU + 1e-5
    for page in {x["page"] for x in out}:
        own = sorted((x for x in out if x["page"] == page), key=lambda x: x["order"])
        assert [x["order"] for x in own] == list(range(len(own)))
        assert own == sorted(own, key=lambda x: (-x["r"]["y1"], x["r"]["x0"], x["r"]["x1"], x["id"]))
    shuffled = fuse.fuse(candidates(spark, random_boxes(3, 80)).repartition(7, "id"), 0.0).collect()
    assert sorted(map(str, shuffled)) == sorted(map(str, out))


def test_what_a_winner_leaves():
    assert fuse.remainder((0, 0, 10, 10), (6, -1, 12, 11)) == (0, 0, 6, 10)
    assert fuse.remainder((0, 0, 10, 10), (-1, -1, 11, 11)) is None
    assert fuse.cut_down((0.0, 0.0, 100.0, 20.0), "text", [(50.0, 0.0, 100.0, 20.0)], 0.1) == (0.0, 0.0, 50.0, 20.0)
    assert fuse.cut_down((0.0, 0.0, 60.0, 20.0), "text", [(30.0, 0.0, 60.0, 20.0)], 0.1) is None


@pytest.mark.parametrize("partitions", [1, 4])
def test_numbered_places_without_a_whole_key_in_a_task(spark, partitions):
    rows = [(i % 3 if i % 7 else None, i * 37 % 101) for i in range(101)]
    got = runs.numbered(spark.createDataFrame(rows, "k int, v int").repartition(partitions), ["v"], ["k"]).collect()
    for k in (0, 1, 2, None):
        own = sorted(v for a, v in rows if a == k)
        assert sorted((x["at"], x["v"], x["n"]) for x in got if x["k"] == k) == [(i, v, len(own)) for i, v in enumerate(own)]
    assert runs.numbered(spark.createDataFrame([], "v int"), ["v"]).count() == 0


def test_groups_come_whole_and_in_order(spark):
    df = spark.createDataFrame([(i % 5, -i) for i in range(1000)], "k int, v int").repartition(6)
    got = by_group(df, ["k"], ["v"], lambda rows: [(rows[0][0], [r[1] for r in rows])], "k int, v array<int>").collect()
    assert {x["k"]: x["v"] for x in got} == {k: sorted(-i for i in range(1000) if i % 5 == k) for k in range(5)}


def test_checks_give_findings(spark):
    files = spark.createDataFrame([(1, b"abc", b"abcd"), (2, b"abc", b"abd"), (3, b"abc", b"ab"), (4, b"", b"x")], "doc int, original binary, produced binary")
    assert {x["doc"]: (x["severity"], x["message"].split()[-1]) for x in verify.prefix_preserved(files).collect()} == {1: ("info", "prefix"), 2: ("error", "2"), 3: ("error", "2"), 4: ("info", "prefix")}
    fields = boxes(spark, [(0, "a", 0.0, 0.0, 50.0, 10.0), (0, "b", 0.0, 0.0, 50.0, 11.0), (0, "c", 90.0, 0.0, 130.0, 10.0)])
    pages = spark.range(1).select(F.lit(0).alias("page"), R.rect(F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(100.0)).alias("crop"))
    written = spark.createDataFrame([("a", "text", "x", 5), ("a", "text", "x", 5), ("b", "text", "y", None)], "name string, field_type string, value string, max_length int")
    read = spark.createDataFrame([("a", "date", "z", 4)], "name string, field_type string, value string, max_length int")
    rules = spark.createDataFrame([("a", 4, None, "[a-z]+", None)], "name string, max_chars int, comb_cells int, pattern string, choices array<string>")
    fills = spark.createDataFrame([("a", "filled", "toolong"), ("a", "filled", "ok"), ("a", "filled", "A1")], "name string, status string, value string")
    found = verify.verify(fields, pages, written, read, rules, fills)
    counts = {x["code"]: x["n"] for x in verify.summary(found).collect()}
    assert counts == {"FIELD_OVERLAP": 1, "FIELD_OUT_OF_BOUNDS": 1, "DUPLICATE_FIELD_NAME": 1, "FIELD_MISSING": 1, "FIELD_TYPE_MISMATCH": 2, "FIELD_VALUE_MISMATCH": 2, "FIELD_MAXLEN_MISMATCH": 2, "VALUE_CONSTRAINT_VIOLATION": 2}
    text = verify.render(found)
    assert text.startswith("failed\n") and "FIELD_MISSING: b is not there" in text
    assert verify.render(found.limit(0)) == "passed\n0 error, 0 warning, 0 info"


def entries(spark):
    rows = [("p", "person.name.first", "Ada", "manual", 0.9, "normal", ["First "]), ("p", "person.name.last", "Byron", "manual", 1.0, "normal", ["Last"]), ("p", "person.ssn", "123", "manual", 1.0, "secret", [])]
    return spark.createDataFrame(rows, "profile_id string, key string, value string, source string, confidence double, sensitivity string, labels_seen array<string>")


def test_vault_is_saved_sealed_and_read_back(spark, tmp_path):
    v = entries(spark)
    vault.save(v, f"{tmp_path}/v", "pass")
    raw = {x["value"] for x in spark.read.parquet(f"{tmp_path}/v").collect()}
    assert not raw & {"Ada", "Byron", "123"}
    assert sorted(map(tuple, vault.load(spark, f"{tmp_path}/v", "pass").collect()), key=str) == sorted(map(tuple, v.collect()), key=str)
    with pytest.raises(Exception, match="(?i)aes|decrypt|tag"):
        vault.load(spark, f"{tmp_path}/v", "other").collect()
    vault.save(v, f"{tmp_path}/plain")
    assert vault.load(spark, f"{tmp_path}/plain").count() == 3


def test_vault_derives_suggests_and_redacts(spark):
    v = entries(spark)
    assert {x["key"]: (x["value"], x["confidence"]) for x in vault.derived(v).collect()} == {"person.name.full": ("Ada Byron", 0.882), "person.name.initials": ("AB", 0.882)}
    labels = spark.createDataFrame([("FIRST",), (" ",), ("other",)], "label string")
    assert [tuple(x) for x in vault.suggest_key(v, labels).collect()] == [("FIRST", "person.name.first")]
    assert {x["key"]: x["value"] for x in vault.redacted(v).collect()}["person.ssn"] == vault.SECRET


@pytest.mark.parametrize(
    ("value", "rule", "ok"),
    [
        ({"a": 1}, {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "maximum": 2}}, "additionalProperties": False}, True),
        ({"a": True}, {"properties": {"a": {"type": "number"}}}, False), ({"b": 1}, {"additionalProperties": False}, False), (["x"], {"items": {"enum": ["x"]}, "maxItems": 1}, True),
        (["x", "y"], {"maxItems": 1}, False), ("ab", {"minLength": 3}, False), (1.0, {"const": 1}, True), (True, {"const": 1}, False), (None, {"type": ["null", "string"]}, True), ({"z": 1}, {"additionalProperties": {"type": "string"}}, False),
    ],
)
def test_answers_keep_to_schemas(value, rule, ok):
    assert answers.holds(value, rule) is ok


def test_contexts_are_redacted_within_a_budget():
    context = {"label": "Call 555 now", "value": "secret", "page_id": "ab12", "mail": "a1@b.org", "n": 12345678, "cells": 4, "nested": {"full_text": "x", "hint": "y" * 50}}
    got = answers.redacted(context, 40)
    assert got["label"] == "Call ### now" and "value" not in got and got["mail"] == "x#@x.xxx" and got["n"] == "########" and got["cells"] == 4
    assert answers.char_count(got) <= 40 + 8 and "full_text" not in got["nested"]
    assert list(answers.walk({"b": [1, {"c": None}], "a": "x"})) == [("a", "x"), ("b[0]", 1), ("b[1].c", None)]


def test_values_ids_and_rates(spark):
    one = spark.range(1)
    row = one.select(V.state_abbrev(F.lit(" texas ")).alias("a"), V.state_abbrev(F.lit("tx")).alias("b"), V.state_abbrev(F.lit("Nowhere")).alias("c"), V.country_iso2(F.lit("Germany")).alias("d"), V.check_ein(F.lit("07-1234567"))["ok"].alias("e"), V.check_ein(F.lit("10-1234567"))["ok"].alias("f")).first()
    assert tuple(row) == ("TX", "TX", "Nowhere", "DE", False, True)
    box = lambda x: R.rect(F.lit(x), F.lit(0.0), F.lit(10.0), F.lit(10.0))
    a, b, c = one.select(ids.candidate_id(F.lit(1), box(0.00001), F.lit("text")), ids.candidate_id(F.lit(1), box(0.0), F.lit("text")), ids.candidate_id(F.lit(2), box(0.0), F.lit("text"))).first()
    assert a == b != c
    readings = spark.createDataFrame([(1, "the cat sat", "the cat sat"), (2, "the cat", "the cat sat"), (3, "", ""), (4, "x", ""), (5, None, "a b")], "id int, read string, truth string")
    assert {x["id"]: (x["word_edits"], round(x["wer"], 3), x["char_edits"]) for x in evaluate.error_rates(readings).collect()} == {1: (0, 0.0, 0), 2: (1, 0.333, 4), 3: (0, 0.0, 0), 4: (1, 1.0, 1), 5: (2, 1.0, 3)}


def test_detectors_leave_live_fields_headings_and_claims_alone():
    label = ("span", "Name:", 72.0, 698.0, 102.0, 708.0, 10.0)
    rule = ("line", None, 110.0, 697.0, 300.0, 697.0, 0.6)
    frame = (0.0, 0.0, 612.0, 792.0)
    one = detectors.generate(detectors.page_of([label, rule], frame))
    assert [(f.detector, f.label) for f in one] == [("underline", "Name")]
    assert detectors.generate(detectors.page_of([label, rule, ("widget", "n", 110.0, 697.0, 300.0, 709.0, None)], frame)) == []
    only = detectors.generate(detectors.page_of([label, rule], frame), {"colon_run": detectors.colon_runs})
    assert [f.detector for f in only] == ["colon_run"]
    assert detectors.generate(detectors.page_of([("span", "A heading", 72.0, 698.0, 130.0, 708.0, 10.0)], frame), {"underline": detectors.underlines}) == []
