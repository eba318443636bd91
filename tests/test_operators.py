"""Operators on small tables whose answers are known."""

import pytest
from pyspark.sql import functions as F

from leafmark.functions import rects as R
from leafmark.functions import text as T
from leafmark.functions import values as V
from leafmark.operators import cluster, decide, labels, runs, spatial


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def box(*v):
    return R.rect(*(F.lit(float(x)) for x in v))


def test_touching_rectangles_intersect_with_no_area(spark):
    a, b, far = box(0, 0, 10, 10), box(10, 0, 20, 10), box(11, 0, 20, 10)
    row = one(spark, R.intersection(a, b).alias("i"), R.intersection(a, far).alias("n"), R.iou(a, b).alias("u"), R.iou(a, a).alias("s"))
    assert row["i"]["x0"] == row["i"]["x1"] == 10 and row["n"] is None and row["u"] == 0 and row["s"] == 1


def test_affine_maps_invert(spark):
    m = R.concat(R.rotation(F.lit(90.0)), R.matrix(2, 0, 0, 2, 5, 7))
    back = R.concat(m, R.inverted(m))
    row = one(spark, back.alias("m"), R.transform_rect(m, box(0, 0, 1, 2)).alias("r"), R.inverted(R.matrix(0, 0, 0, 0, 1, 1)).alias("none"))
    assert [round(row["m"][k], 9) for k in "abcdef"] == [1, 0, 0, 1, 0, 0] and row["none"] is None
    assert [round(row["r"][k], 9) for k in ("x0", "y0", "x1", "y1")] == [1, 7, 5, 9]


@pytest.mark.parametrize(
    ("name", "value", "want"),
    [
        ("phone_us", "1-415-555-0132", "(415) 555-0132"), ("phone_us", " 12  34 ", "12 34"), ("phone_e164", "4155550132", "+14155550132"), ("phone_e164", None, ""),
        ("ssn", "123456789", "123-45-6789"), ("ein", "12-3456789", "12-3456789"), ("zip5", "123", "00123"), ("zip9", "123456789", "12345-6789"),
        ("credit_card", "4111111111111111", "4111 1111 1111 1111"), ("iban", "de89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 00"),
        ("currency", "($1,234.5)", "-1,234.50"), ("currency", "-$7", "-7.00"), ("currency", "n/a", "n/a"), ("boolean_yes_no", "", "No"), ("boolean_yes_no", "X", "X"),
        ("date_mdy", "March 3rd, 2021", "03/03/2021"), ("date_ymd", "1/2/69", "2069-01-02"), ("date_ymd", "1/2/70", "1970-01-02"), ("date_dmy", "2021-02-30", "2021-02-30"),
        ("name_case", "mary-jane o'neil", "Mary-Jane O'Neil"), ("name_case", "LUDWIG VAN mcdonald", "Ludwig van McDonald"), ("vin", "1m8gdm9a-xkp042788", "1M8GDM9AXKP042788"),
    ],
)
def test_normalizers(spark, name, value, want):
    assert one(spark, V.NORMALIZERS[name](F.lit(value)).alias("v"))["v"] == want


@pytest.mark.parametrize(
    ("name", "value", "ok"),
    [
        ("luhn", "4111 1111 1111 1111", True), ("luhn", "4111 1111 1111 1112", False), ("luhn", "79927398713", False), ("ssn", "000-12-3456", False), ("ssn", "123-45-6789", True),
        ("email", "a@b.co", True), ("email", "a@b.c", False), ("phone_us", "1155550132", False), ("zip_us", "12345-6789", True), ("iban", "DE89370400440532013000", True),
        ("iban", "DE88370400440532013000", False), ("iban", "FR7630006000011234567890189", True), ("routing_aba", "021000021", True), ("routing_aba", "021000022", False),
        ("vin", "1M8GDM9AXKP042788", True), ("vin", "1M8GDM9AXKP042789", False), ("vin", "IM8GDM9AXKP042788", False), ("date", "31/12/2020", False), ("nonempty", "  ", False), ("ein", "07-1234567", False),
    ],
)
def test_validators(spark, name, value, ok):
    assert one(spark, V.VALIDATORS[name](F.lit(value)).alias("v"))["v"]["ok"] is ok


def test_anchored_runs_compare_with_their_first(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (0, 4, 8, 12)], "page long, v double")
    got = runs.anchored_runs(df, ["page"], "v", 5.0, [])
    assert [r["run"] for r in got.orderBy("v").collect()] == [0, 0, 1, 1]


def test_comb_runs_need_equal_cells(spark):
    rows = [(1, 0, f"c{i}", 10.0 * i, 10.0 * i + 8) for i in range(4)] + [(1, 0, "w", 60.0, 99.0), (1, 1, "a", 0.0, 8.0), (1, 1, "b", 10.0, 18.0)]
    got = runs.comb_runs(spark.createDataFrame(rows, "page long, row long, id string, x0 double, x1 double")).collect()
    assert [(r["row"], r["first"], r["cells"]) for r in got] == [(0, "c0", 4)]


def rects(spark, *rows):
    df = spark.createDataFrame([(1, i, *map(float, r)) for i, r in rows], "page long, id string, x0 double, y0 double, x1 double, y1 double")
    return df.select("page", "id", R.rect(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))).alias("r"))


def test_range_join_gives_each_pair_once_over_many_cells(spark):
    t = rects(spark, ("a", (0, 0, 2000, 2000)), ("b", (1000, 1000, 3000, 3000)), ("c", (5000, 0, 5001, 1)))
    assert [(r["a_id"], r["b_id"]) for r in spatial.overlap_pairs(t, 0.05).collect()] == [("a", "b")]


def test_greedy_operators(spark):
    t = rects(spark, ("a", (0, 0, 10, 10)), ("b", (0, 0, 10, 9)), ("c", (2, 2, 4, 4)), ("d", (50, 50, 60, 60)))
    assert {r["id"] for r in cluster.suppress(t).collect()} == {"a", "d"}
    assert {(r["id"], r["cluster"]) for r in cluster.components(t).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")}
    got = cluster.greedy_match(t, t).collect()
    assert {(r["pred_id"], r["truth_id"]) for r in got} == {(i, i) for i in "abcd"}


def test_votes_unknown_weighs_but_cannot_win(spark):
    v = spark.createDataFrame([(1, "m", "unknown", 0.9), (1, "n", "x", 0.4), (1, "o", "y", 0.4), (2, "m", "unknown", 0.5)], "question long, member string, answer string, confidence double")
    got = {r["question"]: r for r in decide.tally(v).collect()}
    assert got[1]["answer"] == "x" and round(got[1]["consensus"], 6) == round(0.4 / 1.7, 6) and got[2]["answer"] is None and got[2]["confidence"] == 0


def test_labels(spark):
    df = spark.createDataFrame([(1, "2. Applicant's Full Name (required):"), (2, "Phone Numbers here"), (3, "nothing")], "id long, label string")
    assert [r["canonical_key"] for r in labels.lookup(df, "label").orderBy("id").collect()] == ["person.name.full", "person.phone", None]
    assert one(spark, T.normalize_label(F.lit(None)).alias("v"))["v"] == ""
    fuzzy = labels.fuzzy_lookup(df.limit(2), cutoff=0.8).collect()
    assert (2, "person.phone") in {(r["id"], r["canonical_key"]) for r in fuzzy}
