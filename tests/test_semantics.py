"""Pattern rules, the registry of keys, and the local voters."""

import re

import pytest
from pyspark.sql import functions as F

from leafmark.functions import patterns as P
from leafmark.operators import semantics

PRINTED = {
    "MM/DD/YYYY": "date_mdy_placeholder", "DD.MM.YY": "date_dmy_placeholder", "YYYY-MM-DD": "date_iso_placeholder", "__/__/____": "date_underscore_placeholder", "[ ][ ][ ][ ][ ][ ]": "date_box_placeholder", "Month / Day / Year": "month_day_year_placeholder", "MM/YY": "mmyy_expiry_placeholder",
    "XXX-XX-XXXX": "ssn_placeholder", "###-##-####": "ssn_hash_placeholder", "##-#######": "ein_placeholder", "XXXXX-XXXX": "zip4_placeholder", "(###) ###-####": "phone_paren_placeholder", "XXX-XXX-XXXX": "phone_dash_placeholder", "Ext. ####": "phone_ext_placeholder",
    "name@example.com": "email_placeholder", "www.example.com": "url_placeholder", "$ ____": "currency_blank_placeholder", "$X,XXX.XX": "currency_placeholder", "HH:MM": "time_placeholder", "|_|_|_|": "comb_placeholder", "☐": "checkbox_placeholder", "____________": "underscore_blank_placeholder", "......": "dot_leader_placeholder",
}
VALUES = {
    "123-45-6789": "ssn_value", "12-3456789": "ein_value", "12345-6789": "zip9_value", "12345": "zip5_value", "(555) 123-4567": "phone_us_value", "a.b@c.org": "email_value", "https://x.org/y": "url_value", "$1,234.50": "currency_value", "12.50": "decimal_amount_value",
    "2024-02-03": "date_iso_value", "3/4/2024": "date_mdy_value", "12/27": "mmyy_value", "4111 1111 1111 1111": "card_value", "DE89370400440532013000": "iban_value", "1HGCM82633A004352": "vin_value", "10:45": "time_value", "50%": "percent_value", "TX": "state_abbrev_value", "123456789": "routing_value", "1999": "year_value", "Yes": "yes_no_value", "x": "checkbox_mark_value",
}


def by_hand(text, mode):
    return next((r[0] for r in sorted(P.PLACEHOLDERS if mode == "placeholder" else P.VALUES, key=lambda r: (-r[2], r[0])) if re.fullmatch(r[1], text)), None)


@pytest.mark.parametrize(("mode", "cases"), [("placeholder", PRINTED), ("value", VALUES)])
def test_rules(spark, mode, cases):
    texts = [*cases, "plain words", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["n"] for r in df.select("t", P.match(F.col("t"), mode)["name"].alias("n")).collect()}
    assert got == {t: by_hand(t, mode) for t in texts} and {t: got[t] for t in cases} == cases
    assert all(r["a"][0] == r["t"] for r in df.select(P.match(F.col("t"), mode)["name"].alias("t"), F.transform(P.match_all(F.col("t"), mode), lambda x: x["name"]).alias("a")).collect() if r["t"])
    assert len(P.PLACEHOLDERS) == 40 and len(P.VALUES) == 26


def test_labels_and_values_are_told_apart(spark):
    df = spark.createDataFrame([("10001",), ("12-3456789",), ("ZIP:",), ("Tax ID",), ("Yes",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(P.looks_like_value(F.col("t")), P.is_option_caption(F.col("t"))).collect()]
    assert got == [(True, False), (True, False), (False, False), (False, False), (True, True), (False, False), (False, False)]


def test_registry_and_voters(spark):
    keys = semantics.keys(spark)
    assert keys.count() == len(semantics.KEYS) and {r["key"] for r in semantics.children(keys, "billing").collect()} == {k for k in semantics.KEYS if k.startswith("billing.")}
    assert semantics.with_parent(keys, "card").count() == 2 and set(semantics.ALIASES.values()) <= set(semantics.KEYS)
    one = spark.createDataFrame([("ssn",), ("person.ssn",), ("City",)], "n string").select(semantics.secret_key_for(F.col("n")).alias("k")).collect()
    assert [r["k"] for r in one] == ["person.ssn", "person.ssn", None]
    none = F.array().cast("array<string>")
    fields = spark.createDataFrame([(0, 1, "City"), (0, 2, "city:"), (0, 3, "Zzz")], "page int, id int, label string").withColumns({"parents": none, "nearby": none})
    got = {r["question"]: (r["answer"], round(r["confidence"], 4)) for r in semantics.deliberate(fields).collect()}
    assert got == {"0/1": ("person.address.city", 0.835), "0/2": ("person.address.city", 0.835), "0/3": (None, 0.0)}
