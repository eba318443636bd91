"""What a printed placeholder or a value is, by the first of a list of whole-text patterns.

Names, modes, confidences, types and keys are fixed values; the patterns are our own, in the
common part of regular expressions, so that SQL engines read them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_D, _Y, _X = "[0-9]", "[Yy]{4}", "[xX#_9]"
_MONEY = "[$€£]"
#: name, pattern of the whole text, confidence, field type, canonical key.
PLACEHOLDERS = (
    ("date_mdy_placeholder", "[Mm]{2} ?[/.-] ?[Dd]{2} ?[/.-] ?[Yy]{2,4}", 0.96, "date", "document.today"), ("date_dmy_placeholder", "[Dd]{2} ?[/.-] ?[Mm]{2} ?[/.-] ?[Yy]{2,4}", 0.94, "date", "document.today"),
    ("date_iso_placeholder", f"{_Y}-[Mm]{{2}}-[Dd]{{2}}", 0.95, "date", "document.today"), ("date_underscore_placeholder", "_+ ?/ ?_+ ?/ ?_+", 0.88, "date", "document.today"),
    ("date_box_placeholder", "(\\[ ?\\] ?){6,8}", 0.55, "date", None), ("month_day_year_placeholder", "[Mm]onth[ ,/]+[Dd]ay[ ,/]+[Yy]ear", 0.90, "date", "document.today"),
    ("ordinal_date_placeholder", "_+ day of _+,? ?(20)?_+", 0.92, "date", "document.signed_date"), ("mmyy_expiry_placeholder", "[Mm]{2} ?/ ?[Yy]{2}([Yy]{2})?", 0.95, "text", "card.expiration"),
    ("ssn_placeholder", "[Xx]{3}-[Xx]{2}-[Xx]{4}|_{3}-_{2}-_{4}", 0.97, "text", "person.ssn"), ("ssn_hash_placeholder", "#{3}-#{2}-#{4}", 0.96, "text", "person.ssn"),
    ("ein_placeholder", "[Xx#]{2}-[Xx#]{7}", 0.97, "text", "company.tax_id.ein"), ("ein_underscore_placeholder", "_{2}-_{7}", 0.90, "text", "company.tax_id.ein"),
    ("vin_placeholder", "[Xx_#]{17}", 0.62, "text", "vehicle.vin"), ("iban_placeholder", "[A-Z]{2}[Xx#]{2}( ?[Xx#]{4}){3,7}", 0.85, "text", "bank.iban"),
    ("routing_placeholder", "[Xx#]{9}", 0.58, "text", "bank.routing_number"), ("account_number_placeholder", "[Xx#]{8}|[Xx#]{10,12}", 0.52, "text", "bank.account_number"),
    ("card_placeholder", "[Xx]{4}([ -]?[Xx]{4}){3}", 0.95, "text", "card.number"), ("card_hash_placeholder", "#{4}([ -]?#{4}){3}", 0.95, "text", "card.number"),
    ("cvv_placeholder", "([Cc][Vv][VvCc]2? ?:? ?)[Xx#_]{3,4}", 0.92, "text", "card.cvv"), ("zip4_placeholder", "[Xx]{5}-[Xx]{4}|_{5}-_{4}", 0.95, "text", "person.address.postal_code"),
    ("zip4_hash_placeholder", "#{5}-#{4}", 0.94, "text", "person.address.postal_code"), ("zip5_placeholder", "[Xx#_]{5}", 0.50, "text", "person.address.postal_code"),
    ("postal_ca_placeholder", "[AaXx][19][AaXx] ?[19][AaXx][19]", 0.90, "text", "person.address.postal_code"), ("state_two_letter_placeholder", "_{2}|[Ss][Tt]", 0.52, "text", "person.address.region"),
    ("phone_paren_placeholder", f"\\( ?{_X}{{0,3}} *\\) ?{_X}{{3}} ?- ?{_X}{{4}}|\\( {{2,}}\\) ?_* ?- ?_*", 0.97, "phone", "person.phone.mobile"), ("phone_dash_placeholder", "([Xx#]{3}-[Xx#]{3}|_{3}-_{3})-([Xx#]{4}|_{4})", 0.95, "phone", "person.phone.mobile"),
    ("phone_ext_placeholder", "[Ee]xt[.:]? ?[Xx#_]{2,6}", 0.90, "text", "person.phone.extension"), ("email_placeholder", "[a-z_]+@([a-z_]+[.])+[a-z_]+", 0.94, "email", "person.email"),
    ("url_placeholder", "(https?://|www[.])[a-z_.]+", 0.80, "text", "company.website"), ("currency_placeholder", f"{_MONEY} ?[Xx#0_,]+[.][Xx#0_]{{2}}", 0.95, "currency", "document.amount"),
    ("currency_blank_placeholder", f"{_MONEY} ?_+", 0.88, "currency", "document.amount"), ("percent_placeholder", "[Xx#_]+ ?%", 0.90, "number", None), ("time_placeholder", "([Hh]{2}|_{2}) ?: ?([Mm]{2}|_{2})( ?[AaPp][Mm](/[AaPp][Mm])?)?", 0.93, "text", None),
    ("numeric_box_placeholder", "#{1,4}", 0.45, "number", None), ("comb_placeholder", "(\\|_+){3,}\\|?", 0.90, "comb", None), ("checkbox_placeholder", "[☐□❑]|\\[ ?\\]", 0.92, "checkbox", None),
    ("initials_pair_placeholder", "_{2,4}/_{2,4}", 0.85, "text", "person.initials"), ("signature_placeholder", "[Xx] ?_{5,}|[Ss]ign here", 0.90, "signature", "person.signature"),
    ("underscore_blank_placeholder", "_{6,}", 0.40, "text", None), ("dot_leader_placeholder", "[.]{4,}", 0.40, "text", None),
)
VALUES = (
    ("ssn_value", f"{_D}{{3}}-{_D}{{2}}-{_D}{{4}}", 0.95, "text", "person.ssn"), ("ein_value", f"{_D}{{2}}-{_D}{{7}}", 0.93, "text", "company.tax_id.ein"), ("zip9_value", f"{_D}{{5}}-{_D}{{4}}", 0.93, "text", "person.address.postal_code"),
    ("zip5_value", f"{_D}{{5}}", 0.70, "text", "person.address.postal_code"), ("phone_us_value", f"([+]?1[ .-]?)?(\\({_D}{{3}}\\) ?|{_D}{{3}}[ .-]){_D}{{3}}[ .-]{_D}{{4}}", 0.90, "phone", "person.phone.mobile"),
    ("email_value", "[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+[.])+[A-Za-z]{2,}", 0.96, "email", "person.email"), ("url_value", "(https?://|www[.])[^ ]+", 0.90, "text", "company.website"),
    ("currency_value", f"{_MONEY} ?{_D}{{1,3}}(,?{_D}{{3}})*([.]{_D}{{2}})?", 0.92, "currency", "document.amount"), ("decimal_amount_value", f"{_D}{{1,3}}(,{_D}{{3}})*[.]{_D}{{2}}", 0.70, "currency", None),
    ("date_iso_value", f"{_D}{{4}}-{_D}{{2}}-{_D}{{2}}", 0.95, "date", "document.today"), ("date_dmy_value", f"{_D}{{1,2}}[.]{_D}{{1,2}}[.]{_D}{{2,4}}", 0.80, "date", "document.today"), ("date_mdy_value", f"{_D}{{1,2}}[/-]{_D}{{1,2}}[/-]{_D}{{2,4}}", 0.88, "date", "document.today"),
    ("mmyy_value", "(0[1-9]|1[0-2])/[0-9]{2}", 0.85, "text", "card.expiration"), ("card_value", f"{_D}{{4}}([ -]?{_D}{{4}}){{3}}", 0.88, "text", "card.number"), ("iban_value", "[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", 0.90, "text", "bank.iban"),
    ("vin_value", "[A-HJ-NPR-Z0-9]{8}[0-9X][A-HJ-NPR-Z0-9]{8}", 0.90, "text", "vehicle.vin"), ("time_value", "([01]?[0-9]|2[0-3]):[0-5][0-9]( ?[AaPp][Mm])?", 0.85, "text", None), ("percent_value", f"{_D}+([.]{_D}+)? ?%", 0.90, "number", None),
    ("state_abbrev_value", "A[KLRZ]|C[AOT]|D[CE]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEINOST]|N[CDEHJMVY]|O[HKR]|PA|RI|S[CD]|T[NX]|UT|V[AT]|W[AIVY]", 0.72, "text", "person.address.region"), ("routing_value", f"{_D}{{9}}", 0.55, "text", "bank.routing_number"),
    ("npi_value", f"[12]{_D}{{9}}", 0.42, "text", "medical.npi"), ("account_number_value", f"{_D}{{8}}|{_D}{{11,17}}", 0.50, "text", "bank.account_number"), ("year_value", "(19|20)[0-9]{2}", 0.60, "text", None), ("cvv_value", f"{_D}{{3,4}}", 0.35, "text", "card.cvv"),
    ("yes_no_value", "[Yy]es|[Nn]o|YES|NO|N/A|n/a", 0.85, "checkbox", "misc.yes_no"), ("checkbox_mark_value", "[xX✓✔☑☒]", 0.80, "checkbox", None),
)
OPTIONS = ("yes_no_value", "checkbox_mark_value")
RULES = {"placeholder": tuple(sorted(PLACEHOLDERS, key=lambda r: (-r[2], r[0]))), "value": tuple(sorted(VALUES, key=lambda r: (-r[2], r[0])))}


def any_of(mode: str) -> str:
    """One pattern that matches where any rule of a mode does."""
    return "^(?:" + "|".join(f"(?:{r[1]})" for r in RULES[mode]) + ")$"


def bare(text: Column) -> Column:
    """The text without decoration around it: blanks, bullets, and marks at its end."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), "^[*•·:;,]+ *", ""), "[ :;,]*$", "")


def _rule(r: tuple) -> Column:
    name, _, sure, kind, key = r
    return F.struct(F.lit(name).alias("name"), F.lit(kind).alias("field_type"), F.lit(key).cast("string").alias("canonical_key"), F.lit(sure).alias("confidence"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is written and computed once, however often f reads it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def match(text: Column, mode: str) -> Column:
    """The best rule of a mode that the whole text keeps to: struct(name, field_type, canonical_key, confidence), or null.

    text should be a plain column; ``match_bare`` is for anything that has to be computed.
    """
    return F.coalesce(*(F.when(text.rlike(f"^(?:{r[1]})$"), _rule(r)) for r in RULES[mode]))


def match_bare(text: Column, mode: str) -> Column:
    """The best rule of a text without its decoration."""
    return let(bare(text), lambda t: F.when(t.rlike(any_of(mode)), match(t, mode)))


def match_all(text: Column, mode: str) -> Column:
    """All rules of a mode that the whole text keeps to, best first."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"^(?:{r[1]})$"), _rule(r)) for r in RULES[mode])))


def looks_like_value(text: Column) -> Column:
    """True for text that is filled in, not a label: digits and marks alone, or of the form of a value."""
    return let(bare(text), lambda t: (t != "") & ((t.rlike("^[0-9 .,/()+-]+$") & t.rlike("[0-9]")) | t.rlike(any_of("value"))))


def is_option_caption(text: Column) -> Column:
    """True for a text that stands beside a box as a choice."""
    return F.coalesce(match_bare(text, "value")["name"].isin(*OPTIONS), F.lit(False))


def rules_for_key(key: str) -> list[tuple]:
    """All rules that tell a key, best first."""
    return sorted((r for rules in RULES.values() for r in rules if r[4] == key), key=lambda r: (-r[2], r[0]))


def rule_for_key(key: Column) -> Column:
    """The best rule that tells a key, or null."""
    known = sorted({r[4] for rules in RULES.values() for r in rules if r[4]})
    return F.coalesce(*(F.when(key == k, _rule(rules_for_key(k)[0])) for k in known))


def infer(key: Column, nearby: Column) -> Column:
    """The rule that a label's key and the texts near it tell together.

    Texts and their words are tried as placeholders, then as values. One that tells the
    label's key is believed halfway more; then comes one of the key's namespace, the best
    of all, and without any the best rule of the key itself.
    """
    words = F.array_distinct(F.concat(nearby, F.flatten(F.transform(nearby, lambda t: F.split(t, " ")))))
    found = lambda ws, mode: F.filter(F.transform(ws, lambda t: match_bare(t, mode)), lambda r: r.isNotNull())
    both = let(words, lambda ws: F.struct(found(ws, "placeholder").alias("p"), found(ws, "value").alias("v")))
    rules = let(both, lambda b: F.when(F.size(b["p"]) > 0, b["p"]).otherwise(b["v"]))
    return let(F.struct(rules.alias("rules"), key.alias("key")), lambda x: _best_of(x["rules"], x["key"]))


def _best_of(rules: Column, key: Column) -> Column:
    best = lambda a: F.get(F.array_sort(F.transform(a, lambda r: F.struct((-r["confidence"]).alias("c"), r["name"].alias("n"), r.alias("r")))), F.lit(0))["r"]
    same = best(F.filter(rules, lambda r: r["canonical_key"] == key))
    raised = F.when(same.isNotNull(), F.struct(same["name"].alias("name"), same["field_type"].alias("field_type"), same["canonical_key"].alias("canonical_key"), F.round(same["confidence"] + (1 - same["confidence"]) / 2, 4).alias("confidence")))
    near = best(F.filter(rules, lambda r: F.substring_index(r["canonical_key"], ".", 1) == F.substring_index(key, ".", 1)))
    return F.coalesce(raised, near, best(rules), rule_for_key(key))
