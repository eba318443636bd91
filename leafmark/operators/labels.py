"""Looking labels up in the alias table: exactly, by rewriting, by parent, and by likeness."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import text as T

#: Labels and the keys they name: our own small table.
ALIASES = {
    "full name": "person.name.full", "name": "person.name.full", "first name": "person.name.first", "given name": "person.name.first", "last name": "person.name.last", "surname": "person.name.last",
    "date of birth": "person.birth_date", "birth date": "person.birth_date", "email": "person.email", "email address": "person.email", "phone": "person.phone", "phone number": "person.phone",
    "street address": "address.street", "city": "address.city", "state": "address.state", "zip code": "address.zip", "country": "address.country", "employer": "employment.employer",
    "job title": "employment.title", "start date": "employment.start_date", "annual income": "employment.income", "account number": "bank.account", "routing number": "bank.routing",
    "card number": "card.number", "signature": "document.signature", "date": "document.date", "company name": "company.name", "tax id": "company.tax_id", "policy number": "insurance.policy",
}
#: Words that say whose or what a label is, without changing its key.
ROLES, FILLERS = ("applicant", "borrower", "patient", "employee", "your", "the"), ("here", "below", "required", "optional")


def rewrites(label: Column) -> list[Column]:
    """A normalized label and its simpler forms, in the order to try."""
    roles, fillers = "|".join(ROLES), "|".join(FILLERS)
    bare = F.regexp_replace(label, f"^(?:(?:{roles})s? )+", "")
    short = F.regexp_replace(bare, f"(?: (?:{fillers}))+$", "")
    single = F.regexp_replace(short, "([^s])s$", "$1")
    return [label, bare, short, single]


def lookup(df: DataFrame, label: str, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Adds canonical_key: that of the first form of the label that is an alias, else null."""
    keys = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    forms = rewrites(T.normalize_label(F.col(label)))
    return df.withColumn("canonical_key", F.coalesce(*(F.try_element_at(keys, f) for f in forms)))


def fuzzy_lookup(df: DataFrame, aliases: dict[str, str] = ALIASES, cutoff: float = 0.55, top: int = 12) -> DataFrame:
    """Aliases like each label by the Ratcliff-Obershelp ratio: id, canonical_key, score (thousandths), best per key.

    df has id and label. The alias table is a constant of the program. Each distinct
    label is compared once, an Arrow batch at a time.
    """

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for label in batch["norm"]:
                best: dict[str, float] = {}
                matcher = difflib.SequenceMatcher(autojunk=False)
                matcher.set_seq2(label or "")
                for alias, key in aliases.items():
                    matcher.set_seq1(alias)
                    if matcher.real_quick_ratio() >= cutoff and matcher.quick_ratio() >= cutoff and (r := matcher.ratio()) >= cutoff:
                        best[key] = max(best.get(key, 0.0), r)
                out += [(label, k, int(1000 * r)) for k, r in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:top]]
            yield pd.DataFrame(out, columns=["norm", "canonical_key", "score"])

    named = df.select(F.col("id").cast("long").alias("id"), T.normalize_label(F.col("label")).alias("norm"))
    found = named.select("norm").distinct().mapInPandas(match, "norm string, canonical_key string, score bigint")
    return named.join(found, "norm").select("id", "canonical_key", "score")


#: Score of a label by where it stands, and what adds to or takes from it (fixed values).
BASE_SCORES = {"left_of": 1.00, "above": 0.80, "right_of": 0.45, "below": 0.25}
TOGGLE_SCORES = {"right_of": 1.00, "above": 0.80, "left_of": 0.55, "below": 0.25}
BONUSES = {"colon": 0.25, "ontology": 0.30, "mutual": 0.15}
PENALTIES = {"inside": 0.50, "value": 0.40, "heading": 0.30, "long": 0.20}
LONG_LABEL = 60


def label_score(text: Column, kind: Column, weight: Column, toggle: Column, known: Column, mutual: Column, inside: Column, value_like: Column) -> Column:
    """The score of a text as a field's label, within 0 and 1; 0 where they are unrelated."""
    table = lambda scores: F.try_element_at(F.create_map(*(F.lit(x) for kv in scores.items() for x in kv)), kind)
    base = F.when(toggle, table(TOGGLE_SCORES)).otherwise(table(BASE_SCORES))
    t = F.trim(F.coalesce(text, F.lit("")))
    add = lambda c, n: F.when(c, n).otherwise(0.0)
    total = base * weight + add(t.endswith(":"), BONUSES["colon"]) + add(known, BONUSES["ontology"]) + add(mutual, BONUSES["mutual"])
    total = total - add(inside, PENALTIES["inside"]) - add(value_like, PENALTIES["value"]) - add(T.is_heading(t), PENALTIES["heading"]) - add(F.length(t) > LONG_LABEL, PENALTIES["long"])
    return F.when(base.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))
