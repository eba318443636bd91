"""Scores, votes, repeats and filling: decisions made by aggregates, windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.operators.runs import numbered

#: Evidence buckets and their weights (fixed values).
SCORE_WEIGHTS = {"geometric": 0.30, "blank_region": 0.20, "nearby_label": 0.15, "layout": 0.10, "repeated": 0.10, "semantic": 0.10, "model": 0.05}
#: Weights of the confidence axes (fixed values).
AXES = {"geometry": 0.35, "label_link": 0.25, "semantic_type": 0.25, "autofill_value": 0.15}
NOISY_CAP = 0.999


def normalized_weights(weights: dict[str, float]) -> dict[str, float]:
    """The weights of the buckets scaled to sum 1: negative ones count as 0, and if none is left all are equal."""
    values = {name: max(0.0, weights.get(name, 0.0)) for name in SCORE_WEIGHTS}
    total = sum(values.values())
    return {name: v / total if total else 1 / len(values) for name, v in values.items()}


def fused_score(buckets: dict[str, Column], weights: dict[str, float] = SCORE_WEIGHTS) -> Column:
    """Weighted sum of a candidate's bucket scores, each within 0 and 1."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + weight * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(buckets[name], F.lit(0.0))))
    return total


def overall_confidence(axes: dict[str, Column]) -> Column:
    """Weighted geometric mean of the axes above zero; 0 if there is none."""
    logs, weights = F.lit(0.0), F.lit(0.0)
    for name, weight in AXES.items():
        there = F.coalesce(axes[name], F.lit(0.0)) > 0
        logs = logs + F.when(there, weight * F.ln(axes[name])).otherwise(0.0)
        weights = weights + F.when(there, weight).otherwise(0.0)
    return F.when(weights > 0, F.exp(logs / weights)).otherwise(0.0)


def noisy_or(df: DataFrame, key: list[str], signature: list[str], score: str) -> DataFrame:
    """1 - prod(1 - best score of each distinct signature) per key, capped, and at least the best."""
    best = df.groupBy(*key, *signature).agg(F.max(score).alias("s"))
    out = best.groupBy(*key).agg(F.product(1 - F.col("s")).alias("rest"), F.max("s").alias("top"), F.count("*").alias("signatures"))
    return out.select(*key, "signatures", F.greatest("top", F.least(F.lit(NOISY_CAP), 1 - F.col("rest"))).alias("combined"))


# votes -----------------------------------------------------------------------------


def tally(votes: DataFrame, unknown: str = "unknown") -> DataFrame:
    """Per question the winning answer, its consensus and confidence, and who dissents.

    votes: question, member, answer, confidence. An answer weighs the sum of its
    confidences; ties go to the larger single confidence, then to the smaller
    answer. Unknown answers weigh in the total but cannot win. A question with no
    answer but unknown ones has a null answer and confidence 0.
    """
    by_answer = votes.groupBy("question", "answer").agg(F.sum("confidence").alias("weight"), F.max("confidence").alias("best"), F.avg("confidence").alias("mean"), F.count("*").alias("n"))
    known = F.coalesce(F.col("answer"), F.lit(unknown)) != unknown
    rank = F.when(known, F.struct((-F.col("weight")).alias("w"), (-F.col("best")).alias("b"), F.col("answer").alias("answer"), F.col("mean").alias("mean"), F.col("n").alias("n")))
    total = by_answer.groupBy("question").agg(F.sum("weight").alias("total"), F.sum("n").alias("votes"), F.min(rank).alias("top"), F.sum(known.cast("long")).alias("answers"))
    sound = F.col("top").isNotNull() & (F.col("total") > 0)
    consensus = F.when(sound, -F.col("top.w") / F.col("total")).otherwise(0.0)
    return total.select(
        "question", "votes", "answers",
        F.when(sound, F.col("top.answer")).alias("answer"),
        consensus.alias("consensus"),
        F.when(sound, F.col("top.mean") * consensus).otherwise(0.0).alias("confidence"),
        F.when(sound, F.col("votes") - F.col("top.n")).otherwise(0).alias("dissent"),
    )


def contradictions(votes: DataFrame) -> DataFrame:
    """Members that gave one question different answers."""
    out = votes.groupBy("question", "member").agg(F.count_distinct("answer").alias("answers"))
    return out.where("answers > 1")


def second_round(votes: DataFrame, least: float = 0.80) -> DataFrame:
    """Votes of questions whose first verdict falls short, to be put again."""
    weak = tally(votes).where(F.col("confidence") < least).select("question")
    return votes.join(weak, "question", "left_semi")


# repeats ----------------------------------------------------------------------------


def repeat_groups(fields: DataFrame) -> DataFrame:
    """Groups of two or more fields with one canonical key or, lacking keys, one label: kind, name, members, pages.

    fields: id, page, canonical_key, label.
    """
    keyed = F.col("canonical_key").isNotNull()
    named = fields.withColumns({"kind": F.when(keyed, "key").otherwise("label"), "name": F.coalesce("canonical_key", "label")}).where("name IS NOT NULL AND name <> ''")
    out = named.groupBy("kind", "name").agg(F.count("*").alias("members"), F.count_distinct("page").alias("pages"), F.min("id").alias("first_id"))
    return out.where("members >= 2")


def repeat_score(n: Column) -> Column:
    """Evidence from n equal fields: .6 for two, .1 for each more, .95 at most."""
    return F.least(F.lit(0.95), 0.6 + 0.1 * (n - 2))


def inconsistent(values: DataFrame, group: str, value: str) -> DataFrame:
    """Groups whose non-null values differ, with the distinct ones in order."""
    out = values.where(F.col(value).isNotNull()).groupBy(group).agg(F.sort_array(F.collect_set(value)).alias("found"))
    return out.where(F.size("found") >= 2)


def propagate(fills: DataFrame, group: str) -> DataFrame:
    """Each member of a group with its winner's value: filled first, then confidence, then name.

    fills: field, value, confidence, status. Adds winner_value and group_confidence.
    """
    usable = fills.where("value IS NOT NULL AND value <> ''")
    win = usable.groupBy(group).agg(
        F.min(F.struct((F.col("status") != "filled").alias("late"), (-F.col("confidence")).alias("c"), F.col("field").alias("f"), F.col("value").alias("v"))).alias("w"),
        F.max("confidence").alias("group_confidence"),
    )
    return fills.join(win.select(group, F.col("w.v").alias("winner_value"), "group_confidence"), group, "left")


# filling ------------------------------------------------------------------------------

CONSERVATIVE, COMPLETION = 0.90, 0.55


def autofill(fields: DataFrame, vault: DataFrame, mode: str = "conservative", valid: Column | None = None, blocked: Column | None = None) -> DataFrame:
    """Fields joined to the vault by key, with status, value and confidence.

    fields: field, field_type, canonical_key. vault: key, value, confidence, unique by
    key. A signature field is a policy boundary and is never filled; then come a
    missing entry, a blocked key, an invalid value, and confidence below the mode's
    threshold.
    """
    least = CONSERVATIVE if mode == "conservative" else COMPLETION
    valid = F.lit(True) if valid is None else valid
    blocked = F.lit(False) if blocked is None else blocked
    joined = fields.join(vault, fields["canonical_key"] == vault["key"], "left")
    status = (
        F.when(F.col("field_type") == "signature", "policy_blocked")
        .when(F.lit(mode == "off") | F.col("key").isNull(), "unavailable")
        .when(blocked, "policy_blocked")
        .when(~F.coalesce(valid, F.lit(False)), "invalid")
        .when(F.col("confidence") < least, "low_confidence")
        .otherwise("filled")
    )
    out = joined.withColumn("status", status)
    return out.withColumn("value", F.when(F.col("status") == "filled", F.col("value"))).withColumn("confidence", F.when(F.col("status").isin("filled", "low_confidence"), F.col("confidence")).otherwise(0.0))


def merge_vaults(ours: DataFrame, theirs: DataFrame, prefer: str = "higher_confidence") -> DataFrame:
    """Union of two vaults by key; where both have one: ours, theirs or the higher confidence (ours on a tie)."""
    a = ours.select("key", F.struct("value", "confidence").alias("a"))
    b = theirs.select("key", F.struct("value", "confidence").alias("b"))
    both = a.join(b, "key", "full_outer")
    take_b = {"self": F.col("a").isNull(), "other": F.col("b").isNotNull(), "higher_confidence": F.col("a").isNull() | F.coalesce(F.col("b.confidence") > F.col("a.confidence"), F.lit(False))}[prefer]
    chosen = F.when(take_b, F.col("b")).otherwise(F.col("a"))
    return both.select("key", chosen["value"].alias("value"), chosen["confidence"].alias("confidence"), F.when(take_b, "other").otherwise("self").alias("origin"))


def deduped_names(df: DataFrame, name: str, order: list) -> DataFrame:
    """Adds unique_name: the second and later rows of a name get _1, _2 and so on."""
    unique = F.when(F.col("at") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), F.col("at").cast("string")))
    return numbered(df, order, [name]).withColumn("unique_name", unique).drop("at", "n")
