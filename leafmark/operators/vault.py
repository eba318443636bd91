"""Profile values: upserts, derived values, look-up in order, what a form teaches, saving and loading.

A vault has profile_id, key, value, source, confidence, sensitivity, labels_seen (array); a key once a profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.storage import dealt

SECRET = "[redacted]"
COLUMNS = ("profile_id", "key", "value", "source", "confidence", "sensitivity", "labels_seen")
#: What a derived value keeps of the confidence of its weakest part (fixed value).
DERIVED = 0.98
#: Words of a section that choose a namespace (fixed values).
SCOPES = {"billing": "billing", "shipping": "shipping", "mailing": "mailing", "employer": "employment", "spouse": "spouse"}


def put(vault: DataFrame, entries: DataFrame) -> DataFrame:
    """The vault with the entries in it, a new one in place of an old one of its profile and key."""
    old = vault.join(entries.select("profile_id", "key"), ["profile_id", "key"], "left_anti")
    return old.unionByName(entries, allowMissingColumns=True)


def from_fills(fills: DataFrame, profile_id: str = "default") -> DataFrame:
    """What a filled form teaches: its filled values with a key, the surest of each. fills: canonical_key, value, status, confidence."""
    known = fills.where("status = 'filled' AND value IS NOT NULL AND coalesce(canonical_key, '') <> ''")
    best = known.groupBy(F.col("canonical_key").alias("key")).agg(F.min(F.struct((-F.coalesce("confidence", F.lit(0.8))).alias("c"), F.col("value").alias("v"))).alias("m"))
    return best.select(F.lit(profile_id).alias("profile_id"), "key", F.col("m.v").alias("value"), F.lit("prior_form").alias("source"), (-F.col("m.c")).alias("confidence"), F.lit("normal").alias("sensitivity"), F.array().cast("array<string>").alias("labels_seen"))


def redacted(vault: DataFrame) -> DataFrame:
    """The vault without its secret values."""
    return vault.withColumn("value", F.when(F.col("sensitivity") == "secret", SECRET).otherwise(F.col("value")))


def stats(vault: DataFrame) -> DataFrame:
    """Entries by source and by sensitivity, and all: by, name, entries."""
    found = vault.groupingSets([[F.col("source")], [F.col("sensitivity")], []], "source", "sensitivity").agg(F.count("*").alias("entries"), F.grouping("source").alias("a"), F.grouping("sensitivity").alias("b"))
    return found.select(F.when(F.col("a") == 0, "source").when(F.col("b") == 0, "sensitivity").otherwise("all").alias("by"), F.coalesce("source", "sensitivity").alias("name"), "entries")


def derived(vault: DataFrame) -> DataFrame:
    """Full names, initials and full addresses that follow from a profile's parts: profile_id, key, value, confidence.

    A middle name longer than a letter is cut to one with a dot; an address needs street, town and region.
    """
    get = lambda k, c: F.max(F.when(F.col("key") == k, F.col(c)))
    parts = {"first": "person.name.first", "middle": "person.name.middle", "initial": "person.name.middle_initial", "last": "person.name.last"}
    places = {f"{p}_{n}": f"{p}.address.{k}" for p in ("person", "billing", "shipping", "mailing") for n, k in (("s1", "street_1"), ("s2", "street_2"), ("city", "city"), ("region", "region"), ("postal", "postal_code"))}
    wanted = {**parts, **places}
    # Texts are aggregated by sorting; a split of a small file may hold all profiles, so what is wanted of them is dealt first.
    held = dealt(vault.where(F.col("key").isin(*wanted.values()) & (F.col("value") != "")).select("profile_id", "key", "value", "confidence"), "profile_id")
    wide = held.groupBy("profile_id").agg(*(get(k, "value").alias(n) for n, k in wanted.items()), *(get(k, "confidence").alias(f"{n}_c") for n, k in wanted.items()))
    c = F.col
    middle = F.coalesce("initial", "middle")
    short = F.when(F.length(middle) > 1, F.concat(F.substring(middle, 1, 1), F.lit("."))).otherwise(middle)
    named = c("first").isNotNull() & c("last").isNotNull()
    sure = lambda *names: F.round(F.least(*(c(f"{n}_c") for n in names)) * DERIVED, 4)
    rows = [
        F.when(named, F.struct(F.lit("person.name.full").alias("key"), F.concat_ws(" ", "first", short, "last").alias("value"), sure("first", "last").alias("confidence"))),
        F.when(named, F.struct(F.lit("person.name.initials").alias("key"), F.upper(F.concat(F.substring("first", 1, 1), F.substring("last", 1, 1))).alias("value"), sure("first", "last").alias("confidence"))),
    ]
    for p in ("person", "billing", "shipping", "mailing"):
        whole = c(f"{p}_s1").isNotNull() & c(f"{p}_city").isNotNull() & c(f"{p}_region").isNotNull()
        text = F.concat_ws(", ", f"{p}_s1", f"{p}_s2", f"{p}_city", F.concat_ws(" ", f"{p}_region", f"{p}_postal"))
        rows.append(F.when(whole, F.struct(F.lit(f"{p}.address.full").alias("key"), text.alias("value"), sure(f"{p}_s1", f"{p}_city", f"{p}_region").alias("confidence"))))
    return wide.select("profile_id", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("profile_id", "r.*")


def scoped_key(key: Column, context: Column) -> Column:
    """The key in the namespace that the first telling word of its sections names; null if none does."""
    scopes = F.create_map(*(F.lit(x) for kv in SCOPES.items() for x in kv))
    named = F.filter(F.transform(context, lambda w: F.try_element_at(scopes, F.lower(F.trim(w)))), lambda p: p.isNotNull())
    return F.when(F.size(named) > 0, F.concat(F.get(named, F.lit(0)), F.lit("."), F.regexp_replace(key, r"^[^.]+\.", "")))


def resolve(fields: DataFrame, vault: DataFrame) -> DataFrame:
    """Each field (profile_id, field, key, context) with its value, confidence and the step that found it: scoped, exact or derived.

    A vault may be far larger than the file that it comes from, so it is never broadcast.
    """
    entries = vault.select("profile_id", "key", F.struct("value", "confidence").alias("e"))
    ready = fields.withColumn("scoped", scoped_key(F.col("key"), F.col("context")))
    names = [("s", "scoped", entries), ("x", "key", entries), ("d", "key", derived(vault).select("profile_id", "key", F.struct("value", "confidence").alias("e")))]
    for name, on, table in names:
        side = table.select(F.col("profile_id").alias(f"p_{name}"), F.col("key").alias(f"k_{name}"), F.col("e").alias(name)).hint("merge")
        ready = ready.join(side, (F.col("profile_id") == F.col(f"p_{name}")) & (F.col(on) == F.col(f"k_{name}")), "left").drop(f"p_{name}", f"k_{name}")
    found = F.coalesce("s", "x", "d")
    step = F.when(F.col("s").isNotNull(), "scoped").when(F.col("x").isNotNull(), "exact").when(F.col("d").isNotNull(), "derived")
    return ready.select("profile_id", "field", found["value"].alias("value"), found["confidence"].alias("confidence"), step.alias("step"))


def suggest_key(vault: DataFrame, labels: DataFrame) -> DataFrame:
    """The first key (by name) that each label was seen to name: label, key."""
    seen = vault.select("key", F.explode("labels_seen").alias("seen")).select("key", F.lower(F.trim("seen")).alias("norm"))
    own = labels.select("label", F.lower(F.trim("label")).alias("norm")).where("norm <> ''")
    return own.join(seen, "norm").groupBy("label").agg(F.min("key").alias("key"))


def save(vault: DataFrame, path: str, passphrase: str | None = None) -> None:
    """Writes a vault as Parquet; with a passphrase, values are sealed (AES-GCM under a key derived from it)."""
    if passphrase is not None:
        vault = vault.withColumn("value", F.base64(F.aes_encrypt("value", F.unhex(F.sha2(F.lit(passphrase), 256)), F.lit("GCM"), F.lit("DEFAULT"))))
    vault.select(*COLUMNS).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, passphrase: str | None = None) -> DataFrame:
    """Reads a vault; a wrong passphrase is an error when rows are read."""
    vault = spark.read.parquet(path)
    if passphrase is None:
        return vault
    return vault.withColumn("value", F.aes_decrypt(F.unbase64("value"), F.unhex(F.sha2(F.lit(passphrase), 256)), F.lit("GCM"), F.lit("DEFAULT")).cast("string"))


def best_entry(vault: DataFrame) -> DataFrame:
    """The surest entry of each profile and key, ties to the smaller value."""
    order = Window.partitionBy("profile_id", "key").orderBy(F.desc("confidence"), "value")
    return vault.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
