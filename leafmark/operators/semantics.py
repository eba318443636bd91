"""What a field means: its key by a cascade of readings of its label, and its type by signals that add up.

Fields have page, id, label, parents (array, outermost first) and nearby (array of texts).
The table of keys is our own and small; a caller may pass a larger one of the same form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions import patterns as P
from leafmark.functions import text as T
from leafmark.operators import decide, labels

#: key: field type, label, sensitivity, normalizer, validator and parents.
KEYS = {
    "person.name.full": ("text", "Full name", "personal", "name_case", "nonempty", ("applicant", "person")), "person.name.first": ("text", "First name", "personal", "name_case", "nonempty", ("applicant", "person")),
    "person.name.last": ("text", "Last name", "personal", "name_case", "nonempty", ("applicant", "person")), "person.birth_date": ("date", "Date of birth", "personal", "date_mdy", "date", ("person",)),
    "person.email": ("email", "Email", "personal", "lower", "email", ("contact",)), "person.phone": ("phone", "Phone", "personal", "phone_us", "phone_us", ("contact",)), "person.ssn": ("text", "Social security number", "secret", "ssn", "ssn", ("person",)),
    "person.address.street": ("text", "Street address", "personal", "title", "nonempty", ("address", "home")), "person.address.city": ("text", "City", "personal", "title", "nonempty", ("address", "home")), "person.address.zip": ("text", "Zip code", "personal", "zip5", "zip_us", ("address", "home")),
    "person.address.state": ("text", "State", "personal", "state_abbrev", "nonempty", ("address", "home")), "person.signature": ("signature", "Signature", "personal", "strip_ws", "nonempty", ("signature",)),
    "billing.address.street": ("text", "Billing street", "personal", "title", "nonempty", ("billing",)), "billing.address.city": ("text", "Billing city", "personal", "title", "nonempty", ("billing",)), "billing.address.zip": ("text", "Billing zip code", "personal", "zip5", "zip_us", ("billing",)),
    "employment.employer": ("text", "Employer", "normal", "title", "nonempty", ("employment",)), "employment.title": ("text", "Job title", "normal", "title", "nonempty", ("employment",)), "employment.income": ("currency", "Annual income", "personal", "currency", "nonempty", ("employment",)),
    "employment.phone": ("phone", "Work phone", "normal", "phone_us", "phone_us", ("employment",)), "company.name": ("text", "Company name", "normal", "title", "nonempty", ("company",)), "company.website": ("text", "Website", "normal", "lower", "nonempty", ("company",)),
    "company.tax_id.ein": ("text", "Tax ID", "secret", "ein", "ein", ("company",)), "bank.account_number": ("text", "Account number", "secret", "digits_only", "nonempty", ("bank",)), "bank.routing_number": ("text", "Routing number", "secret", "digits_only", "routing_aba", ("bank",)),
    "card.number": ("text", "Card number", "secret", "credit_card", "luhn", ("card",)), "card.expiration": ("text", "Expiration", "secret", "strip_ws", "nonempty", ("card",)), "document.today": ("date", "Date", "normal", "date_mdy", "date", ("document",)), "document.amount": ("currency", "Amount", "normal", "currency", "nonempty", ("document",)),
}
#: Normalized labels and the keys they name, beside the keys' own labels.
ALIASES = {
    "name": "person.name.full", "given name": "person.name.first", "surname": "person.name.last", "birth date": "person.birth_date", "e mail": "person.email", "email address": "person.email", "phone number": "person.phone", "telephone": "person.phone",
    "address": "person.address.street", "street": "person.address.street", "town": "person.address.city", "zip": "person.address.zip", "postal code": "person.address.zip", "business phone": "employment.phone", "occupation": "employment.title", "salary": "employment.income",
    "ein": "company.tax_id.ein", "company": "company.name", "account no": "bank.account_number", "ssn": "person.ssn", "total": "document.amount", "billing address": "billing.address.street",
} | {label.lower(): key for key, (_, label, *_) in KEYS.items()}
#: Words of a section that choose a namespace for the keys below it.
CONTEXTS = {"billing": "billing", "bill to": "billing", "employment": "employment", "employer": "employment", "work": "employment", "company": "company", "business": "company"}
#: Scores of the steps of the cascade (fixed values).
EXACT, CONTEXT, NEIGHBOUR, PLACEHOLDER, CONCAT, INFERENCE, FUZZY, SIBLING = 0.97, 0.95, 0.93, 0.90, 0.88, 0.82, 0.85, 0.70
FUZZY_CUTOFF, MARGIN = 0.86, 0.08
#: Labels that mean what stands around them, and what each namespace makes of them.
AMBIGUOUS = {"number": {"card": "card.number", "bank": "bank.account_number", "person": "person.phone"}, "address": {"company": "company.website"}, "date": {"card": "card.expiration"}}
REPEATABLE = ("signature", "initials", "date", "page_number")
#: Strengths of signals of a type (fixed values).
LABEL, HEIGHT, CURRENCY, CHOICE, KEYWORD, GEOMETRY, DEFAULT, OF_PATTERN = 0.78, 0.70, 0.80, 0.65, 0.45, 0.95, 0.40, 0.9
MULTILINE = 2.2
DRAWN = ("checkbox", "radio", "comb", "signature", "button", "listbox")
CHOICE_WORDS = ("check one", "select one", "choose one", "mark one", "check all", "select all", "circle one")
KEYWORDS = (
    (r"\b(date|dob|birthday|expiry|expiration|issued)\b", "date"), (r"\be[- ]?mail\b", "email"), (r"\b(phone|telephone|mobile|cell|fax)\b", "phone"), (r"\b(amount|total|salary|income|price|fee|payment|balance|cost|wage)\b", "currency"),
    (r"\b(number|quantity|qty|count|age|years|percent|percentage)\b", "number"), (r"\b(comments?|remarks?|notes?|description|explain|details?|address\s+2)\b", "multiline_text"),
)
#: Field types in the order that decides ties (fixed values).
TYPES = ("text", "multiline_text", "checkbox", "radio", "choice", "listbox", "signature", "date", "number", "currency", "email", "phone", "comb", "button", "unknown")


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def _map_int(names: tuple[str, ...]) -> Column:
    return F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i)))


def keys(spark: SparkSession) -> DataFrame:
    """The registry of keys: key, namespace, field_type, label, sensitivity, normalizer, validator, parents."""
    rows = [(k, k.split(".")[0], *v[:5], list(v[5])) for k, v in KEYS.items()]
    return spark.createDataFrame(rows, "key string, namespace string, field_type string, label string, sensitivity string, normalizer string, validator string, parents array<string>")


def children(registry: DataFrame, prefix: str) -> DataFrame:
    return registry.where(F.col("key").startswith(f"{prefix}."))


def with_parent(registry: DataFrame, parent: str) -> DataFrame:
    return registry.where(F.array_contains("parents", parent))


def aliases(spark: SparkSession) -> DataFrame:
    """alias, key: how many there are and which name a key are a count and a filter."""
    return spark.createDataFrame(sorted(ALIASES.items()), "alias string, key string")


def secret_key_for(name: Column) -> Column:
    """The secret key that a name is or names, or null."""
    secret = [k for k, v in KEYS.items() if v[2] == "secret"]
    own = F.trim(name)
    found = F.when(own.isin(*secret), own).otherwise(lookup(own))
    return F.when(found.isin(*secret), found)


def lookup(label: Column) -> Column:
    """The key of the first form of a label that is an alias."""
    table = _map(ALIASES)
    return P.let(T.normalize_label(label), lambda n: F.coalesce(*(F.try_element_at(table, f) for f in labels.rewrites(n))))


def context_lookup(label: Column, parents: Column) -> Column:
    """The label's key in the namespace of the innermost section that names one, if there is such a key; else the plain one."""
    spaces = _map(CONTEXTS)
    named = F.reverse(F.filter(F.transform(parents, lambda p: F.try_element_at(spaces, T.normalize_label(p))), lambda s: s.isNotNull()))
    moved = lambda base: F.transform(named, lambda s: F.concat(s, F.lit("."), F.regexp_replace(base, r"^[^.]+\.", "")))
    return P.let(lookup(label), lambda base: F.coalesce(F.get(F.filter(moved(base), lambda k: k.isin(*KEYS)), F.lit(0)), base))


def disambiguate(label: Column, nearby: Column) -> Column:
    """The key of an ambiguous label by the namespace that most of the texts nearby belong to, if two or more do."""
    spaces = F.transform(nearby, lambda t: F.substring_index(P.let(t, lookup), ".", 1))

    def vote(space: str, key: str, all_: Column) -> Column:
        return F.struct((-F.size(F.filter(all_, lambda s: s == space))).alias("votes"), F.lit(space).alias("space"), F.lit(key).alias("key"))

    def read(x: Column) -> Column:
        found = []
        for word, choices in AMBIGUOUS.items():
            top = P.let(F.array_min(F.array(*(vote(n, k, x["spaces"]) for n, k in choices.items()))), lambda m: F.when(m["votes"] <= -2, m["key"]))
            found.append(F.when(x["label"] == word, top))
        return F.coalesce(*found)

    return P.let(F.struct(T.normalize_label(label).alias("label"), spaces.alias("spaces")), read)


def _read(key: Column, score: float | Column, reason: Column | str) -> Column:
    score = F.lit(score) if isinstance(score, float) else score
    return F.when(key.isNotNull(), F.struct(key.alias("key"), score.cast("double").alias("score"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason")))


def canonicalize(fields: DataFrame) -> DataFrame:
    """Adds canonical_key, key_score and key_reason: the first step of the cascade that tells a key.

    A section's namespace, the texts around an ambiguous label, the alias itself, a
    placeholder nearby, the label and a section together, what the texts nearby tell, and
    aliases that are spelt much alike.
    """
    c = F.col
    ready = fields.withColumns({"_base": lookup(c("label")), "_scoped": context_lookup(c("label"), c("parents"))})
    ready = ready.withColumn("_flip", disambiguate(c("label"), c("nearby")))
    printed = F.filter(F.transform("nearby", lambda t: P.match_bare(t, "placeholder")), lambda r: r["canonical_key"].isNotNull())
    printed = F.array_min(F.transform(printed, lambda r: F.struct((-r["confidence"]).alias("c"), r["name"].alias("n"), r["canonical_key"].alias("k"))))
    ready = ready.withColumns({"_printed": printed, "_inferred": P.infer(c("_base"), c("nearby"))})
    printed, inferred = c("_printed"), c("_inferred")
    glued = F.filter(F.flatten(F.transform(F.reverse("parents"), lambda p: F.array(lookup(F.concat_ws(" ", p, "label")), lookup(F.concat_ws(" ", "label", p))))), lambda k: k.isNotNull())
    steps = [
        _read(F.when(~c("_scoped").eqNullSafe(c("_base")), c("_scoped")), CONTEXT, "context_alias"),
        _read(F.when(~c("_flip").eqNullSafe(c("_base")), c("_flip")), NEIGHBOUR, "neighbour_disambiguation"),
        _read(c("_base"), EXACT, "exact_alias"),
        _read(printed["k"], PLACEHOLDER, F.concat(F.lit("pattern:"), printed["n"])),
        _read(F.get(glued, F.lit(0)), CONCAT, "label_context_concat"),
        _read(inferred["canonical_key"], INFERENCE, F.concat(F.lit("inferred:"), inferred["name"])),
    ]
    read = ready.withColumn("_read", F.coalesce(*steps))
    open_ = read.where(F.col("_read").isNull() & (F.trim(F.coalesce("label", F.lit(""))) != "")).select("label").distinct()
    named = open_.select(F.xxhash64("label").alias("id"), "label")
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("canonical_key").alias("k")))
    alike = labels.fuzzy_lookup(named, ALIASES, FUZZY_CUTOFF).groupBy("id").agg(best.alias("m"))
    alike = named.join(alike, "id").select(F.col("label").alias("_label"), F.col("m.k").alias("_k"), F.round(-F.col("m.s") / 1000 * FUZZY, 6).alias("_s"))
    joined = read.join(alike, read["label"] == alike["_label"], "left")
    final = F.coalesce("_read", _read(c("_k"), c("_s"), "fuzzy_alias"))
    return joined.select(*fields.columns, final["key"].alias("canonical_key"), F.coalesce(final["score"], F.lit(0.0)).alias("key_score"), F.coalesce(final["reason"], F.lit("unresolved")).alias("key_reason"))


def without_conflicts(fields: DataFrame) -> DataFrame:
    """A page's weaker claims of one key, by MARGIN or more, lose it; keys that may repeat, and fields of one label, keep theirs."""
    leaf = F.substring_index("canonical_key", ".", -1)
    best = fields.where(F.col("canonical_key").isNotNull() & ~leaf.isin(*REPEATABLE)).groupBy("page", "canonical_key").agg(F.min(F.struct((-F.col("key_score")).alias("s"), F.col("id").alias("id"), T.normalize_label(F.col("label")).alias("l"))).alias("best"))
    both = fields.join(best, ["page", "canonical_key"], "left")
    weak = (F.round(-F.col("best.s") - F.col("key_score"), 9) >= MARGIN) & (T.normalize_label(F.col("label")) != F.col("best.l"))
    lost = F.coalesce(weak, F.lit(False))
    kept = {"canonical_key": F.when(~lost, F.col("canonical_key")), "key_score": F.when(lost, 0.0).otherwise(F.col("key_score")), "key_reason": F.when(lost, F.concat(F.lit("conflicts_with:"), F.col("best.id").cast("string"))).otherwise(F.col("key_reason"))}
    return both.select(*(kept.get(c, F.col(c)).alias(c) for c in fields.columns))


def infer_type(label: Column, parents: Column, drawn: Column, height: Column, line: Column, nearby: Column, currency_left: Column, marks: Column) -> Column:
    """struct(field_type, confidence): what is drawn counts by itself; else the type whose independent signals are strongest together."""
    kinds = _map({k: v[0] for k, v in KEYS.items()})
    signal = lambda kind, strength: F.struct(kind.alias("kind"), strength.cast("double").alias("strength"))
    one = lambda test, kind, strength: F.when(test, signal(F.lit(kind), F.lit(strength)))
    own = F.try_element_at(kinds, context_lookup(label, parents))
    rule = F.array_min(F.transform(F.filter(F.transform(nearby, lambda t: P.match_bare(t, "placeholder")), lambda r: r.isNotNull()), lambda r: F.struct((-r["confidence"]).alias("c"), r["name"].alias("n"), r["field_type"].alias("k"))))
    low = F.lower(F.coalesce(label, F.lit("")))
    choice = marks >= 2
    for words in CHOICE_WORDS:
        choice = choice | low.contains(words)
    of_key, of_rule = P.let(own, lambda k: F.when(k.isNotNull(), signal(k, F.lit(LABEL)))), P.let(rule, lambda r: F.when(r.isNotNull(), signal(r["k"], -r["c"] * OF_PATTERN)))
    first = F.array_compact(F.array(of_key, of_rule, one(height > MULTILINE * line, "multiline_text", HEIGHT), one(currency_left, "currency", CURRENCY), one(choice, "choice", CHOICE)))
    word = F.coalesce(*(F.when(low.rlike(p), F.lit(k)) for p, k in KEYWORDS))
    by_word = P.let(word, lambda w: F.when(w.isNotNull(), F.array(signal(w, F.lit(KEYWORD)))).otherwise(F.array().cast("array<struct<kind:string,strength:double>>")))
    found = P.let(first, lambda a: F.when(F.exists(a, lambda s: s["kind"] != "text"), a).otherwise(F.concat(a, by_word)))
    order = _map_int(TYPES)
    rest = lambda a, kind: F.aggregate(F.filter(a, lambda s: s["kind"] == kind), F.lit(1.0), lambda acc, s: acc * (1 - s["strength"]))
    scored = lambda a: F.transform(F.array_distinct(F.transform(a, lambda s: s["kind"])), lambda k: F.struct(rest(a, k).alias("rest"), F.try_element_at(order, k).alias("order"), k.alias("kind")))
    by_signal = P.let(P.let(found, lambda a: F.array_min(scored(a))), lambda top: F.when(top.isNotNull(), F.struct(top["kind"].alias("field_type"), F.round(1 - top["rest"], 6).alias("confidence"))))
    default = F.struct(F.when(F.coalesce(drawn, F.lit("unknown")) == "unknown", "text").otherwise(drawn).alias("field_type"), F.lit(DEFAULT).alias("confidence"))
    return F.when(drawn.isin(*DRAWN), F.struct(drawn.alias("field_type"), F.lit(GEOMETRY).alias("confidence"))).otherwise(F.coalesce(by_signal, default))


#: The voters on a field's key: each reads it by one of the steps.
VOTERS = ("rules", "heuristic", "ontology_fuzzy", "sibling_consensus")


def votes(fields: DataFrame) -> DataFrame:
    """question (page/id), member, answer and confidence of the local voters on each field's key; unknown if a voter cannot tell.

    Rules go by the alias and sections, the heuristic by texts nearby, the fuzzy voter by
    aliases spelt alike, and siblings by the commonest key of the page's fields of that label.
    """
    c = F.col
    question = F.concat_ws("/", "page", "id")
    read = canonicalize(fields)
    inferred = P.infer(F.lit(None).cast("string"), c("nearby"))
    peers = read.where(c("canonical_key").isNotNull()).groupBy(T.normalize_label(c("label")).alias("norm"), "canonical_key").agg(F.count("*").alias("n"))
    common = peers.groupBy("norm").agg(F.min(F.struct((-c("n")).alias("n"), c("canonical_key").alias("k"))).alias("m")).where("m.n <= -2").select("norm", c("m.k").alias("_peer"))
    ready = read.withColumn("norm", T.normalize_label(c("label"))).join(common, "norm", "left")
    answer = lambda key, sure: F.struct(F.coalesce(key, F.lit("unknown")).alias("answer"), F.when(key.isNotNull(), sure).otherwise(0.0).alias("confidence"))
    said = {"rules": answer(context_lookup(c("label"), c("parents")), F.lit(EXACT)), "heuristic": answer(inferred["canonical_key"], inferred["confidence"]), "ontology_fuzzy": answer(F.when(c("key_reason") == "fuzzy_alias", c("canonical_key")), c("key_score")), "sibling_consensus": answer(c("_peer"), F.lit(SIBLING))}
    rows = F.array(*(F.struct(F.lit(m).alias("member"), said[m].alias("v")) for m in VOTERS))
    return ready.select(question.alias("question"), F.explode(rows).alias("r")).select("question", "r.member", "r.v.answer", "r.v.confidence")


def deliberate(fields: DataFrame, least: float = 0.80) -> DataFrame:
    """The verdict on each field's key; answers of less than least confidence are withdrawn (null)."""
    out = decide.tally(votes(fields))
    return out.withColumn("answer", F.when(F.col("confidence") >= least, F.col("answer")))
