"""Checks of a filled form as queries: each gives findings (severity, code, message, page, field), none if all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import rects as R
from leafmark.operators import spatial

ORDER = {"error": 0, "warning": 1, "info": 2}


def finding(severity: str, code: str, message: Column, page: Column | None = None, field: Column | None = None) -> list[Column]:
    return [F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"), (F.lit(None) if page is None else page).cast("long").alias("page"), (F.lit(None) if field is None else field).cast("string").alias("field")]


def prefix_preserved(files: DataFrame, original: str = "original", produced: str = "produced") -> DataFrame:
    """Whether the new bytes begin with the old ones, and where they part if not. files: doc, original, produced."""
    a, b = F.col(original), F.col(produced)
    # The first place at which they part, halving the stretch in which it lies.
    low, high = F.lit(0), F.least(F.length(a), F.length(b)) + 1
    steps = F.sequence(F.lit(1), F.lit(32))
    where = F.aggregate(steps, F.struct(low.alias("l"), high.alias("h")), lambda s, _: _halved(s, a, b))["l"]
    kept = b.startswith(a)
    said = F.when(kept, "original bytes are a literal prefix").otherwise(F.format_string("output diverges from the original at byte offset %d", where))
    return files.select("doc", F.when(kept, "info").otherwise("error").alias("severity"), F.when(kept, "PREFIX_PRESERVED").otherwise("PREFIX_NOT_PRESERVED").alias("code"), said.alias("message"))


def _halved(s: Column, a: Column, b: Column) -> Column:
    """One step: l bytes are known to agree, h bytes not to."""
    mid = F.floor((s["l"] + s["h"]) / 2).cast("int")
    same = F.substr(a, F.lit(1), mid) == F.substr(b, F.lit(1), mid)
    done = s["h"] - s["l"] <= 1
    return F.struct(F.when(done | ~same, s["l"]).otherwise(mid).alias("l"), F.when(done | same, s["h"]).otherwise(mid).alias("h"))


def no_overlap(fields: DataFrame, most: float = 0.10) -> DataFrame:
    """Pairs of a page's widgets that overlap. fields: page, id, r."""
    found = spatial.overlap_pairs(fields, most)
    said = F.concat(F.col("a_id").cast("string"), F.lit(" and "), F.col("b_id").cast("string"), F.lit(" overlap"))
    return found.select(*finding("error", "FIELD_OVERLAP", said, F.col("page")))


def in_bounds(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """Widgets that are not inside their page's crop box. pages: page, crop."""
    out = fields.join(pages, "page").where(~R.contains(F.col("crop"), F.col("r")))
    return out.select(*finding("error", "FIELD_OUT_OF_BOUNDS", F.concat(F.col("id").cast("string"), F.lit(" is outside its page")), F.col("page"), F.col("id")))


def names_unique(fields: DataFrame, name: str = "name") -> DataFrame:
    many = fields.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("n")).where("n > 1")
    return many.select(*finding("warning", "DUPLICATE_FIELD_NAME", F.format_string("name %s used %d times", F.col("name"), F.col("n")), None, F.col("name")))


def roundtrip(written: DataFrame, read: DataFrame) -> DataFrame:
    """What was written (name, field_type, value, max_length) and is missing or different when read again."""
    a = written.select("name", F.struct("field_type", "value", "max_length").alias("a"))
    both = a.join(read.select("name", F.struct("field_type", "value", "max_length").alias("b")), "name", "left")
    there, radio = F.col("b").isNotNull(), F.col("a.field_type") == "radio"
    cases = [
        ("error", "FIELD_MISSING", ~there, "is not there"),
        ("error", "FIELD_TYPE_MISMATCH", there & ~radio & ~F.col("a.field_type").eqNullSafe(F.col("b.field_type")), "has another type"),
        ("warning", "FIELD_VALUE_MISMATCH", there & ~radio & F.col("a.value").isNotNull() & ~F.col("a.value").eqNullSafe(F.col("b.value")), "has another value"),
        ("warning", "FIELD_MAXLEN_MISMATCH", there & F.coalesce((F.col("a.max_length") > 0) & (F.col("b.max_length") > 0) & (F.col("a.max_length") != F.col("b.max_length")), F.lit(False)), "has another length limit"),
    ]
    said = F.array_compact(F.array(*(F.when(hit, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.concat_ws(" ", "name", F.lit(text)).alias("message"))) for s, c, hit, text in cases)))
    return both.select(F.explode(said).alias("f"), "name").select("f.*", F.lit(None).cast("long").alias("page"), F.col("name").alias("field"))


def constraint_outcome(value: Column, max_chars: Column, comb_cells: Column, pattern: Column, choices: Column) -> Column:
    """The first constraint that a value breaks, null if none: length (15 % over the estimate is let pass), comb cells, pattern, choices."""
    n = F.length(value)
    return F.coalesce(
        F.when(n > 1.15 * max_chars, "longer than the field"),
        F.when(n > comb_cells, "more characters than cells"),
        F.when(~F.rlike(value, F.concat(F.lit("^(?:"), pattern, F.lit(")$"))), "does not match the pattern"),
        F.when((F.size(choices) > 0) & ~F.array_contains(choices, value), "not one of the choices"),
    )


def values_validate(fields: DataFrame, fills: DataFrame) -> DataFrame:
    """Filled values that break a constraint of their field. fields: name, max_chars, comb_cells, pattern, choices. fills: name, status, value."""
    broken = constraint_outcome(F.col("value"), F.col("max_chars"), F.col("comb_cells"), F.col("pattern"), F.col("choices"))
    joined = fills.where("status = 'filled' AND value IS NOT NULL").join(fields, "name").withColumn("broken", broken).where("broken IS NOT NULL")
    return joined.select(*finding("error", "VALUE_CONSTRAINT_VIOLATION", F.concat_ws(": ", "name", "broken"), None, F.col("name")))


def security_preserved(files: DataFrame) -> DataFrame:
    """Documents whose encryption was lost. files: doc, was_encrypted, is_encrypted."""
    return files.where("was_encrypted AND NOT is_encrypted").select("doc", *finding("error", "ENCRYPTION_LOST", F.lit("input was encrypted but output is not")))


def verify(fields: DataFrame, pages: DataFrame, written: DataFrame, read: DataFrame, constraints: DataFrame, fills: DataFrame) -> DataFrame:
    """All findings of the checks that need no file, worst first."""
    parts = [no_overlap(fields), in_bounds(fields, pages), names_unique(written), roundtrip(written, read), values_validate(constraints, fills)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(findings: DataFrame) -> DataFrame:
    """Findings by severity and code, and whether there is no error."""
    return findings.groupBy("severity", "code").agg(F.count("*").alias("n"), F.min("message").alias("example"))


def render(findings: DataFrame, most: int = 1000) -> str:
    """A report as text: the counts, then the first findings, worst first."""
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ORDER.items() for x in kv)), F.col("severity")), F.lit(9))
    counts = {r["severity"]: r["n"] for r in findings.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    shown = findings.orderBy(rank, "code", "message").limit(most).collect()
    lines = ["passed" if not counts.get("error") else "failed", ", ".join(f"{counts.get(s, 0)} {s}" for s in ORDER)]
    return "\n".join(lines + [f"[{r['severity']}] {r['code']}: {r['message']}" for r in shown])
