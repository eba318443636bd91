"""What kind of page and document this is, from counts of what a page holds, as Column expressions and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the triage (fixed values).
MIN_TEXT, MIN_VECTOR, RASTER_SHARE, HYBRID_SHARE, POOR_VECTOR = 8, 4, 0.6, 0.25, 12
FORM_RULES, FORM_MARKERS, FORM_BOXES = 3, 2, 3
#: Words that mark a form (fixed values).
MARKERS = {
    "name": "names?", "address": "address(es)?", "date": "dates?", "signature": "signatures?", "phone": "phone", "email": "e-?mail", "city": "city",
    "state": "state", "zip": "zip", "title": "title", "please print": r"please\s+print", "check one": r"check\s+one",
}
SCANNED = ("scanned_form", "scanned_document")
#: Bits of a permission word, counted from 1 (fixed values).
PRINT, MODIFY, EXTRACT, ANNOTATE, FILL, ACCESS, ASSEMBLE, PRINT_HIGH = 3, 4, 5, 6, 9, 10, 11, 12


def marker_hits(text: Column) -> Column:
    """The form markers that stand in a text, in their listed order."""
    return F.array_compact(F.array(*(F.when(text.rlike(rf"(?i)\b{p}\b"), F.lit(name)) for name, p in MARKERS.items())))


def has_form_cues(rules: Column, boxes: Column, text: Column) -> Column:
    """Enough thin rules, enough small boxes, or enough marker words."""
    return (rules >= FORM_RULES) | (boxes >= FORM_BOXES) | (F.size(marker_hits(text)) >= FORM_MARKERS)


def has_native_text(chars: Column, visible: Column) -> Column:
    return (chars >= MIN_TEXT) & visible


def has_vector(operators: Column) -> Column:
    return operators >= MIN_VECTOR


def page_mode(widgets: Column, native: Column, vector: Column, raster: Column, operators: Column, image_share: Column, cues: Column) -> Column:
    """A page's mode: the first row of the triage that holds."""
    image = raster & (image_share > RASTER_SHARE)
    return (
        F.when(widgets, "interactive_form")
        .when(~(native | vector | raster), "empty")
        .when(image & ~native & (operators <= POOR_VECTOR), "scanned_form")
        .when(image & ~cues, "scanned_document")
        .when(raster & native & (image_share > HYBRID_SHARE), "hybrid")
        .when(native & cues, "flat_native_form")
        .when(raster & ~native, F.when(cues, "scanned_form").otherwise("scanned_document"))
        .otherwise("native_document")
    )


def wants_raster(native: Column, raster: Column, mode: Column) -> Column:
    """True if a page has to be read from its pixels: never with native text."""
    return ~native & (raster | mode.isin(*SCANNED))


def has_permission(word: Column, bit: int) -> Column:
    """True if a permission word, signed or not, grants a bit; no bit outside 1 to 32 is granted."""
    return F.shiftright(word.cast("long"), bit - 1).bitwiseAND(1) == 1 if 1 <= bit <= 32 else F.lit(False)


def can_add_fields(encrypted: Column, authenticated: Column, word: Column, certified: Column) -> Column:
    """struct(allowed, reason): certification first, then encryption and what its permissions grant."""
    reason = (
        F.when(F.coalesce(certified, F.lit(0)) == 1, "certified against changes")
        .when(encrypted & ~authenticated, "not authenticated")
        .when(encrypted & ~has_permission(word, MODIFY) & ~has_permission(word, ANNOTATE), "permissions do not allow it")
    )
    return F.struct(reason.isNull().alias("allowed"), F.coalesce(reason, F.lit("")).alias("reason"))


def documents(pages: DataFrame, key: str) -> DataFrame:
    """One row for each document: pages, how many are of each mode, and which layers any page has."""
    modes = ("interactive_form", "empty", *SCANNED, "hybrid", "flat_native_form", "native_document")
    flags = ("native", "vector", "raster", "widgets")
    return pages.groupBy(key).agg(F.count("*").alias("pages"), *(F.count_if(F.col("mode") == m).alias(m) for m in modes), *(F.bool_or(f).alias(f) for f in flags))


def majority_class() -> Column:
    """A document's class from its counts of page modes."""
    scan, flat, hybrid, other = (F.col(c) for c in ("scanned_form", "flat_native_form", "hybrid", "scanned_document"))
    return (
        F.when(scan + flat + hybrid == 0, "non_form")
        .when((hybrid > 0) & (hybrid >= F.greatest(scan, flat)), "hybrid")
        .when((flat > 0) & (scan + other + hybrid > 0), "hybrid")
        .when(scan >= flat, "scanned_form")
        .otherwise("flat_native_form")
    )


def route(encrypted: Column, can_modify: Column, signed: Column, dynamic_xfa: Column, widgets: Column, acroform: Column, xfa: Column, fields: Column) -> Column:
    """A document's class: security before signatures, XFA, an existing form, and what its pages are."""
    form = widgets | (acroform & (xfa | (F.coalesce(fields, F.lit(0)) > 0)))
    return F.when(encrypted & ~can_modify, "encrypted").when(signed, "signed").when(dynamic_xfa, "xfa").when(form, "existing_acroform").otherwise(majority_class())


def describe() -> Column:
    """A line on a document's profile."""
    return F.format_string("%s: %d pages, %d of them scanned", F.col("class"), F.col("pages"), F.col("scanned_form") + F.col("scanned_document"))
