"""Fitting text into rectangles, by mean advances of a font."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean advance of a character as a share of the size, by font (approximate; monospaced is exact).
ADVANCE = {"Helvetica": 0.52, "Helvetica-Bold": 0.56, "Times-Roman": 0.47, "Times-Bold": 0.50, "Courier": 0.60}


def text_width(text: Column, size: Column, font: str = "Helvetica") -> Column:
    return F.length(F.coalesce(text, F.lit(""))) * size * ADVANCE[font]


def max_chars(width: Column, size: Column, font: str = "Helvetica") -> Column:
    """Characters that fit a width; null for a width or size of nothing."""
    return F.when((width > 0) & (size > 0), F.floor(width / (size * ADVANCE[font])).cast("int"))


def fit_size(text: Column, r: Column, font: str = "Helvetica", most: float = 12.0, least: float = 4.0, padding: float = 2.0) -> Column:
    """The largest size in hundredths of a point at which a line fits a rectangle, within least and most."""
    wide, high = F.abs(r["x1"] - r["x0"]) - 2 * padding, F.abs(r["y1"] - r["y0"]) - 2 * padding
    by_width = F.when(F.length(text) > 0, wide / (F.length(text) * ADVANCE[font])).otherwise(F.lit(most))
    return F.greatest(F.lit(least), F.floor(F.least(F.lit(most), by_width, high / 1.15) * 100) / 100)


def comb_cells(text: Column, r: Column, cells: int) -> Column:
    """A character and the centre of its cell for each cell filled."""
    step = (r["x1"] - r["x0"]) / cells
    chars = F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), 1, cells)
    return F.transform(chars, lambda c, i: F.struct(c.alias("char"), (r["x0"] + step * (i + 0.5)).alias("x")))


def wrap(text: str | None, most: int) -> list[str]:
    """Lines of at most so many characters, broken at blanks, long words cut."""
    out: list[str] = []
    for line in (text or "").split("\n"):
        now = ""
        for word in line.split(" "):
            while len(word) > most:
                if now:
                    out.append(now)
                    now = ""
                out.append(word[:most])
                word = word[most:]
            if now and len(now) + 1 + len(word) > most:
                out.append(now)
                now = word
            else:
                now = f"{now} {word}" if now else word
        out.append(now)
    return out


#: Bits of a field's flags, from 0 (fixed values).
FLAGS = {"read_only": 0, "required": 1, "multiline": 12, "password": 13, "radio": 15, "push_button": 16, "combo": 17, "comb": 24}


def field_flags(**set_: Column) -> Column:
    """The flags of a field from boolean columns by name."""
    total = F.lit(0)
    for name, on in set_.items():
        total = total.bitwiseOR(F.when(on, 1 << FLAGS[name]).otherwise(0))
    return total
