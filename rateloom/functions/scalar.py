"""Name keys, label and height parsing, odds and clamps as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dropped from the end of names (fixed values).
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def name_key(name: Column, *more: Column) -> Column:
    """Lower-case words of letters without generational suffixes, and further parts, joined by ``|``."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z\\s]", "")), "\\s+")
    kept = F.filter(words, lambda w: ~w.isin(*SUFFIXES) & (w != ""))
    return F.concat_ws("|", F.array_join(kept, " "), *more)


def label_key(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(label)), "\\.", ""), "\\s+", " ")


def practice_status(text: Column) -> Column:
    """Full, Limited, DNP or Unknown."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.startswith("full"), "Full").when(t.startswith("limited"), "Limited").when(t.startswith("did not") | (t == "dnp"), "DNP").otherwise("Unknown")


def height_inches(text: Column) -> Column:
    """6'2" or 6-2 to 74; a plain number stays; else null."""
    feet, inches = (F.regexp_extract(text, "^(\\d+)['-](\\d{1,2})\"?$", k) for k in (1, 2))
    return F.when(feet != "", feet.try_cast("int") * 12 + inches.try_cast("int")).otherwise(text.try_cast("int"))


def american_odds(p: Column) -> Column:
    """Fair odds of a probability strictly between 0 and 1; else null."""
    fair = F.when(p >= 0.5, -F.round(100 * p / (1 - p))).otherwise(F.round(100 * (1 - p) / p))
    return F.when((p > 0) & (p < 1), fair).cast("long")


def log_loss(p: Column, y: Column, least: float = 1e-12) -> Column:
    q = clip(p, least, 1 - least)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def freshness(age_hours: Column, green: float, yellow: float) -> Column:
    return F.when(age_hours < green, "green").when(age_hours < yellow, "yellow").otherwise("red")
