"""German numbers, tolerances and ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, narrow_spaces, once, scrub_section_codes

#: One number, with dots or spaces between thousands but never both.
NUMBER = r"\(?\s*(?:\d{1,3}(?:\.\d{3})+|\d{1,3}(?: \d{3})+|\d+)(?:,\d+)?\s*%?\)?"
#: The first "current (previous)" pair; separators may mix.
PAIR = r"((?:\d{1,3}(?:[ .   ]\d{3})+|\d+)(?:,\d+)?)\s*\(\s*((?:\d{1,3}(?:[ .   ]\d{3})+|\d+)(?:,\d+)?)\s*\)"
TOLERANCE = 1e-6


def german_double(c: Column) -> Column:
    plain = F.replace(F.regexp_replace(c, r"[.\s   ()%]", ""), F.lit(","), F.lit("."))
    return plain.try_cast("double")


def number_tokens(c: Column) -> Column:
    return F.regexp_extract_all(scrub_section_codes(collapse(narrow_spaces(c))), F.lit(NUMBER), 0)


def numbers_de(c: Column) -> Column:
    """All numbers of a text in order; an opening parenthesis makes one negative."""
    return F.transform(number_tokens(c), lambda t: F.when(t.startswith("("), -german_double(t)).otherwise(german_double(t)))


def current_previous(c: Column) -> Column:
    """Struct (current, previous) of the first ``X (Y)``, else null."""
    def parts(m: Column) -> Column:
        return F.when(m != "", F.struct(german_double(F.regexp_extract(m, PAIR, 1)).alias("current"), german_double(F.regexp_extract(m, PAIR, 2)).alias("previous")))

    return once(F.regexp_extract(c, PAIR, 0), parts)


def coerce_scale(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return (
        F.when(low.isin("teur", "tsd", "tausend", "1k"), 1e3).when(low.isin("mio", "million", "1m"), 1e6)
        .when(low.isin("mrd", "milliarde", "1b"), 1e9).otherwise(low.try_cast("double"))
    )


def apply_scale(value: Column, scale: Column) -> Column:
    return value * F.coalesce(coerce_scale(scale), F.lit(1.0))


def round_half_even(c: Column, digits: int = 2) -> Column:
    """Round the exact binary value, as format_number does; infinities and null pass."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit("")).try_cast("double")


def plain(c: Column) -> Column:
    """A number as text with the digits it needs and no exponent: ``1250.0``, ``12500000.5``; None for null."""
    text = F.regexp_replace(c.cast("string").try_cast("decimal(38,18)").cast("string"), "0+$", "")
    return F.coalesce(F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text), c.cast("string"), F.lit("None"))


def canonical(value: Column, unit: Column, scale: Column) -> Column:
    return F.when(unit == "%", value).otherwise(value * scale)


def close_to(value: Column, other: Column) -> Column:
    return F.abs(value - other) <= TOLERANCE * F.greatest(F.lit(1.0), F.abs(other))


def within_tolerance(value: Column, unit: Column, gold: Column, gold_unit: Column) -> Column:
    allowed = F.when(gold_unit == "EUR", F.greatest(F.lit(500.0), 0.001 * F.abs(gold))).when(gold_unit == "%", 0.2).otherwise(0.0)
    return F.coalesce((unit == gold_unit) & (F.abs(value - gold) <= allowed), F.lit(False))


def ratio_pct(part: Column, whole: Column) -> Column:
    """100 * part / whole, null where either is null or whole is 0."""
    return F.try_divide(100 * part, whole)
