"""Units and scales in German report text, as struct columns (scale, unit, label); null: no hit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lines, narrow_spaces, once, strip

#: Scale tokens in the order in which they are tried.
SCALE_TOKENS = (
    (r"(?iU)\bteur\b", 1e3, "TEUR"),
    (r"(?iU)\btsd\.?\b", 1e3, "Tsd"),
    (r"(?iU)\btausend\b", 1e3, "Tausend"),
    (r"(?iU)\bmio\.?\b|\bmillion(?:en)?\b", 1e6, "Mio"),
    (r"(?iU)\bmrd\.?\b|\bmilliard(?:en)?\b", 1e9, "Mrd"),
)
EUR = r"(?iU)\bEUR\b|€"
#: Cues of a table caption.
CAPTION_CUES = ("angaben in", "in teur", "in tsd", "in mio", "in mrd", "beträge in", "beträge")
CAPTION_LINES, WINDOW, FINGERPRINT, FINGERPRINT_LEAST = 80, 800, 60, 20


def unit_of(c: Column) -> Column:
    return F.when(c.contains("%"), "%").when(c.rlike(EUR), "EUR")


def hit(scale: Column | None, unit: Column, label: Column) -> Column:
    scale = F.lit(None).cast("double") if scale is None else scale
    return F.struct(scale.cast("double").alias("scale"), unit.alias("unit"), label.alias("label"))


def _label(label: str, c: Column) -> Column:
    return F.concat(F.lit(label), F.when(c.contains("€"), " €").when(c.rlike(EUR), " EUR").otherwise(""))


def token(c: Column) -> Column:
    """Struct (factor, label) of the first pattern that occurs."""
    out = F.when(F.lit(False), F.struct(F.lit(0.0).alias("factor"), F.lit("").alias("label")))
    for pattern, factor, label in SCALE_TOKENS:
        out = out.when(c.rlike(pattern), F.struct(F.lit(factor).alias("factor"), _label(label, c).alias("label")))
    return out


def from_source(source: Column) -> Column:
    """Scale in the row's own text: token, else EUR (1), else % (no scale)."""
    def judged(c: Column) -> Column:
        def by_token(found: Column) -> Column:
            return (
                F.when(found.isNotNull(), hit(found.factor, F.coalesce(unit_of(c), F.lit("EUR")), found.label))
                .when(c.contains("%"), hit(None, F.lit("%"), F.lit("%")))
                .when(c.rlike(EUR), hit(F.lit(1.0), F.lit("EUR"), F.lit("EUR")))
            )

        return once(token(c), by_token)

    return once(narrow_spaces(source), judged)


def locate(source: Column, page: Column) -> Column:
    """1-based place of the source in the page, by its first 60 characters where the whole is not there; 0: nowhere."""
    whole = F.call_function("instr", page, source)
    head = F.substring(source, 1, FINGERPRINT)
    part = F.when(F.length(source) >= FINGERPRINT_LEAST, F.call_function("instr", page, head)).otherwise(0)
    return F.when(source == "", 0).when(whole > 0, whole).otherwise(part)


def _matches(c: Column, pattern: str, order: int, anchor: Column) -> Column:
    """Array of struct (distance, order, start) of a pattern's matches."""
    add = lambda a, x: a + x

    def starts(m: Column) -> Column:
        place = lambda _, i: F.aggregate(F.slice(m.gaps, F.lit(1), i + 1), F.lit(0), add) + F.aggregate(F.slice(m.sizes, F.lit(1), i), F.lit(0), add)
        return F.transform(F.transform(m.sizes, place), lambda s: F.struct(F.abs(s - anchor).alias("distance"), F.lit(order).alias("order"), s.alias("start")))

    gaps = F.transform(F.split(c, pattern, -1), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), lambda x: F.length(x))
    return once(F.struct(gaps.alias("gaps"), sizes.alias("sizes")), starts)


def closest_token(c: Column, anchor: Column) -> Column:
    """Struct (factor, label) of the token nearest to an offset; ties: the earlier pattern, then the earlier match."""
    def named(best: Column) -> Column:
        factor = F.array(*[F.lit(f) for _, f, _ in SCALE_TOKENS])[best.order]
        label = F.array(*[_label(x, c) for _, _, x in SCALE_TOKENS])[best.order]
        return F.when(best.isNotNull(), F.struct(factor.alias("factor"), label.alias("label")))

    return once(F.array_min(F.concat(*[_matches(c, p, k, anchor) for k, (p, _, _) in enumerate(SCALE_TOKENS)])), named)


def near_source(source: Column, page: Column) -> Column:
    """Scale nearest to the source's place on its page, within a window on either side."""
    def around(v: Column) -> Column:
        first = F.greatest(F.lit(1), v["at"] - WINDOW)
        window = F.substr(v["p"], first, v["at"] + F.length(v["s"]) + WINDOW - first)
        return F.when(v["at"] > 0, once(F.struct(window.alias("text"), (v["at"] - first).alias("anchor")), judged))

    def judged(w: Column) -> Column:
        text = w["text"]

        def by_token(found: Column) -> Column:
            return (
                F.when(found.isNotNull(), hit(found.factor, F.coalesce(unit_of(text), F.lit("EUR")), found.label))
                .when(text.rlike(EUR), hit(F.lit(1.0), F.lit("EUR"), F.lit("EUR")))
                .when(text.contains("%"), hit(None, F.lit("%"), F.lit("%")))
            )

        return once(closest_token(text, w["anchor"]), by_token)

    def placed(v: Column) -> Column:
        return once(F.struct(v["s"].alias("s"), v["p"].alias("p"), locate(v["s"], v["p"]).alias("at")), around)

    return F.when(page != "", once(F.struct(narrow_spaces(strip(source)).alias("s"), narrow_spaces(page).alias("p")), placed))


def from_caption(page: Column) -> Column:
    """Scale of the first caption-like line with a token."""
    kept = F.slice(F.filter(F.transform(lines(narrow_spaces(page)), strip), lambda x: x != ""), 1, CAPTION_LINES)
    cue = lambda x: F.lower(x).rlike("|".join(CAPTION_CUES)) | token(x).isNotNull()
    line = F.try_element_at(F.filter(F.filter(kept, cue), lambda x: token(x).isNotNull()), F.lit(1))
    found = token(line)
    return F.when(found.isNotNull(), hit(found.factor, F.coalesce(unit_of(line), F.lit("EUR")), found.label))


def infer(source: Column, page: Column, typical: Column) -> Column:
    """Row, then its surroundings, then the caption, then the field's usual scale."""
    usual = F.when(typical.isNotNull(), hit(typical, F.lit("EUR"), F.lit("default")))
    return F.coalesce(from_source(source), near_source(source, page), from_caption(page), usual)
