"""German formatting of values, table rows and metric cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import null_if_empty

#: Labels and order of the fields.
LABELS = {"scr_total": "SCR", "mcr_total": "MCR", "sii_ratio_pct": "Bedeckungsquote SCR", "eof_total": "Eigenmittel gesamt", "eof_t1": "Eigenmittel Tier 1", "eof_t2": "Eigenmittel Tier 2", "tech_provisions_total": "vt. Rückstellung"}
ORDER = ("sii_ratio_pct", "eof_total", "scr_total", "mcr_total", "eof_t1", "eof_t2", "tech_provisions_total")
CARDS = ("sii_ratio_pct", "eof_total", "scr_total", "mcr_total")
HINTS = {"derived": "Abgeleitet", "extracted": "Automatisch extrahiert"}
SECTION_RANK = ("A", "B", "C", "D", "E")


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for p in d.items() for x in p])


def label(field: Column) -> Column:
    return F.coalesce(_map(LABELS)[field], field)


def rank(field: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ORDER)), field), F.lit(0)), F.lit(len(ORDER) + 1))


def section_rank(section: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SECTION_RANK)), section), F.lit(0)), F.lit(99)).cast("int")


def value_de(value: Column, unit: Column) -> Column:
    """``1.234.567,89 EUR``; a dash for null."""
    text = F.translate(F.format_number(value, 2), ",.", ".,")
    return F.when(value.isNull(), "—").otherwise(F.trim(F.concat_ws(" ", text, unit)))


def value_compact(value: Column, unit: Column) -> Column:
    big = lambda d, name: F.concat(F.translate(F.format_number(value / d, 2), ",.", ".,"), F.lit(f" {name} €"))
    return F.when(value.isNull() | (unit == "%"), value_de(value, unit)).when(F.abs(value) >= 1e9, big(1e9, "Mrd")).when(F.abs(value) >= 1e6, big(1e6, "Mio")).otherwise(value_de(value, unit))


def hint(source_type: Column, note: Column) -> Column:
    return F.concat_ws(" – ", _map(HINTS)[source_type], null_if_empty(note))


def table_rows(final: DataFrame) -> DataFrame:
    """doc_id, pos, Feld, Wert, Hinweise; pos orders a document's rows."""
    return final.select("doc_id", rank(F.col("field_id")).cast("int").alias("pos"), label(F.col("field_id")).alias("Feld"), value_de(F.col("value"), F.col("unit")).alias("Wert"), hint(F.col("source_type"), F.col("source_note")).alias("Hinweise"))


def metric_cards(final: DataFrame) -> DataFrame:
    return final.where(F.col("field_id").isin(*CARDS)).select("doc_id", "field_id", label(F.col("field_id")).alias("label"), value_compact(F.col("value"), F.col("unit")).alias("value_text"))


def summaries_of(summaries: DataFrame, doc_id) -> DataFrame:
    """The summaries of one document in the order of its sections."""
    rows = summaries.where(F.col("doc_id") == doc_id).select("section_id", "title", "start_page", "end_page", "summary")
    return rows.orderBy(section_rank(F.col("section_id")), "start_page", "section_id")


def display_name(given: Column, company: Column, year: Column, doc_id: Column) -> Column:
    return F.coalesce(null_if_empty(F.trim(given)), F.when((company != "") & year.isNotNull(), F.concat(company, F.lit(" ("), year.cast("string"), F.lit(")"))), null_if_empty(company), doc_id.cast("string"))
