"""Verification of extracted values: one chain of column expressions, no UDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scale as S
from ..functions.numbers import close_to, current_previous, numbers_de, plain, round_half_even

#: Notes, and the weights of the confidence.
NO_VALUE = "no_value_or_not_ok"
NOT_FOUND = "Wert konnte in Textquelle nicht verifiziert werden"
PREVIOUS_YEAR = "Wert stammt eventuell aus dem Vorjahr"
BASE, SOURCE, EVIDENCE, NOT_FOUND_COST, PREVIOUS_COST, RATIO_GAIN, THRESHOLD = 0.50, 0.10, 0.10, 0.35, 0.25, 0.15, 0.50
ALLOWED_SCALES = (1.0, 1e3, 1e6, 1e9)


def verify(df: DataFrame, rounded: bool = True) -> DataFrame:
    """Add verified, value_canonical, unit_out, confidence, scale_applied, verifier_notes.

    df: status, value_unscaled, unit, scale, source_text, has_evidence, typical_scale,
    page_text (any of the last two may be null), optionally ratio_expected and ratio_tol.
    """
    gate = (F.col("status") == "ok") & F.col("value_unscaled").isNotNull()
    unit = F.col("unit")
    inferred = S.infer(F.coalesce("source_text", F.lit("")), F.coalesce("page_text", F.lit("")), F.col("typical_scale"))
    df = df.withColumn("__scale", F.coalesce(F.when(F.col("scale").isin(*ALLOWED_SCALES), F.col("scale")), inferred.scale, F.when(unit == "EUR", 1.0)))
    value = F.when(unit == "%", F.col("value_unscaled")).otherwise(F.col("value_unscaled") * F.col("__scale"))
    df = df.withColumn("__value", round_half_even(value) if rounded else value)
    has_source = F.coalesce(F.col("source_text") != "", F.lit(False))
    df = df.withColumn("__pair", F.when(has_source, current_previous(F.col("source_text"))))
    pair = F.col("__pair")
    numbers = F.concat(F.when(pair.isNotNull(), F.array(pair.current, pair.previous)).otherwise(F.array().cast("array<double>")), numbers_de(F.col("source_text")))
    df = df.withColumn("__found", F.coalesce(F.exists(numbers, lambda c: close_to(F.col("value_unscaled"), c)), F.lit(False)))
    missing = has_source & ~F.col("__found")
    previous = has_source & F.coalesce(close_to(F.col("value_unscaled"), pair.previous), F.lit(False))
    score = F.lit(BASE) + F.when(has_source, SOURCE).otherwise(0.0) + F.when(F.col("has_evidence"), EVIDENCE).otherwise(0.0)
    score = score - F.when(missing, NOT_FOUND_COST).otherwise(0.0) - F.when(previous, PREVIOUS_COST).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(score, 2)))
    ratio_note = F.lit(None).cast("string")
    if {"ratio_expected", "ratio_tol"} <= set(df.columns):
        asked = (unit == "%") & F.col("ratio_expected").isNotNull() & F.col("ratio_tol").isNotNull()
        near = F.coalesce(F.abs(F.col("__value") - F.col("ratio_expected")) <= F.col("ratio_tol"), F.lit(False))
        score = F.when(asked & near, F.least(F.lit(1.0), score + RATIO_GAIN)).otherwise(score)
        ratio_note = F.when(asked & ~near, F.concat(F.lit("Erwartetes Verhältnis ist "), plain(F.col("ratio_expected")), F.lit(" anstatt "), plain(F.col("__value"))))
    notes = F.concat_ws(";", F.when(missing, NOT_FOUND), F.when(previous, PREVIOUS_YEAR), ratio_note)
    fine = gate & (score >= THRESHOLD) & ~missing & ~previous & unit.isNotNull() & F.col("__value").isNotNull()
    return (
        df.withColumn("verified", F.coalesce(fine, F.lit(False)))
        .withColumn("value_canonical", F.when(gate, F.col("__value")))
        .withColumn("unit_out", F.when(~gate | F.col("__value").isNotNull(), unit))
        .withColumn("confidence", F.when(gate, score).otherwise(0.0))
        .withColumn("scale_applied", F.when(gate & (unit != "%"), F.col("__scale")))
        .withColumn("verifier_notes", F.when(gate, F.when(notes != "", notes)).otherwise(NO_VALUE))
        .drop("__scale", "__value", "__pair", "__found")
    )
