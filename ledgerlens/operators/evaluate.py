"""Evaluation of predictions against a gold table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import plain, within_tolerance


def compare(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Gold left-joined to predictions (both one row a key), with the outcome of each row."""
    p = predictions.select("doc_id", "field_id", F.col("value").alias("p_value"), F.col("unit").alias("p_unit"), F.col("verified").alias("p_verified"), F.lit(True).alias("there"))
    both = gold.join(p, ["doc_id", "field_id"], "left")
    ok = within_tolerance(F.col("p_value"), F.col("p_unit"), F.col("value"), F.col("unit"))
    return both.withColumn("missing", F.col("there").isNull()).withColumn("ok", ok).withColumn("p_verified", F.coalesce("p_verified", F.lit(False)))


def metrics(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """Counters and rates in one row; a zero denominator gives 0."""
    rows = compare(gold, predictions)
    count = lambda c: F.count_if(c)
    wrong_unit = ~F.col("p_verified") & ~F.col("missing") & ~F.col("ok") & F.col("p_unit").isNotNull() & (F.col("p_unit") != F.col("unit"))
    c = rows.agg(
        F.count("*").alias("n_gold"), count(F.col("p_verified")).alias("n_verified"), count(F.col("p_verified") & F.col("ok")).alias("n_correct_verified"),
        count(F.col("ok")).alias("n_within_tol"), count(F.col("missing")).alias("n_missing"), count(~F.col("p_verified") & F.col("ok")).alias("n_unverified_but_ok"),
        count(wrong_unit).alias("n_wrong_unit"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    c = c.withColumn("accuracy", rate("n_within_tol", "n_gold")).withColumn("precision", rate("n_correct_verified", "n_verified"))
    c = c.withColumn("recall", rate("n_correct_verified", "n_gold")).withColumn("coverage", rate("n_verified", "n_gold"))
    return c.withColumn("abstention", 1 - F.col("coverage"))


def errors(gold: DataFrame, predictions: DataFrame, first: int | None = None) -> DataFrame:
    """doc_id, field_id, message of gold rows that are missing or out of tolerance, verified or not; the first by key, if asked."""
    rows = compare(gold, predictions).where("missing or not ok")
    key, said = F.concat_ws("/", "doc_id", "field_id"), lambda v, u: F.concat(plain(F.col(v)), F.lit(" "), F.coalesce(u, F.lit("None")))
    wrong = F.concat(F.lit("WRONG "), key, F.lit(" pred="), said("p_value", "p_unit"), F.lit(" gold="), said("value", "unit"))
    found = rows.select("doc_id", "field_id", F.when(F.col("missing"), F.concat(F.lit("MISSING "), key)).otherwise(wrong).alias("message"))
    return found if first is None else found.orderBy("doc_id", "field_id").limit(first)


#: The lines of the report.
REPORT = (
    "=== Extraction Evaluation ===",
    "Gold items            : {n_gold}",
    "Verified predictions  : {n_verified}",
    "Within tolerance (all): {n_within_tol} / {n_gold}  (accuracy={accuracy})",
    "Correct among verified: {n_correct_verified} / {n_verified}  (precision={precision})",
    "Recall (verified corr): {recall}",
    "Verified coverage     : {coverage}   (abstention={abstention})",
    "Unverified but OK     : {n_unverified_but_ok}",
    "Wrong-unit count      : {n_wrong_unit}",
)
RATES = ("accuracy", "precision", "recall", "coverage", "abstention")


def report(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row, report: the metrics as text, rates in percent with one place."""
    parts = []
    for k, piece in enumerate(re.split(r"\{(\w+)\}", "\n".join(REPORT))):
        rate = F.concat(F.format_number(100 * F.col(piece), 1), F.lit("%")) if piece in RATES else None
        parts.append(F.lit(piece) if k % 2 == 0 else rate if rate is not None else F.col(piece).cast("string"))
    return metrics(gold, predictions).select(F.concat(*parts).alias("report"))
