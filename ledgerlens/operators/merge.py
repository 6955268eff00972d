"""Keyed merges: deduplication, upserts, orphan handling and final values by precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio_pct

PRECEDENCE = {"manual": 0, "derived": 1, "extracted": 2}


def dedupe(df: DataFrame, keys: list[str], order: list[Column], last: bool = True) -> DataFrame:
    """One row a key: the last (or first) in a total order; deterministic, unlike dropDuplicates."""
    by = [c.desc() if last else c.asc() for c in order]
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upsert_coalesce(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge; a null in the new row keeps the old value."""
    values = [c for c in old.columns if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    cond = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = o.join(n, cond, "full_outer")
    return both.select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in [*keys, *values]])


def upsert_overwrite(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old rows of their key, nulls included; other old rows stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def without_orphans(child: DataFrame, parent: DataFrame, key: str = "doc_id") -> DataFrame:
    return child.join(parent.select(key).distinct(), key, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that break the foreign key; quarantine them instead of aborting."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def final_values(extracted: DataFrame, overrides: DataFrame, documents: DataFrame, rounded: bool = True) -> DataFrame:
    """Manual over derived over extracted, for known documents only.

    extracted, overrides: one row a (doc_id, field_id), with value, unit (extracted: verified;
    overrides: note).  The ratio is derived from the pool in which overrides have replaced
    extracted rows, so an override without a value takes the ratio away.
    """
    auto = extracted.where("verified").select("doc_id", "field_id", "value", "unit", F.lit("extracted").alias("source_type"), F.lit(None).cast("string").alias("source_note"))
    manual = overrides.select("doc_id", "field_id", "value", "unit", F.lit("manual").alias("source_type"), F.col("note").alias("source_note"))
    pool = auto.join(manual.select("doc_id", "field_id"), ["doc_id", "field_id"], "left_anti").unionByName(manual)
    pick = lambda f: F.max(F.when(F.col("field_id") == f, F.col("value")))
    ratio = pool.where(F.col("field_id").isin("eof_total", "scr_total")).groupBy("doc_id").agg(ratio_pct(pick("eof_total"), pick("scr_total")).alias("value")).where("value is not null")
    if rounded:
        from ..functions.numbers import round_half_even

        ratio = ratio.withColumn("value", round_half_even(F.col("value")))
    derived = ratio.select("doc_id", F.lit("sii_ratio_pct").alias("field_id"), "value", F.lit("%").alias("unit"), F.lit("derived").alias("source_type"), F.lit("Eigenmittel / SCR").alias("source_note"))
    rank = F.create_map(*[x for k, v in PRECEDENCE.items() for x in (F.lit(k), F.lit(v))])
    w = Window.partitionBy("doc_id", "field_id").orderBy(rank[F.col("source_type")])
    best = pool.unionByName(derived).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return without_orphans(best, documents).withColumn("verified", F.lit(True))


def gold_merge(existing: DataFrame, predictions: DataFrame, only_verified: bool, order: list[Column]) -> DataFrame:
    """Existing gold rows, then one new row (without a value) for each key not yet there; seq, where existing has it, is kept."""
    new = predictions.where("verified") if only_verified else predictions
    new = dedupe(new, ["doc_id", "field_id"], order, last=False).join(existing, ["doc_id", "field_id"], "left_anti")
    new = new.select("doc_id", "field_id", "unit", F.lit(None).cast(existing.schema["value"].dataType).alias("value"), F.lit(1).alias("is_new"))
    kept = [c for c in ("seq",) if c in existing.columns]
    return existing.select("doc_id", "field_id", "unit", "value", F.lit(0).alias("is_new"), *kept).unionByName(new, allowMissingColumns=True)


def final_values_of(final: DataFrame, doc_id) -> DataFrame:
    """The final values of one document, by field."""
    return final.where(F.col("doc_id") == doc_id).select("doc_id", "field_id", "value", "unit", "verified", "source_type", "source_note").orderBy("field_id")


def document_list(documents: DataFrame) -> DataFrame:
    """Documents by display name."""
    return documents.select("doc_id", "display_name", "pdf_path", "pdf_url", "page_count").orderBy("display_name", "doc_id")


def load_counts(loaded: DataFrame, file: str = "file") -> DataFrame:
    """n_docs (files) and n_rows of a load, in one row."""
    return loaded.agg(F.count_distinct(file).alias("n_docs"), F.count("*").alias("n_rows"))
