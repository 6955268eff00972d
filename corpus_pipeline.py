"""The corpus pipeline: five stages over ``documents``, each written as Parquet before the next reads it.

Toxic documents go, one document of each group of near copies stays, contaminated documents go,
secrets in the texts that remain are replaced, and what is left is encoded and decoded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, ngram_join, secret_scan, sentencepiece_bpe, toxicity
from ledgerlens.llm.common import materialize
from ledgerlens.llm.queries import digest_pieces, piece_model, table

TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; fitted on the training rows of ``labels``."""
    grammar = toxicity.fit_on_training_rows(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, grammar, into="__toxicity").where(F.col("__toxicity.score") < TOXIC).select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near copies the row with the smallest id, then text digest; rows without an id stay.

    Rows of one id are told apart by their texts; of rows with the same id and text the first by all columns stays.
    """
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").head(1):
        found = materialize(ngram_join.near_duplicates(docs.select("doc_id", "text")), "components")
        gone = found.where("doc_id != component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    rows = docs.where("doc_id is not null").withColumn("__digest", F.coalesce(F.sha2("text", 256), F.lit("")))
    numbers = rows.select("doc_id", "__digest").distinct().orderBy("doc_id", "__digest").withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows.join(materialize(numbers, "numbers"), ["doc_id", "__digest"]), "rows")
    found = materialize(ngram_join.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")), "components")
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("__row")).distinct()
    kept = rows.join(gone, "__row", "left_anti").withColumn("__copy", F.row_number().over(Window.partitionBy("__row").orderBy(*docs.columns)))
    return kept.where("__copy = 1").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth of the words."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), into="__found")
    return found.where(~decontaminate.is_contaminated("__found")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret; n_chars follows the text."""
    found = secret_scan.find_secrets(docs, into="__secrets")
    text = secret_scan.redact(F.col("text"), F.col("__secrets"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("__secrets") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(changed).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text."""
    return digest_pieces(sentencepiece_bpe.encode_decode(docs.select("doc_id", "text"), piece_model()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_copy),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode),
]

#: Toxicity, secrets and pieces have no SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
