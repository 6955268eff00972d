"""The contract queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, license_scan, media, ngram_join, secret_scan, sentencepiece_bpe, substring_dedup, toxicity, url_filter
from .common import WORD

PIECE_MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def sha(text) -> F.Column:
    return F.sha2(text, 256)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "logit", "verdict")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.find_secrets(docs)
    base = F.filter("secrets", lambda s: s["rank"] < 3)
    count = lambda rank: F.size(F.filter("secrets", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        sha(secret_scan.span_list(base)).alias("base_sha256"), secret_scan.span_list(F.col("secrets")).alias("spans"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.col("contamination.items")
    return found.select(
        "doc_id", F.col("contamination.n_words").alias("n_words"), decontaminate.n_hit().alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        sha(F.array_join(F.array_sort(items), ",")).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_pieces(sentencepiece_bpe.encode_decode(docs, piece_model()))


def digest_pieces(coded: DataFrame) -> DataFrame:
    """doc_id, the number of ids, and digests of the ids and of the decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(ids).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    made = chat_format.format_trees(chat_format.chain(turns.unionByName(own), "conv_id", ["turn"]))
    made = made.withColumn("turns", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.read_loss(F.col("formatted"), F.col("mask")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.fit_on_training_rows(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, grammar)
    score = F.col("toxicity.score")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"), F.col("toxicity.clauses").alias("n_clauses"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return stored.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), sha(F.col("payload")).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 15, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), sha(F.col("media")).alias("media_sha256"), "feature")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
assert _RE_WORD == WORD

_OP3 = rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '{_RE_WORD}') AS w FROM documents),
item AS (
  SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOW}, '{_RE_WORD}') AS w FROM benchmark),
item_window AS (
  SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM item_window),
doc_window AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, sizes WHERE len(w) >= size)),
hit AS (
  SELECT d.doc_id, d.size, d.i, x.item FROM doc_window d JOIN item_window x ON d.size = x.size AND d.win = x.win),
covered AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""

_OP5 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
joined AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<x\1|', 'g')) + 11)::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined"""


_OP7 = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM doc UNION SELECT e.b, r.root FROM reach r JOIN edge e ON r.doc_id = e.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(root)::BIGINT AS component_id
FROM doc d LEFT JOIN sized USING (doc_id) JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id, n"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_secret_scan": op2_secret_scan,
        "op3_decontaminate": op3_decontaminate,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_chat_format": op5_chat_format,
        "op6_license_scan": op6_license_scan,
        "op7_ngram_join": op7_ngram_join,
        "op8_toxicity": op8_toxicity,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_media": op10_media,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.oracle(), "op3_decontaminate": _OP3, "op5_chat_format": _OP5, "op7_ngram_join": _OP7}
