"""Printed page numbers: hits in headers and footers, offsets by majority, and page mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DATE_LIKE, TIME_LIKE, VERSION_LIKE, page_token, roman_value, strip

#: Fixed values of the score and of the decision.
EDGE, MIN_ARABIC = 0.14, 6
SHORT, CENTER, NOISE = 0.55, 0.30, 0.15
REFUSE_BELOW, REFUSE_FROM, PENALTY_CAP, ROMAN_FACTOR = 0.55, 8, 0.25, 0.7


def sample_pages(df: DataFrame, strategy: str = "all", page: str = "page_index", count: str = "page_count") -> DataFrame:
    """All pages, or (smart) the first and last 12 and every fifth."""
    if strategy == "all":
        return df
    if strategy != "smart":
        raise ValueError(f"unknown strategy {strategy!r}")
    i = F.col(page)
    return df.where((i < 12) | (i >= F.col(count) - 12) | (i % 5 == 0))


def edge_lines(lines: DataFrame) -> DataFrame:
    """Lines in the header or footer, with their place; page coordinates start at 0."""
    h = F.col("page_height")
    place = F.when(F.col("y1") <= h * EDGE, "header").when(F.col("y0") >= h - h * EDGE, "footer")
    return lines.withColumn("text", strip(F.col("text"))).withColumn("place", place).where("place is not null and text != ''")


def hit_score(text: Column, strength: Column, x0: Column, x1: Column, width: Column) -> Column:
    short = 1 - 0.7 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.length(text) - 6) / F.lit(30.0)))
    center = F.greatest(F.lit(0.0), 1 - F.abs((x0 + x1) / 2 - width / 2) / (width / 2))
    bad = F.when(text.rlike(DATE_LIKE), 0.5).otherwise(0.0) + F.when(text.rlike(TIME_LIKE), 0.3).otherwise(0.0) + F.when(text.rlike(VERSION_LIKE), 0.3).otherwise(0.0)
    return strength * (SHORT * short + CENTER * center + NOISE * F.greatest(F.lit(0.0), 1 - bad))


def page_hits(lines: DataFrame) -> DataFrame:
    """Candidate page numbers: doc_id, page_index, line_seq, kind, printed, score, place, text."""
    e = edge_lines(lines).withColumn("t", page_token(F.col("text"))).where("t is not null")
    value = F.when(F.col("t.kind") == "arabic", F.col("t.text").try_cast("int")).otherwise(roman_value(F.col("t.text")))
    e = e.withColumn("printed", value).where("printed is not null and printed > 0")
    score = hit_score(F.col("text"), F.col("t.strength"), F.col("x0"), F.col("x1"), F.col("page_width"))
    return e.select("doc_id", "page_index", "line_seq", F.col("t.kind").alias("kind"), "printed", score.alias("score"), "place", "text")


def best_hits(hits: DataFrame) -> DataFrame:
    """One hit a page: best score, footer before header, shorter text, first."""
    w = Window.partitionBy("doc_id", "page_index").orderBy(F.desc("score"), F.desc((F.col("place") == "footer").cast("int")), F.length("text"), "line_seq")
    return hits.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def infer_offsets(best: DataFrame) -> DataFrame:
    """doc_id, kind, n, offset (null: refused), confidence, from doc_id, page_index, kind, printed of best hits.

    The most frequent offset wins; among equals the one seen first in page order.
    """
    o = best.withColumn("offset", F.col("page_index") + 1 - F.col("printed"))
    counted = o.groupBy("doc_id", "kind", "offset").agg(F.count("*").alias("c"), F.min("page_index").alias("seen"))
    w = Window.partitionBy("doc_id", "kind").orderBy(F.desc("c"), "seen")
    ranked = counted.withColumn("r", F.row_number().over(w))
    pick = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    g = ranked.groupBy("doc_id", "kind").agg(F.sum("c").alias("n"), pick(1, "offset").alias("offset"), pick(1, "c").alias("c1"), F.coalesce(pick(2, "c"), F.lit(0)).alias("c2"))
    dominance = F.col("c1") / F.col("n")
    penalty = F.when(F.col("c2") > 0, F.least(F.lit(PENALTY_CAP), F.col("c2") / F.col("n") * 0.5)).otherwise(0.0)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dominance - penalty))
    refused = (dominance < REFUSE_BELOW) & (F.col("n") >= REFUSE_FROM)
    return g.select("doc_id", "kind", "n", F.when(~refused, F.col("offset")).alias("offset"), conf.alias("confidence"))


def decide_offsets(inferred: DataFrame) -> DataFrame:
    """doc_id, offset_arabic, offset_roman, confidence, n_arabic."""
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    d = inferred.groupBy("doc_id").agg(
        of("arabic", "offset").alias("a"), of("roman", "offset").alias("r"), F.coalesce(of("arabic", "confidence"), F.lit(0.0)).alias("ca"),
        F.coalesce(of("roman", "confidence"), F.lit(0.0)).alias("cr"), F.coalesce(of("arabic", "n"), F.lit(0)).alias("n_arabic"))
    conf = F.when(F.col("a").isNotNull(), F.col("ca")).when(F.col("r").isNotNull(), ROMAN_FACTOR * F.col("cr")).otherwise(0.0)
    few = F.col("n_arabic") < MIN_ARABIC
    conf = F.when(few & F.col("r").isNull(), 0.0).otherwise(conf)
    return d.select("doc_id", F.when(~few, F.col("a")).alias("offset_arabic"), F.col("r").alias("offset_roman"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)).alias("confidence"), "n_arabic")


def resolve_pages(spans: DataFrame, offsets: DataFrame) -> DataFrame:
    """Printed spans to PDF pages: shifted by the arabic offset, clamped to the document, end at start at least."""
    o = offsets.select("doc_id", "offset_arabic", "page_count")
    s = spans.join(o, "doc_id", "left")
    clamp = lambda c: F.greatest(F.lit(1), F.least(c, F.coalesce(F.col("page_count"), c)))
    shift = F.coalesce("offset_arabic", F.lit(0))
    start = clamp(F.col("start_page") + shift)
    return s.withColumn("pdf_start", start).withColumn("pdf_end", F.greatest(start, clamp(F.col("end_page") + shift))).drop("offset_arabic", "page_count")
