"""Readers and writers of the library's files, with explicit schemas throughout."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INGEST = ("schema_version string, doc_id string, pdf_sha256 string, page_count int, sections array<struct<section: string, start_page: int, end_page: int>>, "
          "subsections array<struct<section: string, code: string, title: string, start_page: int, end_page: int>>, coverage_ratio double, issues array<string>")
EXTRACTIONS = ("doc_id string, field_id string, status string, verified boolean, value_canonical double, unit string, confidence double, "
               "evidence array<struct<page: int, ref: string, snippet_hash: string>>, source_text string, scale_applied double, verifier_notes string")
SUMMARIES = "doc_id string, section_id string, title string, start_page int, end_page int, summary string"
CATALOG = "doc_id string, year string, company string, pdf_path string, pdf_url string, display_name string"
GOLD = "doc_id string, field_id string, unit string, value string"


def read_ingest(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file."""
    return spark.read.schema(INGEST).option("multiLine", True).option("pathGlobFilter", "*.ingest.json").json(path)


def read_extractions(spark: SparkSession, path: str, default_status: str | None = None) -> DataFrame:
    """JSON lines of ``*.extractions.jsonl`` with file and running number, for last-wins rules."""
    df = spark.read.schema(EXTRACTIONS).option("pathGlobFilter", "*.extractions.jsonl").json(path).where("doc_id is not null")
    df = df.withColumn("file", F.col("_metadata.file_name")).withColumn("seq", F.monotonically_increasing_id())
    return df.withColumn("status", F.coalesce("status", F.lit(default_status))) if default_status is not None else df


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(SUMMARIES).option("pathGlobFilter", "*.summaries.jsonl").json(path).where("doc_id is not null")
    return df.withColumn("summary", F.coalesce("summary", F.lit("")))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue CSV; values stripped, rows without an id left out, a missing display_name null."""
    head = spark.read.text(path).head()
    columns = [c.strip() for c in head.value.lstrip("﻿").split(",")] if head else CATALOG_COLUMNS
    df = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("enforceSchema", True).csv(path)
    for c in CATALOG_COLUMNS:
        df = df.withColumn(c, F.trim(c) if c in columns else F.lit(None).cast("string"))
    return df.select(*CATALOG_COLUMNS).where("doc_id != ''").withColumn("year", F.col("year").try_cast("int"))


CATALOG_COLUMNS = ["doc_id", "year", "company", "pdf_path", "pdf_url", "display_name"]


def read_gold(spark: SparkSession, path: str, sep: str = ";", numeric: bool = True) -> DataFrame:
    """Gold rows with seq, their place in the file; of rows with one key the last stays, at the first one's place."""
    df = spark.read.schema(GOLD).option("header", True).option("sep", sep).csv(path)
    df = df.select(*[F.trim(c).alias(c) for c in df.columns]).where("doc_id != '' and field_id != ''").withColumn("seq", F.monotonically_increasing_id())
    last = F.max_by(F.struct("unit", "value"), "seq")
    df = df.groupBy("doc_id", "field_id").agg(last.alias("last"), F.min("seq").alias("seq")).select("doc_id", "field_id", "last.unit", "last.value", "seq")
    return df.withColumn("value", F.col("value").try_cast("double")) if numeric else df


def read_fields(spark: SparkSession, path: str) -> DataFrame:
    """Field taxonomy: id, subsection_hint, unit, typical_scale, keywords, notes."""
    import yaml

    rows = []
    for f in (yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}).get("fields", []):
        scale = f.get("typical_scale")
        rows.append((f["id"], f.get("subsection_hint") or f.get("section_hint") or "E", f.get("unit"), None if scale is None else float(scale), list(f.get("keywords") or []), f.get("notes") or ""))
    return spark.createDataFrame(rows, "field_id string, subsection_hint string, unit string, typical_scale double, keywords array<string>, notes string")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Manual overrides; a missing file, another type or rows without keys give no rows."""
    import yaml

    p = Path(path)
    data = yaml.safe_load(p.read_text(encoding="utf-8")) if p.exists() else []
    rows = [r for r in data if isinstance(r, dict) and r.get("doc_id") and r.get("field_id")] if isinstance(data, list) else []
    number = lambda v: None if v is None else float(v)
    return spark.createDataFrame([(str(r["doc_id"]), str(r["field_id"]), number(r.get("value_canonical")), r.get("unit"), r.get("note"), i) for i, r in enumerate(rows)], "doc_id string, field_id string, value double, unit string, note string, seq int")


def list_files(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """path, doc_id (the name's stem), sha256, length; lazily and distributed."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return df.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("doc_id"), F.sha2("content", 256).alias("sha256"), "length")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, nulls left out, replacing what was there."""
    df.write.mode("overwrite").json(path)


def write_ingest(df: DataFrame, path: str) -> None:
    """A JSON object a line in one folder for each document."""
    row = F.to_json(F.struct(*sorted(c for c in df.columns)))
    df.select("doc_id", row.alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_gold(df: DataFrame, path: str, sep: str = ",") -> None:
    """Gold CSV, existing rows in their order, new rows by key; ranges of the order become files that are read in turn."""
    order = ["is_new", *[c for c in ("seq",) if c in df.columns], "doc_id", "field_id"]
    df.orderBy(*order).select("doc_id", "field_id", "unit", "value").write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def backup(spark: SparkSession, path: str) -> bool:
    """Copy a file or folder to its name with ``.bak``, through Hadoop's file system; whether there was one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.bak")
    fs = source.getFileSystem(conf)
    return fs.exists(source) and jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, target, False, True, conf)


def write_report(df: DataFrame, path: str) -> None:
    """A text column as text files; a report is one row."""
    df.write.mode("overwrite").text(path)


def refresh_final_values(final: DataFrame, path: str) -> int:
    """Replace the table of final values; the number of rows written."""
    final.write.mode("overwrite").parquet(path)
    return final.sparkSession.read.parquet(path).count()
