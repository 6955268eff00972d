"""Idempotent upserts from a stream of JSON lines into a Parquet table of versioned buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import dedupe, upsert_overwrite

#: Parts of the table by hash of the key; a batch rewrites those that it touches.
BUCKETS = 64


def stream_jsonl(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def upsert_batches(stream: DataFrame, table: str, keys: list[str], order: str, checkpoint: str, buckets: int = BUCKETS):
    """Merge every micro-batch by key (last by ``order`` wins); a repeated batch changes nothing.

    A batch writes a version folder with the buckets it touches; of each bucket the newest version
    counts, and the one before it stays for readers that have begun.  A failed write is never seen.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = dedupe(batch, keys, [F.col(order)]).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` rows
        old = _read(spark, [p for b, p in _newest(spark, table, epoch).items() if b in touched], batch.schema)
        old = old.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        merged = upsert_overwrite(old, new.select(old.columns), keys)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/version={epoch}")
        for b, paths in _versions(spark, table).items():
            for p in paths[:-2]:
                _path(spark, p).getFileSystem(_conf(spark)).delete(_path(spark, p), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _conf(spark: SparkSession):
    return spark.sparkContext._jsc.hadoopConfiguration()


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _versions(spark: SparkSession, table: str, before: int | None = None) -> dict[int, list[str]]:
    """The folders of each bucket, oldest version first, of versions that were written to the end."""
    root = _path(spark, table)
    fs = root.getFileSystem(_conf(spark))
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    epochs = sorted(int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(_path(spark, f"{table}/{n}/_SUCCESS")))
    found: dict[int, list[str]] = {}
    for e in epochs:
        if before is None or e < before:
            for s in fs.listStatus(_path(spark, f"{table}/version={e}")):
                if s.getPath().getName().startswith("bucket="):
                    found.setdefault(int(s.getPath().getName().split("=")[1]), []).append(f"{table}/version={e}/{s.getPath().getName()}")
    return found


def _newest(spark: SparkSession, table: str, before: int | None = None) -> dict[int, str]:
    return {b: paths[-1] for b, paths in _versions(spark, table, before).items()}


def _read(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, table: str, schema, before: int | None = None) -> DataFrame:
    """The newest version of every bucket (before an epoch), or an empty table."""
    return _read(spark, list(_newest(spark, table, before).values()), schema)
