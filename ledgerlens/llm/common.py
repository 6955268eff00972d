"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a lower-cased text, as a regular expression for Java and RE2.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same word in the UTF-8 bytes of a lower-cased text: non-ASCII code points have only bytes above 0x7F.
WORD_BYTES = rb"[0-9a-z\x80-\xff]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column as a string, null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else (``lower`` would also change other letters)."""
    return F.translate(text, UPPER, LOWER)


#: Folders of this process's own, by application, for local masters without a shared folder.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, as in tests, a temporary folder of this
    process serves and is removed at exit; on a cluster the setting is required.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _own_dirs:
        own = tempfile.mkdtemp(prefix="ledgerlens-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_dirs[context.applicationId] = "file://" + own
    return _own_dirs[context.applicationId]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    schema = df.schema
    del df
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._ledgerlens_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df._ledgerlens_path)


#: Words of 64 bits in a membership bitmap, a fixed size: 2**20 bits.
BITMAP_WORDS = 1 << 14


def may_be_in(key: str, keys: DataFrame) -> Column:
    """A condition that holds for every key in ``keys`` (one column of that name) and for few others while these are few.

    It is a constant of at most BITMAP_WORDS words in the plan, so it filters a large table before
    a shuffle; when keys are very many it lets all rows through and the join behind it decides.
    """
    bit = F.pmod(F.xxhash64(F.col(key)), F.lit(BITMAP_WORDS * 64))
    words = keys.select(bit.alias("b")).groupBy(F.floor(F.col("b") / 64).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b % 64))")).alias("m")).collect()
    table = [0] * BITMAP_WORDS
    for r in words:
        table[r.w] = r.m
    held = F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<bigint>")
    word = F.get(held, F.floor(bit / 64).cast("int"))
    return word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))) != 0


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of phases whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidied(run):
    """The function of a partition; what it leaves in a reused Python worker goes back to the system when it ends."""

    def whole(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # not a GNU C library
            pass

    return whole


def workers(spark: SparkSession, batch: str = "4m") -> None:
    """Make this package importable in Python workers and bound what one Arrow batch holds by bytes, not only by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", batch)
    context = spark.sparkContext
    if getattr(context, "_ledgerlens_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="ledgerlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f.relative_to(package.parent))
    context.addPyFile(archive)
    context._ledgerlens_shipped = True
