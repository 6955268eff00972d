"""Connected components of a link table, without a driver-side graph and without hot tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, tidied

#: Links that one task contracts at most.
BLOCK = 500_000


def _contract(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars: each node with the smallest node that it reaches within the partition."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in frame:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    stars = [(x, r) for x in parent if (r := root(x)) != x]
    if stars:
        a, b = zip(*stars, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows node, root (the smallest node reachable) of all nodes that have links to others.

    Links are dealt into blocks of at most BLOCK, and each block is contracted to stars by one
    task.  Where there is more than one block, large-star and small-star steps alternate on the
    stars, which shorten every path to its minimum in about log-squared rounds.  Minima are
    pre-aggregated before they move, and the joins that spread them are plain equi-joins, which
    adaptive execution splits where one node has very many links.
    """
    links = materialize(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a != b").distinct(), "links")
    blocks = -(-links.count() // BLOCK)
    edges = materialize(links.repartition(max(1, blocks)).mapInArrow(tidied(_contract), "a bigint, b bigint").distinct(), "links")
    discard(links)
    state = None
    while blocks > 1:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == state:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = materialize(large, "links")
        discard(edges)
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        edges = materialize(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(large)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = materialize(stars.unionByName(stars.select(F.col("root").alias("node"), "root")).groupBy("node").agg(F.min("root").alias("root")), "components")
    discard(edges)
    return found
