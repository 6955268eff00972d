"""Session settings that suit the library: adaptive execution, UTC, bounded shuffle partitions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "ledgerlens", **conf: str) -> SparkSession:
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()
