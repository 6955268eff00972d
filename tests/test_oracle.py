"""Every query of the library with SQL, side by side with DuckDB on the smallest tables."""

import duckdb
import pytest

from ledgerlens.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    df = catalogue.queries()[name](spark, sf)
    columns = sorted(df.columns)
    mine = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    theirs = sorted(map(repr, duck.execute(f"select {', '.join(columns)} from ({catalogue.oracle_sql()[name]})").fetchall()))
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "source_type" in df.columns


def test_pages_in_span_text_of_repeated_rows(spark, sf, tmp_path):
    """Documents that occur twice take two page numbers, parts that occur twice are one span."""
    for t, k in (("documents", "doc_id"), ("part", "p_partkey")):
        rows = spark.read.parquet(f"{sf}/{t}.parquet")
        rows.union(rows.where(f"{k} % 3 = 0")).union(rows.where(f"{k} = 40")).write.parquet(f"{tmp_path}/{t}.parquet")
    c = duckdb.connect()
    for t in ("documents", "part"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    name, columns = "pages_in_span_text", "doc_id, n_pages, span_id, text"
    mine = sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).select(*columns.split(", ")).collect()))
    assert mine == sorted(c.execute(f"select {columns} from ({catalogue.oracle_sql()[name]})").fetchall())
