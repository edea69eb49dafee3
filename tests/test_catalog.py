"""Every query with an SQL twin gives what DuckDB gives on the smallest tables."""

import math

import duckdb
import pytest

from gazeflow import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    text = lambda v: "" if v is None else f"{v:.5f}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_upper_median_counts_before_its_windows(spark, duck, tmp_path):
    """no row of the table reaches a window before it is counted with its equals; nulls come last as in DuckDB."""
    values = [("A", 1.0), ("A", 2.0), ("A", None), ("B", 5.0), ("C", None), ("C", None), ("C", 1.0), (None, 3.0), (None, 4.0)] + [("D", float(i % 7)) for i in range(1000)]
    spark.createDataFrame(values, "l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["upper_median"](spark, str(tmp_path))
    want = duck.execute(catalog.ORACLE_SQL["upper_median"].replace("FROM lineitem", f"FROM '{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate")
