"""Every query runs at the smallest size and equals its SQL where it has one."""

import math

import duckdb
import pandas as pd
import pytest

from quillstone.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def one(x):
        if hasattr(x, "tolist"):
            return str(x.tolist())
        if isinstance(x, float):
            return "null" if math.isnan(x) else repr(x)
        return "null" if x is None or x is pd.NA else str(x)

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    if name in registry.ORACLES:
        assert rows(got) == rows(duck.sql(registry.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
