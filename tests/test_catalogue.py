"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import math

import duckdb
import numpy as np
import pytest

from sparkloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    def one(v):
        if isinstance(v, np.ndarray):
            return str(v.tolist())
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 5))
        return str(v)

    out = frame[sorted(frame.columns)]
    for c in out.select_dtypes("datetime").columns:
        out = out.assign(**{c: out[c].astype("datetime64[us]").astype(str)})
    return sorted(tuple(map(one, row)) for row in out.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.SQL:
        want = duck.sql(catalogue.SQL[name]).df()
        assert sorted(frame.columns) == sorted(want.columns)
        assert plain(frame) == plain(want)
    else:
        assert len(frame)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(catalogue.SQL) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
