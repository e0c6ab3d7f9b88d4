"""Every query with an oracle gives the oracle's rows; the rest run."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from marlstone.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def kinds(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object).where(lambda x: x.notna(), None)
    rows = sorted(frame.itertuples(index=False), key=repr)
    return pd.DataFrame(rows, columns=frame.columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf):
    got = QUERIES[name](spark, sf)
    if name not in ORACLES:
        assert got.count() > 0
        return
    want = duck.execute(ORACLES[name]).df()
    types = {c: t for c, t, *_ in duck.execute(f"describe {ORACLES[name]}").fetchall()}
    names = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    assert {c: names.get(t, t) for c, t in got.dtypes} == types
    pd.testing.assert_frame_equal(kinds(got.toPandas()), kinds(want), check_dtype=False, rtol=0, atol=0, check_exact=True)


def test_entry(spark):
    assert E.entry(spark).count() > 0
