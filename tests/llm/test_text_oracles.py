"""The queries that SQL can express give the rows of their SQL."""

import duckdb
import pandas as pd
import pytest

from marlstone.llm import queries as Q

TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    sql = Q.oracle_sql()[name]
    got, want = Q.queries()[name](spark, sf), con.execute(sql).df()
    assert {c: TYPES[t] for c, t in got.dtypes} == {c: t for c, t, *_ in con.execute(f"describe {sql}").fetchall()}
    key, columns = list(want.columns[:2]), sorted(want.columns)
    frames = [f[columns].sort_values(key).astype(object).where(f[columns].notna(), None).reset_index(drop=True) for f in (got.toPandas(), want)]
    pd.testing.assert_frame_equal(*frames, check_dtype=False, check_exact=True)
