"""Every query with SQL gives the rows that DuckDB gives for it."""

import duckdb
import pandas as pd
import pytest

from shelfspark import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, sf_dir, name, run, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    want, got = con.execute(sql).df(), run(spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)

    def spelt(frame):
        def one(v):
            if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
                return "null"
            return repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

        return frame[columns].map(one).sort_values(columns).reset_index(drop=True)

    pd.testing.assert_frame_equal(spelt(want), spelt(got))


@pytest.mark.parametrize("name", sorted(own.SQL))
def test_same_rows(spark, sf_dir, name):
    compare(spark, sf_dir, name, own.QUERIES[name], own.SQL[name])


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.SQL)))
def test_without_sql_runs(spark, sf_dir, name):
    own.QUERIES[name](spark, sf_dir).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(own.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
