"""Every query that has SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from paddock.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("set timezone='UTC'")
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return connection


def canonical(df: pd.DataFrame) -> list[tuple]:
    def value(x):
        if x is None or (not isinstance(x, str) and pd.isna(x)):
            return ""
        if isinstance(x, bool) or str(type(x)).endswith("bool'>"):
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype"):
            return f"{float(x) + 0.0:.6f}" if not isinstance(x, pd.Timestamp) else str(x)
        return str(x)

    return sorted(tuple(value(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, expected = registry.queries()[name](spark, DIR).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, DIR)
    assert all(t[:5] not in ("array", "struc", "map<") for _, t in df.dtypes)
    df.count()
