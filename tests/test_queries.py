"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from checks import ALL_QUERIES, ALL_SQL
from tests.conftest import DATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return connection


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)]
    df = pd.DataFrame({c: df[c].map(text) for c in df.columns})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ALL_QUERIES))
def test_query(spark, duck, name):
    found = ALL_QUERIES[name](spark, DATA).toPandas()
    assert len(found) > 0 or name == "key_value_search"
    if name in ALL_SQL:
        pd.testing.assert_frame_equal(plain(found), plain(duck.sql(ALL_SQL[name]).df()))
