"""Every core query that has SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quillon.plans.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(map(repr, (tuple(x.item() if hasattr(x, "item") else x for x in r) for r in df.itertuples(index=False, name=None))))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, str(DATA)).toPandas()) == plain(duck.sql(ORACLES[name]).df())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
