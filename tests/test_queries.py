"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from clausemill.plans import all_queries  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    def plain(v):
        if v is None or pd.isna(v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return bool(v)
        return round(float(v), 6) if isinstance(v, (int, float)) or type(v).__module__ == "numpy" else str(v)

    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLES[name]).df())
