"""Every query that has an oracle, held against DuckDB on the smallest fixture."""

import os

import duckdb
import pandas as pd
import pytest

from chronocell.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(found: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    nulls = lambda rows: sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
    safe = lambda df: nulls([tuple(None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6) for v in r) for r in df[columns].itertuples(index=False)])
    assert safe(found) == safe(wanted)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).fetchdf())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
