"""The training-data queries that have SQL, held against DuckDB on a fixture."""

import os

import duckdb
import pandas as pd
import pytest

from chronocell.llm.oracles import ORACLES
from chronocell.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> dict:
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) else round(float(v), 6)
    return {int(r["doc_id"]): {k: plain(v) for k, v in r.items()} for r in df.to_dict("records")}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    found, wanted = rows(QUERIES[name](spark, SF).toPandas()), rows(duck.execute(ORACLES[name]).fetchdf())
    assert found.keys() == wanted.keys() and len(found) > 100
    differing = {k: (found[k], wanted[k]) for k in found if found[k] != wanted[k]}
    assert not differing, list(differing.items())[:2]
