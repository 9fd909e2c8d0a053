"""The fold meets partial counts of pages, not finished ones, and the whole table."""

from collections import Counter

import duckdb
import pyarrow as pa
import pytest

from chronocell.catalogue import ORACLES, QUERIES, folded_counts
from chronocell.operators import aggregates


def test_fold_adds_partial_counts(spark, monkeypatch):
    seen, fold = [], aggregates.fold
    monkeypatch.setattr(aggregates, "fold", lambda df, *a, **b: (seen.append(df.count()), fold(df, *a, **b))[1])
    tags = [1, 1, 2, 3, 3, 3] * 20
    df = spark.createDataFrame([(t,) for t in tags], "tag_id long").repartition(4)
    assert {r.tag_id: r.samples for r in folded_counts(spark, df).collect()} == Counter(tags) and seen[0] > 3


def test_whole_table_counts(spark):
    found = [sorted(map(tuple, QUERIES[n](spark, "/root/testdata/sf0.001").collect())) for n in ("count_per_tag_whole", "fold_generic_whole")]
    assert found[0] == found[1] and len(found[0]) > 10


def test_small_pages_share_calls(spark):
    """Python is called by rows, not by pages: 30,000 rows are 3,000 pages."""
    df = spark.range(30_000).selectExpr("id % 100 AS tag", "id AS at").coalesce(1)
    found = aggregates.map_numbered(df, ["tag"], ["at"], 10, lambda p: pa.table({"rows": [p.num_rows]}), "rows long").collect()
    assert sum(r.rows for r in found) == 30_000 and len(found) < 50


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_pages_are_whole(spark, monkeypatch, size):
    """In small batches and runs, a page is in one call, whether it is smaller than a batch or larger than a run."""
    monkeypatch.setattr(aggregates, "RUN_ROWS", 20)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(600).selectExpr("nullif(id % 4, 3) AS tag", "1000 - id AS at").union(spark.sql("SELECT 9L, 5L"))
        count = lambda p: p.group_by(["tag", "page"], use_threads=False).aggregate([([], "count_all"), ("at", "min"), ("at", "max")]).select([0, 1, 2, 3, 4])
        found = sorted(map(tuple, aggregates.map_numbered(df, ["tag"], ["at"], size, count, "tag long, page long, n long, low long, high long").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    times = {None if t == 3 else t: sorted(1000 - i for i in range(600) if i % 4 == t) for t in range(4)} | {9: [5]}
    assert found == sorted(((t, i // size, len(x[i : i + size]), x[i], x[i : i + size][-1]) for t, x in times.items() for i in range(0, len(x), size)), key=str)


def test_page_map_may_give_nothing(spark):
    df = spark.range(50).selectExpr("id % 5 AS tag", "id AS at")
    assert aggregates.map_numbered(df, ["tag"], ["at"], 3, lambda p: None, "tag long").count() == 0


def test_lambda_per_page_of_odd_tags(spark, tmp_path):
    """Tags beyond the whole numbers of doubles stay apart, and a null tag has pages, as in SQL."""
    big = 1 << 53
    spark.range(200).selectExpr("id AS event_id", f"CASE WHEN id % 3 > 0 THEN {big} + id % 3 END AS user_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) AS ts", "double(id) AS value", "'a' AS event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    wanted = con.execute(ORACLES["lambda_per_page"]).fetchall()
    assert sorted(map(tuple, QUERIES["lambda_per_page"](spark, str(tmp_path)).collect()), key=str) == sorted(wanted, key=str) and len(wanted) == 21
