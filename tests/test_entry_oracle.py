"""The driver contract: entry smoke check and every query against its DuckDB oracle (sf0.001)."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="generated data not present")


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["month", "total_orders", "total_revenue", "avg_order_value", "row_no"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    import __spark_entry__ as E
    from marketlens.registry import ORACLE, QUERIES
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(E.queries())


def test_queries_match_oracle(spark):
    from concurrent.futures import ThreadPoolExecutor

    import duckdb
    from check_oracle import VIEWS, rows_of

    import __spark_entry__ as E
    con = duckdb.connect()
    for v in VIEWS:
        p = f"{SF}/{v}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{p}')")
    from marketlens.registry import QUERIES
    sql = E.oracle_sql()

    def check(item):
        # queries are independent Spark jobs; submitting a few at once hides
        # their fixed latency. Each thread reads DuckDB through its own cursor.
        name, fn = item
        got = fn(spark, SF).toPandas()
        want = con.cursor().execute(sql[name]).df()
        same = sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)
        return name, same

    with ThreadPoolExecutor(max_workers=4) as pool:
        results = dict(pool.map(check, QUERIES.items()))
    assert len(results) == len(QUERIES)
    assert [n for n, ok in results.items() if not ok] == []


def test_reviews_by_category_has_rows_where_the_threshold_leaves_some(spark):
    import duckdb
    from check_oracle import VIEWS, rows_of

    from marketlens.registry import ORACLE, QUERIES
    sf, con = SF.replace("0.001", "0.01"), duckdb.connect()
    for v in VIEWS:
        if os.path.exists(f"{sf}/{v}.parquet"):
            con.execute(f"CREATE VIEW {v} AS SELECT * FROM read_parquet('{sf}/{v}.parquet')")
    got = QUERIES["q07_reviews_by_category"](spark, sf).toPandas()
    assert len(got) and rows_of(got) == rows_of(con.execute(ORACLE["q07_reviews_by_category"]).df())
