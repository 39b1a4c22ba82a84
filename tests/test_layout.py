"""Orders and items stored by month and bucketed by order: pruning, joins without a shuffle, equal results."""

from __future__ import annotations

import os
import re
from dataclasses import replace

import pytest
from conftest import rows, ts
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from marketlens.plans import reports as R
from marketlens.session import scratch_path
from marketlens.sources.driver import driver_tables
from marketlens.sources.layout import MONTH, read_by_month, read_last_months, write_by_month

SF = "/root/testdata/sf0.001"
SINCE = "1997-06-15"


@pytest.fixture(scope="module")
def gen(spark):
    if not os.path.isdir(SF):
        pytest.skip("generated data not present")
    return driver_tables(spark, SF)


@pytest.fixture(scope="module")
def layout(spark, gen):
    return write_by_month(gen, scratch_path(spark, "test-layout"), buckets=4)


def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return old


def final_plan(df) -> str:
    df.collect()
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]



def test_a_start_date_reads_later_months_only(spark, gen, layout):
    whole, later = read_by_month(spark, layout, gen), read_by_month(spark, layout, gen, SINCE)
    for name in ("orders", "order_items"):
        every = spark.table(getattr(layout, name)).select(F.date_format(MONTH, "yyyy-MM")).distinct().collect()
        every = {r[0] for r in every if r[0]}
        read = {r[0] for r in getattr(later, name).select(F.regexp_extract(F.input_file_name(), MONTH + r"=(\d{4}-\d\d)", 1)).distinct().collect()}
        assert read == {m for m in every if m >= "1997-06"} and read < every
        assert getattr(whole, name).count() == getattr(gen, name).count()


def test_q1_has_no_exchange_under_the_order_join(spark, gen, layout):
    old = no_broadcast(spark)
    try:
        p = final_plan(R.monthly_revenue(read_by_month(spark, layout, gen, SINCE), since=SINCE))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scans = re.findall(r"PartitionFilters: \[([^\]]*)\]", p)
    assert len(scans) == 2 and all(f"{MONTH}" in s and ">=" in s for s in scans)
    join = p[p.index("SortMergeJoin"):] if "SortMergeJoin" in p else p[p.index("ShuffledHashJoin"):]
    assert "Exchange" not in join


def test_results_equal_those_of_plain_tables(spark, gen, layout):
    t = read_by_month(spark, layout, gen, SINCE)
    assert rows(R.monthly_revenue(t, since=SINCE)) == rows(R.monthly_revenue(gen, since=SINCE))
    whole = read_by_month(spark, layout, gen)
    for report in (R.orders_by_state, R.top_sellers, R.freight_by_category):
        assert rows(report(whole)) == rows(report(gen))


def test_the_newest_months_are_found_while_the_query_runs(spark, gen, layout):
    t = read_last_months(spark, layout, gen, 3)
    newest = gen.orders.agg(F.max(F.date_trunc("month", "order_purchase_timestamp"))).first()[0]
    since = gen.orders.select(F.add_months(F.lit(newest).cast("date"), -2)).first()[0].isoformat()
    assert t.orders.count() == gen.orders.where(F.col("order_purchase_timestamp") >= F.lit(since).cast("timestamp_ntz")).count() > 0
    assert rows(R.monthly_revenue(t, since="1900-01-01")) == rows(R.monthly_revenue(gen, since=since))
    assert "Subquery" in re.search(r"PartitionFilters: \[[^\]]*\]", final_plan(t.order_items.select("price"))).group(0).title()


def test_a_second_load_is_appended_with_items_of_older_orders(spark, gen):
    path = scratch_path(spark, "test-layout-two")
    early = F.col("order_id") % 2 == 0
    one = replace(gen, orders=gen.orders.where(early), order_items=gen.order_items.where(early & (F.col("order_item_id") == 1)))
    two = replace(gen, orders=gen.orders.where(~early), order_items=gen.order_items.where(~(early & (F.col("order_item_id") == 1))))
    layout = write_by_month(one, path, buckets=4)
    assert write_by_month(two, path, buckets=4, layout=layout, all_orders=gen.orders) == layout
    t = read_by_month(spark, layout, gen, SINCE)
    assert rows(R.monthly_revenue(t, since=SINCE)) == rows(R.monthly_revenue(gen, since=SINCE))


def test_items_without_an_order_and_orders_without_a_time(spark, fixture_tables):
    t = fixture_tables
    stray = t.order_items.limit(1).withColumn("order_id", F.lit("nobody's")).unionByName(
        t.order_items.limit(1).withColumn("order_id", F.lit(None).cast("string")))
    timeless = t.orders.where("order_id = 'o1'").withColumn("order_id", F.lit("o0")).withColumn(
        "order_purchase_timestamp", F.lit(None).cast("timestamp_ntz"))
    odd = replace(t, orders=t.orders.unionByName(timeless), order_items=t.order_items.unionByName(stray))
    layout = write_by_month(odd, scratch_path(spark, "test-layout-odd"), buckets=2)
    whole = read_by_month(spark, layout, odd)
    assert whole.orders.count() == odd.orders.count() and whole.order_items.count() == odd.order_items.count()
    pruned = read_by_month(spark, layout, odd, "2017-02-01")
    assert pruned.order_items.where("order_id is null or order_id = 'nobody''s'").count() == 0
    assert rows(R.monthly_revenue(pruned, since="2017-02-01")) == rows(R.monthly_revenue(odd, since="2017-02-01"))


def test_one_order_in_two_months_raises(spark, fixture_tables):
    t = fixture_tables
    again = t.orders.where("order_id = 'o1'").withColumn("order_purchase_timestamp", F.lit(ts("2017-06-01 00:00:00")))
    with pytest.raises(PySparkException, match="several months"):
        write_by_month(replace(t, orders=t.orders.unionByName(again)), scratch_path(spark, "test-layout-twice"), buckets=2)


def test_empty_tables(spark, fixture_tables):
    t = replace(fixture_tables, orders=fixture_tables.orders.where("false"), order_items=fixture_tables.order_items.where("false"))
    layout = write_by_month(t, scratch_path(spark, "test-layout-empty"), buckets=2)
    assert rows(R.monthly_revenue(read_by_month(spark, layout, t, "2017-01-01"), since="2017-01-01")) == []
