"""A hot key: one order holding a third of all items.

AQE must split the hot order's join partition in Q2 (a shuffled join whose
split needs one more exchange, allowed by forceOptimizeSkewedJoin), and every
report must give the same rows with and without skew handling. Thresholds are
scaled down to the test data; partition coalescing is off so each reducer
reads several map outputs, as on a cluster (a split follows map boundaries).
"""

from __future__ import annotations

import os
from contextlib import contextmanager

import pytest
from conftest import rows
from pyspark.sql import functions as F

from marketlens.plans import reports as R
from marketlens.session import scratch_path
from marketlens.sources.driver import driver_tables
from marketlens.sources.staging import stage_tables
from marketlens.tables import Tables

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="generated data not present")

SMALL_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextmanager
def conf(spark, settings):
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@pytest.fixture(scope="module")
def hot(spark):
    t = driver_tables(spark, SF)
    items = t.order_items.withColumn(
        "order_id", F.when(F.col("product_id") % 3 == 0, F.lit(7).cast("bigint")).otherwise(F.col("order_id")))
    t = Tables(**{**t.as_dict(), "order_items": items})
    return stage_tables(spark, t, scratch_path(spark, "test-skew"), files=8)


def final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_order_is_a_third_of_items(hot):
    assert hot.order_items.filter(F.col("order_id") == 7).count() * 3 >= hot.order_items.count() * 0.95


def test_aqe_splits_the_hot_order_in_q2(spark, hot):
    with conf(spark, {**SMALL_SKEW, "spark.sql.shuffle.partitions": "16"}):
        df = R.revenue_by_category(hot)
        got = rows(df)
        assert "skew=true" in final_plan(df)
    with conf(spark, {**SMALL_SKEW, "spark.sql.adaptive.skewJoin.enabled": "false"}):
        assert rows(R.revenue_by_category(hot)) == got


def test_reports_identical_with_and_without_skew_handling(spark, hot):
    jobs = {"q01": lambda t: R.monthly_revenue(t, since="1997-01-01"), "q03": R.orders_by_state,
            "q06": R.top_sellers, "q07": lambda t: R.reviews_by_category(t, min_reviews=1500),
            "q10": lambda t: R.freight_by_category(t, min_avg_price=53000)}
    with conf(spark, {**SMALL_SKEW, "spark.sql.shuffle.partitions": "16"}):
        on = {n: rows(f(hot)) for n, f in jobs.items()}
    with conf(spark, {**SMALL_SKEW, "spark.sql.adaptive.skewJoin.enabled": "false"}):
        off = {n: rows(f(hot)) for n, f in jobs.items()}
    assert on == off


# --------------------------------------------------------------------------- heavy hitters
def tasks_of(df):
    """Rows each task of the last shuffle hands on."""
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


@pytest.fixture(scope="module")
def many_sellers(spark):
    """30,000 items: a third belongs to one order, by 10,000 sellers."""
    items = spark.range(30_000).select(
        F.when(F.col("id") < 10_000, F.lit("hot")).otherwise(F.concat(F.lit("o"), F.col("id"))).alias("order_id"),
        F.lit(1).alias("order_item_id"), F.concat(F.lit("p"), F.col("id") % 50).alias("product_id"),
        F.concat(F.lit("s"), F.col("id") % 10_000).alias("seller_id"),
        F.lit(10).cast("decimal(10,2)").alias("price"), F.lit(1).cast("decimal(10,2)").alias("freight_value"))
    return items


def test_heaviest_of_counted_keys_are_found_and_bounded(spark, many_sellers):
    from marketlens.operators import skew
    counted = many_sellers.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    assert [r.order_id for r in skew.heaviest(counted, "order_id", "n").collect()] == ["hot"]
    assert skew.heaviest(counted.limit(0), "order_id", "n").count() == 0
    assert skew.heaviest(counted.select(F.lit(None).cast("string").alias("order_id"), "n"), "order_id", "n").count() == 0
    assert skew.heaviest(spark.range(250).select(F.col("id").alias("k"), F.lit(2).alias("n")), "k", "n").count() <= skew.HOT_KEYS


def test_heavy_hitters_are_found_and_bounded(spark, many_sellers):
    from marketlens.operators import skew
    assert [r.order_id for r in skew.heavy_hitters(many_sellers, "order_id").collect()] == ["hot"]
    assert skew.heavy_hitters(many_sellers, "seller_id").count() == 0
    assert skew.heavy_hitters(many_sellers.limit(0), "order_id").count() == 0
    assert skew.heavy_hitters(many_sellers.select(F.lit(None).cast("string").alias("order_id")), "order_id").count() == 0
    assert skew.heavy_hitters(spark.range(500).select((F.col("id") % 250).alias("k")), "k").count() <= skew.HOT_KEYS


def test_a_hot_orders_sellers_are_dealt_out(spark, many_sellers):
    from marketlens.operators.skew import heavy_hitters, salted_join
    per_order = many_sellers.select("order_id").distinct().withColumn("n_rev", F.lit(2))
    per_seller = many_sellers.groupBy("order_id", "seller_id").count()
    with conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
                      "spark.sql.shuffle.partitions": "16"}):
        plain = per_seller.join(per_order, "order_id")
        dealt = salted_join(per_seller, per_order, "order_id", "seller_id", heavy_hitters(many_sellers, "order_id"))
        assert sorted(rows(dealt.select("order_id", "seller_id", "count", "n_rev"))) == sorted(
            rows(plain.select("order_id", "seller_id", "count", "n_rev")))
        skewed, even = tasks_of(plain), tasks_of(dealt)
        assert skewed[-1] > 3 * skewed[len(skewed) // 2]
        assert even[-1] <= 3 * even[len(even) // 2]


def test_q6_with_a_hot_order_of_many_sellers(spark, many_sellers, fixture_tables):
    from marketlens.operators import skew
    n = many_sellers.select("order_id").distinct()
    orders = n.select("order_id", F.lit("c1").alias("customer_id"), F.lit("delivered").alias("order_status"))
    orders = fixture_tables.orders.limit(0).unionByName(orders, allowMissingColumns=True)
    reviews = n.select(F.concat(F.lit("r"), "order_id").alias("review_id"), "order_id", F.lit(4).alias("review_score"))
    reviews = fixture_tables.order_reviews.limit(0).unionByName(reviews, allowMissingColumns=True)
    sellers = many_sellers.select("seller_id").distinct().withColumns({"seller_city": F.lit("x"), "seller_state": F.lit("SP")})
    t = Tables(**{**fixture_tables.as_dict(), "order_items": many_sellers, "orders": orders, "order_reviews": reviews, "sellers": sellers})
    got = rows(R.top_sellers(t, k=20_000))
    # the hot order counts once for each of its 10,000 sellers, the other orders have one seller each
    assert len(got) == 10_000 and sum(r[3] for r in got) == 30_000
    assert {(r[3], r[4], r[6]) for r in got} == {(3, 30.0, 4.0)}
    assert skew.heavy_hitters(t.order_items, "order_id").count() == 1


def test_review_categories_and_a_hot_product(spark, hot):
    """J6 keeps its rows with a hot order; Q2 and Q7 split a product that holds a third of the items."""
    from marketlens.operators import joins as J
    with conf(spark, {**SMALL_SKEW, "spark.sql.shuffle.partitions": "16"}):
        df = J.review_categories(hot).select("review_id", "order_item_id", "product_id")
        on = df.groupBy().agg(F.count("*"), F.sum(F.xxhash64("review_id", "order_item_id", "product_id").cast("decimal(38,0)"))).first()
    with conf(spark, {**SMALL_SKEW, "spark.sql.adaptive.skewJoin.enabled": "false"}):
        df = J.review_categories(hot).select("review_id", "order_item_id", "product_id")
        off = df.groupBy().agg(F.count("*"), F.sum(F.xxhash64("review_id", "order_item_id", "product_id").cast("decimal(38,0)"))).first()
    assert on == off
    items = hot.order_items.withColumn("product_id", F.when(F.col("order_item_id") % 3 == 0, F.lit(5).cast("bigint")).otherwise(F.col("product_id")))
    t = stage_tables(spark, Tables(**{**hot.as_dict(), "order_items": items}), scratch_path(spark, "test-hot-product"), files=8)
    with conf(spark, {**SMALL_SKEW, "spark.sql.shuffle.partitions": "16"}):
        plans = {n: f(t) for n, f in (("q02", R.revenue_by_category), ("q07", lambda t: R.reviews_by_category(t, min_reviews=1500)))}
        got = {n: rows(df) for n, df in plans.items()}
        assert all("skew=true" in final_plan(df) for df in plans.values())
    with conf(spark, {**SMALL_SKEW, "spark.sql.adaptive.skewJoin.enabled": "false"}):
        assert got == {"q02": rows(R.revenue_by_category(t)), "q07": rows(R.reviews_by_category(t, min_reviews=1500))}
