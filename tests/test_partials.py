"""Partial aggregates of loads, merged, against the reports over all rows."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from marketlens.plans import partials as P
from marketlens.plans import reports as R
from marketlens.session import scratch_path
from marketlens.sources import versions as V
from marketlens.tables import Tables


def split(t: Tables, first: bool) -> Tables:
    """Orders o1 to o3 with their items, payments and reviews, or the others."""
    of = F.col("order_id") <= "o3" if first else F.col("order_id") > "o3"
    return Tables(**{**t.as_dict(), **{n: t.as_dict()[n].where(of) for n in ("orders", "order_items", "order_payments", "order_reviews")}})


@pytest.fixture(scope="module")
def numbers(spark, fixture_tables):
    return P.number_orders(fixture_tables.orders)


def numbered(t: Tables, numbers) -> Tables:
    return Tables(**{**t.as_dict(), "orders": t.orders.join(numbers, "order_id")})


def test_loads_add_up_to_the_full_reports(spark, fixture_tables, numbers):
    target = scratch_path(spark, "test-partials")
    t = numbered(fixture_tables, numbers)
    for n in (True, False, True):          # the third is the first again
        P.add_load(split(t, n), target, f"load-{n}", number="number")
    assert V.current(spark, target)["version"] == 2
    full = {"q01": R.monthly_revenue, "q02": R.revenue_by_category, "q03": R.orders_by_state, "q04": R.delivery_delay,
            "q05": R.payment_methods}
    for name, report in full.items():
        got = P.report(spark, target, name)
        want = report(fixture_tables, since="2016-01-01") if name == "q01" else report(fixture_tables)
        assert got.columns == want.columns and rows(got) == rows(want), name
    assert rows(P.report(spark, target, "q01", since="2017-01-01")) == rows(R.monthly_revenue(fixture_tables))
    with pytest.raises(ValueError, match="first of a month"):
        P.report(spark, target, "q01", since="2017-01-15")


def test_an_order_in_two_loads_counts_once(spark, fixture_tables, numbers):
    target = scratch_path(spark, "test-partials-late")
    t = numbered(fixture_tables, numbers)
    none = t.orders.where("false")
    for n in (1, 2):                        # second items come later than their order
        part = Tables(**{**t.as_dict(), "orders": t.orders if n == 1 else none,
                         "order_items": t.order_items.where(F.col("order_item_id") == n),
                         "order_payments": t.order_payments if n == 1 else t.order_payments.where("false")})
        P.add_load(part, target, str(n), orders=t.orders, number="number")
    assert rows(P.report(spark, target, "q01", since="2017-01-01")) == rows(R.monthly_revenue(fixture_tables))
    assert rows(P.report(spark, target, "q03")) == rows(R.orders_by_state(fixture_tables))
    assert rows(P.report(spark, target, "q04")) == rows(R.delivery_delay(fixture_tables))


def test_merged_reports_read_partials_alone(spark, fixture_tables, numbers):
    target = scratch_path(spark, "test-partials-plan")
    P.add_load(numbered(fixture_tables, numbers), target, "a", number="number")
    files = P.report(spark, target, "q02").inputFiles()
    assert files and all("/data/a/q02/" in f for f in files)


def test_bitmaps_count_exactly_over_buckets(spark):
    ids = spark.range(0, 200_000, 3).select((F.col("id") % 7).alias("k"), "id")
    halves = [P.bitmaps(ids.where(c), ["k"], "id", n=F.count("*")) for c in ("id < 120000", "id > 60000")]
    merged = P.merge_bitmaps(halves[0].unionByName(halves[1]), ["k"], "distinct", ["n"])
    want = ids.groupBy("k").agg(F.countDistinct("id").alias("distinct"))
    assert sorted(rows(merged.select("k", "distinct"))) == sorted(rows(want))
    assert merged.agg(F.sum("n")).first()[0] > ids.count()      # rows seen twice are summed twice


def test_numbers_are_dense_and_go_on(spark):
    a = P.number_orders(spark.range(1000).select(F.concat(F.lit("x"), "id").alias("order_id")).repartition(5))
    assert sorted(r.number for r in a.collect()) == list(range(1000))
    more = spark.range(900, 1100).select(F.concat(F.lit("x"), "id").alias("order_id"))
    b = P.number_orders(more.unionByName(more), a)
    assert sorted(r.number for r in b.collect()) == list(range(1000, 1100))
    assert P.number_orders(more.limit(0), a).count() == 0
