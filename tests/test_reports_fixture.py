"""Reports on the hand-made fixture: exact rows, in order (FIXTURES.md section 3)."""

from __future__ import annotations

import datetime as dt

from conftest import rows

from marketlens.plans import reports as R


def month(y, m):
    return dt.datetime(y, m, 1)


def test_q01_monthly_revenue(fixture_tables):
    assert rows(R.monthly_revenue(fixture_tables)) == [
        (month(2017, 1), 1, 33.51, 16.76),      # 16.755 rounds up
        (month(2017, 2), 2, 183.00, 61.00),
        (month(2017, 3), 1, 88.05, 88.05),
    ]


def test_q02_revenue_by_category(fixture_tables):
    assert rows(R.revenue_by_category(fixture_tables)) == [
        ("health_beauty", 3, 110.00, 36.67),
        ("esporte", 2, 100.01, 50.01),          # 50.005 rounds up
        ("Unknown", 2, 65.00, 32.50),
    ]


def test_q03_orders_by_state(fixture_tables):
    assert rows(R.orders_by_state(fixture_tables)) == [
        ("RJ", 2, 85.00, 42.50),                # tie on 2 orders broken by state
        ("SP", 2, 130.01, 43.34),
        ("MA", 1, 60.00, 30.00),
    ]


def test_q04_delivery_delay(fixture_tables):
    assert rows(R.delivery_delay(fixture_tables)) == [
        ("SP", 2, 1, 50.00, 7.4),
        ("MA", 1, 0, 0.00, 5.0),                # no estimate: not late
        ("RJ", 1, 0, 0.00, 2.0),
    ]


def test_q05_payment_methods(fixture_tables):
    assert rows(R.payment_methods(fixture_tables)) == [
        ("credit_card", 3, 112.51, 37.50, 5.0),
        ("boleto", 2, 188.05, 94.03, 1.0),      # 94.025 rounds up
        ("voucher", 1, 10.00, 10.00, 1.0),
    ]


def test_q06_top_sellers(fixture_tables):
    assert rows(R.top_sellers(fixture_tables)) == [
        ("s2", "niteroi", "RJ", 2, 260.00, 65.00, 2.25),   # o2's item counted once per review
        ("s1", "campinas", "SP", 2, 35.01, 11.67, 4.67),
    ]


def test_q07_reviews_by_category(fixture_tables):
    assert rows(R.reviews_by_category(fixture_tables, min_reviews=1)) == [
        ("Unknown", 2, 3.50, 0, 0),
        ("health_beauty", 5, 3.20, 2, 1),       # esporte has 1 review: filtered
    ]


def test_q08_delay_vs_reviews(fixture_tables):
    assert rows(R.delay_vs_reviews(fixture_tables)) == [
        ("On Time", 2, 4.50, None),
        ("Late", 3, 2.00, 1.3),                 # no estimate counts as Late; 1.25 rounds up
    ]


def test_q08b_review_distribution(fixture_tables):
    assert rows(R.review_distribution(fixture_tables)) == [
        ("Late", 1, 1), ("Late", 2, 1), ("Late", 3, 1), ("On Time", 4, 1), ("On Time", 5, 1)]


def test_q09_repeat_customers(fixture_tables):
    assert rows(R.repeat_customers(fixture_tables)) == [
        ("One-time buyer", 3, 75.00),
        ("Repeat (2 orders)", 1, 25.00),        # c1 and c2 are one person
    ]


def test_q09b_short_labels(fixture_tables):
    assert rows(R.loyalty_short_labels(fixture_tables)) == [("One-time", 3, 75.00), ("Repeat (2x)", 1, 25.00)]


def test_q10_freight_by_category(fixture_tables):
    assert rows(R.freight_by_category(fixture_tables, min_avg_price=30)) == [
        ("Unknown", 32.50, 3.50, 15.0),
        ("health_beauty", 35.83, 5.46, 11.7),   # zero price skipped in the ratio only
        ("esporte", 50.01, 5.03, 10.0),
    ]


def test_q10_default_threshold_keeps_unrounded_comparison(fixture_tables):
    # avg price per category: Unknown 32.5, health_beauty 35.83.., esporte 50.005 > 50
    assert [r[0] for r in rows(R.freight_by_category(fixture_tables))] == ["esporte"]


def test_reports_unchanged_under_repartition(fixture_tables):
    from marketlens.tables import Tables
    for n in (1, 7):
        t = Tables(**{k: v.repartition(n) for k, v in fixture_tables.as_dict().items()})
        for name, fn in R.REPORTS.items():
            assert rows(fn(t)) == rows(fn(fixture_tables)), (name, n)


def test_q06_repeated_seller_rows_match_join_first_semantics(spark, fixture_tables):
    from pyspark.sql import functions as F

    from marketlens.tables import Tables
    s = fixture_tables.sellers
    same = s.unionByName(s.filter(F.col("seller_id") == "s1"))
    other = s.unionByName(s.filter(F.col("seller_id") == "s1").withColumn("seller_city", F.lit("other")))
    t_same = Tables(**{**fixture_tables.as_dict(), "sellers": same})
    t_other = Tables(**{**fixture_tables.as_dict(), "sellers": other})
    assert rows(R.top_sellers(t_same)) == [
        ("s2", "niteroi", "RJ", 2, 260.00, 65.00, 2.25),
        ("s1", "campinas", "SP", 2, 70.02, 11.67, 4.67)]       # one group, sums doubled
    assert rows(R.top_sellers(t_other)) == [
        ("s2", "niteroi", "RJ", 2, 260.00, 65.00, 2.25),
        ("s1", "campinas", "SP", 2, 35.01, 11.67, 4.67),
        ("s1", "other", "SP", 2, 35.01, 11.67, 4.67)]
