"""The data behind each dashboard chart.

Drawing is left to the caller; these frames restate in data what the chart
library does with a report frame: the bars' re-sorting (``plot_order``), the
pie's percentages (``share``) and the grouped bars' series (a pivot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions.exprs import LATE, ON_TIME
from marketlens.operators.ordering import asc, plot_order, reverse, sort_cols
from marketlens.operators.windows import share_of_total
from marketlens.plans import reports as R
from marketlens.tables import Tables

# Bars are drawn bottom-up: the exact reverse of the top-k order.
CATEGORY_BARS_ORDER = reverse(R.ORDER["q02"])
REVIEW_BARS_ORDER = reverse(R.ORDER["q07"])


def monthly_trend(report: DataFrame) -> DataFrame:
    """C1 from Q1: month, revenue and orders (a two-axis series)."""
    return report.select("month", "total_revenue", "total_orders").orderBy(*sort_cols(R.ORDER["q01"]))


def category_bars(report: DataFrame, k: int = 15) -> DataFrame:
    """C2 from Q2: top categories by revenue, numbered ascending for horizontal bars."""
    return plot_order(report.select("category", "total_revenue", "total_orders"), R.ORDER["q02"], k, CATEGORY_BARS_ORDER)


def state_bars(report: DataFrame) -> DataFrame:
    """C3 from Q3: state, orders, revenue (the bar colour)."""
    return report.select("state", "total_orders", "total_revenue").orderBy(*sort_cols(R.ORDER["q03"]))


def delivery_scatter(report: DataFrame) -> DataFrame:
    """C4 from Q4: x mean days, y late %, size deliveries, label state."""
    return (report.select("customer_state", "total_delivered", "late_delivery_pct", "avg_delivery_days")
            .orderBy(*sort_cols(R.ORDER["q04"])))


def payment_share(report: DataFrame) -> DataFrame:
    """C5 from Q5: transactions per payment type with their share of all transactions."""
    cols = report.select("payment_type", "total_transactions", "avg_value")
    return share_of_total(cols, "total_transactions").orderBy(*sort_cols(R.ORDER["q05"]))


def review_bars(report: DataFrame, k: int = 15) -> DataFrame:
    """C6 from Q7: best-reviewed categories, numbered ascending by score."""
    return plot_order(report.select("category", "avg_score", "total_reviews"), R.ORDER["q07"], k, REVIEW_BARS_ORDER)


def score_distribution(report: DataFrame) -> DataFrame:
    """C7 from Q8b: one row per review score, one column per delivery result (grouped bars).

    The pivot values are named, so no extra job discovers them.
    """
    wide = report.groupBy("review_score").pivot("delivery_result", [ON_TIME, LATE]).agg(F.sum("count"))
    return (wide.select("review_score", F.col(f"`{ON_TIME}`").alias("on_time"), F.col(f"`{LATE}`").alias("late"))
            .orderBy(*sort_cols([asc("review_score")])))


def segment_share(report: DataFrame) -> DataFrame:
    """C8 from Q9b: loyalty segments (short labels) with customers and share (pie and funnel)."""
    return share_of_total(report.select("segment", "customer_count"), "customer_count").orderBy(*sort_cols(R.ORDER["q09b"]))


def freight_scatter(report: DataFrame) -> DataFrame:
    """C9 from Q10: x mean price, y mean freight, size/colour freight %, label category."""
    return (report.select("category", "avg_product_price", "avg_freight", "freight_pct_of_price")
            .orderBy(*sort_cols(R.ORDER["q10"])))


# One chart alone, straight from the tables; the catalog draws them from the written reports.
def chart_monthly_trend(t: Tables, since: str = "2017-01-01") -> DataFrame:
    return monthly_trend(R.monthly_revenue(t, since=since, narrow=True, ordered=False))


def chart_category_bars(t: Tables, k: int = 15) -> DataFrame:
    return category_bars(R.revenue_by_category(t, k=k, narrow=True), k)


def chart_state_bars(t: Tables, k: int = 10) -> DataFrame:
    return state_bars(R.orders_by_state(t, k=k, narrow=True))


def chart_delivery_scatter(t: Tables) -> DataFrame:
    return delivery_scatter(R.delivery_delay(t, narrow=True, ordered=False))


def chart_payment_share(t: Tables) -> DataFrame:
    return payment_share(R.payment_methods(t, narrow=True))


def chart_review_bars(t: Tables, min_reviews: int = 100, k: int = 15) -> DataFrame:
    return review_bars(R.reviews_by_category(t, min_reviews=min_reviews, k=k, narrow=True), k)


def chart_score_distribution(t: Tables) -> DataFrame:
    return score_distribution(R.review_distribution(t))


def chart_segment_share(t: Tables) -> DataFrame:
    return segment_share(R.loyalty_short_labels(t))


def chart_freight_scatter(t: Tables, min_avg_price=50, k: int = 15) -> DataFrame:
    return freight_scatter(R.freight_by_category(t, min_avg_price=min_avg_price, k=k))


CHARTS = {
    "chart_monthly_trend": chart_monthly_trend,
    "chart_category_bars": chart_category_bars,
    "chart_state_bars": chart_state_bars,
    "chart_delivery_scatter": chart_delivery_scatter,
    "chart_payment_share": chart_payment_share,
    "chart_review_bars": chart_review_bars,
    "chart_score_distribution": chart_score_distribution,
    "chart_segment_share": chart_segment_share,
    "chart_freight_scatter": chart_freight_scatter,
}
