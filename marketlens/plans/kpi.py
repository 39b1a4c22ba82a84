"""K1: the dashboard's headline numbers as one row.

* total_revenue: sum of the rounded monthly revenues (Q1, purchase month
  from ``since``, price + freight);
* total_orders: sum of the monthly distinct order counts;
* avg_late_pct: plain mean of the rounded per-state late percentages (Q4),
  not weighted by deliveries, to one place;
* top_category: first category of Q2 (revenue without freight);

plus display strings (``R$ 12.3M``, ``99,441``, ``10.4%``, title-cased
category). The three inputs are small aggregated frames; they are unioned
and reduced by one global aggregate, so no join is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import numeric as N
from marketlens.functions.exprs import display_int, display_millions, display_pct, title_case
from marketlens.operators.aggregates import first_by
from marketlens.plans.reports import DELIVERED, delivery_delay, monthly_revenue, revenue_by_category
from marketlens.tables import Tables


def kpi_summary(t: Tables, status: str = DELIVERED, since: str = "2017-01-01",
                k: int = 15) -> DataFrame:
    """K1 straight from the tables."""
    return kpi_from(monthly_revenue(t, status, since, narrow=True, ordered=False, exact=True),
                    delivery_delay(t, status, narrow=True, ordered=False),
                    revenue_by_category(t, status, k, narrow=True))


def kpi_from(monthly: DataFrame, delay: DataFrame, categories: DataFrame) -> DataFrame:
    """K1 from Q1, Q4 and Q2 (their rounded values, as DOUBLE or DECIMAL)."""
    months = monthly.select(F.col("total_revenue").cast("decimal(38,2)").alias("month_revenue"),
                            F.col("total_orders").alias("month_orders"))
    states = delay.select(F.col("late_delivery_pct").cast("decimal(10,2)").alias("state_pct"))
    cats = categories.select(F.col("category"), F.col("total_revenue").alias("category_revenue"), F.lit(True).alias("is_category"))
    parts = (months.unionByName(states, allowMissingColumns=True)
             .unionByName(cats, allowMissingColumns=True))
    row = parts.agg(
        F.sum("month_revenue").alias("rev"),
        F.sum("month_orders").alias("total_orders"),
        F.sum("state_pct").alias("pct_sum"), F.count("state_pct").alias("pct_n"),
        first_by("category", [-F.col("category_revenue"), F.col("category")],
                 where=F.col("is_category")).alias("top_category"))
    avg_late = N.mean_of("pct_sum", "pct_n", 1)
    return row.select(
        F.col("rev").cast("double").alias("total_revenue"),
        F.col("total_orders"),
        avg_late.alias("avg_late_pct"),
        F.col("top_category"),
        display_millions("rev").alias("total_revenue_label"),
        display_int("total_orders").alias("total_orders_label"),
        display_pct(avg_late).alias("avg_late_label"),
        title_case("top_category").alias("top_category_label"))
