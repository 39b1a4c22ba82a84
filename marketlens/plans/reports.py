"""The ten business reports as lazy DataFrame functions.

Each report takes :class:`Tables` and parameters (reference defaults) and
returns a sorted DataFrame with the reference's column names. Values are
rounded half away from zero in decimal and exposed as DOUBLE.

Plan shape. Where an aggregate is linear (sums and counts) the fact rows are
pre-aggregated to the join key before a join: items per order, reviews per
order, joined rows per product. The result is the same as aggregating after
the join (including the reference's fan-out: an item counts once per review
of its order), but a hot key collapses map-side and the next shuffle moves
one row per key instead of one per fact row. Joins are written so that
consecutive joins share a key (order_id) and a COUNT(DISTINCT order_id)
follows an order_id-partitioned join, which lets Spark reuse the partitioning
instead of shuffling again.

Semantics kept from the reference on purpose:

* ``avg_order_value`` (Q1, Q3) is the mean per item row, not per order.
* Q6 counts an item once per review of its order; orders without a review drop out.
* Q7 counts a review once per item of its order.
* Q8 ``total_orders`` counts reviews.
* A delivered order with no estimate is not late in Q4 but 'Late' in Q8.
* The status filter is absent in Q5, Q7 and Q10.
* ``HAVING`` in Q10 compares the unrounded mean; sorting uses rounded values,
  with the group key ascending as tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import numeric as N
from marketlens.functions.exprs import (SEGMENT_LABELS, SHORT_SEGMENT_LABELS, delivery_result,
                                        late_flag, segment_expr)
from marketlens.operators.aggregates import count_distinct, count_rows, count_where, month_start
from marketlens.operators.joins import product_categories
from marketlens.operators.ordering import asc, desc, sort_cols, top_k
from marketlens.operators.relational import filter_eq, filter_not_null, filter_since
from marketlens.operators.skew import heaviest, heavy_hitters, salted_join
from marketlens.operators.windows import window_share
from marketlens.tables import Tables

DELIVERED = "delivered"

# Sort orders of the reports (reference key first, then the tie-break).
ORDER = {
    "q01": [asc("month")],
    "q02": [desc("total_revenue"), asc("category")],
    "q03": [desc("total_orders"), asc("state")],
    "q04": [desc("late_delivery_pct"), asc("customer_state")],
    "q05": [desc("total_transactions"), asc("payment_type")],
    "q06": [desc("total_revenue"), asc("seller_id"), asc("seller_city"), asc("seller_state")],
    "q07": [desc("avg_score"), asc("category")],
    "q08": [desc("avg_review_score"), asc("delivery_result")],
    "q08b": [asc("delivery_result"), asc("review_score")],
    "q09": [desc("customer_count"), asc("customer_segment")],
    "q09b": [desc("customer_count"), asc("segment")],
    "q10": [desc("freight_pct_of_price"), asc("category")],
}


def delivered_orders(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Orders with the given status."""
    return filter_eq(t.orders, "order_status", status)


def item_totals(t: Tables) -> DataFrame:
    """Items pre-aggregated per order: sums and counts of price and of price + freight (for Q1 and Q3)."""
    amount = F.col("price") + F.col("freight_value")
    return t.order_items.groupBy("order_id").agg(
        F.sum(amount).alias("amount_sum"), F.count(amount).alias("amount_n"),
        F.sum("price").alias("price_sum"), F.count("price").alias("price_n"))


# --------------------------------------------------------------------------- Q1
def monthly_revenue(t: Tables, status: str = DELIVERED, since: str = "2017-01-01",
                    narrow: bool = False, ordered: bool = True, exact: bool = False,
                    per_order: DataFrame | None = None) -> DataFrame:
    """Q1: orders, revenue (price + freight) and mean item value per purchase month.

    ``narrow=True`` gives the dashboard's three columns (no average); ``ordered=False``
    skips the final sort and ``exact=True`` leaves the rounded revenue DECIMAL (for
    callers that aggregate further). ``per_order`` is :func:`item_totals` where it is at hand.
    """
    per_order = item_totals(t) if per_order is None else per_order
    orders = filter_since(delivered_orders(t, status), "order_purchase_timestamp", since)
    rows = (orders.select("order_id", month_start("order_purchase_timestamp").alias("month"))
            .join(per_order.select("order_id", "amount_sum", "amount_n"), "order_id"))
    cols = [count_distinct("order_id").alias("total_orders"),
            (F.round(F.sum("amount_sum"), 2) if exact else N.round_out(F.sum("amount_sum"), 2)).alias("total_revenue")]
    if not narrow:
        cols.append(N.mean_of(F.sum("amount_sum"), F.sum("amount_n"), 2).alias("avg_order_value"))
    out = rows.groupBy("month").agg(*cols)
    return out.orderBy(*sort_cols(ORDER["q01"])) if ordered else out


# --------------------------------------------------------------------------- Q2
def revenue_by_category(t: Tables, status: str = DELIVERED, k: int = 15,
                        narrow: bool = False) -> DataFrame:
    """Q2: top ``k`` categories by item revenue of delivered orders."""
    items = t.order_items.select("order_id", "product_id", "price")
    orders = delivered_orders(t, status).select("order_id")
    # product join first, order join second: the distinct order count then
    # runs on the order_id partitioning of the last join.
    rows = items.join(product_categories(t), "product_id").join(orders, "order_id")
    cols = [count_distinct("order_id").alias("total_orders"),
            N.sum_money("price").alias("total_revenue")]
    if not narrow:
        cols.append(N.avg_exact("price", 2).alias("avg_item_price"))
    out = rows.groupBy("category").agg(*cols)
    if narrow:
        out = out.select("category", "total_revenue", "total_orders")
    return top_k(out, ORDER["q02"], k)


# --------------------------------------------------------------------------- Q3
def orders_by_state(t: Tables, status: str = DELIVERED, k: int = 10,
                    narrow: bool = False, per_order: DataFrame | None = None) -> DataFrame:
    """Q3: top ``k`` customer states by delivered orders (with item revenue)."""
    per_order = item_totals(t) if per_order is None else per_order
    rows = (delivered_orders(t, status).select("order_id", "customer_id")
            .join(t.customers.select("customer_id", "customer_state"), "customer_id")
            .join(per_order.select("order_id", "price_sum", "price_n"), "order_id"))
    cols = [count_distinct("order_id").alias("total_orders"),
            N.round_out(F.sum("price_sum"), 2).alias("total_revenue")]
    if not narrow:
        cols.append(N.mean_of(F.sum("price_sum"), F.sum("price_n"), 2).alias("avg_order_value"))
    out = rows.groupBy(F.col("customer_state").alias("state")).agg(*cols)
    return top_k(out, ORDER["q03"], k)


# --------------------------------------------------------------------------- Q4
def delivery_delay(t: Tables, status: str = DELIVERED, narrow: bool = False,
                   ordered: bool = True) -> DataFrame:
    """Q4: per customer state: delivered orders, late ones, late %, mean delivery days.

    ``ordered=False`` skips the final sort (for callers that aggregate further).
    """
    orders = filter_not_null(delivered_orders(t, status), "order_delivered_customer_date")
    us = N.micros_between("order_purchase_timestamp", "order_delivered_customer_date")
    # sums and counts per customer first: a customer with a huge share of the
    # orders collapses map-side, and the join sees one row per customer
    per_customer = orders.groupBy("customer_id").agg(
        count_rows().alias("n"), F.sum(late_flag()).alias("late"),
        N.sum_micros(us).alias("sum_us"), F.count(us).alias("n_us"))
    agg = (per_customer.join(t.customers.select("customer_id", "customer_state"), "customer_id")
           .groupBy("customer_state").agg(
               F.sum("n").alias("total_delivered"),
               F.sum("late").cast("bigint").alias("late_deliveries"),
               F.sum("sum_us").alias("sum_us"), F.sum("n_us").alias("n_us")))
    cols = [F.col("customer_state"), F.col("total_delivered")]
    if not narrow:
        cols.append(F.col("late_deliveries"))
    cols += [N.pct("late_deliveries", "total_delivered").alias("late_delivery_pct"),
             N.avg_days("sum_us", "n_us", 1).alias("avg_delivery_days")]
    out = agg.select(*cols)
    return out.orderBy(*sort_cols(ORDER["q04"])) if ordered else out


# --------------------------------------------------------------------------- Q5
def payment_methods(t: Tables, narrow: bool = False) -> DataFrame:
    """Q5: transactions, value and instalments per payment type (all orders)."""
    cols = [count_rows().alias("total_transactions")]
    if not narrow:
        cols.append(N.sum_money("payment_value").alias("total_value"))
    cols.append(N.avg_exact("payment_value", 2).alias("avg_value"))
    if not narrow:
        cols.append(N.avg_exact("payment_installments", 1, integral=True).alias("avg_installments"))
    return t.order_payments.groupBy("payment_type").agg(*cols).orderBy(*sort_cols(ORDER["q05"]))


# --------------------------------------------------------------------------- Q6
def review_totals(t: Tables) -> DataFrame:
    """Reviews pre-aggregated per order: rows, non-NULL ids, score sums and counts."""
    score = F.col("review_score")
    return t.order_reviews.groupBy("order_id").agg(
        count_rows().alias("n_rev"), F.count("review_id").alias("n_rid"),
        F.sum(score).alias("score_sum"), F.count(score).alias("score_n"),
        count_where(score == 5).alias("five"), count_where(score == 1).alias("one"))


def top_sellers(t: Tables, status: str = DELIVERED, k: int = 10, reviews: DataFrame | None = None,
                per_order: DataFrame | None = None) -> DataFrame:
    """Q6: top ``k`` sellers by revenue of delivered, reviewed orders, with review mean.

    Each item counts once per review of its order (the reference's fan-out).
    Items are summed per (order, seller) and reviews per order before the
    order join, so the fan-out becomes a product of sums (``price_sum *
    reviews``) and repeated items of a seller collapse map-side. What a hot
    order still has is a row per seller: such orders are found by a frequency
    sketch (or by ``per_order``, :func:`item_totals`, where it is at hand) and dealt out by seller (:mod:`marketlens.operators.skew`). The
    seller attributes join after the per-seller aggregate.
    """
    items = t.order_items.groupBy("order_id", "seller_id").agg(
        count_rows().alias("n_items"), F.sum("price").alias("price_sum"),
        F.count("price").alias("price_n"))
    reviewed = (delivered_orders(t, status).select("order_id")
                .join((review_totals(t) if reviews is None else reviews)
                      .select("order_id", "n_rev", "score_sum", "score_n"), "order_id"))
    hot = heavy_hitters(t.order_items, "order_id") if per_order is None else heaviest(per_order, "order_id", "price_n")
    rows = salted_join(items, reviewed, "order_id", "seller_id", hot)
    per_seller = rows.groupBy("seller_id").agg(
        count_distinct("order_id").alias("total_orders"),
        F.sum(F.col("price_sum") * F.col("n_rev")).alias("rev"),
        F.sum(F.col("price_n") * F.col("n_rev")).alias("rev_n"),
        F.sum(F.col("n_items") * F.col("score_sum")).alias("score_sum"),
        F.sum(F.col("n_items") * F.col("score_n")).alias("score_n"))
    # seller rows join after the aggregate; grouping on (id, city, state) then
    # reuses the join's seller_id partitioning, and a repeated seller row
    # multiplies the sums exactly as joining it before the aggregate would
    out = (per_seller.join(t.sellers.select("seller_id", "seller_city", "seller_state"), "seller_id")
           .groupBy("seller_id", "seller_city", "seller_state")
           .agg(F.max("total_orders").alias("total_orders"),
                F.sum("rev").alias("rev"), F.sum("rev_n").alias("rev_n"),
                F.sum("score_sum").alias("score_sum"), F.sum("score_n").alias("score_n"))
           .select("seller_id", "seller_city", "seller_state", "total_orders",
                   N.round_out("rev", 2).alias("total_revenue"),
                   N.mean_of("rev", "rev_n", 2).alias("avg_price"),
                   N.mean_of("score_sum", "score_n", 2, scale=0).alias("avg_review_score")))
    return top_k(out, ORDER["q06"], k)


# --------------------------------------------------------------------------- Q7
def reviews_by_category(t: Tables, min_reviews: int = 100, k: int = 15,
                        narrow: bool = False, reviews: DataFrame | None = None) -> DataFrame:
    """Q7: best-reviewed categories with more than ``min_reviews`` reviews (all orders).

    A review counts once per item of its order. Items get their category
    first (a plain shuffled join, which AQE splits for a hot product) and are
    counted per (order, category); reviews are summed per order. Their join
    therefore sees at most one row per category for any order, however many
    items it holds, and the per-category sums are products of the two.
    """
    item_cats = (t.order_items.select("order_id", "product_id")
                 .join(product_categories(t), "product_id")
                 .groupBy("order_id", "category").agg(count_rows().alias("n_items")))
    rows = ((review_totals(t) if reviews is None else reviews)
            .join(t.orders.select("order_id"), "order_id")
            .join(item_cats, "order_id"))
    sums = ["n_rid", "score_sum", "score_n", "five", "one"]
    per_cat = (rows.groupBy("category")
               .agg(*[F.sum(F.col(c) * F.col("n_items")).alias(c) for c in sums])
               .filter(F.col("n_rid") > min_reviews))
    cols = [F.col("category"), F.col("n_rid").alias("total_reviews"),
            N.mean_of("score_sum", "score_n", 2, scale=0).alias("avg_score")]
    if narrow:
        cols = [cols[0], cols[2], cols[1]]
    else:
        cols += [F.col("five").cast("bigint").alias("five_star"),
                 F.col("one").cast("bigint").alias("one_star")]
    return top_k(per_cat.select(*cols), ORDER["q07"], k)


# --------------------------------------------------------------------------- Q8
def delivery_status(t: Tables, status: str = DELIVERED) -> DataFrame:
    """P10: one row per (delivered order, review) with the delivery result and lateness.

    ``days_late_us`` is ``delivered - estimate`` in microseconds (NULL without an
    estimate); ``days_late`` is the same in days, rounded to 6 places.
    """
    orders = filter_not_null(delivered_orders(t, status), "order_delivered_customer_date")
    us = N.micros_between("order_estimated_delivery_date", "order_delivered_customer_date")
    return (orders.join(t.order_reviews, "order_id")
            .select("order_id", "review_score",
                    delivery_result().alias("delivery_result"),
                    us.alias("days_late_us"),
                    N.round_ratio(us, F.lit(N.MICROS_PER_DAY), 6).alias("days_late")))


def delay_vs_reviews(t: Tables, status: str = DELIVERED, reviews: DataFrame | None = None) -> DataFrame:
    """Q8: review mean and mean days late, on-time against late deliveries.

    Every (order, review) row counts, so an order's lateness is weighted by
    its number of reviews. Reviews are summed per order first (one shuffle,
    a heavily reviewed order collapses map-side), then joined to the orders.
    """
    orders = filter_not_null(delivered_orders(t, status), "order_delivered_customer_date")
    us = N.micros_between("order_estimated_delivery_date", "order_delivered_customer_date")
    rows = (orders.select("order_id", delivery_result().alias("delivery_result"), us.alias("late_us"))
            .join((review_totals(t) if reviews is None else reviews)
                  .select("order_id", "n_rev", "score_sum", "score_n"), "order_id"))
    late = F.col("late_us") > 0
    agg = rows.groupBy("delivery_result").agg(
        F.sum("n_rev").alias("total_orders"),
        F.sum("score_sum").alias("score_sum"), F.sum("score_n").alias("score_n"),
        F.sum(F.when(late, F.col("late_us").cast(N.HUGE_INT) * F.col("n_rev"))).alias("late_sum"),
        F.sum(F.when(late, F.col("n_rev"))).alias("late_n"))
    return agg.select(
        "delivery_result", "total_orders",
        N.mean_of("score_sum", "score_n", 2, scale=0).alias("avg_review_score"),
        N.avg_days("late_sum", "late_n", 1).alias("avg_days_late")).orderBy(*sort_cols(ORDER["q08"]))


def review_distribution(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Review count per (delivery result, score).

    A plain join of two shuffled inputs followed by a new aggregation
    exchange: AQE can split a hot order's partition without extra shuffles.
    """
    return (delivery_status(t, status).groupBy("delivery_result", "review_score")
            .agg(count_rows().alias("count")).orderBy(*sort_cols(ORDER["q08b"])))


# --------------------------------------------------------------------------- Q9
def repeat_customers(t: Tables, status: str = DELIVERED,
                     labels: Sequence[str] = SEGMENT_LABELS,
                     segment_col: str = "customer_segment") -> DataFrame:
    """Q9: customers (persons) per loyalty segment with their share in percent."""
    per_person = (delivered_orders(t, status).select("order_id", "customer_id")
                  .join(t.customers.select("customer_id", "customer_unique_id"), "customer_id")
                  .groupBy("customer_unique_id")
                  .agg(count_distinct("order_id").alias("order_count")))
    seg = (per_person.groupBy(segment_expr("order_count", labels).alias(segment_col))
           .agg(count_rows().alias("customer_count")))
    order = ORDER["q09"] if segment_col == "customer_segment" else [desc("customer_count"), asc(segment_col)]
    return window_share(seg, "customer_count", "percentage").orderBy(*sort_cols(order))


def loyalty_short_labels(t: Tables, status: str = DELIVERED) -> DataFrame:
    """Q9 with the dashboard's short labels in a ``segment`` column."""
    return repeat_customers(t, status, SHORT_SEGMENT_LABELS, "segment")


def short_labels(report: DataFrame) -> DataFrame:
    """Q9b from Q9."""
    short = F.create_map(*[F.lit(x) for pair in zip(SEGMENT_LABELS, SHORT_SEGMENT_LABELS) for x in pair])
    return (report.select(short[F.col("customer_segment")].alias("segment"), "customer_count", "percentage")
            .orderBy(*sort_cols(ORDER["q09b"])))


# --------------------------------------------------------------------------- Q10
def freight_by_category(t: Tables, min_avg_price=50, k: int = 15) -> DataFrame:
    """Q10: freight as a share of price per category (all orders), top ``k``.

    ``freight_pct_of_price`` is the mean of the per-item ratio
    ``freight / NULLIF(price, 0) * 100`` (not a ratio of means); a zero price
    drops from that mean only.
    """
    ratio = F.col("freight_value") / F.nullif(F.col("price"), F.lit(0)) * 100
    sums = {"price_sum": F.sum("price"), "price_n": F.count("price"),
            "freight_sum": F.sum("freight_value"), "freight_n": F.count("freight_value"),
            "ratio_sum": F.sum(ratio), "ratio_n": F.count(ratio)}
    per_product = t.order_items.groupBy("product_id").agg(*[c.alias(n) for n, c in sums.items()])
    per_cat = (per_product.join(product_categories(t), "product_id")
               .groupBy("category").agg(*[F.sum(n).alias(n) for n in sums])
               .filter(F.col("price_sum") > F.col("price_n") * F.lit(min_avg_price)))
    out = per_cat.select(
        "category",
        N.mean_of("price_sum", "price_n", 2).alias("avg_product_price"),
        N.mean_of("freight_sum", "freight_n", 2).alias("avg_freight"),
        N.mean_of("ratio_sum", "ratio_n", 1, scale=15).alias("freight_pct_of_price"))
    return top_k(out, ORDER["q10"], k)


REPORTS = {
    "q01_monthly_revenue": monthly_revenue,
    "q02_revenue_by_category": revenue_by_category,
    "q03_orders_by_state": orders_by_state,
    "q04_delivery_delay": delivery_delay,
    "q05_payment_methods": payment_methods,
    "q06_top_sellers": top_sellers,
    "q07_reviews_by_category": reviews_by_category,
    "q08_delay_vs_reviews": delay_vs_reviews,
    "q08b_review_distribution": review_distribution,
    "q09_repeat_customers": repeat_customers,
    "q09b_loyalty_short_labels": loyalty_short_labels,
    "q10_freight_by_category": freight_by_category,
}
