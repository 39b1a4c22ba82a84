"""Operator-level entries: each isolates one operator of the reports on the
stand-in tables (whole tables, no sampling), with its DuckDB statement."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens import oracle as O
from marketlens.functions import exprs as X
from marketlens.functions import numeric as N
from marketlens.operators import aggregates as AG
from marketlens.operators import joins as J
from marketlens.operators import ordering as OR
from marketlens.operators import relational as RL
from marketlens.operators.windows import share_of_total, window_share
from marketlens.plans.reports import delivery_status
from marketlens.registry import as_double, numbered, register
from marketlens.tables import Tables

M = O.with_mapping
PURCHASE, DELIVERED_AT, ESTIMATE = ("order_purchase_timestamp", "order_delivered_customer_date",
                                    "order_estimated_delivery_date")


# --------------------------------------------------------------------------- projections, filters
@register("op_project_alias", M(
    "SELECT order_id AS id, customer_id AS customer, order_status AS status FROM x_orders"))
def op_project_alias(t: Tables) -> DataFrame:
    return RL.project(t.orders, {"id": "order_id", "customer": "customer_id", "status": "order_status"})


@register("op_filter_equals", M(
    "SELECT order_id, customer_id, order_status FROM x_orders WHERE order_status = 'delivered'"))
def op_filter_equals(t: Tables) -> DataFrame:
    return RL.filter_eq(t.orders, "order_status", "delivered").select("order_id", "customer_id", "order_status")


@register("op_filter_since", M(
    f"SELECT order_id, {PURCHASE} FROM x_orders WHERE {PURCHASE} >= TIMESTAMP '1997-01-01'"))
def op_filter_since(t: Tables) -> DataFrame:
    return RL.filter_since(t.orders, PURCHASE, "1997-01-01").select("order_id", PURCHASE)


@register("op_filter_not_null", M(
    f"SELECT order_id, {DELIVERED_AT} FROM x_orders WHERE {DELIVERED_AT} IS NOT NULL"))
def op_filter_not_null(t: Tables) -> DataFrame:
    return RL.filter_not_null(t.orders, DELIVERED_AT).select("order_id", DELIVERED_AT)


@register("op_filter_conjunction", M(
    f"SELECT order_id FROM x_orders WHERE order_status = 'delivered' AND {DELIVERED_AT} IS NOT NULL"))
def op_filter_conjunction(t: Tables) -> DataFrame:
    return RL.filter_all(t.orders, [F.col("order_status") == "delivered",
                                    F.col(DELIVERED_AT).isNotNull()]).select("order_id")


@register("op_having_count", M(
    "SELECT order_id, COUNT(review_id) AS n_reviews FROM x_reviews GROUP BY order_id "
    "HAVING COUNT(review_id) > 1"))
def op_having_count(t: Tables) -> DataFrame:
    return RL.having_count(t.order_reviews, ["order_id"], "review_id", 1, "n_reviews")


@register("op_having_avg", M(
    "SELECT seller_id, COUNT(*) AS n_items FROM x_items GROUP BY seller_id "
    "HAVING SUM(price) > 55000 * COUNT(price)"))
def op_having_avg(t: Tables) -> DataFrame:
    return RL.having_avg(t.order_items, ["seller_id"], "price", Decimal("55000"),
                         [AG.count_rows().alias("n_items")])


@register("op_compare_columns", M(
    f"SELECT order_id, CAST({DELIVERED_AT} > {ESTIMATE} AS VARCHAR) AS is_late, "
    f"CAST({DELIVERED_AT} <= {ESTIMATE} AS VARCHAR) AS on_time FROM x_orders"))
def op_compare_columns(t: Tables) -> DataFrame:
    # three-valued results shown as text ('true' / 'false' / NULL)
    return t.orders.select("order_id", X.is_after(DELIVERED_AT, ESTIMATE).cast("string").alias("is_late"),
                           X.is_on_time(DELIVERED_AT, ESTIMATE).cast("string").alias("on_time"))


_PERSON_ORDERS = """x_person_orders AS (
  SELECT customer_unique_id, COUNT(DISTINCT order_id) AS order_count
  FROM x_customers JOIN x_orders USING (customer_id)
  GROUP BY ALL)"""


def _person_orders(t: Tables) -> DataFrame:
    return (t.orders.select("order_id", "customer_id")
            .join(t.customers.select("customer_id", "customer_unique_id"), "customer_id")
            .groupBy("customer_unique_id").agg(AG.count_distinct("order_id").alias("order_count")))


@register("op_between", M(
    "SELECT customer_unique_id, order_count, order_count BETWEEN 3 AND 5 AS loyal FROM x_person_orders",
    _PERSON_ORDERS))
def op_between(t: Tables) -> DataFrame:
    return _person_orders(t).withColumn("loyal", X.between("order_count", 3, 5))


@register("op_cte_projection", M(
    "SELECT order_id, review_score, delivery_result, "
    f"{O.r_ratio('days_late_us', str(O.MICROS_PER_DAY), 6)} AS days_late FROM x_status", O.STATUS_CTE))
def op_cte_projection(t: Tables) -> DataFrame:
    return delivery_status(t).drop("days_late_us")


# --------------------------------------------------------------------------- joins
@register("op_join_inner_1n", M(
    "SELECT order_id, order_item_id, order_status, CAST(price AS DOUBLE) AS price FROM x_items JOIN x_orders USING (order_id)"))
def op_join_inner_1n(t: Tables) -> DataFrame:
    return as_double(J.orders_items(t).select("order_id", "order_item_id", "order_status", "price"))


@register("op_join_inner_n1", M(
    "SELECT order_id, customer_id, customer_state FROM x_customers JOIN x_orders USING (customer_id)"))
def op_join_inner_n1(t: Tables) -> DataFrame:
    return J.orders_customers(t).select("order_id", "customer_id", "customer_state")


@register("op_join_chain", M(
    "SELECT customer_id, order_id, order_item_id, customer_state, CAST(price AS DOUBLE) AS price "
    "FROM x_items JOIN (FROM x_orders JOIN x_customers USING (customer_id)) bought USING (order_id)"))
def op_join_chain(t: Tables) -> DataFrame:
    return as_double(J.customer_items(t).select("customer_id", "order_id", "order_item_id",
                                                "customer_state", "price"))


@register("op_join_star", M(
    "SELECT order_id, order_item_id, seller_id, seller_state, review_id, review_score "
    "FROM x_reviews JOIN (FROM x_sellers JOIN x_items USING (seller_id)) sold USING (order_id) "
    "WHERE order_id IN (SELECT order_id FROM x_orders)"))
def op_join_star(t: Tables) -> DataFrame:
    return J.seller_items_reviews(t).select("order_id", "order_item_id", "seller_id", "seller_state",
                                            "review_id", "review_score")


@register("op_join_left_lookup", M(
    "SELECT product_id, product_category_name, product_category_name_english "
    "FROM x_products LEFT JOIN x_translation USING (product_category_name)"))
def op_join_left_lookup(t: Tables) -> DataFrame:
    return J.with_category(t.products, t.category_translation).select(
        "product_id", "product_category_name", "product_category_name_english")


@register("op_join_mixed", M(
    "SELECT review_id, order_id, order_item_id, product_id, product_category_name_english "
    "FROM x_items JOIN (FROM x_products LEFT JOIN x_translation USING (product_category_name)) named USING (product_id) "
    "JOIN x_reviews USING (order_id) WHERE order_id IN (SELECT order_id FROM x_orders)"))
def op_join_mixed(t: Tables) -> DataFrame:
    return J.review_categories(t).select("review_id", "order_id", "order_item_id", "product_id",
                                         "product_category_name_english")


@register("op_join_fanout", M(
    "SELECT order_id, review_id, review_score FROM x_reviews JOIN x_orders USING (order_id)"))
def op_join_fanout(t: Tables) -> DataFrame:
    return J.orders_reviews(t).select("order_id", "review_id", "review_score")


# --------------------------------------------------------------------------- aggregations
@register("op_count_star", M("SELECT order_status, COUNT(*) AS n FROM x_orders GROUP BY order_status"))
def op_count_star(t: Tables) -> DataFrame:
    return t.orders.groupBy("order_status").agg(AG.count_rows().alias("n"))


@register("op_count_column", M(
    f"SELECT order_status, COUNT({DELIVERED_AT}) AS n_delivered, COUNT({ESTIMATE}) AS n_estimate "
    "FROM x_orders GROUP BY order_status"))
def op_count_column(t: Tables) -> DataFrame:
    return t.orders.groupBy("order_status").agg(AG.count_col(DELIVERED_AT).alias("n_delivered"),
                                                AG.count_col(ESTIMATE).alias("n_estimate"))


@register("op_count_distinct", M(
    "SELECT seller_id, COUNT(DISTINCT order_id) AS n_orders FROM x_items GROUP BY seller_id"))
def op_count_distinct(t: Tables) -> DataFrame:
    return t.order_items.groupBy("seller_id").agg(AG.count_distinct("order_id").alias("n_orders"))


@register("op_sum_decimal", M(
    f"SELECT payment_type, {O.money('SUM(payment_value)')} AS total_value FROM x_payments GROUP BY payment_type"))
def op_sum_decimal(t: Tables) -> DataFrame:
    return t.order_payments.groupBy("payment_type").agg(N.sum_money("payment_value").alias("total_value"))


@register("op_sum_expression", M(
    f"SELECT seller_id, {O.money('SUM(price + freight_value)')} AS revenue FROM x_items GROUP BY seller_id"))
def op_sum_expression(t: Tables) -> DataFrame:
    return t.order_items.groupBy("seller_id").agg(
        N.sum_money(F.col("price") + F.col("freight_value")).alias("revenue"))


@register("op_avg", M(
    f"SELECT seller_id, {O.avg_money('SUM(price)', 'COUNT(price)')} AS avg_price FROM x_items GROUP BY seller_id"))
def op_avg(t: Tables) -> DataFrame:
    return t.order_items.groupBy("seller_id").agg(N.avg_exact("price", 2).alias("avg_price"))


@register("op_avg_expression", M(
    f"SELECT seller_id, {O.avg_money('SUM(price + freight_value)', 'COUNT(price + freight_value)')} AS avg_amount "
    "FROM x_items GROUP BY seller_id"))
def op_avg_expression(t: Tables) -> DataFrame:
    return t.order_items.groupBy("seller_id").agg(
        N.avg_exact(F.col("price") + F.col("freight_value"), 2).alias("avg_amount"))


_LATE_SQL = f"CASE WHEN {DELIVERED_AT} > {ESTIMATE} THEN 1 ELSE 0 END"


@register("op_conditional_count", M(
    f"SELECT order_status, CAST(SUM({_LATE_SQL}) AS BIGINT) AS late FROM x_orders GROUP BY order_status"))
def op_conditional_count(t: Tables) -> DataFrame:
    return t.orders.groupBy("order_status").agg(
        AG.count_where(X.is_after(DELIVERED_AT, ESTIMATE)).alias("late"))


@register("op_ratio_pct", M(
    f"SELECT order_status, {O.pct(f'SUM({_LATE_SQL})', 'COUNT(*)')} AS late_pct FROM x_orders GROUP BY order_status"))
def op_ratio_pct(t: Tables) -> DataFrame:
    agg = t.orders.groupBy("order_status").agg(
        AG.count_where(X.is_after(DELIVERED_AT, ESTIMATE)).alias("late"), AG.count_rows().alias("n"))
    return agg.select("order_status", N.pct("late", "n").alias("late_pct"))


_HIGH = "CASE WHEN freight_value > 2000 THEN price END"


@register("op_conditional_avg", M(
    f"SELECT seller_id, {O.avg_money(f'SUM({_HIGH})', f'COUNT({_HIGH})')} AS high_freight_avg_price "
    "FROM x_items GROUP BY seller_id"))
def op_conditional_avg(t: Tables) -> DataFrame:
    total, n = AG.avg_where(F.col("freight_value") > 2000, F.col("price"))
    return t.order_items.groupBy("seller_id").agg(N.mean_of(total, n, 2).alias("high_freight_avg_price"))


@register("op_avg_of_ratio", M(
    f"SELECT seller_id, ROUND(AVG({O.RATIO}), 1) AS freight_pct FROM x_items GROUP BY seller_id"))
def op_avg_of_ratio(t: Tables) -> DataFrame:
    ratio = F.col("freight_value") / F.nullif(F.col("price"), F.lit(0)) * 100
    return t.order_items.groupBy("seller_id").agg(
        N.mean_of(F.sum(ratio), F.count(ratio), 1, scale=15).alias("freight_pct"))


@register("op_group_by_expression", M(
    f"SELECT CAST(date_trunc('month', {PURCHASE}) AS TIMESTAMP) AS month, COUNT(*) AS n_orders "
    "FROM x_orders GROUP BY 1"))
def op_group_by_expression(t: Tables) -> DataFrame:
    return AG.by_month(t.orders, PURCHASE).agg(AG.count_rows().alias("n_orders"))


@register("op_group_by_coalesce", M(
    "SELECT category, COUNT(*) AS n_products FROM x_categories GROUP BY category"))
def op_group_by_coalesce(t: Tables) -> DataFrame:
    return J.product_categories(t).groupBy("category").agg(AG.count_rows().alias("n_products"))


_SENTIMENT_SQL = ("CASE WHEN review_score >= 4 THEN 'positive' WHEN review_score <= 2 THEN 'negative' "
                  "ELSE 'neutral' END")


@register("op_group_by_alias", M(
    f"SELECT {_SENTIMENT_SQL} AS sentiment, COUNT(*) AS n FROM x_reviews GROUP BY sentiment"))
def op_group_by_alias(t: Tables) -> DataFrame:
    s = F.col("review_score")
    sentiment = F.when(s >= 4, "positive").when(s <= 2, "negative").otherwise("neutral")
    return AG.by_expr(t.order_reviews, "sentiment", sentiment).agg(AG.count_rows().alias("n"))


@register("op_group_by_multi", M(
    f"SELECT seller_id, order_item_id, COUNT(*) AS n, {O.money('SUM(price)')} AS revenue "
    "FROM x_items GROUP BY seller_id, order_item_id"))
def op_group_by_multi(t: Tables) -> DataFrame:
    return AG.by_keys(t.order_items, "seller_id", "order_item_id").agg(
        AG.count_rows().alias("n"), N.sum_money("price").alias("revenue"))


@register("op_two_level_agg", M(
    f"SELECT {O.SEGMENT_CASE.format(*O.SEGMENT_LABELS)} AS customer_segment, COUNT(*) AS customer_count "
    "FROM x_person_orders GROUP BY 1", _PERSON_ORDERS))
def op_two_level_agg(t: Tables) -> DataFrame:
    people = (t.orders.select("order_id", "customer_id")
              .join(t.customers.select("customer_id", "customer_unique_id"), "customer_id"))
    return AG.bucket_counts(people, "customer_unique_id", AG.count_distinct("order_id"),
                            X.segment_expr, "customer_segment", "customer_count")


@register("op_global_agg", M(
    f"SELECT {O.money('SUM(price)')} AS revenue, COUNT(*) AS n_items, "
    f"{O.avg_money('SUM(price)', 'COUNT(price)')} AS avg_price FROM x_items"))
def op_global_agg(t: Tables) -> DataFrame:
    return AG.totals(t.order_items, revenue=N.sum_money("price"), n_items=AG.count_rows(),
                     avg_price=N.avg_exact("price", 2))


@register("op_mixed_distinct_agg", M(
    f"SELECT order_status, COUNT(DISTINCT order_id) AS n_orders, COUNT(*) AS n_items, "
    f"{O.money('SUM(price)')} AS revenue, {O.avg_money('SUM(price)', 'COUNT(price)')} AS avg_price "
    "FROM x_items JOIN x_orders USING (order_id) GROUP BY ALL"))
def op_mixed_distinct_agg(t: Tables) -> DataFrame:
    return J.orders_items(t).groupBy("order_status").agg(
        AG.count_distinct("order_id").alias("n_orders"), AG.count_rows().alias("n_items"),
        N.sum_money("price").alias("revenue"), N.avg_exact("price", 2).alias("avg_price"))


# --------------------------------------------------------------------------- windows
@register("op_window_share", M(
    f"SELECT order_status, n, {O.pct('n', 'SUM(n) OVER ()')} AS percentage "
    "FROM (SELECT order_status, COUNT(*) AS n FROM x_orders GROUP BY order_status) s"))
def op_window_share(t: Tables) -> DataFrame:
    return window_share(t.orders.groupBy("order_status").agg(AG.count_rows().alias("n")), "n")


@register("op_share_of_total", M(
    f"SELECT payment_type, CAST(total_value AS DOUBLE) AS total_value, "
    f"{O.r_ratio('100 * 100 * total_value', '100 * SUM(total_value) OVER ()', 2)} AS share "
    "FROM (SELECT payment_type, SUM(payment_value) AS total_value FROM x_payments GROUP BY payment_type) s"))
def op_share_of_total(t: Tables) -> DataFrame:
    agg = t.order_payments.groupBy("payment_type").agg(F.sum("payment_value").alias("total_value"))
    return as_double(share_of_total(agg, "total_value", "share", scale=2))


# --------------------------------------------------------------------------- sorts, limits
_MONTHS_SQL = (f"SELECT CAST(date_trunc('month', {PURCHASE}) AS TIMESTAMP) AS month, COUNT(*) AS n_orders "
               "FROM x_orders GROUP BY 1")


@register("op_sort_asc", M(O.numbered(_MONTHS_SQL, "month ASC NULLS LAST")))
def op_sort_asc(t: Tables) -> DataFrame:
    months = AG.by_month(t.orders, PURCHASE).agg(AG.count_rows().alias("n_orders"))
    return numbered(OR.sort_asc(months, "month"), [OR.asc("month")])


_PAY_SQL = "SELECT payment_type, COUNT(*) AS n FROM x_payments GROUP BY payment_type"


@register("op_sort_desc", M(O.numbered(_PAY_SQL, "n DESC NULLS FIRST, payment_type ASC NULLS LAST")))
def op_sort_desc(t: Tables) -> DataFrame:
    pays = t.order_payments.groupBy("payment_type").agg(AG.count_rows().alias("n"))
    return numbered(OR.sort_desc(pays, "n", "payment_type"), [OR.desc("n"), OR.asc("payment_type")])


_STATUS_MONTH_SQL = (f"SELECT order_status, CAST(date_trunc('month', {PURCHASE}) AS TIMESTAMP) AS month, "
                     "COUNT(*) AS n FROM x_orders GROUP BY 1, 2")


@register("op_sort_multi", M(O.numbered(_STATUS_MONTH_SQL, "order_status ASC NULLS LAST, month ASC NULLS LAST")))
def op_sort_multi(t: Tables) -> DataFrame:
    g = t.orders.groupBy("order_status", AG.month_start(PURCHASE).alias("month")).agg(AG.count_rows().alias("n"))
    return numbered(OR.sort_asc(g, "order_status", "month"), [OR.asc("order_status"), OR.asc("month")])


_SELLER_REV_SQL = f"SELECT seller_id, {O.money('SUM(price)')} AS revenue FROM x_items GROUP BY seller_id"
_SELLER_ORDER = "revenue DESC NULLS FIRST, seller_id ASC NULLS LAST"


def _seller_revenue(t: Tables) -> DataFrame:
    return t.order_items.groupBy("seller_id").agg(N.sum_money("price").alias("revenue"))


_SELLER_TOP = [OR.desc("revenue"), OR.asc("seller_id")]


@register("op_top_k", M(O.numbered(_SELLER_REV_SQL, _SELLER_ORDER, 10)))
def op_top_k(t: Tables) -> DataFrame:
    return numbered(OR.top_k(_seller_revenue(t), _SELLER_TOP, 10), _SELLER_TOP)


@register("op_resort_top_k", M(
    "SELECT seller_id, revenue, ROW_NUMBER() OVER (ORDER BY revenue ASC NULLS LAST, seller_id DESC NULLS FIRST) "
    f"AS plot_order FROM ({O.numbered(_SELLER_REV_SQL, _SELLER_ORDER, 10)}) t"))
def op_resort_top_k(t: Tables) -> DataFrame:
    return OR.plot_order(_seller_revenue(t), _SELLER_TOP, 10, OR.reverse(_SELLER_TOP))


@register("op_first_row", M(f"{_SELLER_REV_SQL} ORDER BY {_SELLER_ORDER} LIMIT 1"))
def op_first_row(t: Tables) -> DataFrame:
    return OR.first_row(_seller_revenue(t), _SELLER_TOP)


# --------------------------------------------------------------------------- scalar functions
@register("op_date_trunc_month", M(
    f"SELECT order_id, CAST(date_trunc('month', {PURCHASE}) AS TIMESTAMP) AS month FROM x_orders"))
def op_date_trunc_month(t: Tables) -> DataFrame:
    return t.orders.select("order_id", AG.month_start(PURCHASE).alias("month"))


@register("op_cast_timestamp", M(
    f"SELECT order_id, strftime({PURCHASE}, '%Y-%m-%d %H:%M:%S') AS purchase_text, "
    f"CAST(strftime({PURCHASE}, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS purchase_ts FROM x_orders"))
def op_cast_timestamp(t: Tables) -> DataFrame:
    text = F.date_format(PURCHASE, "yyyy-MM-dd HH:mm:ss")
    return t.orders.select("order_id", text.alias("purchase_text"), X.to_ts(text).alias("purchase_ts"))


@register("op_cast_numeric", M(
    "SELECT seller_id, CAST(SUM(CAST(CAST(freight_value AS DOUBLE) AS DECIMAL(12,2))) AS DOUBLE) AS total_freight "
    "FROM x_items GROUP BY seller_id"))
def op_cast_numeric(t: Tables) -> DataFrame:
    as_float = F.col("freight_value").cast("double")
    return t.order_items.groupBy("seller_id").agg(N.sum_money(N.money(as_float)).alias("total_freight"))


@register("op_round_half_up", M(
    f"SELECT order_id, {O.r_ratio('payment_value * 100', '800', 2)} AS eighth FROM x_payments"))
def op_round_half_up(t: Tables) -> DataFrame:
    return t.order_payments.select("order_id", N.round_out(F.col("payment_value") / 8, 2).alias("eighth"))


@register("op_coalesce", M(
    "SELECT product_id, category FROM x_categories"))
def op_coalesce(t: Tables) -> DataFrame:
    return J.product_categories(t)


@register("op_nullif", M(
    "SELECT order_id, order_item_id, CAST(NULLIF(order_item_id, 1) AS DOUBLE) AS item_or_null FROM x_items"))
def op_nullif(t: Tables) -> DataFrame:
    return t.order_items.select("order_id", "order_item_id",
                                F.nullif(F.col("order_item_id"), F.lit(1)).cast("double").alias("item_or_null"))


@register("op_case_two_way", M(
    f"SELECT order_id, CASE WHEN {DELIVERED_AT} <= {ESTIMATE} THEN 'On Time' ELSE 'Late' END AS delivery_result "
    "FROM x_orders"))
def op_case_two_way(t: Tables) -> DataFrame:
    return t.orders.select("order_id", X.delivery_result().alias("delivery_result"))


@register("op_case_buckets", M(
    f"SELECT customer_unique_id, order_count, {O.SEGMENT_CASE.format(*O.SEGMENT_LABELS)} AS customer_segment "
    "FROM x_person_orders", _PERSON_ORDERS))
def op_case_buckets(t: Tables) -> DataFrame:
    return _person_orders(t).withColumn("customer_segment", X.segment_expr("order_count"))


@register("op_days_between", M(
    f"SELECT order_id, {O.r_ratio(O.us_between(PURCHASE, DELIVERED_AT), str(O.MICROS_PER_DAY), 6)} "
    "AS delivery_days FROM x_orders"))
def op_days_between(t: Tables) -> DataFrame:
    return t.orders.select("order_id", N.days_between(PURCHASE, DELIVERED_AT, 6).alias("delivery_days"))


@register("op_arithmetic", M(
    "SELECT order_id, order_item_id, CAST(price + freight_value AS DOUBLE) AS amount, "
    "CAST(price - freight_value AS DOUBLE) AS net, CAST(price * 2 AS DOUBLE) AS doubled, "
    "CAST(price AS DOUBLE) / 4 AS quarter FROM x_items"))
def op_arithmetic(t: Tables) -> DataFrame:
    p, f = F.col("price"), F.col("freight_value")
    return t.order_items.select("order_id", "order_item_id", (p + f).cast("double").alias("amount"),
                                (p - f).cast("double").alias("net"), (p * 2).cast("double").alias("doubled"),
                                (p / 4).cast("double").alias("quarter"))


@register("op_title_case", M(
    f"SELECT name, {O.title_sql('name')} AS title FROM ("
    "SELECT DISTINCT customer_state AS name FROM x_customers UNION "
    "SELECT DISTINCT category FROM x_categories) n"))
def op_title_case(t: Tables) -> DataFrame:
    names = (t.customers.select(F.col("customer_state").alias("name"))
             .union(J.product_categories(t).select(F.col("category").alias("name"))).distinct())
    return names.select("name", X.title_case("name").alias("title"))


@register("op_format_display", M(
    "SELECT payment_type, "
    f"'R$ ' || {O.decimal_text(O.r_ratio('SUM(payment_value) * 100', '100000000', 1), 1)} || 'M' AS value_label, "
    "format('{:,}', COUNT(*)) AS count_label, "
    f"{O.decimal_text(O.pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()', 1), 1)} || '%' AS share_label "
    "FROM x_payments GROUP BY payment_type"))
def op_format_display(t: Tables) -> DataFrame:
    agg = t.order_payments.groupBy("payment_type").agg(F.sum("payment_value").alias("v"),
                                                       AG.count_rows().alias("n"))
    return share_of_total(agg, "n", "s", places=1).select(
        "payment_type", X.display_millions("v").alias("value_label"),
        X.display_int("n").alias("count_label"), X.display_pct("s").alias("share_label"))
