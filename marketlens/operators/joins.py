"""Equi-joins between the marketplace tables.

No join carries a broadcast hint. Spark broadcasts a side only when its size
is measured under ``spark.sql.autoBroadcastJoinThreshold``: statically from
file statistics (the region/nation lookups), or at run time by AQE once the
side's shuffle stage has reported its real size (the category translation,
per-seller aggregates). Beyond the threshold the same join runs as a
shuffled sort-merge join, and AQE splits skewed key partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketlens.functions.exprs import category_expr
from marketlens.operators.skew import heavy_hitters, salted_join
from marketlens.tables import Tables


def orders_items(t: Tables) -> DataFrame:
    """Orders x items on order_id (one-to-many)."""
    return t.orders.join(t.order_items, "order_id")


def orders_customers(t: Tables) -> DataFrame:
    """Orders x customers on customer_id (many-to-one)."""
    return t.orders.join(t.customers, "customer_id")


def customer_items(t: Tables) -> DataFrame:
    """Customers x orders x items."""
    return t.customers.join(t.orders, "customer_id").join(t.order_items, "order_id")


def seller_items_reviews(t: Tables) -> DataFrame:
    """Items x sellers x orders x reviews (an item repeats once per review).

    A hot order's items are dealt out by seller, each part with the order's reviews.
    """
    return salted_join(t.order_items.join(t.sellers, "seller_id"), t.orders.join(t.order_reviews, "order_id"),
                       "order_id", "seller_id", heavy_hitters(t.order_items, "order_id"))


def with_category(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Products left-joined to the translation; unmatched and NULL names kept."""
    return products.join(translation, "product_category_name", "left")


def product_categories(t: Tables) -> DataFrame:
    """(product_id, category) with the three-way COALESCE applied."""
    return (with_category(t.products, t.category_translation)
            .select("product_id", category_expr().alias("category")))


def review_categories(t: Tables) -> DataFrame:
    """Reviews x orders x items x products, left-joined to the translation.

    Items, the side an order can be hot in, enter the lowest join: a join of two
    shuffled scans is one that AQE can split.
    """
    return (t.order_items.join(t.orders, "order_id").join(t.order_reviews, "order_id")
            .join(with_category(t.products, t.category_translation), "product_id"))


def orders_reviews(t: Tables) -> DataFrame:
    """Orders x reviews; an order repeats once per review, unreviewed orders drop."""
    return t.orders.join(t.order_reviews, "order_id")
