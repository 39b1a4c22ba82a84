"""Storage by month and order: orders and items as catalog tables partitioned by the month of purchase and
bucketed by ``order_id``.

A report that starts at a date reads only the folders of later months, of both tables, and joins
them bucket by bucket without a shuffle. An item is stored under the month of its order, so the
two tables are pruned alike; items without an order, and orders without a time of purchase, lie under the
null month, which no start date reads (they have no part in a report that has one).

A bucket of all months read is one task: take enough buckets for the months that reports read
together, and keep to plain tables (``staging``) where a single order holds a large share of the items.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators.aggregates import month_start
from marketlens.tables import Tables

MONTH = "purchase_month"        # the added partition column, a date
KEY = "order_id"


def _month(ts: str) -> Column:
    return month_start(ts).cast("date")


@dataclass(frozen=True)
class MonthlyLayout:
    """Names of the two catalog tables of one layout."""
    orders: str
    order_items: str


def _write(df: DataFrame, table: str, path: str, buckets: int, append: bool) -> None:
    # the shuffle's hash is the buckets' hash: a task holds one bucket and writes one file for each month
    (df.repartition(buckets, KEY).write.mode("append" if append else "errorifexists").format("parquet").option("path", path)
     .partitionBy(MONTH).bucketBy(buckets, KEY).saveAsTable(table))


def write_by_month(tables: Tables, base_path: str, buckets: int, layout: MonthlyLayout | None = None,
                   all_orders: DataFrame | None = None) -> MonthlyLayout:
    """Writes orders and items under ``base_path``, or appends them to the tables of ``layout`` (with its
    number of buckets). ``all_orders`` are the orders whose items come, where these are not all in ``tables``.

    A repeated order_id in the orders: its items lie under its first month, and a report that starts
    between its months would miss them, so this raises, before anything is committed. The two tables
    are written one after the other: a load killed between them has items whose orders are missing.
    """
    spark = tables.orders.sparkSession
    append = layout is not None
    if layout is None:
        name = f"monthly_{uuid.uuid4().hex[:8]}"
        layout = MonthlyLayout(f"{name}_orders", f"{name}_order_items")
    known = tables.orders if all_orders is None else all_orders
    months = (known.where(F.col(KEY).isNotNull()).groupBy(KEY)
              .agg(F.min(_month("order_purchase_timestamp")).alias(MONTH), F.max(_month("order_purchase_timestamp")).alias("last")))
    differ = F.raise_error(F.concat(F.lit("orders of one order_id in several months: "), F.col(KEY).cast("string")))
    months = months.select(KEY, F.when(F.col("last") > F.col(MONTH), differ.cast("date")).otherwise(F.col(MONTH)).alias(MONTH))
    _write(tables.order_items.join(months, KEY, "left").select(*tables.order_items.columns, MONTH), layout.order_items,
           f"{base_path}/order_items", buckets, append)
    _write(tables.orders.withColumn(MONTH, _month("order_purchase_timestamp")), layout.orders, f"{base_path}/orders", buckets, append)
    if append:
        for table in (layout.orders, layout.order_items):
            spark.catalog.refreshTable(table)
    return layout


def _pruned(spark: SparkSession, layout: MonthlyLayout, first: Column | None) -> tuple[DataFrame, DataFrame]:
    out = []
    for table in (layout.orders, layout.order_items):
        df = spark.table(table)
        out.append((df if first is None else df.where(F.col(MONTH) >= first)).drop(MONTH))
    return out[0], out[1]


def read_by_month(spark: SparkSession, layout: MonthlyLayout, others: Tables, since: str | None = None) -> Tables:
    """``others`` with orders and items of the layout: all of them, or those of the months from that of
    ``since`` on. Rows of that month before ``since`` are left to the report's own filter."""
    first = None if since is None else F.trunc(F.lit(since).cast("timestamp_ntz").cast("date"), "month")
    orders, items = _pruned(spark, layout, first)
    return replace(others, orders=orders, order_items=items)


def read_last_months(spark: SparkSession, layout: MonthlyLayout, others: Tables, months: int) -> Tables:
    """Like :func:`read_by_month`, of the newest ``months`` months. The newest month is found while the
    query runs, by a subquery on the partition column, before the files of either table are chosen."""
    first = spark.table(layout.orders).select(F.add_months(F.max(MONTH), 1 - months)).scalar()
    orders, items = _pruned(spark, layout, first)
    return replace(others, orders=orders, order_items=items)
