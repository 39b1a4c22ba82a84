"""Stored partial aggregates of Q1 to Q5: per load, merged on read.

``add_load`` aggregates a load's own rows to group keys and stores the sums and counts,
which add up over loads. Distinct orders do not: they are kept as bitmaps over dense order
numbers, one bitmap of 32,768 bits per (group, bucket of numbers) with an order in it, and
loads are merged by OR. So a report over all loads reads their partials, never the facts.

Sums stand beside the bitmap of their (group, bucket). Loads become visible whole, under
their id (:mod:`marketlens.sources.versions`); adding an id again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions import numeric as N
from marketlens.functions.exprs import late_flag
from marketlens.operators.aggregates import count_rows, month_start
from marketlens.operators.joins import product_categories
from marketlens.operators.ordering import sort_cols, top_k
from marketlens.operators.relational import filter_not_null
from marketlens.plans.reports import DELIVERED, ORDER, delivered_orders, item_totals
from marketlens.sources import versions
from marketlens.tables import Tables

SUM = "decimal(38,2)"


# --------------------------------------------------------------------------- distinct orders as bitmaps
def bitmaps(rows: DataFrame, keys: list[str], number: Column | str, **sums: Column) -> DataFrame:
    """Rows -> ``*keys, bucket, members`` and the named sums, per group and bucket of numbers (0 and up)."""
    n = F.col(number) if isinstance(number, str) else number
    return (rows.withColumn("bucket", F.bitmap_bucket_number(n)).withColumn("__bit", F.bitmap_bit_position(n))
            .groupBy(*keys, "bucket").agg(F.bitmap_construct_agg("__bit").alias("members"), *[c.alias(a) for a, c in sums.items()]))


def merge_bitmaps(parts: DataFrame, keys: list[str], count: str, sums: list[str]) -> DataFrame:
    """Partials of any number of loads -> per group the exact number of distinct members and the sums."""
    per_bucket = parts.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("members").alias("members"), *[F.sum(s).alias(s) for s in sums])
    return per_bucket.groupBy(*keys).agg(F.sum(F.bitmap_count("members")).alias(count), *[F.sum(s).alias(s) for s in sums])


def number_orders(ids: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Dense numbers for ids that are no whole numbers: ``order_id, number``, of those not in ``known``
    (of the same form), from its largest on. Ids are range-partitioned and counted per partition;
    only one count per partition goes through a single task."""
    fresh = ids.select("order_id").where("order_id is not null").distinct()
    start = F.lit(0).cast("long")
    if known is not None:
        fresh = fresh.join(known.select("order_id"), "order_id", "left_anti")
        largest = known.agg(F.max("number")).first()[0]
        start = F.lit(0 if largest is None else largest + 1).cast("long")
    placed = fresh.repartitionByRange("order_id").withColumn("__p", F.spark_partition_id())
    inside = placed.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy("order_id")) - 1)
    before = (placed.groupBy("__p").agg(count_rows().alias("__n"))
              .withColumn("__before", F.coalesce(F.sum("__n").over(
                  Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    return inside.join(F.broadcast(before.select("__p", "__before")), "__p").select(
        "order_id", (start + F.col("__before") + F.col("__r")).alias("number"))


# --------------------------------------------------------------------------- one load
def partials(t: Tables, orders: DataFrame | None = None, number: Column | str = "order_id", status: str = DELIVERED) -> dict[str, DataFrame]:
    """Partial aggregates of a load's rows, per report.

    ``orders`` are those its items may belong to (the load's own by default; pass all known
    ones where items come later than their order). An order row, a payment and an item
    must come in one load only. ``number`` is a dense order number, a column of ``orders``.
    """
    known = delivered_orders(Tables(**{**t.as_dict(), "orders": orders}) if orders is not None else t, status)
    known = known.withColumn("__number", F.col(number) if isinstance(number, str) else number)
    totals = item_totals(t)
    dated = known.select("order_id", "__number", month_start("order_purchase_timestamp").alias("month"))
    placed = known.select("order_id", "__number", "customer_id").join(t.customers.select("customer_id", "customer_state"), "customer_id")
    sold = (t.order_items.select("order_id", "product_id", "price").join(product_categories(t), "product_id")
            .join(known.select("order_id", "__number"), "order_id"))
    arrived = filter_not_null(delivered_orders(t, status), "order_delivered_customer_date")
    us = N.micros_between("order_purchase_timestamp", "order_delivered_customer_date")
    per_customer = arrived.groupBy("customer_id").agg(
        count_rows().alias("n"), F.sum(late_flag()).cast("long").alias("late"), N.sum_micros(us).alias("sum_us"), F.count(us).alias("n_us"))
    return {
        "q01": bitmaps(dated.join(totals, "order_id"), ["month"], "__number",
                       amount=F.sum("amount_sum").cast(SUM), amounts=F.sum("amount_n")),
        "q02": bitmaps(sold, ["category"], "__number", price=F.sum("price").cast(SUM), prices=F.count("price")),
        "q03": bitmaps(placed.join(totals, "order_id"), ["customer_state"], "__number",
                       price=F.sum("price_sum").cast(SUM), prices=F.sum("price_n")),
        "q04": (per_customer.join(t.customers.select("customer_id", "customer_state"), "customer_id").groupBy("customer_state")
                .agg(*[F.sum(c).alias(c) for c in ("n", "late", "sum_us", "n_us")])),
        "q05": t.order_payments.groupBy("payment_type").agg(
            count_rows().alias("n"), F.sum("payment_value").cast(SUM).alias("value"), F.count("payment_value").alias("values"),
            F.sum("payment_installments").cast("long").alias("installments"), F.count("payment_installments").alias("with_installments")),
    }


def add_load(t: Tables, target: str, load_id: str, orders: DataFrame | None = None, number: Column | str = "order_id",
             status: str = DELIVERED) -> None:
    """Stores a load's partials under ``target`` and commits them together."""
    spark = t.orders.sparkSession
    if load_id in versions.current(spark, target)["ids"]:
        return
    made = {}
    for name, df in partials(t, orders, number, status).items():
        made[name] = f"data/{load_id}/{name}"
        df.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{made[name]}")
    versions.commit(spark, target, load_id, made, append=True)


# --------------------------------------------------------------------------- all loads
def _q01(parts: DataFrame, since: str | None = None) -> DataFrame:
    if since is not None:
        if not since.endswith("-01"):
            raise ValueError("stored months can only be cut at the first of a month")
        parts = parts.where(F.col("month") >= F.lit(since).cast("timestamp_ntz"))
    sums = merge_bitmaps(parts, ["month"], "total_orders", ["amount", "amounts"])
    return sums.select("month", "total_orders", N.round_out("amount", 2).alias("total_revenue"),
                       N.mean_of("amount", "amounts", 2).alias("avg_order_value")).orderBy(*sort_cols(ORDER["q01"]))


def _q02(parts: DataFrame, k: int = 15) -> DataFrame:
    sums = merge_bitmaps(parts, ["category"], "total_orders", ["price", "prices"])
    return top_k(sums.select("category", "total_orders", N.round_out("price", 2).alias("total_revenue"),
                             N.mean_of("price", "prices", 2).alias("avg_item_price")), ORDER["q02"], k)


def _q03(parts: DataFrame, k: int = 10) -> DataFrame:
    sums = merge_bitmaps(parts, ["customer_state"], "total_orders", ["price", "prices"])
    return top_k(sums.select(F.col("customer_state").alias("state"), "total_orders", N.round_out("price", 2).alias("total_revenue"),
                             N.mean_of("price", "prices", 2).alias("avg_order_value")), ORDER["q03"], k)


def _q04(parts: DataFrame) -> DataFrame:
    sums = parts.groupBy("customer_state").agg(*[F.sum(c).alias(c) for c in ("n", "late", "sum_us", "n_us")])
    return sums.select("customer_state", F.col("n").alias("total_delivered"), F.col("late").alias("late_deliveries"),
                       N.pct("late", "n").alias("late_delivery_pct"),
                       N.avg_days("sum_us", "n_us", 1).alias("avg_delivery_days")).orderBy(*sort_cols(ORDER["q04"]))


def _q05(parts: DataFrame) -> DataFrame:
    sums = parts.groupBy("payment_type").agg(*[F.sum(c).alias(c) for c in ("n", "value", "values", "installments", "with_installments")])
    return sums.select("payment_type", F.col("n").alias("total_transactions"), N.round_out("value", 2).alias("total_value"),
                       N.mean_of("value", "values", 2).alias("avg_value"),
                       N.mean_of("installments", "with_installments", 1, scale=0).alias("avg_installments")).orderBy(*sort_cols(ORDER["q05"]))


MERGED = {"q01": _q01, "q02": _q02, "q03": _q03, "q04": _q04, "q05": _q05}


def report(spark: SparkSession, target: str, name: str, **params) -> DataFrame:
    """Report ``name`` (q01 to q05) over all loads, with the columns of the report from the tables."""
    found = versions.folders(spark, target, name)
    if not found:
        raise ValueError(f"{target}: no load")
    out = None
    for folder in found:
        part = spark.read.parquet(folder)
        out = part if out is None else out.unionByName(part)
    return MERGED[name](out, **params)
