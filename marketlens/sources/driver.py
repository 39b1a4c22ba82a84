"""Stand-in marketplace tables derived from the generated TPC-H-style parquet.

The generated data set has no marketplace tables, so each of the eight is
derived from it with DataFrame code (the same rules the DuckDB oracle states
in SQL). Everything stays lazy: Catalyst prunes unused columns and drops the
delivery-date join when a report does not read that column (the aggregated
side is unique on its key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType

from marketlens.tables import Tables

MONEY = DecimalType(12, 2)

# Fixed values of the stand-in rules.
NULL_BRAND = "Brand#25"          # brand whose raw category name becomes NULL
UNIQUE_ID_MOD = 10               # customer c with c % 10 == 9 is the same person as c - 9
TRANSLATION_SKIP_MOD = 5         # brand numbers divisible by 5 have no translation
TRANSLATION_MERGE_MOD = 17       # English name is 'cat_' || (brand number % 17)
NO_ESTIMATE_MOD = 97             # orders with key % 97 == 0 have no estimate
ESTIMATE_DAYS = 1500             # estimate = purchase + 1500 days
STATUS_BY_CODE = {"F": "delivered", "O": "shipped"}   # anything else: 'processing'
INSTALMENT_MOD = 12              # instalments = order key % 12 + 1
REVIEW_SHIFT_MOD = 10            # event e with e % 10 == 9 reviews order e - 1

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events")


def read_driver(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet") for n in DRIVER_TABLES}


def _brand_number(col: Column) -> Column:
    return F.substr(col, F.lit(7)).cast(IntegerType())


def customers(d: dict[str, DataFrame]) -> DataFrame:
    key = F.col("c_custkey")
    return (d["customer"].join(d["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
            .select(key.alias("customer_id"),
                    F.when(key % UNIQUE_ID_MOD == UNIQUE_ID_MOD - 1, key - (UNIQUE_ID_MOD - 1))
                    .otherwise(key).alias("customer_unique_id"),
                    F.col("n_name").alias("customer_state")))


def sellers(d: dict[str, DataFrame]) -> DataFrame:
    return (d["supplier"].join(d["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
            .join(d["region"], F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("seller_id"),
                    F.col("n_name").alias("seller_city"),
                    F.col("r_name").alias("seller_state")))


def products(d: dict[str, DataFrame]) -> DataFrame:
    return d["part"].select(F.col("p_partkey").alias("product_id"),
                            F.nullif(F.col("p_brand"), F.lit(NULL_BRAND))
                            .alias("product_category_name"))


def category_translation(d: dict[str, DataFrame]) -> DataFrame:
    brands = d["part"].select("p_brand").distinct()
    num = _brand_number(F.col("p_brand"))
    return (brands.where(num % TRANSLATION_SKIP_MOD != 0)
            .select(F.col("p_brand").alias("product_category_name"),
                    F.concat(F.lit("cat_"), (num % TRANSLATION_MERGE_MOD).cast("string"))
                    .alias("product_category_name_english")))


def orders(d: dict[str, DataFrame]) -> DataFrame:
    delivery = (d["lineitem"].groupBy("l_orderkey")
                .agg(F.max("l_shipdate").alias("order_delivered_customer_date")))
    o = d["orders"]
    status = F.when(F.col("o_orderstatus") == "F", STATUS_BY_CODE["F"]) \
        .when(F.col("o_orderstatus") == "O", STATUS_BY_CODE["O"]).otherwise("processing")
    estimate = F.when(F.col("o_orderkey") % NO_ESTIMATE_MOD != 0,
                      F.col("o_orderdate") + F.expr(f"INTERVAL {ESTIMATE_DAYS} DAYS"))
    return (o.join(delivery, o["o_orderkey"] == delivery["l_orderkey"], "left")
            .select(F.col("o_orderkey").alias("order_id"),
                    F.col("o_custkey").alias("customer_id"),
                    status.alias("order_status"),
                    F.col("o_orderdate").alias("order_purchase_timestamp"),
                    F.col("order_delivered_customer_date"),
                    estimate.alias("order_estimated_delivery_date")))


def order_items(d: dict[str, DataFrame]) -> DataFrame:
    price = F.col("l_extendedprice").cast(MONEY)
    freight = F.round(price * F.col("l_tax").cast(DecimalType(4, 2)), 2).cast(MONEY)
    return d["lineitem"].select(F.col("l_orderkey").alias("order_id"),
                                F.col("l_linenumber").alias("order_item_id"),
                                F.col("l_partkey").alias("product_id"),
                                F.col("l_suppkey").alias("seller_id"),
                                price.alias("price"), freight.alias("freight_value"))


def order_payments(d: dict[str, DataFrame]) -> DataFrame:
    key = F.col("o_orderkey")
    return d["orders"].select(key.alias("order_id"),
                              F.col("o_orderpriority").alias("payment_type"),
                              (key % INSTALMENT_MOD + 1).cast(IntegerType())
                              .alias("payment_installments"),
                              F.col("o_totalprice").cast(MONEY).alias("payment_value"))


def order_reviews(d: dict[str, DataFrame]) -> DataFrame:
    eid = F.col("event_id")
    return d["events"].select(
        eid.alias("review_id"),
        F.when(eid % REVIEW_SHIFT_MOD == REVIEW_SHIFT_MOD - 1, eid - 1).otherwise(eid).alias("order_id"),
        (F.floor("value").cast(IntegerType()) % 5 + 1).alias("review_score"))


def driver_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The eight marketplace tables as lazy frames over the generated parquet."""
    d = read_driver(spark, sf_dir)
    return Tables(customers=customers(d), sellers=sellers(d), products=products(d),
                  orders=orders(d), order_items=order_items(d),
                  order_payments=order_payments(d), order_reviews=order_reviews(d),
                  category_translation=category_translation(d))
