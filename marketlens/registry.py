"""Named queries over the driver's generated tables, with their oracle SQL.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLE[name]`` is the
DuckDB statement over the driver's registered views that must give the same
rows. Report entries carry a ``row_no`` column (the report's order) so an
order-insensitive comparison still checks the order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens import oracle as O
from marketlens.operators.ordering import asc, with_row_number
from marketlens.plans import reports as R
from marketlens.sources.driver import driver_tables
from marketlens.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]

# Parameters on the generated data (reference defaults where they fit it).
DRIVER_PARAMS = {"since": "1997-01-01", "min_reviews": 1500, "min_avg_price": 53000}

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Stand-in tables for ``sf_dir`` (lazy frames; cheap to build, so built per call)."""
    return driver_tables(spark, sf_dir)


def numbered(df: DataFrame, order) -> DataFrame:
    """Add ``row_no`` (BIGINT) in the report's order, so the order is part of the values."""
    return with_row_number(df, order, "row_no")


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def register_spark(name: str, sql: str | None = None):
    """For queries that need the session itself (file sources and sinks)."""
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --------------------------------------------------------------------------- reports
_P = DRIVER_PARAMS
_RSQL = O.report_sql()

register("q01_monthly_revenue", _RSQL["q01_monthly_revenue"])(
    lambda t: numbered(R.monthly_revenue(t, since=_P["since"]), R.ORDER["q01"]))
register("q02_revenue_by_category", _RSQL["q02_revenue_by_category"])(
    lambda t: numbered(R.revenue_by_category(t), R.ORDER["q02"]))
register("q03_orders_by_state", _RSQL["q03_orders_by_state"])(
    lambda t: numbered(R.orders_by_state(t), R.ORDER["q03"]))
register("q04_delivery_delay", _RSQL["q04_delivery_delay"])(
    lambda t: numbered(R.delivery_delay(t), R.ORDER["q04"]))
register("q05_payment_methods", _RSQL["q05_payment_methods"])(
    lambda t: numbered(R.payment_methods(t), R.ORDER["q05"]))
register("q06_top_sellers", _RSQL["q06_top_sellers"])(
    lambda t: numbered(R.top_sellers(t), R.ORDER["q06"]))
register("q07_reviews_by_category", _RSQL["q07_reviews_by_category"])(
    lambda t: numbered(R.reviews_by_category(t, min_reviews=_P["min_reviews"]), R.ORDER["q07"]))
register("q08_delay_vs_reviews", _RSQL["q08_delay_vs_reviews"])(
    lambda t: numbered(R.delay_vs_reviews(t), R.ORDER["q08"]))
register("q08b_review_distribution", _RSQL["q08b_review_distribution"])(
    lambda t: numbered(R.review_distribution(t), R.ORDER["q08b"]))
register("q09_repeat_customers", _RSQL["q09_repeat_customers"])(
    lambda t: numbered(R.repeat_customers(t), R.ORDER["q09"]))
register("q09b_loyalty_short_labels", _RSQL["q09b_loyalty_short_labels"])(
    lambda t: numbered(R.loyalty_short_labels(t), R.ORDER["q09b"]))
register("q10_freight_by_category", _RSQL["q10_freight_by_category"])(
    lambda t: numbered(R.freight_by_category(t, min_avg_price=_P["min_avg_price"]), R.ORDER["q10"]))


def as_double(df: DataFrame) -> DataFrame:
    """Expose DECIMAL columns as DOUBLE (the output convention of every entry)."""
    from pyspark.sql.types import DecimalType
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


# --------------------------------------------------------------------------- K1, charts
from marketlens.plans import charts as C  # noqa: E402
from marketlens.plans.kpi import kpi_summary  # noqa: E402

register("kpi_summary", O.kpi_sql(_P["since"]))(lambda t: kpi_summary(t, since=_P["since"]))

_CSQL = O.chart_sql(_P["min_reviews"], _P["min_avg_price"], _P["since"])
register("chart_monthly_trend", _CSQL["chart_monthly_trend"])(
    lambda t: numbered(C.chart_monthly_trend(t, since=_P["since"]), R.ORDER["q01"]))
register("chart_category_bars", _CSQL["chart_category_bars"])(C.chart_category_bars)
register("chart_state_bars", _CSQL["chart_state_bars"])(
    lambda t: numbered(C.chart_state_bars(t), R.ORDER["q03"]))
register("chart_delivery_scatter", _CSQL["chart_delivery_scatter"])(
    lambda t: numbered(C.chart_delivery_scatter(t), R.ORDER["q04"]))
register("chart_payment_share", _CSQL["chart_payment_share"])(
    lambda t: numbered(C.chart_payment_share(t), R.ORDER["q05"]))
register("chart_review_bars", _CSQL["chart_review_bars"])(
    lambda t: C.chart_review_bars(t, min_reviews=_P["min_reviews"]))
register("chart_score_distribution", _CSQL["chart_score_distribution"])(
    lambda t: numbered(C.chart_score_distribution(t), [asc("review_score")]))
register("chart_segment_share", _CSQL["chart_segment_share"])(
    lambda t: numbered(C.chart_segment_share(t), R.ORDER["q09b"]))
register("chart_freight_scatter", _CSQL["chart_freight_scatter"])(
    lambda t: numbered(C.chart_freight_scatter(t, min_avg_price=_P["min_avg_price"]), R.ORDER["q10"]))


# --------------------------------------------------------------------------- sources, sinks, audits
from pyspark.sql.types import LongType  # noqa: E402

from marketlens.operators import audit as A  # noqa: E402
from marketlens.plans.catalog import digest, run_reports  # noqa: E402
from marketlens.schema import DEFAULT_MANIFEST, PRIMARY_KEYS, string_bounds, table_schema  # noqa: E402
from marketlens.session import scratch_path  # noqa: E402
from marketlens.sources import files as IO  # noqa: E402
from marketlens.sources import load  # noqa: E402
from marketlens.sources.driver import MONEY  # noqa: E402
from marketlens.sources.sql import run_sql  # noqa: E402


def driver_schema(table: str):
    """Declared schema with the generated data's id and money types."""
    return table_schema(table, LongType(), MONEY)


_ORDERS_AS_DECLARED = O.with_mapping("""
SELECT order_id, customer_id, order_status, order_purchase_timestamp,
  CAST(NULL AS TIMESTAMP) AS order_approved_at, CAST(NULL AS TIMESTAMP) AS order_delivered_carrier_date,
  order_delivered_customer_date, order_estimated_delivery_date
FROM x_orders""")


@register_spark("io_csv_scan", _ORDERS_AS_DECLARED)
def io_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage the orders as header CSV in the shared folder, scan them back typed."""
    path = scratch_path(spark, "csv-scan")
    IO.write_csv(tables(spark, sf_dir).orders, path)
    return IO.read_csv(spark, path, driver_schema("orders"), required=PRIMARY_KEYS["orders"])


@register_spark("io_quoted_csv_scan", "SELECT doc_id, lang, md5(coalesce(text, '')) AS text_md5, length(coalesce(text, '')) AS n "
                "FROM documents")
def io_quoted_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks and quotes as header CSV, read back in splits."""
    path = scratch_path(spark, "csv-quoted")
    IO.write_csv(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "lang", "text"), path)
    text = F.coalesce("text", F.lit(""))
    return IO.read_csv(spark, path, multi_line=True).select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", F.md5(text.cast("binary")).alias("text_md5"),
        F.length(text).cast("long").alias("n"))


def _declared() -> dict[str, list[str]]:
    return {name: driver_schema(name).fieldNames() for _, name in DEFAULT_MANIFEST}


@register_spark("io_manifest_load", O.load_sql(_declared()))
def io_manifest_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage all eight tables as the manifest's CSV files, load them, digest every loaded column."""
    base = scratch_path(spark, "manifest")
    frames = tables(spark, sf_dir).as_dict()
    for filename, name in DEFAULT_MANIFEST:
        IO.write_csv(frames[name], f"{base}/files/{filename}")
    load.load(spark, f"{base}/files", f"{base}/tables", id_type=LongType(), money_type=MONEY)
    return digest(load.loaded_tables(spark, f"{base}/tables", LongType(), MONEY).as_dict())


@register_spark("dq_load_audit", O.load_counts_sql())
def dq_load_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4 as the load tells it: counts gathered while the tables are written."""
    base = scratch_path(spark, "load-audit")
    frames = tables(spark, sf_dir).as_dict()
    for filename, name in DEFAULT_MANIFEST:
        frames[name].write.parquet(f"{base}/files/{name}.parquet")
    metrics = load.load(spark, f"{base}/files", f"{base}/tables", [(f"{n}.parquet", n) for _, n in DEFAULT_MANIFEST],
                        id_type=LongType(), money_type=MONEY, fmt="parquet")
    return load.counts(spark, metrics).select("table_name", "row_count")


@register_spark("io_append_sink", O.with_mapping(
    "SELECT order_id, payment_type, payment_installments, CAST(payment_value AS DOUBLE) AS payment_value "
    "FROM x_payments UNION ALL SELECT order_id, payment_type, payment_installments, "
    "CAST(payment_value AS DOUBLE) AS payment_value FROM x_payments"))
def io_append_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append the payments twice to one table; both copies remain."""
    path = scratch_path(spark, "append")
    payments = tables(spark, sf_dir).order_payments
    IO.append_table(payments, path)
    IO.append_table(payments, path)
    return as_double(spark.read.parquet(path))


register("io_load_counts", O.load_counts_sql())(lambda t: A.load_counts(t.as_dict()))


@register("io_schema_cast", O.with_mapping(
    "SELECT order_id, order_item_id, product_id, seller_id, CAST(NULL AS TIMESTAMP) AS shipping_limit_date, "
    "CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value FROM x_items"))
def io_schema_cast(t: Tables) -> DataFrame:
    """Items as raw text, conformed to the declared item schema."""
    items = t.order_items
    raw = items.select(*[F.col(c).cast("string").alias(c) for c in items.columns])
    return as_double(IO.conform(raw, driver_schema("order_items"), required=PRIMARY_KEYS["order_items"]))


_Q05_SPARK_SQL = """
SELECT payment_type, COUNT(*) AS total_transactions,
  CAST(ROUND(SUM(payment_value), 2) AS DOUBLE) AS total_value,
  CAST(ROUND(CAST(SUM(payment_value) AS DECIMAL(22,2)) / COUNT(payment_value), 2) AS DOUBLE) AS avg_value,
  CAST(ROUND(CAST(SUM(payment_installments) AS DECIMAL(20,0)) / COUNT(payment_installments), 1) AS DOUBLE)
    AS avg_installments
FROM {order_payments}
GROUP BY payment_type"""

register("io_sql_to_frame", O.with_mapping(O.q05()))(
    lambda t: run_sql(t.order_payments.sparkSession, _Q05_SPARK_SQL, {"order_payments": t.order_payments}))


def _catalog_params() -> dict:
    return {"q01_monthly_revenue": {"since": _P["since"]},
            "q07_reviews_by_category": {"min_reviews": _P["min_reviews"]},
            "q10_freight_by_category": {"min_avg_price": _P["min_avg_price"]},
            "kpi_summary": {"since": _P["since"]},
            "chart_monthly_trend": {"since": _P["since"]},
            "chart_review_bars": {"min_reviews": _P["min_reviews"]},
            "chart_freight_scatter": {"min_avg_price": _P["min_avg_price"]}}


register("io_report_catalog", O.catalog_sql({**_RSQL, "kpi_summary": O.kpi_sql(_P["since"]), **_CSQL}))(
    lambda t: digest(run_reports(t, params=_catalog_params())))


@register_spark("io_report_sink", _RSQL["q05_payment_methods"])
def io_report_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a report under the shared folder and read the written table."""
    report = numbered(R.payment_methods(tables(spark, sf_dir)), R.ORDER["q05"])
    path = IO.write_report(report, scratch_path(spark, "reports"), "q05_payment_methods")
    return spark.read.parquet(path)


register("dq_primary_keys", O.primary_keys_sql())(lambda t: A.check_primary_keys(t.as_dict()))
register("dq_foreign_keys", O.foreign_keys_sql())(lambda t: A.check_foreign_keys(t.as_dict()))
register("dq_length_bounds", O.lengths_sql({n: string_bounds(n) for n in O.MAPPED}))(
    lambda t: A.check_lengths(t.as_dict()))


# Operator-level entries register themselves on import.
from marketlens import registry_ops  # noqa: E402,F401


# --------------------------------------------------------------------------- incremental load
from marketlens.streaming.ingest import load_new_files  # noqa: E402

_PAYMENT_COLUMNS = ["order_id", "payment_type", "payment_installments", "payment_value"]


@register_spark("io_stream_append", O.with_mapping(
    "SELECT order_id, payment_type, payment_installments, CAST(payment_value AS DOUBLE) AS payment_value "
    "FROM x_payments"))
def io_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming load: stage the payments as CSV files, append them with a file-source
    stream (availableNow), run it twice; the second run finds nothing new."""
    base = scratch_path(spark, "stream-load")
    payments = tables(spark, sf_dir).order_payments
    IO.write_csv(payments.select(*_PAYMENT_COLUMNS), f"{base}/incoming")
    for _ in range(2):
        load_new_files(spark, f"{base}/incoming", driver_schema("order_payments"), f"{base}/table",
                       f"{base}/checkpoint", header=_PAYMENT_COLUMNS, required=["order_id"])
    return as_double(spark.read.parquet(f"{base}/table").select(*_PAYMENT_COLUMNS))


# --------------------------------------------------------------------------- stored partial aggregates
from marketlens.plans import partials as PA  # noqa: E402


def _from_two_loads(spark: SparkSession, sf_dir: str, name: str, **params) -> DataFrame:
    """Two loads: all orders with their odd items and half of the payments, then the rest; an order's
    items lie in both, so its partials must not count it twice."""
    t, target = tables(spark, sf_dir), scratch_path(spark, f"partials-{name}")
    for n, load_id in enumerate(("first", "second")):
        part = Tables(**{**t.as_dict(), "orders": t.orders if n == 0 else t.orders.where("false"),
                         "order_items": t.order_items.where(F.col("order_item_id") % 2 == n),
                         "order_payments": t.order_payments.where(F.col("order_id") % 2 == n)})
        PA.add_load(part, target, load_id, orders=t.orders)
    return PA.report(spark, target, name, **params)


def _register_partials(name: str, report: str, **params) -> None:
    register_spark(f"partials_{report}", _RSQL[report])(
        lambda spark, sf_dir: numbered(_from_two_loads(spark, sf_dir, name, **params), R.ORDER[name]))


_register_partials("q01", "q01_monthly_revenue", since=_P["since"])
_register_partials("q02", "q02_revenue_by_category")
_register_partials("q03", "q03_orders_by_state")
_register_partials("q04", "q04_delivery_delay")
_register_partials("q05", "q05_payment_methods")


# --------------------------------------------------------------------------- storage by month and order
from marketlens.sources.layout import read_by_month, write_by_month  # noqa: E402

_LAYOUT_BUCKETS = 4


@register_spark("layout_q01_monthly_revenue", _RSQL["q01_monthly_revenue"])
def _q01_from_monthly_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    layout = write_by_month(t, scratch_path(spark, "layout-q01"), buckets=_LAYOUT_BUCKETS)
    return numbered(R.monthly_revenue(read_by_month(spark, layout, t, _P["since"]), since=_P["since"]), R.ORDER["q01"])
