"""Declared schemas, keys, length bounds and the load manifest.

The eight tables of the marketplace model with their declared column types.
Identifier and money types are parameters: the declared model uses strings and
DECIMAL(10,2); stand-in data with integer ids and wider money passes other
types to :func:`table_schema`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (DataType, DecimalType, DoubleType, IntegerType, StringType,
                               StructField, StructType, TimestampNTZType)

TABLE_NAMES = (
    "customers", "sellers", "products", "orders", "order_items",
    "order_payments", "order_reviews", "category_translation",
)

# Column layout of the declared model. Each entry is
# (column, kind, declared string bound or None). Kinds: id, str, int, float,
# money, ts.
_COLUMNS = {
    "customers": [
        ("customer_id", "id", 50), ("customer_unique_id", "id", 50),
        ("customer_zip_code", "str", 10), ("customer_city", "str", 100),
        ("customer_state", "str", 2),
    ],
    "sellers": [
        ("seller_id", "id", 50), ("seller_zip_code", "str", 10),
        ("seller_city", "str", 100), ("seller_state", "str", 2),
    ],
    "products": [
        ("product_id", "id", 50), ("product_category_name", "str", 100),
        ("product_name_length", "int", None), ("product_description_length", "int", None),
        ("product_photos_qty", "int", None), ("product_weight_g", "float", None),
        ("product_length_cm", "float", None), ("product_height_cm", "float", None),
        ("product_width_cm", "float", None),
    ],
    "orders": [
        ("order_id", "id", 50), ("customer_id", "id", 50), ("order_status", "str", 20),
        ("order_purchase_timestamp", "ts", None), ("order_approved_at", "ts", None),
        ("order_delivered_carrier_date", "ts", None),
        ("order_delivered_customer_date", "ts", None),
        ("order_estimated_delivery_date", "ts", None),
    ],
    "order_items": [
        ("order_id", "id", 50), ("order_item_id", "int", None), ("product_id", "id", 50),
        ("seller_id", "id", 50), ("shipping_limit_date", "ts", None),
        ("price", "money", None), ("freight_value", "money", None),
    ],
    "order_payments": [
        ("order_id", "id", 50), ("payment_sequential", "int", None),
        ("payment_type", "str", 20), ("payment_installments", "int", None),
        ("payment_value", "money", None),
    ],
    "order_reviews": [
        ("review_id", "id", 50), ("order_id", "id", 50), ("review_score", "int", None),
        ("review_comment_title", "str", 100), ("review_comment_message", "str", None),
        ("review_creation_date", "ts", None), ("review_answer_timestamp", "ts", None),
    ],
    "category_translation": [
        ("product_category_name", "str", 100), ("product_category_name_english", "str", 100),
    ],
}

# Declared primary keys (order_payments and order_reviews have none).
PRIMARY_KEYS = {
    "customers": ("customer_id",),
    "sellers": ("seller_id",),
    "products": ("product_id",),
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "category_translation": ("product_category_name",),
}


@dataclass(frozen=True)
class ForeignKey:
    child: str
    column: str
    parent: str
    parent_column: str


# Declared foreign keys.
FOREIGN_KEYS = (
    ForeignKey("orders", "customer_id", "customers", "customer_id"),
    ForeignKey("order_items", "order_id", "orders", "order_id"),
    ForeignKey("order_items", "product_id", "products", "product_id"),
    ForeignKey("order_items", "seller_id", "sellers", "seller_id"),
    ForeignKey("order_payments", "order_id", "orders", "order_id"),
    ForeignKey("order_reviews", "order_id", "orders", "order_id"),
)

# Columns of unbounded text, which may hold line breaks.
FREE_TEXT = {c for columns in _COLUMNS.values() for c, kind, bound in columns if kind == "str" and bound is None}


# Load order: parents before children, one CSV file per table.
DEFAULT_MANIFEST = tuple((f"{t}.csv", t) for t in TABLE_NAMES)


def _spark_type(kind: str, id_type: DataType, money_type: DataType) -> DataType:
    return {
        "id": id_type, "str": StringType(), "int": IntegerType(), "float": DoubleType(),
        "money": money_type, "ts": TimestampNTZType(),
    }[kind]


def table_schema(table: str, id_type: DataType = StringType(),
                 money_type: DataType = DecimalType(10, 2),
                 columns: list[str] | None = None) -> StructType:
    """Declared StructType of ``table`` (optionally only ``columns``, in declared order)."""
    fields = [StructField(c, _spark_type(k, id_type, money_type), True)
              for c, k, _ in _COLUMNS[table] if columns is None or c in columns]
    return StructType(fields)


def string_bounds(table: str) -> list[tuple[str, int]]:
    """(column, declared length bound) for every bounded string/id column."""
    return [(c, b) for c, _, b in _COLUMNS[table] if b is not None]

