"""The bundle of the eight marketplace tables handed to every report."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DecimalType

# The translation table's name in the declared model, and the money columns.
DECLARED_TRANSLATION = "product_category_translation"
MONEY_COLUMNS = {"order_items": ("price", "freight_value"), "order_payments": ("payment_value",)}


@dataclass(frozen=True)
class Tables:
    customers: DataFrame
    sellers: DataFrame
    products: DataFrame
    orders: DataFrame
    order_items: DataFrame
    order_payments: DataFrame
    order_reviews: DataFrame
    category_translation: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def __post_init__(self) -> None:
        """Money must be DECIMAL: sums of DOUBLE are not exact and depend on partitioning."""
        for table, columns in MONEY_COLUMNS.items():
            for f in getattr(self, table).schema.fields:
                if f.name in columns and not isinstance(f.dataType, DecimalType):
                    raise TypeError(f"{table}.{f.name} must be DECIMAL, not {f.dataType.simpleString()}")

    @classmethod
    def from_catalog(cls, spark: SparkSession, schema: str | None = None) -> "Tables":
        """The eight catalog tables (of ``schema``); the translation also under its declared name."""
        prefix = f"{schema}." if schema else ""
        found = {f.name: prefix + f.name for f in fields(cls)}
        if not spark.catalog.tableExists(found["category_translation"]):
            found["category_translation"] = prefix + DECLARED_TRANSLATION
        return cls(**{name: spark.table(table) for name, table in found.items()})

    @classmethod
    def from_dict(cls, frames: dict[str, DataFrame]) -> "Tables":
        frames = dict(frames)
        if DECLARED_TRANSLATION in frames:
            frames.setdefault("category_translation", frames[DECLARED_TRANSLATION])
        missing = [f.name for f in fields(cls) if f.name not in frames]
        if missing:
            raise ValueError(f"missing tables: {missing}")
        return cls(**{f.name: frames[f.name] for f in fields(cls)})
