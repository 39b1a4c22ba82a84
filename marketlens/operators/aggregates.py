"""Aggregation building blocks.

Every aggregate here is algebraic (sum, count, min/max-by), so Spark combines
it map-side before the shuffle: a hot group key costs one partial row per
task, never a whole group in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F


def count_rows() -> Column:
    """A1: ``COUNT(*)``."""
    return F.count(F.lit(1))


def count_col(c: str | Column) -> Column:
    """A2: non-NULL count."""
    return F.count(c)


def count_distinct(c: str | Column) -> Column:
    """A3: exact distinct count (never approximate)."""
    return F.count_distinct(c)


def count_where(pred: Column) -> Column:
    """``SUM(CASE WHEN pred THEN 1 ELSE 0 END)`` (a NULL predicate counts 0)."""
    return F.sum(F.when(pred, 1).otherwise(0)).cast("bigint")


def avg_where(pred: Column, x: Column) -> tuple[Column, Column]:
    """A10 parts: (sum, count) of ``x`` over rows where ``pred`` holds; divide later."""
    v = F.when(pred, x)
    return F.sum(v), F.count(v)


def month_start(ts: str | Column) -> Column:
    """First instant of the month of a timestamp without zone.

    Done on the date (``trunc``) and cast back, so no session time zone enters.
    """
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.trunc(c.cast("date"), "month").cast("timestamp_ntz")


def by_month(df: DataFrame, ts_col: str, alias: str = "month") -> GroupedData:
    """Group by the month of ``ts_col``."""
    return df.groupBy(month_start(ts_col).alias(alias))


def by_expr(df: DataFrame, alias: str, expr: Column) -> GroupedData:
    """Group by a derived expression exposed under ``alias``."""
    return df.groupBy(expr.alias(alias))


def by_keys(df: DataFrame, *cols: str) -> GroupedData:
    """Group by several keys."""
    return df.groupBy(*cols)


def bucket_counts(df: DataFrame, key: str, measure: Column, bucket: "callable",
                  bucket_alias: str, count_alias: str = "n") -> DataFrame:
    """Aggregate per ``key``, bucket the aggregate, count keys per bucket."""
    per_key = df.groupBy(key).agg(measure.alias("__m"))
    return per_key.groupBy(bucket(F.col("__m")).alias(bucket_alias)).agg(count_rows().alias(count_alias))


def totals(df: DataFrame, **aggs: Column) -> DataFrame:
    """One-row frame of whole-frame aggregates."""
    return df.agg(*[c.alias(n) for n, c in aggs.items()])


def first_by(value: str | Column, order: Sequence[Column], where: Column | None = None) -> Column:
    """O6 as an aggregate: ``value`` of the row that sorts first under ``order``.

    ``order`` holds ascending sort keys (negate numbers for descending); the
    pick is ``min_by`` over a struct, so no sort or single-task limit runs.
    Only rows where ``where`` holds take part.
    """
    key = F.struct(*order)
    return F.min_by(value, key if where is None else F.when(where, key))
