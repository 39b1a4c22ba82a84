"""Projection, filters and group filters (HAVING)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, columns: Mapping[str, str | Column]) -> DataFrame:
    """``SELECT expr AS alias, ...`` from an {alias: column or expression} map."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(a) for a, c in columns.items()])


def filter_eq(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose ``column`` equals ``value`` (NULL never matches)."""
    return df.filter(F.col(column) == F.lit(value))


def filter_since(df: DataFrame, ts_column: str, since: str) -> DataFrame:
    """Rows with ``ts_column >= since`` (inclusive).

    The literal is cast to the column's type (timestamp without zone) rather
    than the column to the literal's, so the predicate reaches the file scan.
    """
    return df.filter(F.col(ts_column) >= F.lit(since).cast("timestamp_ntz"))


def filter_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def filter_all(df: DataFrame, predicates: Iterable[Column]) -> DataFrame:
    """AND of predicates (a row passes only when every predicate is TRUE)."""
    cond = None
    for p in predicates:
        cond = p if cond is None else cond & p
    return df if cond is None else df.filter(cond)


def having_count(df: DataFrame, keys: Sequence[str], column: str, minimum: int,
                 alias: str = "n") -> DataFrame:
    """Groups of ``keys`` whose non-NULL count of ``column`` exceeds ``minimum``."""
    return df.groupBy(*keys).agg(F.count(column).alias(alias)).filter(F.col(alias) > minimum)


def having_avg(df: DataFrame, keys: Sequence[str], column: str, minimum,
               aggs: Sequence[Column] = ()) -> DataFrame:
    """Groups whose unrounded mean of ``column`` exceeds ``minimum``, with extra ``aggs``.

    Compared exactly as ``SUM(x) > minimum * COUNT(x)`` (no division); a group
    with no non-NULL value fails, as ``AVG`` would be NULL.
    """
    out = df.groupBy(*keys).agg(*aggs, F.sum(column).alias("__sum"), F.count(column).alias("__n"))
    return out.filter(F.col("__sum") > F.col("__n") * F.lit(minimum)).drop("__sum", "__n")
