"""Sorts, limits and top-k with spelled-out NULL order.

The reports follow PostgreSQL's order: NULL sorts as the largest value, so
ascending puts NULL last and descending puts it first. Every top-k adds a
tie-break on the group key, so the rows kept under a LIMIT are determined.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Sort(NamedTuple):
    """One sort key, kept as plain data so orders can be declared at import time."""
    name: str
    descending: bool = False


Order = Sequence["Sort | Column"]


def asc(c: str) -> Sort:
    """Ascending, NULL last."""
    return Sort(c, False)


def desc(c: str) -> Sort:
    """Descending, NULL first."""
    return Sort(c, True)


def sort_cols(order: Order) -> list[Column]:
    """Sort keys as Columns with the NULL order spelled out."""
    return [(F.desc_nulls_first(s.name) if s.descending else F.asc_nulls_last(s.name))
            if isinstance(s, Sort) else s for s in order]


def reverse(order: Sequence[Sort]) -> list[Sort]:
    """The exact reverse of an order (ascending NULL-last flips to descending NULL-first)."""
    return [Sort(s.name, not s.descending) for s in order]


def sort_asc(df: DataFrame, *cols: str) -> DataFrame:
    """O1 / O3: ascending on one or more keys."""
    return df.orderBy(*sort_cols([asc(c) for c in cols]))


def sort_desc(df: DataFrame, col: str, *ties: str) -> DataFrame:
    """O2: descending on ``col``, then ascending on the tie-break keys."""
    return df.orderBy(*sort_cols([desc(col), *[asc(t) for t in ties]]))


def top_k(df: DataFrame, order: Order, k: int) -> DataFrame:
    """The first ``k`` rows under ``order`` (planned as TakeOrderedAndProject)."""
    return df.orderBy(*sort_cols(order)).limit(k)


def with_row_number(df: DataFrame, order: Order, name: str = "row_no") -> DataFrame:
    """Number the rows of a small (already aggregated or top-k) frame by ``order``.

    The window has no partition key, so it runs in one task: use it only on
    frames bounded by a group count or a LIMIT.
    """
    return df.withColumn(name, F.row_number().over(Window.orderBy(*sort_cols(order))).cast("bigint"))


def plot_order(df: DataFrame, order: Order, k: int, plot_by: Order,
               name: str = "plot_order") -> DataFrame:
    """Keep the top ``k`` under ``order``, then number them by ``plot_by``."""
    return with_row_number(top_k(df, order, k), plot_by, name).orderBy(name)


def first_row(df: DataFrame, order: Order) -> DataFrame:
    """The first row under ``order`` as a one-row frame."""
    return df.orderBy(*sort_cols(order)).limit(1)
