"""Vectors that take part in a search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(embeddings: DataFrame, allow_zero: bool) -> DataFrame:
    """``(vec_id, embedding)`` rows with an id and a non-empty vector of finite numbers (and
    not all zero, unless allowed), as ``vec_id long, v array<double>``.

    A vec_id names one vector: of rows that repeat it, the smallest vector stands.
    """
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad)
    if not allow_zero:
        v = v.where(F.exists("v", lambda x: x != 0))
    return v.groupBy("vec_id").agg(F.min("v").alias("v"))
