"""Grand-total shares (the only window functions the reports use)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketlens.functions.numeric import share


def window_share(df: DataFrame, count_col: str, alias: str = "percentage",
                 places: int = 2) -> DataFrame:
    """``100.0 * n / SUM(n) OVER ()`` on an aggregated frame.

    An un-partitioned window gathers its input in one task, so ``df`` must be
    the output of an aggregation with a bounded number of groups.
    """
    return df.withColumn(alias, share(count_col, places))


def share_of_total(df: DataFrame, col: str, alias: str = "share", places: int = 2,
                   scale: int = 0) -> DataFrame:
    """A value's share of its column total, in percent (what a pie chart shows).

    ``scale`` is the decimal scale of ``col`` (0 for counts, 2 for money).
    """
    return df.withColumn(alias, share(col, places, scale))
