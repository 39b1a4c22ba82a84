"""SQL text in, DataFrame out.

Text names tables as ``{name}`` placeholders bound to frames, so no global
view is registered. PostgreSQL-only syntax does not carry over: write
``CAST(x AS DECIMAL(p,s))`` for ``::numeric`` and
``timestampdiff(MICROSECOND, a, b)`` for ``EXTRACT(EPOCH FROM b - a)``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, text: str, tables: Mapping[str, DataFrame] | None = None,
            views: bool = False) -> DataFrame:
    """Run ``text`` with ``{name}`` placeholders bound to ``tables``.

    With ``views=True`` the frames are registered as temporary views under
    their names instead and the text refers to them by plain name.
    """
    tables = dict(tables or {})
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(text)
    return spark.sql(text, **tables)
