"""The report catalog, run in order, and one output per report."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, TimestampNTZType, TimestampType

from marketlens.plans.graph import CATALOG, write_graph
from marketlens.session import scratch_path
from marketlens.tables import Tables


def build_reports(t: Tables, names: Iterable[str] | None = None,
                  params: Mapping[str, Mapping] | None = None) -> dict[str, DataFrame]:
    """Lazy frames of the named reports (all, in catalog order, by default), each from the tables."""
    params = params or {}
    return {n: CATALOG[n](t, **params.get(n, {})) for n in (names or CATALOG)}


def write_reports(t: Tables, directory: str, names: Iterable[str] | None = None,
                  params: Mapping[str, Mapping] | None = None, fmt: str = "parquet") -> dict[str, str]:
    """I11 over the catalog: each named report to ``{directory}/{name}``, computed once (see
    :mod:`marketlens.plans.graph`)."""
    return write_graph(t, directory, names, params, fmt)


def run_reports(t: Tables, names: Iterable[str] | None = None,
                params: Mapping[str, Mapping] | None = None, directory: str | None = None) -> dict[str, DataFrame]:
    """The named reports in catalog order, written (to the shared work folder by default) and read back."""
    spark = t.orders.sparkSession
    paths = write_reports(t, directory or scratch_path(spark, "catalog"), names, params)
    return {n: spark.read.parquet(p) for n, p in paths.items()}


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def count_rows(reports: Mapping[str, DataFrame]) -> DataFrame:
    """(report, row_count) of the given frames, in their order."""
    return _union([df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("report"), "row_count")
                   for n, df in reports.items()])


def _text(df: DataFrame, name: str) -> Column:
    """A value as text that does not depend on the engine: floats in whole hundredths, times to the second."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, DoubleType):
        return F.round(c * 100).cast("bigint").cast("string")
    if isinstance(kind, TimestampNTZType | TimestampType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def digest(frames: Mapping[str, DataFrame]) -> DataFrame:
    """(name, column_name, row_count, value_count, checksum) of the given frames: the checksum adds up the
    first 32 bits of each value's MD5, so swapped columns and wrong values show. One pass per frame."""
    out = []
    for name, df in frames.items():
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, c in enumerate(df.columns):
            text = _text(df, c)
            number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
            aggs += [F.count(text).alias(f"c{i}"), F.coalesce(F.sum(number), F.lit(0)).cast("bigint").alias(f"s{i}")]
        stack = ", ".join(f"'{c}', n, c{i}, s{i}" for i, c in enumerate(df.columns))
        out.append(df.agg(*aggs).selectExpr(f"'{name}' AS name", f"stack({len(df.columns)}, {stack}) AS "
                                            "(column_name, row_count, value_count, checksum)"))
    return _union(out)
