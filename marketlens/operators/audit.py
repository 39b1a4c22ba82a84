"""Load counts and declared-constraint audits (keys, foreign keys, length bounds).

The reference enforced its constraints at insert time; here they are
reported per table as small frames. Each audit aggregates before any join:
child rows are counted per foreign-key value first, so a hot key collapses
map-side and the anti-join sees one row per distinct value.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.schema import FOREIGN_KEYS, PRIMARY_KEYS, ForeignKey, string_bounds


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def load_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """I4: (table_name, row_count) for every table."""
    return _union([df.agg(F.count(F.lit(1)).alias("row_count"))
                   .select(F.lit(name).alias("table_name"), "row_count")
                   for name, df in tables.items()])


def check_primary_keys(tables: Mapping[str, DataFrame],
                       keys: Mapping[str, tuple[str, ...]] = PRIMARY_KEYS) -> DataFrame:
    """Per keyed table: rows, rows with a NULL key part, duplicated key values
    and the rows carrying them -> (table_name, row_count, null_keys,
    duplicate_keys, duplicate_rows)."""
    frames = []
    for name, cols in keys.items():
        if name not in tables:
            continue
        per_key = tables[name].groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
        has_null = F.lit(False)
        for c in cols:
            has_null = has_null | F.col(c).isNull()
        dup = ~has_null & (F.col("n") > 1)
        frames.append(per_key.agg(
            F.sum("n").alias("row_count"),
            F.sum(F.when(has_null, F.col("n")).otherwise(0)).alias("null_keys"),
            F.sum(F.when(dup, 1).otherwise(0)).alias("duplicate_keys"),
            F.sum(F.when(dup, F.col("n")).otherwise(0)).alias("duplicate_rows"))
            .select(F.lit(name).alias("table_name"),
                    *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c)
                      for c in ("row_count", "null_keys", "duplicate_keys", "duplicate_rows")]))
    return _union(frames)


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose non-NULL ``column`` has no parent row -> one row, ``orphan_rows``."""
    per_value = (child.where(F.col(column).isNotNull())
                 .groupBy(F.col(column).alias("__k")).agg(F.count(F.lit(1)).alias("__n")))
    missing = per_value.join(parent.select(F.col(parent_column).alias("__k")), "__k", "left_anti")
    return missing.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("orphan_rows"))


def check_foreign_keys(tables: Mapping[str, DataFrame],
                       fks: Iterable[ForeignKey] = FOREIGN_KEYS) -> DataFrame:
    """Per declared foreign key, child rows with no parent ->
    (child_table, child_column, parent_table, orphan_rows). NULL references
    are not orphans (a NULL foreign key satisfies the constraint)."""
    frames = []
    for fk in fks:
        if fk.child in tables and fk.parent in tables:
            frames.append(orphans(tables[fk.child], fk.column, tables[fk.parent], fk.parent_column)
                          .select(F.lit(fk.child).alias("child_table"),
                                  F.lit(fk.column).alias("child_column"),
                                  F.lit(fk.parent).alias("parent_table"), "orphan_rows"))
    return _union(frames)


def check_lengths(tables: Mapping[str, DataFrame]) -> DataFrame:
    """I8: per bounded string column present: longest value against its declared
    bound -> (table_name, column_name, declared_bound, max_length, over_bound_rows).
    One aggregation pass per table; values are measured as text."""
    frames = []
    for name, df in tables.items():
        bounds = [(c, b) for c, b in string_bounds(name) if c in df.columns]
        if not bounds:
            continue
        aggs = []
        for c, b in bounds:
            ln = F.length(F.col(c).cast("string"))
            aggs += [F.max(ln).cast("bigint").alias(f"{c}__max"),
                     F.sum(F.when(ln > b, 1).otherwise(0)).cast("bigint").alias(f"{c}__over")]
        stack = ", ".join(f"'{c}', {b}, `{c}__max`, `{c}__over`" for c, b in bounds)
        frames.append(df.agg(*aggs).selectExpr(
            f"'{name}' AS table_name",
            f"stack({len(bounds)}, {stack}) AS (column_name, declared_bound, max_length, over_bound_rows)"))
    return _union(frames)
