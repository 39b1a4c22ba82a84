"""File sources and sinks: CSV scan, manifest load, schema conform, append, report sink.

All readers are lazy and distributed (one task per file split, also where
quoted fields hold line breaks); nothing but headers is read on the driver. CSV columns are matched to the declared schema **by
header name**, as an insert by column name does, not by position.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, StringType, StructType

from marketlens.schema import DEFAULT_MANIFEST, FREE_TEXT, PRIMARY_KEYS, table_schema
from marketlens.sources.quoted import read_quoted
from marketlens.tables import DECLARED_TRANSLATION

# enforceSchema=false: every file's header is checked, so a folder whose files order their
# columns differently raises instead of being read by position.
CSV_OPTIONS = {"header": "true", "escape": '"', "mode": "FAILFAST", "enforceSchema": "false"}


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None,
             rename: Mapping[str, str] | None = None, required: Iterable[str] = (),
             multi_line: bool | None = None, **options: str) -> DataFrame:
    """Header CSV (comma, quoted text) -> frame.

    ``multi_line`` is needed where quoted text may hold line breaks (by default: where
    the schema declares unbounded text). Such files are read in splits too, after a first
    pass over their quotes (:mod:`marketlens.sources.quoted`).

    Every field is read as text and then conformed to ``schema`` by name
    (see :func:`conform`); without a schema the text columns are returned.
    """
    if multi_line is None:
        multi_line = schema is not None and any(c in FREE_TEXT for c in schema.fieldNames())
    df = spark.read.options(**{**CSV_OPTIONS, "multiLine": str(multi_line).lower(), **options}).csv(path)
    if multi_line:
        df = read_quoted(spark, path, df.columns, **options)
    return df if schema is None else conform(df, schema, rename, required)


def conform(df: DataFrame, schema: StructType, rename: Mapping[str, str] | None = None,
            required: Iterable[str] = ()) -> DataFrame:
    """Raw frame -> declared types, columns in declared order.

    * ``rename`` maps source names to declared names;
    * a declared column missing from the source is NULL of its type, unless it
      is ``required`` (key columns), which raises;
    * a source column the schema does not declare raises;
    * casts are strict (ANSI): a value that does not parse fails the job.
      :func:`cast_failures` counts such values without failing.
    """
    if rename:
        df = df.select(*[F.col(f"`{c}`").alias(rename.get(c, c)) for c in df.columns])
    declared = [f.name for f in schema.fields]
    extra = [c for c in df.columns if c not in declared]
    if extra:
        raise ValueError(f"columns not in the declared schema: {extra}")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType))
        .alias(f.name) for f in schema.fields])


def cast_failures(df: DataFrame, schema: StructType) -> DataFrame:
    """I5 audit: per declared column present in ``df``, values that are not NULL
    but do not cast to the declared type -> (column_name, bad_values). One pass."""
    cols = [f for f in schema.fields if f.name in df.columns]
    counts = df.agg(*[
        F.sum(F.when(F.col(f.name).isNotNull()
                     & F.col(f.name).cast(StringType()).try_cast(f.dataType).isNull(), 1)
              .otherwise(0)).cast("bigint").alias(f.name) for f in cols])
    stack = ", ".join(f"'{f.name}', `{f.name}`" for f in cols)
    return counts.selectExpr(f"stack({len(cols)}, {stack}) AS (column_name, bad_values)")


def load_tables(spark: SparkSession, directory: str,
                manifest: Iterable[tuple[str, str]] = DEFAULT_MANIFEST,
                id_type: DataType = StringType(), money_type: DataType = DecimalType(10, 2),
                renames: Mapping[str, Mapping[str, str]] | None = None,
                fmt: str = "csv") -> dict[str, DataFrame]:
    """Load every (file, table) of a manifest, conformed to its declared schema.

    Lazy: returns a dict of frames; nothing is scanned until a report runs.
    """
    out = {}
    for filename, table in manifest:
        table = "category_translation" if table == DECLARED_TRANSLATION else table
        path = f"{directory.rstrip('/')}/{filename}"
        schema = table_schema(table, id_type, money_type)
        keys = PRIMARY_KEYS.get(table, ())
        rename = (renames or {}).get(table)
        if fmt == "csv":
            out[table] = read_csv(spark, path, schema, rename, keys)
        else:
            out[table] = conform(spark.read.format(fmt).load(path), schema, rename, keys)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV as the loader expects it (used to stage CSV inputs); white space at the ends of text stays."""
    df.write.mode("overwrite").options(header="true", escape='"', ignoreLeadingWhiteSpace="false",
                                       ignoreTrailingWhiteSpace="false").csv(path)


def append_table(df: DataFrame, target: str, fmt: str = "parquet") -> None:
    """Append rows to a table (a catalog name, or a path when it contains '/').

    There is no key check: appending the same rows twice keeps both copies, as
    in the reference where the tables without a primary key accept repeats.
    """
    writer = df.write.mode("append").format(fmt)
    if "/" in target:
        writer.save(target)
    else:
        writer.saveAsTable(target)


def read_report(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A written report (I11) as a frame."""
    return read_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)


def write_report(df: DataFrame, directory: str, name: str, fmt: str = "parquet") -> str:
    """One output per report, ``{directory}/{name}``, replaced on each run."""
    path = f"{directory.rstrip('/')}/{name}"
    if fmt == "csv":
        write_csv(df, path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
    return path
