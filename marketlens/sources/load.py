"""Audited load: files -> conformed tables, in one pass over each file.

While a table is written its load metrics are gathered by ``DataFrame.observe`` on the
rows as they pass: rows, null key parts, the longest value of every bounded column and how
many exceed the bound, and values that do not cast. A row with such a value goes to the
quarantine with the column and the value as it was; it does not fail the load. Both come
out of the same write, as two partitions of its folder. All tables of a load become
visible in one commit (:mod:`marketlens.sources.versions`), under a load id: loading the
same files again, or a load that was killed, changes nothing for readers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, StringType, StructField, StructType

from marketlens.schema import DEFAULT_MANIFEST, FREE_TEXT, PRIMARY_KEYS, string_bounds, table_schema
from marketlens.sources import versions
from marketlens.sources.files import read_csv
from marketlens.tables import DECLARED_TRANSLATION, Tables

_ERRORS = ArrayType(StructType([StructField("column", StringType()), StructField("value", StringType())]))


def checked(raw: DataFrame, schema: StructType, required: Iterable[str] = ()) -> DataFrame:
    """Raw columns -> the declared ones by ``try_cast``, and ``errors``: column and value of what does not
    cast (null where all do). Undeclared columns and missing required ones raise."""
    names = [f.name for f in schema.fields]
    extra, missing = [c for c in raw.columns if c not in names], [c for c in required if c not in raw.columns]
    if extra or missing:
        raise ValueError(f"columns not in the declared schema: {extra}; required columns missing: {missing}")
    columns, errors = [], []
    for f in schema.fields:
        if f.name not in raw.columns:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        value = F.col(f"`{f.name}`").try_cast(f.dataType)
        columns.append(value.alias(f.name))
        if f.dataType != StringType():
            text = F.col(f"`{f.name}`").cast("string")
            errors.append(F.when(text.isNotNull() & value.isNull(), F.struct(F.lit(f.name).alias("column"), text.alias("value"))))
    found = F.array_compact(F.array(*errors)).cast(_ERRORS) if errors else F.array().cast(_ERRORS)
    return raw.select(*columns, F.when(F.size(found) > 0, found).alias("errors"))


def _metrics(table: str, schema: StructType) -> dict:
    """Name -> aggregate over the checked rows; rows in the quarantine count only as failures."""
    good = F.col("errors").isNull()
    out = {"rows": F.count(F.when(good, 1)), "quarantined": F.count(F.when(~good, 1))}
    for c in PRIMARY_KEYS.get(table, ()):
        out[f"null:{c}"] = F.count(F.when(good & F.col(c).isNull(), 1))
    for c, bound in string_bounds(table):
        n = F.when(good, F.length(F.col(c).cast("string")))
        out[f"longest:{c}"] = F.max(n).cast("long")
        out[f"over:{c}"] = F.count(F.when(n > bound, 1))
    for f in schema.fields:
        if f.dataType != StringType():
            out[f"uncast:{f.name}"] = F.count(F.when(F.array_contains(F.col("errors.column"), f.name), 1))
    return out


def fingerprint(spark: SparkSession, paths: Iterable[str]) -> str:
    """An id of the files under the paths: their names, lengths and times of change."""
    jvm, seen = spark._jvm, []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def load(spark: SparkSession, directory: str, target: str, manifest: Iterable[tuple[str, str]] = DEFAULT_MANIFEST,
         load_id: str | None = None, id_type: DataType = StringType(), money_type: DataType = DecimalType(10, 2),
         renames: Mapping[str, Mapping[str, str]] | None = None, fmt: str = "csv") -> dict[str, dict]:
    """Appends every (file, table) of the manifest to ``target`` and returns the metrics per table.

    ``load_id`` defaults to a fingerprint of the files. An id that is already loaded loads
    nothing and returns what was noted then.
    """
    manifest = [(f, "category_translation" if t == DECLARED_TRANSLATION else t) for f, t in manifest]
    paths = {t: f"{directory.rstrip('/')}/{f}" for f, t in manifest}
    load_id = load_id or fingerprint(spark, paths.values())
    known = versions.current(spark, target)["ids"]
    if load_id in known:
        return known[load_id]
    metrics, folders = {}, {}
    for table, path in paths.items():
        schema, rename = table_schema(table, id_type, money_type), (renames or {}).get(table) or {}
        if fmt == "csv":
            raw = read_csv(spark, path, multi_line=any(c in FREE_TEXT for c in schema.fieldNames()))
        else:
            raw = spark.read.format(fmt).load(path)
        raw = raw.select(*[F.col(f"`{c}`").alias(rename.get(c, c)) for c in raw.columns])
        seen = Observation(f"load-{table}")
        rows = checked(raw, schema, PRIMARY_KEYS.get(table, ()))
        rows = rows.observe(seen, *[c.alias(n) for n, c in _metrics(table, schema).items()])
        folders[table] = f"data/{load_id}/{table}"
        (rows.withColumn("quarantine", F.col("errors").isNotNull()).write.mode("overwrite").partitionBy("quarantine")
         .parquet(f"{target.rstrip('/')}/{folders[table]}"))
        metrics[table] = seen.get
    return versions.commit(spark, target, load_id, folders, append=True, note=metrics)["ids"][load_id]


def _read(spark: SparkSession, target: str, table: str, schema: StructType) -> DataFrame:
    found = versions.folders(spark, target, table)
    full = StructType([*schema.fields]).add("errors", _ERRORS).add("quarantine", BooleanType())
    if not found:
        return spark.createDataFrame([], full)
    out = None
    for folder in found:
        part = spark.read.schema(full).parquet(folder)
        out = part if out is None else out.unionByName(part)
    return out


def loaded(spark: SparkSession, target: str, table: str, id_type: DataType = StringType(),
           money_type: DataType = DecimalType(10, 2)) -> DataFrame:
    """A table's rows in the newest version, of all loads."""
    schema = table_schema(table, id_type, money_type)
    return _read(spark, target, table, schema).where("not quarantine").select(*schema.fieldNames())


def quarantined(spark: SparkSession, target: str, table: str, id_type: DataType = StringType(),
                money_type: DataType = DecimalType(10, 2)) -> DataFrame:
    """Rows kept back, one per value that does not cast: the columns that do, ``column`` and ``value``."""
    schema = table_schema(table, id_type, money_type)
    return (_read(spark, target, table, schema).where("quarantine").withColumn("e", F.explode("errors"))
            .select(*schema.fieldNames(), F.col("e.column").alias("column"), F.col("e.value").alias("value")))


def loaded_tables(spark: SparkSession, target: str, id_type: DataType = StringType(),
                  money_type: DataType = DecimalType(10, 2)) -> Tables:
    """The eight tables of the newest version."""
    return Tables.from_dict({t: loaded(spark, target, t, id_type, money_type) for _, t in DEFAULT_MANIFEST})


# --------------------------------------------------------------------------- audits from the metrics
def counts(spark: SparkSession, metrics: Mapping[str, dict]) -> DataFrame:
    """I4 without a scan: ``table_name, row_count, quarantined_rows``."""
    return spark.createDataFrame([(t, m["rows"], m["quarantined"]) for t, m in metrics.items()],
                                 "table_name string, row_count long, quarantined_rows long")


def lengths(spark: SparkSession, metrics: Mapping[str, dict]) -> DataFrame:
    """I8 without a scan: ``table_name, column_name, declared_bound, max_length, over_bound_rows``."""
    return spark.createDataFrame([(t, c, b, m[f"longest:{c}"], m[f"over:{c}"]) for t, m in metrics.items() for c, b in string_bounds(t)],
                                 "table_name string, column_name string, declared_bound int, max_length long, over_bound_rows long")


def failures(spark: SparkSession, metrics: Mapping[str, dict]) -> DataFrame:
    """Null key parts and values that do not cast: ``table_name, column_name, null_keys, uncast_values``."""
    rows = []
    for t, m in metrics.items():
        for c in sorted({n.split(":", 1)[1] for n in m if n.startswith(("null:", "uncast:"))}):
            rows.append((t, c, m.get(f"null:{c}"), m.get(f"uncast:{c}")))
    return spark.createDataFrame(rows, "table_name string, column_name string, null_keys long, uncast_values long")
