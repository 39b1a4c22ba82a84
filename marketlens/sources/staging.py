"""Write the eight tables once and read them back (the load step of the reports).

Writing cuts the lineage of whatever produced the tables (CSV parsing, casts,
the stand-in derivation): later jobs and retried tasks after a lost executor
re-read files instead of recomputing it. Files go to ``base_path``, a folder
in the shared work directory.

By default the tables are plain parquet. Every report aggregates partially
before it shuffles, and AQE splits skewed join partitions, so a key holding
a large share of the rows (one order with a third of all items) costs one
partial row per task. ``buckets=n`` instead writes external catalog tables
bucketed by join key (``order_id`` for the order-keyed tables), which removes
the ``order_id`` shuffles from joins and per-order aggregates; use it only
when no key is hot, because a bucket is read by a single task and cannot be
split.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from marketlens.tables import Tables

# Bucketing key of each table.
BUCKET_KEYS = {
    "customers": "customer_id",
    "sellers": "seller_id",
    "products": "product_id",
    "orders": "order_id",
    "order_items": "order_id",
    "order_payments": "order_id",
    "order_reviews": "order_id",
    "category_translation": None,
}


def stage_tables(spark: SparkSession, tables: Tables, base_path: str, buckets: int | None = None,
                 files: int | None = None, prefix: str | None = None) -> Tables:
    """Write every table of ``tables`` under ``base_path`` and return the written tables.

    ``files=n`` spreads each plain table over ``n`` files by round-robin
    repartitioning (even sizes whatever the key distribution), so later scans
    run in parallel even when the source came as a few large files.
    """
    out = {}
    if buckets is None:
        def write(item):
            name, df = item
            path = f"{base_path}/{name}"
            (df.repartition(files) if files else df).write.mode("overwrite").parquet(path)
            return name, path

        # the eight writes are independent jobs; submitting them together lets
        # the scheduler fill idle cores while small tables finish
        with ThreadPoolExecutor(max_workers=4) as pool:
            for name, path in pool.map(write, tables.as_dict().items()):
                out[name] = spark.read.parquet(path)
        return Tables.from_dict(out)
    prefix = prefix or f"stage_{uuid.uuid4().hex[:8]}"
    for name, df in tables.as_dict().items():
        table = f"{prefix}_{name}"
        writer = df.write.mode("overwrite").format("parquet").option("path", f"{base_path}/{name}")
        key = BUCKET_KEYS[name]
        if key is not None:
            writer = writer.bucketBy(buckets, key)
        writer.saveAsTable(table)
        out[name] = spark.table(table)
    return Tables.from_dict(out)
