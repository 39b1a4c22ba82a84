"""Shared helpers: the cluster's shared folder, lineage cuts, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a two- or three-column table is hinted for broadcast
#: (about 64 bytes a row in memory: 32 MB); above it the join is shuffled.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Raises when the session names none; a session for one machine sets its own
    (see ``__spark_entry__.py`` and the tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/marketlens-llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: computed
    once, and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*frames: DataFrame) -> None:
    """Deletes the folders of ``written`` frames that nothing reads any more."""
    for df in frames:
        spark, files = df.sparkSession, df.inputFiles()
        for folder in {f.rpartition("/")[0] for f in files}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def swept(df: DataFrame) -> DataFrame:
    """``df``, after a garbage collection of the driver: Spark then removes the files of all shuffles (and, where it is
    set to, of checkpoints) that nothing refers to any more. By itself that may take half an hour, while a job of many
    small queries piles them up. Costs a tenth of a second."""
    df.sparkSession._jvm.System.gc()
    return df


def columns_beside(df: DataFrame, *added: str) -> list[str]:
    """Columns of ``df`` but those that an added one would clash with, whatever their case."""
    low = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in low]


def sized_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df`` hinted for broadcast if its counted ``rows`` are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """Undirected edges ``(a, b)`` -> ``(node, root)``, root the smallest node reachable.

    Alternating large-star and small-star rounds: every node links its larger
    neighbours, then its smaller ones, to the smallest it sees, until nothing
    changes. Minima are grouped with map-side combining and joined back, so a
    node with very many neighbours is a skewed join that Spark can split, not
    one large group. Each round is checkpointed and its shuffles are removed. Nodes without an edge to
    another node are absent; nulls and self-loops are ignored.
    """
    e = swept(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
              .distinct().checkpoint())
    seen = _signature(e)
    while seen[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
                 .distinct())
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        e = swept(large.join(small, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                  .unionByName(small.select("hi", F.col("m").alias("lo"))).distinct().checkpoint())
        now = _signature(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
