"""Heavy-hitter joins: keys with very many rows, found by a sketch and dealt out.

``heavy_hitters`` finds the most frequent values of a key with a frequent-items sketch:
partial sketches of bounded size per task, merged into one, so a scan of one column and no
shuffle of its rows. ``salted_join`` deals the rows of such keys out by a hash of another
column and repeats the other side's rows of those keys, one for each part; all other rows
are joined as they are. Results do not depend on what the sketch finds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 100          # most frequent keys kept at most
TRACKED = 10_000        # keys a sketch follows: what holds 1 / 3,000 of the rows or more is found
SHARE = 1_000           # a key is hot from this fraction of the rows on


def heavy_hitters(df: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """Keys that hold at least ``1 / share`` of the rows: one column ``key``, ``HOT_KEYS`` rows at most."""
    found = df.where(F.col(key).isNotNull()).agg(
        F.expr(f"approx_top_k(`{key}`, {HOT_KEYS}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n"))
    return (found.select("n", F.explode("top").alias("t")).where(F.col("t.count") * share >= F.col("n"))
            .select(F.col("t.item").alias(key)))


def heaviest(counted: DataFrame, key: str, rows: str, share: int = SHARE) -> DataFrame:
    """As ``heavy_hitters``, exactly, where the ``rows`` of each key are counted already."""
    total = counted.agg(F.sum(rows).alias("__n"))
    top = counted.where(F.col(key).isNotNull() & (F.col(rows) > 0)).select(key, rows).orderBy(F.desc(rows)).limit(HOT_KEYS)
    return top.crossJoin(F.broadcast(total)).where(F.col(rows) * share >= F.col("__n")).select(key)   # total: one row


def salted_join(many: DataFrame, one: DataFrame, key: str, spread: str, hot: DataFrame, parts: int | None = None) -> DataFrame:
    """``many`` inner-joined to ``one`` on ``key``; rows of ``many`` with a hot key are dealt out by
    ``spread`` to ``parts`` parts (default: the session's shuffle partitions)."""
    parts = parts or max(int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    marked = F.broadcast(hot.select(F.col(key).alias("__hot")))       # HOT_KEYS rows at most
    left = (many.join(marked, F.col(key) == F.col("__hot"), "left")
            .withColumn("__part", F.when(F.col("__hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(parts))).cast("int"))
            .drop("__hot"))
    right = (one.join(marked, F.col(key) == F.col("__hot"), "left")
             .withColumn("__part", F.explode(F.sequence(F.lit(0), F.when(F.col("__hot").isNull(), 0).otherwise(parts - 1))))
             .drop("__hot"))
    return left.join(right, [key, "__part"]).drop("__part")
