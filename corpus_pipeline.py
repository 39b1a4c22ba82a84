"""Documents to packed training sequences: quality, language, lines, near-duplicates, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return
the columns of ``documents``. A stage's result is written as Parquet and read again as the
next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import langid, lines, packing, quality, simhash
from marketlens.llm.common import scratch, sized_broadcast, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_COSINE = 6 / langid.DIM ** 0.5   # six standard deviations of the cosine of unlike vectors
SHORT_CHARS = 40   # texts under so many characters say too little to be told from noise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose posterior of being good is under the threshold."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    judged = quality.classify(docs.select(*COLUMNS), labels)
    return judged.where(F.col("p_good") >= quality.THRESHOLD).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those like no learned language; ``lang`` becomes the prediction.

    A text is like no language if it scores no more than ``LEAST_COSINE``, what unlike vectors may.
    Texts under ``SHORT_CHARS`` characters stay all the same, with lang ``und``. Null texts go; null and
    repeated doc_ids and repeated rows are judged like others; an empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    training = ~langid.held_out() & F.col("doc_id").isNotNull()
    found = langid.identify(docs, langid.learn(docs.where(training))).where(F.col("lang_pred") != "und")
    like = F.col("score") >= LEAST_COSINE
    kept = found.where(like | (F.length(F.trim("text")) < SHORT_CHARS))
    return kept.withColumn("lang", F.when(like, F.col("lang_pred")).otherwise("und")).select(*COLUMNS)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that equal or nearly equal an earlier one; documents stay, with their new length."""
    return lines.dedup_lines(docs.select(*COLUMNS), whole=True).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash group (3-word shingles, 2 bits): that with the smallest doc_id; rows
    without one come last, and among rows with the same one a hash of the row decides."""
    rows = written(docs.select(*COLUMNS).withColumn("row_id", F.monotonically_increasing_id()), "pipeline-rows")
    found = simhash.near_duplicates(rows.select(F.col("row_id").alias("doc_id"), "text"), words=3, max_bits=2)
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", F.xxhash64(*COLUMNS).alias("hash"), "row_id")
    grouped = written(rows.select("row_id", order.alias("order"))
                      .join(found.select(F.col("doc_id").alias("row_id"), "component_id"), "row_id"), "pipeline-groups")
    first = grouped.groupBy("component_id").agg(F.min("order").getField("row_id").alias("row_id"))
    drop = written(grouped.select("row_id").join(first, "row_id", "left_anti"), "pipeline-drop")
    return rows.join(sized_broadcast(drop, drop.count()), "row_id", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, size=4096)


STAGES = [("quality", quality_stage), ("language", language_stage), ("lines", lines_stage),
          ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

ORACLE_SQL = None   # SimHash, profiles and the tokenizer are not expressible in SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
