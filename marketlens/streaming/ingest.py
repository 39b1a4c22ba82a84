"""Incremental load: CSV files arriving in a folder, appended to a table exactly once.

The batch loader appends each CSV file to its table. This is the same step as
a Structured Streaming query: a file source picks up files not seen before,
each micro-batch is conformed to the declared schema (the same casts as the
batch path) and appended by a file sink. The checkpoint in the shared work
folder records which files were committed, so a restarted or retried run
(lost executor, driver restart) appends every file once. With
``trigger(availableNow=True)`` the query processes what is there and stops,
which suits a scheduled load.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from marketlens.sources.files import CSV_OPTIONS, conform


def start_csv_append(spark: SparkSession, source_dir: str, schema: StructType, target_path: str,
                     checkpoint_path: str, header: Sequence[str] | None = None,
                     rename: Mapping[str, str] | None = None, required: Iterable[str] = (),
                     fmt: str = "parquet", available_now: bool = True, multi_line: bool = False) -> StreamingQuery:
    """Start appending new CSV files of ``source_dir`` to ``target_path``.

    ``header`` lists the files' columns in order (default: the declared
    columns); the source checks every file's header against it.
    """
    columns = list(header) if header is not None else schema.fieldNames()
    text_schema = StructType([StructField(c, StringType(), True) for c in columns])
    raw = (spark.readStream.schema(text_schema)
           .options(**{**CSV_OPTIONS, "multiLine": str(multi_line).lower()})
           .csv(source_dir))
    typed = conform(raw, schema, rename, required)
    writer = (typed.writeStream.format(fmt).outputMode("append")
              .option("checkpointLocation", checkpoint_path))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(target_path)


def load_new_files(spark: SparkSession, source_dir: str, schema: StructType, target_path: str,
                   checkpoint_path: str, **kwargs) -> None:
    """Append every CSV file not loaded before, then return."""
    q = start_csv_append(spark, source_dir, schema, target_path, checkpoint_path,
                         available_now=True, **kwargs)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
