"""Documents as streams.

A document's elements belong together, so a stream carries the list form: one
document a row. Functions over lists are stateless and run on a stream as they
do on a table. ``once`` drops repeated deliveries within the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folia.sources.compact import from_compact


def compact_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of files in the compact format, each a document: ``filename``, ``modified`` and ``blocks``."""
    raw = spark.readStream.schema("value string").text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("filename"), F.col("_metadata.file_modification_time").alias("modified"), from_compact(F.col("value")).alias("blocks"))


def transformed(stream: DataFrame, change: Callable[[Column], Column], blocks_col: str = "blocks") -> DataFrame:
    """A stream with a function over lists applied to each document."""
    return stream.withColumn(blocks_col, change(F.col(blocks_col)))


def once(stream: DataFrame, doc_col: str, time_col: str, delay: str = "10 minutes") -> DataFrame:
    """Each document once within the watermark: repeated deliveries of the same id and time are dropped."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([doc_col, time_col])


def counts_by_type(stream: DataFrame, time_col: str, window: str = "1 minute", delay: str = "10 minutes", blocks_col: str = "blocks") -> DataFrame:
    """How many elements of each type arrived in each window; late documents count until the watermark."""
    opened = stream.withWatermark(time_col, delay).select(time_col, F.explode(blocks_col).alias("b"))
    return opened.groupBy(F.window(time_col, window).alias("window"), F.col("b.element_type").alias("element_type")).agg(F.count(F.lit(1)).alias("n"))


def write_table(stream: DataFrame, path: str, checkpoint: str, all_now: bool = True) -> StreamingQuery:
    """Appends a stream to Parquet files; with ``all_now``, what is there now and no more."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if all_now else writer).start()
