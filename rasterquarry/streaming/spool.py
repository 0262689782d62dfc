"""Image files as a stream: each arrives once, is checked against a size, and is described in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterquarry.operators.boxes import boxes
from rasterquarry.sources.files import MAX_INPUT_BYTES, family, limited

SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def image_stream(spark: SparkSession, path: str, pattern: str = "*.{heic,heif,avif}", files_per_batch: int = 1000) -> DataFrame:
    """A streaming DataFrame (file_id, modificationTime, length, content) of files that appear under path."""
    rows = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(path)
    return rows.select(F.col("path").alias("file_id"), "modificationTime", "length", "content")


def described(stream: DataFrame, most: int = MAX_INPUT_BYTES) -> DataFrame:
    """(file_id, length, family, error) of a stream or table of files; no state is kept between batches."""
    rows = limited(stream, most).withColumn("family", family(F.col("content")))
    return rows.select("file_id", "length", "family", F.coalesce("error", F.when(F.col("family").isNull(), "UnsupportedFeature")).alias("error"))


def spool(stream: DataFrame, target: str, checkpoint: str, most: int = MAX_INPUT_BYTES):
    """Writes each micro-batch's files and their boxes under target as Parquet, once each: a batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        kept = limited(batch, most)
        kept.write.mode("overwrite").parquet(f"{target}/files/batch={number}")
        boxes(kept.where("error IS NULL")).write.mode("overwrite").parquet(f"{target}/boxes/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
