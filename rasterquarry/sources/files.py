"""Image files as rows, and what can be told of them before any pixel is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterquarry.functions.bytes import part

#: Input beyond so many bytes is rejected unless a caller states another bound.
MAX_INPUT_BYTES = 128 << 20
# The ftyp brands by which content is known.
AVIF_BRANDS = ("avif", "avis")
HEIF_BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1", "miaf")


def read_images(spark: SparkSession, path: str, pattern: str = "*.{heic,heif,avif,HEIC,HEIF,AVIF}") -> DataFrame:
    """(file_id string, length long, content binary). Columns that a query doesn't use aren't read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.col("path").alias("file_id"), "length", "content")


def limited(files: DataFrame, most: int = MAX_INPUT_BYTES) -> DataFrame:
    """files with `error`: ResourceLimit for those longer than `most`, by reported length or by content; their content becomes null.

    Over a folder the reported length is filtered first, which Spark pushes into the scan: the content of a file that
    is too long is never read. Only a file whose length is a lie is read before it is rejected.
    """
    told = files.where(F.col("length") <= most)
    lies = F.octet_length("content") > most
    good = told.withColumns({"error": F.when(lies, "ResourceLimit"), "content": F.when(~lies, F.col("content"))})
    over = files.where(F.col("length") > most).withColumns({"error": F.lit("ResourceLimit"), "content": F.lit(None).cast("binary")})
    return good.unionByName(over)


def family(content: Column) -> Column:
    """`avif`, `heif` or null by the content's first twelve bytes."""
    brand = F.when(part(content, 4, 4) == F.lit(b"ftyp"), part(content, 8, 4)).cast("string")
    return F.when(brand.isin(*AVIF_BRANDS), "avif").when(brand.isin(*HEIF_BRANDS), "heif")


def read_range(content: Column, at: Column, n: Column) -> Column:
    """struct<bytes, error>: [at, at + n) of the content, OutOfBounds if it isn't all there. The end is added in 38 digits, so it can't wrap."""
    end = at.cast("decimal(38,0)") + n.cast("decimal(38,0)")
    bad = (at < 0) | (n < 0) | (end > F.octet_length(content))
    return F.struct(F.when(~bad, F.substring(content, at.cast("int") + 1, n.cast("int"))).alias("bytes"), F.when(bad, "OutOfBounds").alias("error"))


def sampled(files: DataFrame, step: int) -> DataFrame:
    """Every step-th path by name. Paths alone are range-partitioned and counted within their range; a range's first rank is the sum of the counts before it."""
    from pyspark.sql import Window

    paths = files.select("file_id").distinct().repartitionByRange("file_id").select("file_id", F.spark_partition_id().alias("__range"))
    paths = paths.withColumn("__n", F.row_number().over(Window.partitionBy("__range").orderBy("file_id")))
    counts = paths.groupBy("__range").agg(F.count("*").alias("__count"))  # a row a range
    before = counts.select("__range", (F.sum("__count").over(Window.orderBy("__range")) - F.col("__count")).alias("__before"))
    kept = paths.join(before, "__range").where((F.col("__before") + F.col("__n") - 1) % step == 0)
    return files.join(kept.select("file_id"), "file_id", "left_semi")
