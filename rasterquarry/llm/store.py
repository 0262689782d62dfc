"""Cutting lineage in a folder that the driver and every executor share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local master without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or None
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="rasterquarry-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Rows of a part of a cut, where it is known beforehand how many there can be.
ROWS_IN_PART = 1 << 17


def cut(df: DataFrame, most: int | None = None) -> DataFrame:
    """df's rows, computed once and kept in the shared folder: a lost executor costs no recomputation beyond it.

    most: a number that df's rows don't exceed. So few rows take no file for each partition of the shuffle before them:
    where the folder is local, each file starts two processes that set its mode.
    """
    shared_folder(df.sparkSession)
    if most is not None:
        df = df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-most // ROWS_IN_PART)))
    return df.checkpoint(eager=True)


def tabled(df: DataFrame) -> DataFrame:
    """df's rows as a Parquet table in the shared folder: Spark knows its size, and broadcasts it only below its own threshold."""
    path = f"{shared_folder(df.sparkSession)}/rasterquarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _files(df.sparkSession, path).deleteOnExit(_path(df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def drop_tabled(table: DataFrame) -> None:
    """Deletes the files of a tabled() table that nothing will read again. Those that aren't dropped go when the driver ends."""
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if path.rsplit("/", 1)[-1].startswith("rasterquarry-"):
            _files(table.sparkSession, path).delete(_path(table.sparkSession, path), True)


#: A key is heavy if it has more than one in so many of a table's rows, so that many keys at most are heavy in any table.
HEAVY = 500


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left LEFT JOIN right on key, of which right has a row at most, for a left that may have any part of its rows on one key.

    The rows of left's heavy keys, HEAVY keys at most, stay where they are and meet a broadcast of those keys' rows; only
    the others are dealt out by key. left is read three times: it should be a cut. A null key has no partner.
    """
    total = left.count()
    heavy = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") * HEAVY > total).select(key)
    there = heavy.withColumn("__heavy", F.lit(True))
    marked = left.join(F.broadcast(there), key, "left")
    few = right.join(F.broadcast(heavy), key, "left_semi")
    own = marked.where("__heavy").drop("__heavy").join(F.broadcast(few), key, "left")
    rest = marked.where("__heavy IS NULL").drop("__heavy").join(right, key, "left")
    return own.unionByName(rest)


def own_names(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs), for a stage that keeps the columns and has working columns led by `__`: docs' own names of that kind step aside meanwhile."""
    if not any(c.startswith("__") for c in docs.columns):
        return stage(docs)
    aside = [f"aside_{i}{c}" if c.startswith("__") else c for i, c in enumerate(docs.columns)]
    return stage(docs.toDF(*aside)).toDF(*docs.columns)
