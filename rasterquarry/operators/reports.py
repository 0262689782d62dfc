"""Reports over many decoded files: expected failures, verdicts, profile comparison, timings, checksums and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_extensions(paths: DataFrame, *extensions: str) -> DataFrame:
    """The distinct paths that end with one of the extensions."""
    return paths.where(F.lower(F.substring_index("path", ".", -1)).isin(*extensions)).distinct()


def expected_kind(path: Column, reason: Column, known: list[tuple[str, str, str]]) -> Column:
    """The kind of the first stated failure (path begins with, reason contains, kind) that a file's is; null without one. The list is the caller's, so nothing is joined."""
    out = F.lit(None).cast("string")
    for begins, contains, kind in reversed(known):
        out = F.when(F.startswith(path, F.lit(begins)) & F.contains(reason, F.lit(contains)), kind).otherwise(out)
    return out


def verdict(failed: Column, differs: Column, expected: Column) -> Column:
    """PASS, FAIL, or EXPECTED_FAIL for a failure of an expected kind."""
    return F.when(failed & expected.isNotNull(), "EXPECTED_FAIL").when(failed | differs, "FAIL").otherwise("PASS")


def compared_profiles(ours: Column, theirs: Column) -> Column:
    """A colour profile that only ours has is told apart from one that ours misses."""
    return F.when(theirs.isNull() & ours.isNull(), "both absent").when(theirs.isNull(), "only ours").when(ours.isNull(), "missing").when(theirs != ours, "differs").otherwise("equal")


def timings(runs: DataFrame, by: str, most_ratio: float = 2.5) -> DataFrame:
    """(by, runs, ours_ms, theirs_ms, peak_mb, over) of rows (by, ours_ms, theirs_ms, peak_mb): over if ours took more than most_ratio times as long."""
    sums = runs.groupBy(by).agg(F.count("*").alias("runs"), F.sum("ours_ms").alias("ours_ms"), F.sum("theirs_ms").alias("theirs_ms"), F.max("peak_mb").alias("peak_mb"))
    return sums.withColumn("over", F.col("ours_ms") > most_ratio * F.col("theirs_ms"))


def compared_modes(runs: DataFrame) -> DataFrame:
    """(mode, runs, fastest_ms, peak_mb, total_ms) of rows (mode, ms, mb)."""
    return runs.groupBy("mode").agg(F.count("*").alias("runs"), F.min("ms").alias("fastest_ms"), F.max("mb").alias("peak_mb"), F.sum("ms").alias("total_ms"))


def concurrent(runs: DataFrame, most_mb: int = 1536) -> DataFrame:
    """(workers, slowest_ms, peak_mb, over) of rows (workers, ms, mb)."""
    sums = runs.groupBy("workers").agg(F.max("ms").alias("slowest_ms"), F.max("mb").alias("peak_mb"))
    return sums.withColumn("over", F.col("peak_mb") > most_mb)


def equal_images(ours: DataFrame, theirs: DataFrame, key: str = "image") -> DataFrame:
    """(key, verdict) of rows (key, samples): equal, differs, or the side that has it alone."""
    both = ours.select(key, F.col("samples").alias("ours")).join(theirs.select(key, F.col("samples").alias("theirs")), key, "full")
    return both.select(key, F.when(F.col("ours").isNull(), "only theirs").when(F.col("theirs").isNull(), "only ours").when(F.col("ours") == F.col("theirs"), "equal").otherwise("differs").alias("verdict"))


def coefficient_checksum(levels: Column) -> Column:
    """A block's levels folded into 64 bits: each, as 16 bits, times its place from 1, added modulo 2 ** 63."""
    return F.aggregate(F.transform(levels, lambda v, i: v.cast("long").bitwiseAND(0xFFFF) * (i + 1)), F.lit(0).cast("long"), lambda a, v: (a + v).bitwiseAND((1 << 63) - 1))


def violations(range_: Column, offset: Column) -> Column:
    """What is wrong with an arithmetic decoder's state; null if nothing is."""
    return F.when(~range_.between(256, 510), "range").when(offset >= range_, "offset")
