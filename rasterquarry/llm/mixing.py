"""Mixing sources to target weights: exact cuts in a hash-random order, found by distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, own_names, tabled

WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of the random key by which a source's order is summed, coarse to fine: 16 million ranges a source, then keys.
LEVELS = (3, 6, 32)


def _sized(docs: DataFrame) -> DataFrame:
    """Adds __size, __skey (orders sources by code point, null last) and __key (the random order)."""
    source, doc_id = F.col("source").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        "*",
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("__size"),
        F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("__skey"),
        F.md5(doc_id.cast("binary")).alias("__key"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(skey, source_size, target) from rows (__skey, __size).

    All sources share the total size by weight; what a source gets beyond `epochs` times its size is shared out again.
    The fixpoint is min(cap, level * weight): sources sorted by cap / weight are full up to the first that isn't. One
    row a source reaches these windows, after sums in every task.
    """
    own = sizes.groupBy(F.col("__skey").alias("skey")).agg(F.sum("__size").alias("source_size"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1).cast("int"))
    own = own.select("skey", "source_size", w.cast("long").alias("w"), (F.col("source_size") * epochs).alias("cap"))
    filling = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    whole = Window.partitionBy()
    own = own.withColumns({
        "left": F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "ahead": F.sum("w").over(filling.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = F.col("left") / F.col("ahead")
    own = own.withColumn("level", F.max(F.when(F.col("cap") > level * F.col("w"), level)).over(whole))
    return own.select("skey", "source_size", F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w"))).alias("target"))


def _cuts(sized: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """One row a source: skey, source_size, target, full (whole epochs), and of the last epoch the key at which it ends, the words taken there and the words there.

    Every level sums the keys' next digits inside the range that holds the cut, so a source with a third of all rows
    sends a row a range and task, and no task orders a source's documents.
    """
    at = targets(sized, weights, epochs)
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    at = at.withColumn("full", F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0)).cast("long"))
    at = at.withColumns({"rest": budget - F.col("full") * F.col("source_size"), "prefix": F.lit(""), "before": F.lit(0).cast("long"), "there": F.col("source_size")})
    at = tabled(at)
    for last, digits in zip((0, *LEVELS), LEVELS):
        inside = sized.withColumnRenamed("__skey", "skey") if not last else sized.join(at.where("rest > 0").select("skey", "prefix"), (F.col("__skey") == F.col("skey")) & (F.substring("__key", 1, last) == F.col("prefix")))
        sums = inside.groupBy("skey", F.substring("__key", 1, digits).alias("piece")).agg(F.sum("__size").alias("words"))
        run = Window.partitionBy("skey").orderBy("piece")
        sums = sums.join(at.select("skey", "before", "rest"), "skey")
        sums = sums.withColumn("ends", F.col("before") + F.sum("words").over(run))
        hit = sums.where((F.col("ends") - F.col("words") < F.col("rest")) & (F.col("rest") <= F.col("ends")))
        hit = hit.select("skey", F.col("piece").alias("prefix"), (F.col("ends") - F.col("words")).alias("before"), F.col("words").alias("there"))
        at = at.drop("prefix", "before", "there").join(hit, "skey", "left")
        at = tabled(at)
    return at.withColumn("part", F.col("rest") - F.col("before"))


def _taken(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows with __taken: whole epochs, and what the last epoch takes. Rows that share the key at the cut share what is left there in proportion."""
    cuts = cuts.select(F.col("skey").alias("__skey"), *(F.col(c).alias(f"__{c}") for c in ("source_size", "target", "full", "prefix", "part", "there")))
    last = (
        F.when(F.col("__prefix").isNull() | (F.col("__key") > F.col("__prefix")), F.lit(0))
        .when(F.col("__key") < F.col("__prefix"), F.col("__size"))
        .otherwise(F.expr("__size * __part div __there"))
    )
    return rows.join(cuts, "__skey").withColumn("__taken", F.col("__full") * F.col("__size") + last.cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs.

    size counts words; sources by code point, null last, weigh `weights` in turn. The order within a source is that of
    md5(doc_id), so reruns agree. taken is size times the source's whole epochs, plus size, nothing or, at the cut
    itself, a part, so that each source's sum is its target rounded. Null and empty texts have size 0 and are taken 0
    times. Rows with one doc_id, repeated or not, stay rows and share a cut that falls on them. Texts of any length are
    counted whole. No rows give no rows; other columns aren't read.
    """
    sized = cut(_sized(docs.select("doc_id", "source", "text")).drop("text", "source"))
    out = _taken(sized, _cuts(sized, weights, epochs))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each time that a document is taken whole, and for a part its first words.

    The first words keep what stands before and between them. n_chars is that of the row's own text. The cuts come from
    a narrow table; texts aren't shuffled but joined to one row a source. Null, empty and blank texts are never taken;
    rows with one doc_id that a cut falls on share it, so each may give its first words; texts of any length are cut by
    whole words. No rows give no rows.
    """
    return own_names(docs, lambda rows: _mixed_rows(rows, weights, epochs))


def _mixed_rows(docs: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    cuts = _cuts(cut(_sized(docs.select("doc_id", "source", "text")).drop("text", "source")), weights, epochs)
    rows = _taken(_sized(docs), cuts).where("__taken > 0")
    parts = F.expr("transform(sequence(0L, (__taken - 1) div __size), i -> least(__size, __taken - i * __size))")
    rows = rows.withColumn("__words", F.explode(parts))
    between = F.split("text", WORD)  # what stands before each word
    first = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("__words").cast("int"))
    cut_text = F.when(F.col("__words") == F.col("__size"), F.col("text")).otherwise(F.array_join(F.transform(first, lambda w, i: F.concat(F.get(between, i), w)), ""))
    rows = rows.withColumn("text", cut_text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
own AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
weighed AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS cap FROM own),
filling AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (ORDER BY cap / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv FROM weighed),
leveled AS (SELECT *, max(CASE WHEN cap > lv * w THEN lv END) OVER () AS level FROM filling),
targets AS (SELECT skey, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, level * w) END AS target FROM leveled),
budgets AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM targets),
keyed AS (SELECT skey, k, sum(size)::BIGINT AS there FROM sized GROUP BY skey, k),
run AS (SELECT *, (sum(there) OVER (PARTITION BY skey ORDER BY k))::BIGINT - there AS before FROM keyed)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
        + CASE WHEN there = 0 THEN 0 ELSE size * greatest(0, least(there, budget % source_size - before)) // there END END)::BIGINT AS taken
FROM sized JOIN budgets USING (skey) JOIN run USING (skey, k)
"""
