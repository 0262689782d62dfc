"""A training corpus from raw documents: quality rules, near-dedup, substring dedup, mixing, tokens.

Every stage takes documents with any further columns, whatever their names, and an empty table; each states what it does
with nulls, empty and very long texts, ties and repeated rows in the operator that it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterquarry.llm import bpe, mixing, quality_rules, simhash, substring_dedup
from rasterquarry.llm.queries import BYTE_RANKS, table
from rasterquarry.llm.store import drop_tabled, tabled


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep. Null, empty and short texts go; repeated rows and ties are judged alike; no rows give none (quality_rules.keep_good)."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least id, null last, then the least digest. Null, empty and blank texts are one group; no rows give none (simhash.keep_one)."""
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the sentences that an earlier document has, documents of which nothing is left aside. Null texts become empty and stay; equal rows don't rob each other (substring_dedup.keep_new)."""
    return substring_dedup.keep_new(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: documents as often as they are taken, the last of a source cut at its budget. Texts without words are never taken; a null source is one of its own (mixing.mixed_rows)."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mix, digests of them and of what they decode to, lang and source. Null and empty texts have none (bpe.round_trip)."""
    return bpe.round_trip(docs, BYTE_RANKS, with_ids=True, more=("lang", "source"))


STAGES = [("quality_rules", quality), ("simhash_near_dedup", near_dedup), ("substring_dedup", substrings), ("mixing", mix), ("byte_bpe", tokens)]

#: SQL has no XXH64 and no byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Each stage's rows are kept in the shared folder until the next stage's are; the last one's input goes when the driver ends."""
    docs = STAGES[0][1](spark, table(spark, sf_dir, "documents"), sf_dir)
    kept = None
    for _, stage in STAGES[1:]:
        before, kept = kept, tabled(docs)
        if before is not None:
            drop_tabled(before)
        docs = stage(spark, kept, sf_dir)
    return docs
