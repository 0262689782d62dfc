"""The queries of this subpackage: thin forms of its operators over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import bpe, chat, ctph, licenses, mixing, quality_classifier, quality_rules, simhash, substring_dedup, wordpiece

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark, sf_dir):
    return ctph.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op3_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_RANKS)


def op4_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_counts(spark, sf_dir):
    return wordpiece.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)


def op6_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.known_licenses(spark))


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op10_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(rows.unionByName(chat.probe(spark)))


QUERIES = {
    f.__name__: f
    for f in (op1_document_fingerprints, op2_mixing, op3_byte_bpe, op4_simhash_near_dedup, op5_token_counts, op6_license_scan, op7_substring_dedup, op8_quality_rules, op9_quality_classifier, op10_chat_formatting)
}
ORACLES = {"op2_mixing": mixing.ORACLE, "op6_license_scan": licenses.oracle(), "op10_chat_formatting": chat.ORACLE}
