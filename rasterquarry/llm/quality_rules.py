"""Quality rules: base counts, and the hashed n-gram log-likelihood ratio between trusted texts and the corpus."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .docstats import measure
from .store import cut, drop_tabled, tabled
from .textops import Words, blocks, column, words

#: Buckets of hashed words and word pairs: the model is two sums for each, whatever the corpus' size.
BUCKETS = 1 << 16
#: Each bucket's target share is that of the trusted texts with so much of the corpus' share mixed in, at every size.
PRIOR = 0.1
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: A document stays if its mean log-likelihood ratio, in nats a feature, reaches that of all but this part of the trusted
#: texts, each scored without its own counts, as texts without a label are.
LOST = 0.005
#: Scores of trusted texts are counted in bins of 1 / BINS nats between -RANGE and RANGE.
BINS, RANGE = 1000, 12
#: Longs of the filter of labelled ids.
FILTER_WORDS = 1 << 21


def features(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, then of all pairs of neighbours in a text, and the text of each."""
    of = w.text_of
    inside = of[1:] == of[:-1]
    pairs = (hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[inside] * np.uint64(0xD6E8FEB86659FD93)
    mixed = np.concatenate([hashes * np.uint64(0xBF58476D1CE4E5B9), pairs]) >> np.uint64(48)
    return mixed.astype(np.int64) % BUCKETS, np.concatenate([of, of[1:][inside]])


def _count_batches(batches):
    """One row a bucket and task: features of all texts."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in blocks(batch):
            w = words(column(part))
            total += np.bincount(features(w, w.hashes())[0], minlength=BUCKETS)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["k", "n"])


def _sums(rows: DataFrame, batches, size: int, first: int = 0) -> np.ndarray:
    """The counts n by key k, first <= k < first + size, that every task adds up by itself."""
    out = np.zeros(size, np.int64)
    for r in rows.mapInArrow(batches, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most size rows
        out[r.k - first] = r.n
    return out


def _through(rows: DataFrame, ids: DataFrame, surely: bool = False) -> DataFrame:
    """The rows whose doc_id may be among ids (doc_id, without nulls), or those whose surely isn't.

    A filter of a bit an id and 64 bits a row of ids is broadcast: at most FILTER_WORDS longs, whatever their number.
    Beyond some 10^8 ids it passes most rows, and no row less.
    """
    size = min(FILTER_WORDS, 1 << max(10, ids.count().bit_length()))

    def place():
        h = F.xxhash64(F.col("doc_id").cast("string"))
        return F.shiftright(h, 6).bitwiseAND(size - 1).alias("__word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int")).alias("__bits")

    words = ids.select(*place()).groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))
    word, bit = place()
    there = F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")) != 0, F.lit(False))
    marked = rows.withColumns({"__at": word, "__bit": bit}).join(F.broadcast(words), F.col("__at") == F.col("__word"), "left")
    return marked.where(~there if surely else there).select(*rows.columns)


def _trusted(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, text) whose id has the label quality 1, and the table that they are read from.

    A filter of the labelled ids leaves them and about one other row in 64. The ids of those others are found by a join
    of ids alone; a filter of these tells which texts need a second look, and only they are dealt out to be told apart.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast(rows.schema["doc_id"].dataType))
    some = tabled(_through(rows, good))
    wrong = cut(some.select("doc_id").distinct().join(good, "doc_id", "left_anti"))
    told = _through(some, wrong).join(wrong, "doc_id", "left_anti")
    return _through(some, wrong, surely=True).unionByName(told.select(*rows.columns)), some


def _base_failed(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _ratio(target: np.ndarray, total: np.ndarray | int, share: np.ndarray) -> np.ndarray:
    return np.log((target / total + PRIOR * share) / (1 + PRIOR)) - np.log(share)


def _held_out_batches(batches, target, share):
    """One row a bin and task: trusted texts that pass the base rules, by their score under the model without their own counts."""
    found = np.zeros(2 * RANGE * BINS, np.int64)
    total = target.sum()
    for batch in batches:
        for part in blocks(batch):
            w, hashes, out = measure(column(part))
            bucket, of = features(w, hashes)
            n = np.bincount(of, minlength=part.num_rows)
            own, at, times = np.unique(of * BUCKETS + bucket, return_inverse=True, return_counts=True)
            text, b = own // BUCKETS, own % BUCKETS
            rest = total - n[text]
            score = np.bincount(text, times * _ratio(target[b] - times, np.maximum(rest, 1), share[b]), minlength=part.num_rows) / np.maximum(n, 1)
            good = ~_base_failed(out["n_words"], out["n_repeat_words"]) & (n < total)
            found += np.bincount(np.clip(np.floor(score[good] * BINS).astype(np.int64) + RANGE * BINS, 0, len(found) - 1), minlength=len(found))
    there = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(found[there])], names=["k", "n"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The log-likelihood ratio of each bucket, trusted texts (label quality 1) against all of docs, and the threshold.

    Counts cover every document, the trusted ones every document that has such a label; the threshold covers those of
    them that the base rules pass. Each task sends a row a bucket or bin, and the driver gets their sums. Trusted texts
    are kept for the two passes over them. Without trusted texts every ratio and the threshold are 0, and without any that
    can be scored apart, nothing is rejected by its score.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found, table = _trusted(rows, labels)
    trusted = found.select("text")
    raw, target = (_sums(x, _count_batches, BUCKETS) for x in (rows.select("text"), trusted))
    if not target.sum():
        drop_tabled(table)
        return np.zeros(BUCKETS), 0.0
    share = (raw + 1) / (raw.sum() + BUCKETS)
    scored = _sums(trusted, partial(_held_out_batches, target=target, share=share), 2 * RANGE * BINS)
    drop_tabled(table)
    below = np.searchsorted(np.cumsum(scored), int(LOST * scored.sum()), side="right")
    return _ratio(target, target.sum(), share), (below / BINS - RANGE if scored.any() else -np.inf)


def judge(texts: pa.Array, ratio: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    w, hashes, out = measure(texts)
    bucket, of = features(w, hashes)
    n = np.bincount(of, minlength=len(texts))
    out["score"] = np.bincount(of, ratio[bucket], minlength=len(texts)) / np.maximum(n, 1)
    out["base_failed"] = _base_failed(out["n_words"], out["n_repeat_words"])
    out["kept"] = ~out["base_failed"] & (out["score"] >= threshold)
    return out


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def _judge_batches(batches, ratio, threshold):
    for batch in batches:
        for part in blocks(batch):
            out = judge(column(part), ratio, threshold)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(out[c]) for c in _COLUMNS)], names=["doc_id", *_COLUMNS])


def _keep_batches(batches, ratio, threshold):
    for batch in batches:
        for part in blocks(batch):
            yield part.filter(pa.array(judge(column(part), ratio, threshold)["kept"]))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a document: doc_id, the base counts, base_failed, kept and score (nats a feature).

    Null and empty texts have no words, so they fail. Texts of any length are read whole. Repeated rows and texts that
    score alike are judged alike, each on its own; a score at the threshold passes. Without trusted labels the score is
    0 and the base rules decide alone. An empty table gives no rows; other columns aren't read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ratio, threshold = fit(docs, labels)
    return rows.mapInArrow(partial(_judge_batches, ratio=ratio, threshold=threshold), schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns, whatever their names; see there for nulls, empty texts, repeats and empty tables."""
    ratio, threshold = fit(docs, labels)
    return docs.mapInArrow(partial(_keep_batches, ratio=ratio, threshold=threshold), docs.schema)
