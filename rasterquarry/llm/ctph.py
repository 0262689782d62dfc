"""Document fingerprints: context-triggered piecewise hashing, compared by edit distance."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: The rolling hash sees so many bytes; a signature has about LENGTH / 2 to LENGTH characters.
WINDOW, LENGTH = 7, 64
#: A signature keeps at most so many equal characters in a row.
RUN = 3
#: Signatures are alike only if they share a piece of at most so many characters, as unrelated ones share single characters by chance.
COMMON = 4
KEPT_POWERS = 1 << 20
_TABLE = np.random.default_rng(20).integers(0, 1 << 32, 256, np.uint32)
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _powers(_P, 1 << 14), _powers(_P_INVERSE, 1 << 14)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i for i < n, for the base and its inverse mod 2 ** 64; kept between texts up to a bound."""
    global _POWERS, _INVERSES
    if n > KEPT_POWERS:
        return _powers(_P, n), _powers(_P_INVERSE, n)
    if len(_POWERS) < n:
        _POWERS, _INVERSES = _powers(_P, min(2 * n, KEPT_POWERS)), _powers(_P_INVERSE, min(2 * n, KEPT_POWERS))
    return _POWERS[:n], _INVERSES[:n]


def _rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, a mixed hash of the WINDOW bytes up to it."""
    mapped = _TABLE[data]
    out = mapped.copy()
    for back in range(1, min(WINDOW, len(data))):
        shifted = mapped[:-back]
        out[back:] ^= (shifted << np.uint32(back * 4)) | (shifted >> np.uint32(32 - back * 4))
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(15)
    return out


class _Pieces:
    """A text's rolling hash and prefix sums, from which the signature at any block size follows."""

    def __init__(self, text: bytes):
        data = np.frombuffer(text, np.uint8)
        self.n = len(data)
        if self.n:
            power, self.inverse = _power_tables(self.n)
            self.roll = _rolling(data)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)])

    def signature(self, block: int) -> str:
        """A character for each piece; pieces end where the rolling hash has the block size's low bits all set."""
        if not self.n:
            return ""
        low = np.uint32(block - 1)
        ends = np.flatnonzero((self.roll & low) == low) + 1
        if not len(ends) or ends[-1] != self.n:
            ends = np.append(ends, self.n)
        starts = np.concatenate([[0], ends[:-1]])
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        h ^= h >> np.uint64(32)
        code = (h * np.uint64(_P)) >> np.uint64(58)
        if len(code) > RUN:
            same = code[1:] == code[:-1]
            run = same[RUN - 1 :].copy()
            for k in range(1, RUN):
                run &= same[RUN - 1 - k : len(same) - k]
            code = code[np.concatenate([np.ones(RUN, bool), ~run])]
        return _LETTERS[code.astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    """block:signature:at twice the block:at four times. Whole texts, equal texts alike; the empty text has `2:::`.

    The block is the least power of two, from 2, that gives about 32 to 64 pieces, so texts of like lengths have
    blocks in common. It is doubled while a signature is longer than four times LENGTH (boundaries come in runs).
    """
    p = _Pieces(text.encode("utf-8", "surrogatepass"))
    block = 2
    while block * LENGTH < p.n or len(p.signature(block)) > 4 * LENGTH and block < p.n:
        block *= 2
    return f"{block}:{p.signature(block)}:{p.signature(2 * block)}:{p.signature(4 * block)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    need = max(1, min(COMMON, len(a) // 3, len(b) // 3))
    pieces = {a[i : i + need] for i in range(len(a) - need + 1)}
    if not any(b[i : i + need] in pieces for i in range(len(b) - need + 1)):
        return 0.0
    return 2 * _common(a, b) / (len(a) + len(b))  # 1 - edits / (len(a) + len(b)), an edit adding or taking a character


def likeness(x: str, y: str) -> float:
    """0 to 1: the edit likeness of two fingerprints' signatures at the finest block size that both have; 0 if there is none, 1 if they are equal."""
    if x == y:
        return 1.0
    sizes = []
    for mark in (x, y):
        block, *signatures = mark.split(":")
        sizes.append({int(block) << i: s for i, s in enumerate(signatures)})
    both = sorted(sizes[0].keys() & sizes[1].keys())
    return _alike(sizes[0][both[0]], sizes[1][both[0]]) if both else 0.0


def edited(text: str, after: str) -> str:
    """text with its last half replaced by as much of the start of `after`."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


_COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _row(held, text, own):
    doc_id, before, mark = held
    changed = edited(before, text)
    new = fingerprint(changed) if changed != before else mark
    return doc_id, len(before), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), mark, new, likeness(mark, new), likeness(mark, own)


def _next_batches(batches):
    """Of a range's rows in order, each row's result, which needs the row after it; the first tail row ends the range."""
    held, done = None, False
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    for batch in batches:
        if done:
            continue
        rows = []
        for doc_id, text, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "__tail"))):
            own = fingerprint(text)
            if held is not None:
                rows.append(_row(held, text, own))
            held = (doc_id, text, own)
            if tail:
                done = True
                break
        columns = zip(*rows) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", *_COLUMNS])


def _deal_batches(batches, lows, nulls):
    """Each row to its range, and the first rows of a range also, as its tail, to the range before."""
    n = max(1, len(lows))
    for batch in batches:
        there = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
        ids = batch.column("doc_id").fill_null(0).to_numpy()
        own = np.where(there, np.searchsorted(lows, ids, side="right") - 1, 0)
        first = there & (ids == lows[own]) & ~((own == 0) & nulls) | ~there & nulls if len(lows) else ~there
        head = np.flatnonzero(first)
        at = np.concatenate([np.arange(len(ids)), head])
        slot = np.concatenate([own, (own[head] - 1) % n]).astype(np.int32)
        tail = (np.arange(len(at)) >= len(ids)).astype(np.int32)
        rows = batch.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), pa.array(slot), pa.array(tail)], names=["doc_id", "text", "__slot", "__tail"])


def fingerprints(docs: DataFrame, rows_in_range: int = 10_000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row a document.

    Documents are taken in ascending order of doc_id (an integer), null first and equal ids by text; the last is
    followed by the first, and a single one by itself. Null texts count as empty. No rows give no rows. Ids are
    range-partitioned, ids alone; the least id of each range is all that the driver learns. A range's rows and the
    first of the next go to one task, sorted: each text is shuffled once, and no task holds more than a batch.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    count = ids.count()
    n = max(1, min(-(-count // 200), max(-(-count // rows_in_range), 4 * spark.sparkContext.defaultParallelism)))
    ranges = ids.repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("r"))
    found = ranges.agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("null")).collect()  # a row a range
    lows = np.array(sorted({r.low for r in found if r.low is not None}), np.int64)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.mapInArrow(partial(_deal_batches, lows=lows, nulls=any(r.null for r in found)), "doc_id long, text string, __slot int, __tail int")
    dealt = dealt.repartitionById(max(1, len(lows)), F.col("__slot")).sortWithinPartitions("__tail", F.col("doc_id").asc_nulls_first(), "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("doc_id", "text", "__tail").mapInArrow(_next_batches, schema)
