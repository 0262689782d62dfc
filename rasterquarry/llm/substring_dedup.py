"""Substring dedup: hash every run of consecutive sentences, and remove what a later document repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import own_names
from .textops import blocks, column, words

#: A run is the shortest one from a sentence on that has so many sentences and so many words.
RUN_SENTENCES, RUN_WORDS = 3, 24
#: Where so many words hold fewer whole sentences than a run has, they are a run too. It starts at a sentence, or at a
#: word whose hash is less than those of its neighbours on both sides, so that a passage gives the same runs whatever
#: stands around it.
LONG_WORDS, NEIGHBOURS = 24, 2
#: A sentence ends with a word that ends so, or at a line's end.
ENDINGS = b".!?"
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_NO_ID = -(1 << 63)
#: What tells documents apart: the id, and the text's hash, as ids may be null or repeated.
_KEY = ("id", "sub")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Runs:
    """The sentences and runs of a block of texts.

    word_text, word_at: each word's text and its first byte in the block; sentence: its sentence's number in the block.
    Run r starts at word first[r], ends before last[r], belongs to text[r] and has the 64-bit hash hash[r] of its words.
    """

    def __init__(self, texts: pa.Array):
        n = len(texts)
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        self.offsets = at - at[0]
        w = words(texts)
        hashes, of = w.hashes(), w.text_of
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        closing = np.zeros(256, bool)
        closing[list(ENDINGS)] = True
        solid = ~space[self.data]
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        edges = self.offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(solid))]
        begins[edges] = solid[edges]
        stops[edges - 1] = solid[edges - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        assert len(starts) == len(w.codes)
        lines = np.concatenate([[0], np.cumsum(self.data == 10)])
        final = closing[self.data[ends - 1]] if len(ends) else np.zeros(0, bool)
        if len(starts):
            final[:-1] |= (lines[starts[1:]] > lines[ends[:-1]]) | (of[1:] != of[:-1])
            final[-1] = True
        until = np.flatnonzero(final) + 1  # the word after each sentence
        begin = np.concatenate([[0], until[:-1]]) if len(until) else until
        self.word_text, self.word_at, self.sentence = of, starts, np.cumsum(final) - final
        powers, inverse = _powers(_P, len(starts)), _powers(_P_INVERSE, len(starts))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers[: len(hashes)])])
        first = np.arange(len(until))
        last = np.maximum(first + RUN_SENTENCES - 1, np.searchsorted(until, begin + RUN_WORDS))
        inside = last < len(until)
        first, last = begin[first[inside]], until[last[inside]]
        opening = np.zeros(len(starts), bool)
        opening[begin] = True
        anchor = opening.copy()
        if len(starts) > 2 * NEIGHBOURS:
            inner = slice(NEIGHBOURS, len(starts) - NEIGHBOURS)
            low = of[: len(starts) - 2 * NEIGHBOURS] == of[2 * NEIGHBOURS :]
            for k in (k for k in range(2 * NEIGHBOURS + 1) if k != NEIGHBOURS):
                low &= hashes[inner] < hashes[k : len(starts) - 2 * NEIGHBOURS + k]
            anchor[inner] |= low
        long = np.flatnonzero(anchor[: max(0, len(starts) - LONG_WORDS + 1)])
        ended = np.concatenate([[0], np.cumsum(final)])
        long = long[ended[long + LONG_WORDS] - ended[long] - ~opening[long] < RUN_SENTENCES]
        first, last = np.concatenate([first, long]), np.concatenate([last, long + LONG_WORDS])
        inside = of[first] == of[last - 1]
        a, b = self.first, self.last = first[inside], last[inside]
        self.text = of[a]
        h = (sums[b] - sums[a]) * inverse[a]
        h ^= h >> np.uint64(31)
        self.hash = (h * np.uint64(0xD6E8FEB86659FD93) + (b - a).astype(np.uint64)).view(np.int64)


def _documents(part: pa.RecordBatch, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return part.column("id").to_numpy()[text], part.column("sub").to_numpy()[text]


def _differs(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before; the first does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _run_batches(batches):
    """(h, id, sub): each run's documents in a block, each once; sub's lowest bit tells if an earlier document of the block has the run.

    Rows go out in the order of the texts, where ids repeat, which packs them well.
    """
    for batch in batches:
        for part in blocks(batch):
            runs = Runs(column(part))
            ids, subs = _documents(part, runs.text)
            order = np.lexsort((subs, ids, runs.hash))
            order = order[_differs(runs.hash[order], ids[order], subs[order])]
            known = np.zeros(len(ids), np.int64)
            known[order] = ~_differs(runs.hash[order])
            at = np.sort(order)
            yield pa.RecordBatch.from_arrays([pa.array(runs.hash[at]), pa.array(ids[at]), pa.array(subs[at] | known[at])], names=["h", "id", "sub"])


def _later_batches(batches):
    """Of rows sorted by sub's lowest bit, h, id, sub: those that are known to be later, and of others those after the run's least document."""
    before = None  # h, id and sub of the run at hand
    for batch in batches:
        if not batch.num_rows:
            continue
        h, ids, subs = (batch.column(c).to_numpy() for c in ("h", "id", "sub"))
        known = (subs & 1).astype(bool)
        lead = _differs(h, known)
        if not known[0] and before is not None and h[0] == before[0]:
            lead[0] = False
        at = np.maximum.accumulate(np.where(lead, np.arange(len(h)), -1))
        least = [np.where(at >= 0, c[np.maximum(at, 0)], x) for c, x in zip((ids, subs), before[1:] if before else (0, 0))]
        later = known | (ids > least[0]) | (ids == least[0]) & (subs > least[1])
        if not known[-1]:
            before = h[-1], least[0][-1], least[1][-1]
        yield pa.RecordBatch.from_arrays([pa.array(c[later]) for c in (ids, subs & ~1, h)], names=["id", "sub", "h"])


def _keyed(docs: DataFrame) -> list:
    text = F.col("text").cast("string")
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(-2).alias("sub"), text.alias("text")]


def repeats(docs: DataFrame) -> DataFrame:
    """(id, sub, hashes): the runs of each document that an earlier document has too, by id (null first), then the text's hash.

    Every block of texts first settles what it can alone, so a run that a third of all documents share sends one row
    a block to the task that holds it; that task reads its rows in order and holds none. What a block has settled is
    dealt out by document. Texts without an id, or with one id, are documents of their own unless they are equal, so a
    list has one document's runs.
    """
    runs = docs.select(*_keyed(docs)).mapInArrow(_run_batches, "h long, id long, sub long")
    known = F.col("sub").bitwiseAND(1)
    dealt = runs.repartition(F.when(known == 1, F.xxhash64("id", "sub", "h")).otherwise(F.col("h"))).sortWithinPartitions(known, "h", *_KEY)
    return dealt.mapInArrow(_later_batches, "id long, sub long, h long").groupBy(*_KEY).agg(F.collect_list("h").alias("hashes"))


def _keys(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) + text.astype(np.uint64) * np.uint64(_P)) * np.uint64(0xBF58476D1CE4E5B9)


def _clean_batches(batches):
    for batch in batches:
        for part in blocks(batch):
            runs, texts = Runs(column(part)), column(part)
            lists = part.column("__hashes")
            where = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
            gone, own = _keys(where, lists.flatten().to_numpy()), _keys(runs.text, runs.hash)
            order = np.lexsort((runs.first, runs.hash, runs.text))
            again = np.zeros(len(own), bool)
            again[order[1:]] = (runs.text[order][1:] == runs.text[order][:-1]) & (runs.hash[order][1:] == runs.hash[order][:-1])
            out = again | np.isin(own, gone)
            delta = np.zeros(len(runs.word_at) + 1, np.int64)
            np.add.at(delta, runs.first[out], 1)
            np.add.at(delta, runs.last[out], -1)
            removed = np.cumsum(delta[:-1]) > 0
            opens = np.flatnonzero(np.diff(runs.sentence, prepend=-1))
            robbed = np.zeros(len(opens), bool)
            robbed[runs.sentence[removed]] = True
            n = np.bincount(runs.word_text[opens], minlength=len(part))
            cut = np.bincount(runs.word_text[opens[robbed]], minlength=len(part))
            words_left = np.bincount(runs.word_text[~removed], minlength=len(part))
            ends = np.minimum(np.append(runs.word_at, len(runs.data))[1:], runs.offsets[runs.word_text + 1])
            mark = np.zeros(len(runs.data) + 1, np.int64)
            np.add.at(mark, runs.word_at[removed], 1)
            np.add.at(mark, ends[removed], -1)
            kept = np.cumsum(mark)[:-1] == 0
            left = np.concatenate([[0], np.cumsum(kept)])[runs.offsets].astype(np.int32)
            text = pa.StringArray.from_buffers(len(part), pa.py_buffer(left.tobytes()), pa.py_buffer(runs.data[kept].tobytes()))
            arrays = [text if f.name == "text" else part.column(f.name) for f in part.schema if f.name != "__hashes"]
            names = [f.name for f in part.schema if f.name != "__hashes"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n), pa.array(cut), pa.array(words_left)], names=[*names, "__n", "__cut", "__left"])


def cleaned(docs: DataFrame) -> DataFrame:
    """docs' rows and columns with the text that is left, and __n, __cut, __left: its sentences, how many of them lost words, and the words left.

    A word goes if it is in a run that an earlier document has (see repeats), or that the same text has before. Runs are
    of whole sentences or, where sentences are long, of LONG_WORDS words, which can take a part of a sentence. So the
    first of equal passages stays, and what goes is left somewhere. Null texts become empty; they and texts shorter than
    a run stay as they are; texts of any length are read whole. Rows of one id and text count as one document and don't
    rob each other. A null id comes before all others. Words count, not the space between them. No rows give no rows.
    """
    gone = repeats(docs).select(F.col("id").alias("__id"), F.col("sub").alias("__sub"), F.col("hashes").alias("__hashes")).hint("shuffle_hash")
    own = _keyed(docs)
    rows = docs.join(gone, (own[0] == F.col("__id")) & (own[1] == F.col("__sub")), "left")
    none = F.array().cast("array<bigint>")
    rows = rows.select(*(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns), F.coalesce("__hashes", none).alias("__hashes"))
    fields = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)
    return rows.mapInArrow(_clean_batches, f"{fields}, __n long, __cut long, __left long")


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed) for every row of docs; other columns aren't read. See cleaned()."""
    return cleaned(docs.select("doc_id", "text")).select("doc_id", "text", F.col("__n").alias("n_sentences"), F.col("__cut").alias("n_removed"))


def keep_new(docs: DataFrame) -> DataFrame:
    """docs' columns with the text that is left (n_chars its length); a document of which no word is left goes.

    Nulls, empty and very long texts, ties, repeated rows and an empty table: see cleaned(). A text without words stays.
    """
    return own_names(docs, _keep_new)


def _keep_new(docs: DataFrame) -> DataFrame:
    out = cleaned(docs).where("__cut = 0 OR __left > 0")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cut") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))
