"""Token counts: greedy longest-match word pieces by a trie with failure links and counts of popped tokens."""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import blocks, column, words

CONTINUES = "##"


class Automaton:
    """Counts a word's greedy pieces in one pass over its characters.

    The trie holds the vocabulary's first pieces under one root and its continuing pieces under another. Where a node
    has no child for the next character, its failure link leads to the node of what is left once the longest match is
    popped, with the number of tokens popped on the way known beforehand; none, if no piece matches. No piece is built.
    """

    def __init__(self, vocabulary):
        self.child: list[dict[str, int]] = [{}, {}]  # 0: first pieces, 1: continuing pieces
        ends = [False, False]
        for first, text in vocabulary:
            if not text:
                continue
            at = 0 if first else 1
            for c in text:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    ends.append(False)
                at = self.child[at][c]
            ends[at] = True
        n = len(self.child)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = [0, 1]
        for at in queue:  # breadth first: links of shorter strings are known
            for c, down in self.child[at].items():
                queue.append(down)
                if ends[down]:
                    self.fail[down], self.pops[down] = 1, 1
                    continue
                link, popped = self.fail[at], self.pops[at]
                while link >= 0 and c not in self.child[link]:
                    popped += self.pops[link]
                    link = self.fail[link]
                if link >= 0:
                    self.fail[down], self.pops[down] = self.child[link][c], popped

    def count(self, word: str) -> int:
        """The number of pieces; 0 if greedy longest match fails."""
        at, n, child, fail, pops = 0, 0, self.child, self.fail, self.pops
        for c in word:
            while c not in child[at]:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return 0
            at = child[at][c]
        while at > 1:  # what is left is popped to the end
            n += pops[at]
            at = fail[at]
            if at < 0:
                return 0
        return n


def vocabulary(path: str) -> list[tuple[bool, str]]:
    """The pieces of a vocabulary and whether they start a word: of a .model file those led by ▁, of a .txt file's lines those not led by ##."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        return [(p.startswith("▁"), p.removeprefix("▁")) for p in plain if p != "▁"]
    with open(path, encoding="utf-8") as lines:
        plain = [line.rstrip("\n") for line in lines]
    return [(False, p[len(CONTINUES) :]) if p.startswith(CONTINUES) and p != CONTINUES else (True, p) for p in plain if p]


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """Built once in each Python worker, from a file that every executor has."""
    return Automaton(vocabulary(path))


def _count_batches(batches, path):
    count = automaton(path).count
    for batch in batches:
        for part in blocks(batch):
            w = words(column(part))
            own = np.fromiter((count(x) for x in w.distinct.to_pylist()), np.int64, len(w.distinct))
            each = own[w.codes] if len(own) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(w.counts), pa.array(w.sums(np.maximum(each, 1))), pa.array(w.sums(each == 0))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for every row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text; a word that greedy longest match can't cover is one unknown
    token. Each distinct word of a block of text is counted once. Null and blank texts have no tokens. Repeated rows
    are counted each. No rows give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_count_batches, path=path), f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
