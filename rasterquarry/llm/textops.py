"""Words of Arrow text columns, in blocks of bounded memory."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Text bytes handled at once; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch that hold about `most` bytes of text each; nulls count as empty."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
    give_back()


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that returns free memory to the system; nothing elsewhere."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def give_back() -> None:
    """Returns what a batch needed and no longer does: a worker lives through many stages, beside others on its machine."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A text column as plain strings, null read as empty."""
    return pc.fill_null(batch.column(name).cast(pa.string()), "")


@dataclass
class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of several texts: words of text i are at starts[i]:starts[i + 1]."""

    starts: np.ndarray
    codes: np.ndarray
    distinct: pa.Array

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, computed once for each distinct one."""
        h = xxhash.xxh3_64_intdigest
        own = np.fromiter((h(w) for w in self.distinct.cast(pa.binary()).to_pylist()), np.uint64, len(self.distinct))
        return own[self.codes] if len(own) else np.zeros(0, np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, the sum of a value of each word."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.starts[1:]] - total[self.starts[:-1]]


def flat_lists(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and the flattened values of a list array without nulls."""
    offsets = lists.offsets.to_numpy()
    return offsets - offsets[0], lists.flatten()


def words(texts: pa.Array) -> Words:
    offsets, flat = flat_lists(pc.ascii_split_whitespace(texts))
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # what stands before leading and after trailing space
    kept = np.concatenate([[0], np.cumsum(there)])
    coded = flat.filter(pa.array(there)).dictionary_encode()
    return Words(kept[offsets], coded.indices.to_numpy(), coded.dictionary)


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive starts, empty ranges included."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]
