"""Counts over whole texts, for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textops import Words, flat_lists, words

WINDOW_WORDS = 8
_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _SYMBOL, _BAR, _SHOUT, _STOP, _COMMA, _MARK, _INNER, _WIDE = range(1, 14)


def _classes() -> np.ndarray:
    table = np.full(256, _MARK, np.int64)
    table[0x80:0xC0], table[0xC0:] = _INNER, _WIDE
    for chars, kind in ((range(97, 123), _LOWER), (range(65, 91), _UPPER), (range(48, 58), _DIGIT), ((9, 11, 12, 13, 32), _SPACE), ((10,), _LINE), (b"#*$%&<>", _SYMBOL), (b"|", _BAR), (b"!", _SHOUT), (b".?", _STOP), (b",;:", _COMMA)):
        table[list(chars)] = kind
    return table


_CLASS = _classes()


def byte_classes(texts: pa.Array) -> np.ndarray:
    """(texts, 16): how many bytes of each class a text has."""
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return np.bincount(np.repeat(np.arange(n) * 16, np.diff(at)) + _CLASS[data], minlength=16 * n).reshape(n, 16)


def repeat_words(w: Words, hashes: np.ndarray, window: int = WINDOW_WORDS) -> np.ndarray:
    """Per text, the words inside windows of `window` words that the text has twice or more."""
    n = len(w.codes)
    if n < window:
        return np.zeros(len(w.starts) - 1, np.int64)
    rolled = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - window + 1 + k]
        rolled ^= rolled >> np.uint64(29)
    of = w.text_of
    whole = np.flatnonzero(of[: n - window + 1] == of[window - 1 :])
    key = (rolled[whole] ^ (of[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(whole), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, whole[twice], 1)
    np.add.at(delta, whole[twice] + window, -1)
    return w.sums(np.cumsum(delta[:-1]) > 0)


def duplicate_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per text: its lines with a word, and those of them that equal an earlier line."""
    at, lines = flat_lists(pc.split_pattern(texts, "\n"))
    coded = lines.dictionary_encode()
    word = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy()
    real = word[codes] if len(word) else np.zeros(0, bool)
    of = np.repeat(np.arange(len(texts)), np.diff(at))[real]
    n = np.bincount(of, minlength=len(texts))
    distinct = np.unique(of * max(1, len(word)) + codes[real]) // max(1, len(word))
    return n, n - np.bincount(distinct, minlength=len(texts))


def measure(texts: pa.Array) -> tuple[Words, np.ndarray, dict[str, np.ndarray]]:
    """The words, their hashes, and per text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, classes."""
    w = words(texts)
    hashes = w.hashes()
    kinds = byte_classes(texts)
    length = pc.utf8_length(w.distinct).to_numpy().astype(np.int64)
    lines, dup = duplicate_lines(texts)
    return w, hashes, {
        "n_words": w.counts.astype(np.int64),
        "word_chars": w.sums(length[w.codes]) if len(length) else np.zeros(len(texts), np.int64),
        "n_symbols": kinds[:, _SYMBOL] + kinds[:, _BAR],
        "n_lines": lines,
        "n_dup_lines": dup,
        "n_repeat_words": repeat_words(w, hashes),
        "classes": kinds,
    }
