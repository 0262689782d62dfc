"""Byte-level BPE by recursive DuckDB queries in each partition: position rows, a merge table, ordered aggregation back."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache, partial

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import blocks, column

#: Bytes of words encoded by one query, though one word at least; bytes of words and ids that a worker remembers, and what an entry takes besides.
QUERY_BYTES, REMEMBERED_BYTES, ENTRY_BYTES = 1 << 18, 48 << 20, 160
#: Bytes of text encoded at once, though one text at least.
TEXT_BYTES = 1 << 20
#: Ids decoded by one query; a longer document takes several, whose bytes follow each other.
QUERY_IDS = 200_000
_LETTER, _DIGIT, _SPACE, _OTHER = range(4)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The class of each code point that the pattern tells apart: \\p{L}, \\p{N}, \\s, any other."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if a < 0xD800 <= b:
                kinds[a:0xD800] = kind
                a = 0xE000
            kinds[a : b + 1] = kind
    return kinds


def _cuts(texts: list[str]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """The pieces of texts: where each text's start, all bytes, and where the pieces start and the last ends in them."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    joined = "".join(texts)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(chars)
    if not n:
        return np.zeros(len(texts) + 1, np.int64), b"", np.zeros(1, np.int64)
    kind = _kinds()[chars]
    start = np.ones(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[bounds] = True
    at = np.flatnonzero(start[:-1])  # runs
    ends = np.append(at[1:], n)
    k = kind[at]
    text_first = np.zeros(n + 1, bool)
    text_first[bounds] = True
    blank = k == _SPACE
    followed = blank & ~text_first[ends]  # white space that the text goes on after
    split = np.flatnonzero(followed & (ends - at > 1))
    start[ends[split] - 1] = True
    joins = np.flatnonzero(followed & (chars[np.maximum(ends, 1) - 1] == 32))
    start[ends[joins]] = False
    alone = np.flatnonzero((k == _OTHER) & (ends - at == 1) & (chars[at] == 39) & start[at] & ~text_first[ends])
    for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
        q = at[alone]
        hit = q + len(ending) < n
        for j, c in enumerate(ending, 1):
            hit &= chars[np.minimum(q + j, n - 1)] == ord(c)
            if j > 1:
                hit &= ~text_first[np.minimum(q + j, n)]
        start[q[hit] + 1] = False
        start[q[hit] + len(ending) + 1] = True
        alone = alone[~hit]
    begin = np.flatnonzero(start[:n])
    width = 1 + (chars >= 0x80).astype(np.int32) + (chars >= 0x800) + (chars >= 0x10000)
    byte_at = np.concatenate([[0], np.cumsum(width)])
    return np.searchsorted(begin, bounds), joined.encode(), np.append(byte_at[begin], byte_at[n])


def _coded(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    flat = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data)])
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Cuts texts as the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+` does.

    Returns where each text's pieces start, each piece's code, and the distinct pieces as bytes. Pieces are runs of one
    class; a space goes to the run after it; of a longer run of white space the last character stands alone or goes
    with what follows; an apostrophe that no space leads takes its ending from the letters after it.
    """
    starts, data, offsets = _cuts(texts)
    return starts, *_coded(data, offsets)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


#: One step of all words, which are strings of a character a token: their pairs by position join the merge table, and
#: each word contracts its leftmost pair of least rank. The pair's other occurrences would come next, from the left,
#: unless a contraction makes a pair of a lower rank, so they are contracted in the same step if the word has none of the
#: pair's `now` before it and none of its `later` after it. A word stays as it is once no pair of it is in the table; the
#: keyed recursion keeps a word's last state only.
_CONTRACT = """
WITH RECURSIVE steps(w, toks) USING KEY (w) AS (
  SELECT w, toks FROM words_in
  UNION
  SELECT s.w, CASE WHEN m.once OR len(list_filter(m.now, lambda x: contains(s.toks, x))) > 0
                     OR len(m.later) > 0 AND len(list_filter(m.later, lambda x: contains(replace(s.toks, m.pair, m.merged), x))) > 0
                   THEN s.toks[:q.pos - 1] || m.merged || s.toks[q.pos + 2:] ELSE replace(s.toks, m.pair, m.merged) END
  FROM steps s JOIN (
    SELECT p.w, arg_min({'i': m.i, 'pos': pos}, (m.t::BIGINT << 31) | pos) AS q
    FROM (
      SELECT w, pos, l || r AS pair
      FROM (SELECT w, unnest(range(1, len(c))) AS pos, unnest(c[:-2]) AS l, unnest(c[2:]) AS r FROM (SELECT w, string_split(toks, '') AS c FROM steps))) p
    JOIN merges m ON m.pair = p.pair GROUP BY p.w) b ON s.w = b.w
  JOIN merges m ON m.i = q.i)
SELECT toks FROM steps ORDER BY w
"""
_DECODE = "SELECT d, string_agg(v.piece, '' ORDER BY pos) AS back FROM ids_in JOIN vocabulary v ON v.id = ids_in.id GROUP BY d ORDER BY d"


def _char(token: int) -> str:
    """A token's character: no NUL, no surrogate."""
    return chr(token + 1 if token + 1 < 0xD800 else token + 0x801)


def _tokens(words: str) -> np.ndarray:
    chars = np.frombuffer(words.encode("utf-32-le"), "<u4")
    return np.where(chars < 0xD800, chars - 1, chars - 0x801).astype("<u4")


def _merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(i, pair, t, merged, once, now, later): every pair of tokens whose bytes are a token, and when its occurrences don't go in one step.

    once: another pair that makes t can overlap this one, so occurrences go one by one. now, later: what a word holds
    if contracting one occurrence makes a pair that ranks lower than t, as it has the others before or after that.
    """
    found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    parts: dict[int, list[tuple[int, int]]] = {}
    before: dict[int, list[str]] = {}
    after: dict[int, list[str]] = {}
    for l, r, t in found:
        parts.setdefault(t, []).append((l, r))
        if t < l:
            after.setdefault(l, []).append(_char(r))
        if t < r:
            before.setdefault(r, []).append(_char(l))
    overlap = {t for t, p in parts.items() if any(a[1] == b[0] for a in p for b in p if a != b)}
    pair = [_char(l) + _char(r) for l, r, _ in found]
    texts = pa.list_(pa.string())
    return pa.table({
        "i": np.arange(len(found), dtype=np.int32),
        "pair": pair,
        "t": pa.array([t for _, _, t in found], pa.int32()),
        "merged": [_char(t) for _, _, t in found],
        "once": [t in overlap for _, _, t in found],
        "now": pa.array([[p + y for y in after.get(t, ())] for p, (_, _, t) in zip(pair, found)], texts),
        "later": pa.array([[x + _char(t) for x in before.get(t, ())] + [_char(t) + y for y in after.get(t, ())] for _, _, t in found], texts),
    })


class Coder:
    """A worker's DuckDB with the merge table and the vocabulary (id, piece), and the words it has encoded."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.bytes_char = np.array([ord(_char(ranks[bytes([b])])) for b in range(256)], "<u4")
        #: Byte pairs that some token holds: no merge ever crosses any other.
        self.joined = np.zeros(1 << 16, bool)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                self.joined[a << 8 | b] = True
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""})
        # a byte is a character of the same number, so that strings carry any bytes
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "piece": [t.decode("latin-1") for t in ranks]})
        for name, rows in (("merges", _merge_table(ranks)), ("vocabulary", vocabulary)):
            self.db.register("rows_in", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_in")
            self.db.unregister("rows_in")
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def _query(self, words: list[bytes]) -> None:
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]).tolist()
        chars = self.bytes_char[np.frombuffer(b"".join(words), np.uint8)].tobytes().decode("utf-32-le")
        self.db.register("words_in", pa.table({"w": np.arange(len(words), dtype=np.int32), "toks": [chars[a:b] for a, b in zip(at, at[1:])]}))
        found = self.db.sql(_CONTRACT).to_arrow_table()["toks"].to_pylist()
        self.db.unregister("words_in")
        flat, ends = _tokens("".join(found)).tobytes(), (4 * np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))).tolist()
        self.known.update(zip(words, (flat[a:b] for a, b in zip([0, *ends], ends))))
        self.held += at[-1] + len(flat) + ENTRY_BYTES * len(words)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Each distinct word's ids as little-endian 32-bit integers."""
        if self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        new = [w for w in words if w not in self.known]
        part = np.cumsum(np.fromiter(map(len, new), np.int64, len(new))) // QUERY_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(new)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                self._query(new[a:b])
        return [self.known[w] for w in words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text: its pieces, cut further where no token spans two bytes, each by itself."""
        starts, data, offsets = _cuts(texts)
        raw = np.frombuffer(data, np.uint8)
        start = np.zeros(len(raw) + 1, bool)
        start[1:-1] = ~self.joined[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
        start[offsets] = True
        finer = np.flatnonzero(start)
        starts = np.searchsorted(finer, offsets[starts])
        codes, distinct = _coded(data, finer)
        own = self.encode_words(distinct.to_pylist())
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat = np.frombuffer(b"".join(own), "<u4")
        n = sizes[codes] if len(sizes) else np.zeros(0, np.int64)
        begins = np.concatenate([[0], np.cumsum(n)])
        first = (np.cumsum(sizes) - sizes)[codes] if len(sizes) else n
        ids = flat[np.repeat(first - begins[:-1], n) + np.arange(begins[-1])]
        at = begins[starts]
        return [ids[a:b] for a, b in zip(at[:-1], at[1:])]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids: its pieces in order of position."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        out = [b""] * len(ids)
        for at in range(0, len(flat), QUERY_IDS):
            part = slice(at, at + QUERY_IDS)
            self.db.register("ids_in", pa.table({"d": owner[part], "pos": np.arange(len(flat[part]), dtype=np.int32), "id": flat[part]}))
            found = self.db.sql(_DECODE).to_arrow_table()
            self.db.unregister("ids_in")
            for d, back in zip(found["d"].to_pylist(), found["back"].to_pylist()):
                out[d] += back.encode("latin-1")
        return out


@lru_cache(maxsize=1)
def coder(path: str) -> Coder:
    return Coder(path)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int64)))


def _encode_batches(batches, path):
    for batch in batches:
        for part in blocks(batch, most=TEXT_BYTES):
            lists = _lists(coder(path).encode(column(part).to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<long>) for every row of docs: the whole text's tokens by the ranks of a tiktoken file.

    Null and empty texts have none. Repeated rows and ids are encoded each; a null doc_id stays null. A text of any
    length is encoded whole, and a word of any length by the same steps. Equal ranks go from the left. No rows give no
    rows; columns beside doc_id and text aren't read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_encode_batches, path=path), f"doc_id {kind}, ids array<bigint>")


def _decode_batches(batches, path):
    for batch in batches:
        lists = batch.column("ids")
        flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
        back = coder(path).decode([flat[a:b] for a, b in zip(at[:-1], at[1:])])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(back, pa.binary())], names=["doc_id", "content"])


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, content binary) for rows (doc_id, ids). A null list counts as empty; an id that the file lacks adds nothing."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    ids = F.coalesce("ids", F.array().cast("array<bigint>")).alias("ids")
    return rows.select("doc_id", ids).mapInArrow(partial(_decode_batches, path=path), f"doc_id {kind}, content binary")


def _round_trip_batches(batches, path, with_ids, more):
    for batch in batches:
        for part in blocks(batch, most=TEXT_BYTES):
            ids = coder(path).encode(column(part).to_pylist())
            back = coder(path).decode(ids)
            out = {
                "doc_id": part.column("doc_id"),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back]),
            }
            if with_ids:
                out["ids"] = _lists(ids)
            yield pa.RecordBatch.from_pydict(out | {c: part.column(c) for c in more})


def round_trip(docs: DataFrame, path: str, with_ids: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs, on demand ids and `more` of docs' columns; encode and decode in one pass over the texts.

    Null and empty texts have no tokens and decode to nothing. Repeated rows and ids stay rows, a null doc_id stays
    null, texts and words of any length are taken whole, and no rows give no rows. Other columns aren't read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *more)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"doc_id {kind['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * with_ids + "".join(f", {c} {kind[c]}" for c in more)
    return rows.mapInArrow(partial(_round_trip_batches, path=path, with_ids=with_ids, more=more), schema)
