"""SimHash near-dedup by multi-index hashing over the halves of 64-bit fingerprints."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components, forest
from .store import cut, own_names, spread_join
from .textops import blocks

SHINGLE_WORDS, HASH_SEED, MAX_BITS = 4, 42, 4
#: A table bucket of up to so many fingerprints is verified pair by pair, a larger one along chains of common midpoints.
#: A bucket of unrelated fingerprints reaches that size at some 3 * 10^10 of them; beyond, it is one of many near copies.
PAIRED = 256
#: Verified links that a task holds before it thins them out.
LINKS_HELD = 1 << 17
#: Distinct fingerprints whose keys a task lists; a fingerprint has 66 keys.
FINGERPRINTS_IN_TASK = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOW = np.uint64(0xFFFFFFFF)


def _fingerprints(texts: list[bytes | None], n: int = SHINGLE_WORDS, seed: int = HASH_SEED) -> np.ndarray:
    """The SimHash of each text; 0 without words."""
    hashed, counts, h = [], np.zeros(len(texts), np.int64), xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        found = text.translate(_LOWER).split() if text else ()
        if not found:
            continue
        line = b" ".join(found)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        if len(found) > n:
            starts, ends = starts[: 1 - n], ends[n - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        hashed += [h(line[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())]
        counts[i] = len(starts)
    full = np.flatnonzero(counts)
    out = np.zeros(len(texts), np.uint64)
    if len(full):
        bits = np.unpackbits(np.array(hashed, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(counts[full])[:-1]]), axis=0, dtype=np.int64)
        out[full] = np.packbits(ones * 2 > counts[full][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _fingerprint_batches(batches):
    for batch in batches:
        for part in blocks(batch, most=1 << 20):  # a shingle takes some 100 bytes here
            out = _fingerprints(part.column("text").cast(pa.binary()).to_pylist())
            kept = [c for c in part.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(out.view(np.int64))], names=[*kept, "fp"])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, more, fp): the whole text's SimHash, a long with the fingerprint's bits. Null and blank texts have 0."""
    rows = docs.select("doc_id", *more, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(_fingerprint_batches, f"{fields}, fp long")


def _halves(fp: np.ndarray, half: np.ndarray | int) -> np.ndarray:
    return np.where(np.asarray(half) == 0, fp >> np.uint64(32), fp & _LOW)


def _ball(bits: int) -> np.ndarray:
    """The 32-bit masks of `bits` set bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(32), bits)], np.uint64)


def _probe_batches(batches):
    """(k, fp): for each half of a fingerprint, the 33 keys within one bit of it; k's bit 32 tells the half."""
    near = np.concatenate([_ball(0), _ball(1)])
    for batch in batches:
        all_fp = batch.column("fp").to_numpy().view(np.uint64)
        for at in range(0, len(all_fp), 20_000):
            fp = all_fp[at : at + 20_000]
            keys = np.concatenate([(_halves(fp, s)[:, None] ^ near) | np.uint64(s << 32) for s in (0, 1)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, keys.shape[1]).view(np.int64))], names=["k", "fp"])


def _bucket_batches(batches):
    """Of rows sorted by k and fp: verified links (k null, a, b) inside small buckets, (k, a, null) for each member of a large one.

    Every pair of a small bucket is compared over all 64 bits; of the links of the buckets at hand only a forest with
    the same components goes out, so a bucket sends fewer rows than it has members. A pair meets in two buckets
    or, with an equal half, in 33; it is taken in the least bucket or the half's own. A bucket is held until more than
    PAIRED rows of it came; from then on its rows pass through.
    """
    schema = pa.schema([("k", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    held_k, held_fp, large = np.zeros(0, np.int64), np.zeros(0, np.int64), None

    def out(k, fp):
        ends = np.flatnonzero(np.append(k[1:] != k[:-1], True)) + 1
        sizes = np.diff(np.concatenate([[0], ends]))
        many = np.repeat(sizes > PAIRED, sizes) | (k == large if large is not None else False)
        links, held_links = [(np.zeros(0, np.int64),) * 2], 0
        u, half = fp.view(np.uint64), (k >> 32) & 1
        i, d = np.flatnonzero(~many), 0
        while len(i):
            d += 1
            i = i[i + d < len(k)]
            i = i[k[i] == k[i + d]]
            x, y = u[i], u[i + d]
            hx, hy = _halves(x, half[i]), _halves(y, half[i])
            key, apart = k[i].view(np.uint64) & _LOW, np.bitwise_count(hx ^ hy)
            other = (np.minimum(hx, hy) == key) | (apart == 2) & (key < (hx ^ hy ^ key))
            mine = np.where(apart == 0, key == hx, other)
            good = i[mine & (np.bitwise_count(x ^ y) <= MAX_BITS)]
            links.append((fp[good], fp[good + d]))
            held_links += len(good)
            if held_links > LINKS_HELD:
                links = [forest(*(np.concatenate(x) for x in zip(*links)))]
                held_links = len(links[0][0])
        one, other = forest(*(np.concatenate(x) for x in zip(*links)))
        row = np.flatnonzero(many)
        n, total = len(row), len(row) + len(one)
        linked = np.arange(total) >= n
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([k[row], np.zeros(len(one), np.int64)]), mask=linked),
            pa.array(np.concatenate([fp[row], one])),
            pa.array(np.concatenate([np.zeros(n, np.int64), other]), mask=~linked),
        ], schema=schema)

    for batch in batches:
        k = np.concatenate([held_k, batch.column("k").to_numpy()])
        fp = np.concatenate([held_fp, batch.column("fp").to_numpy()])
        if not len(k):
            continue
        last = np.flatnonzero(k != k[-1])
        cut_at = last[-1] + 1 if len(last) else 0
        if len(k) - cut_at > PAIRED or k[-1] == large:
            yield out(k, fp)
            large, held_k, held_fp = k[-1], k[:0], fp[:0]
        else:
            if cut_at:
                yield out(k[:cut_at], fp[:cut_at])
            held_k, held_fp = k[cut_at:], fp[cut_at:]
    if len(held_k):
        yield out(held_k, held_fp)


def _midpoint_batches(batches):
    """(z, fp) for members of large buckets: the points whose one half is the bucket's key, within two bits of fp.

    Two fingerprints within four bits share such a point in the bucket that the pair belongs to, and those that share
    one are within four bits: a large bucket is linked whole by at most 529 rows a member and no pairs.
    """
    near = {0: np.concatenate([_ball(0), _ball(1), _ball(2)]), 1: np.concatenate([_ball(0), _ball(1)])}
    for batch in batches:
        k, fp = batch.column("k").to_numpy(), batch.column("a").to_numpy().view(np.uint64)
        half, key = (k >> 32) & 1, k.view(np.uint64) & _LOW
        for s in (0, 1):
            for off, masks in near.items():
                mine = np.flatnonzero((half == s) & (np.bitwise_count(_halves(fp, s) ^ key) == off))
                for at in range(0, len(mine), 2_000):
                    i = mine[at : at + 2_000]
                    rest = _halves(fp[i], 1 - s)[:, None] ^ masks
                    z = (key[i][:, None] << np.uint64(32)) | rest if s == 0 else (rest << np.uint64(32)) | key[i][:, None]
                    yield pa.RecordBatch.from_arrays([pa.array(z.ravel().view(np.int64)), pa.array(np.repeat(fp[i], len(masks)).view(np.int64))], names=["z", "fp"])


def _chain_batches(batches):
    """Of rows sorted by z and fp: a forest of the links of each row's fingerprint to the one before it at the same z, whole distances verified."""
    z0, f0 = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        z, f = np.concatenate([z0, batch.column("z").to_numpy()]), np.concatenate([f0, batch.column("fp").to_numpy()])
        near = np.bitwise_count(f.view(np.uint64)[1:] ^ f.view(np.uint64)[:-1]) <= MAX_BITS
        same = np.flatnonzero((z[1:] == z[:-1]) & (f[1:] != f[:-1]) & near)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(f[same], f[same + 1])], names=["a", "b"])
        z0, f0 = z[-1:], f[-1:]


def _sorted_by(df: DataFrame, key: str, *then: str) -> DataFrame:
    return df.repartition(F.col(key)).sortWithinPartitions(key, *then)


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints within four bits; nodes: distinct fp.

    If two fingerprints differ in four bits or fewer, one half differs in two or fewer, so the 33 keys within one bit
    of that half meet. Every pair that meets in a bucket is verified over all 64 bits. In a bucket of more than PAIRED
    fingerprints, where all pairs would grow with the square of a group of near copies, those that share a point within
    two bits of both are compared in a row along that point: any two at it are within four bits, so none is missed.
    """
    spark = nodes.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, -(-nodes.count() // FINGERPRINTS_IN_TASK))
    probes = _sorted_by(nodes.select("fp").repartition(n, "fp").mapInArrow(_probe_batches, "k long, fp long"), "k", "fp")
    found = cut(probes.mapInArrow(_bucket_batches, "k long, a long, b long"))
    large = found.where("k IS NOT NULL").select("k", "a").distinct()
    half = F.when(F.shiftright("k", 32) == 0, F.shiftrightunsigned("a", 32)).otherwise(F.col("a").bitwiseAND(0xFFFFFFFF))
    key = F.col("k").bitwiseAND(0xFFFFFFFF)
    # a bucket whose members all have one half, and not its key, holds no pair of its own
    live = large.groupBy("k").agg(F.min(half).alias("lo"), F.max(half).alias("hi")).where((F.col("lo") != F.col("hi")) | (F.col("lo") == key)).select("k", F.lit(True).alias("live"))
    own = spread_join(cut(large), live, "k").where("live").select("k", "a")
    points = own.repartition(n, "a").mapInArrow(_midpoint_batches, "z long, fp long")
    chains = _sorted_by(points, "z", "fp").mapInArrow(_chain_batches, "a long, b long")
    return found.where("k IS NULL").select("a", "b").unionByName(chains)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Texts are lower-cased in A-Z, cut into words and hashed as shingles of four words (XXH64, seed 42); a fingerprint
    bit is set if it is in more than half of them. Fingerprints within four bits link; component_id is the least doc_id
    reachable. Null, empty and blank texts have the fingerprint 0 and link like any other. Repeated rows stay rows of
    one component; texts of any length are read whole. A null doc_id stays null and names a component only if no other
    id is in it. No rows give no rows. Only distinct fingerprints are searched: copies meet in the sums before the
    shuffle, and neither a fingerprint nor a component that has a large part of all rows is dealt to one task.
    """
    own = cut(fingerprints(docs))
    nodes = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")), most=own.count())
    stars_of = connected_components(links(nodes))
    roots = stars_of.select(F.col("root").alias("node"), "root").distinct()
    members = cut(stars_of.unionByName(roots).withColumnRenamed("node", "fp").join(nodes, "fp"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = spread_join(members, least, "root").select("fp", "component_id", F.lit(True).alias("linked"))
    label = nodes.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return spread_join(own, cut(label), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of docs, one row of each component of near_duplicates, with an id or without.

    It is the row with the least doc_id, null last, then the least digest of the text, then the least hash of the other
    columns, so that another run keeps the same rows. Different texts under one doc_id, or without any, are settled
    each in its own component.
    """
    return own_names(docs, _keep_one)


def _keep_one(docs: DataFrame) -> DataFrame:
    digest = F.coalesce(F.md5(F.col("text").cast("string").cast("binary")), F.lit(""))
    own = cut(fingerprints(docs, digest.alias("__digest")))
    nodes = cut(own.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__digest")).alias("best")), most=own.count())
    roots = connected_components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    best = nodes.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp")).agg(F.min("best").alias("best"))

    def key(doc_id: Column, digest: Column) -> Column:
        return F.concat(digest, F.lit(" "), F.coalesce(doc_id.cast("string"), F.lit(""))).alias("__kept")

    kept = best.select(key(F.col("best.doc_id"), F.col("best.__digest")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    others = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))))
    # rows of one text and id become one before they are dealt out, so no task gets a group of them
    rows = docs.groupBy(key(F.col("doc_id"), digest)).agg(F.min_by(F.struct(*columns), others).alias("__row"))
    return rows.join(kept, "__kept", "left_semi").select("__row.*")
