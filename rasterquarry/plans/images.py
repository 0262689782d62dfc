"""Queries over whole images: files written from the events table in many layouts, some broken, and SQL that states their pixels."""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rasterquarry.operators import boxes as B
from rasterquarry.operators import hevc as H
from rasterquarry.operators import host
from rasterquarry.operators import images as M
from rasterquarry.operators import items as I
from rasterquarry.operators import reports as R

from . import streams as S
from .container import events

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind.encode() + body


def full(kind: str, version: int, *parts: bytes) -> bytes:
    return box(kind, bytes([version, 0, 0, 0]), *parts)


def container(items: list[tuple[int, str, bytes, list[bytes]]], edges: list[tuple[str, int, list[int]]] = ()) -> bytes:
    """A file of items (id, type, payload, properties), the first of which is primary, and references (type, from, to)."""
    ftyp = box("ftyp", b"mif1", bytes(4), b"mif1")
    at, spans, props, assoc = len(ftyp) + 8, [], [], []
    for item, _, data, own in items:
        spans.append(struct.pack(">HHHHII", item, 0, 0, 1, at, len(data)))
        at += len(data)
        assoc.append(struct.pack(">HB", item, len(own)) + bytes(range(len(props) + 1, len(props) + len(own) + 1)))
        props += own
    iloc = full("iloc", 1, struct.pack(">HH", 0x4400, len(items)), *spans)
    iinf = full("iinf", 0, struct.pack(">H", len(items)), *(full("infe", 2, struct.pack(">HH", item, 0), kind.encode(), b"\0") for item, kind, _, _ in items))
    iref = full("iref", 0, *(box(kind, struct.pack(">HH", source, len(to)), struct.pack(f">{len(to)}H", *to)) for kind, source, to in edges)) if edges else b""
    ipma = full("ipma", 0, struct.pack(">I", len(items)), *assoc)
    meta = full("meta", 0, full("pitm", 0, struct.pack(">H", items[0][0])), iloc, iinf, iref, box("iprp", box("ipco", *props), ipma))
    return ftyp + box("mdat", *(data for _, _, data, _ in items)) + meta


def ispe(width: int, height: int) -> bytes:
    return full("ispe", 0, struct.pack(">II", width, height))


def uncc(depths: list[int], interleave: int, columns: int = 1, rows: int = 1, indexes: list[int] | None = None) -> bytes:
    own = b"".join(struct.pack(">HBBB", i, d - 1, 0, 0) for i, d in zip(indexes or range(len(depths)), depths))
    return full("uncC", 0, bytes(4), struct.pack(">I", len(depths)), own, bytes([0, interleave, 0, 0]), struct.pack(">IIIII", 0, 0, 0, columns - 1, rows - 1))


def cmpd(*kinds: int) -> bytes:
    return box("cmpd", struct.pack(">I", len(kinds)), struct.pack(f">{len(kinds)}H", *kinds))


def exif(orientation: int) -> bytes:
    return bytes(4) + b"MM" + struct.pack(">HI", 42, 8) + struct.pack(">HHHIHH", 1, 0x0112, 3, 1, orientation, 0) + bytes(4)


def sample(e: int, k: int, x, y, depth: int):
    return (e * 31 + x * 7 + y * 13 + k * 57) % (1 << depth)


#: The layout of a file by event_id % 8: a profile, planes, ten-bit pixels, zlib, tiles, rows with deflated units, and two that are wrong.
LAYOUTS = 8


def unci_file(e: int) -> bytes:
    kind, w, h = e % LAYOUTS, 2 * (e % 5 + 1), e % 3 + 1
    depth = 10 if kind == 2 else 8
    y, x = np.meshgrid(np.arange(h), np.arange(w), indexing="ij")
    v = np.stack([sample(e, k, x, y, depth) for k in range(3)], 2)
    props = [ispe(w, h)]
    if kind == 0:
        data, props = v.astype(np.uint8).tobytes(), [*props, full("uncC", 1, b"rgb3")]
    elif kind == 1:
        data, props = v.astype(np.uint8).transpose(2, 0, 1).tobytes(), [*props, cmpd(4, 5, 6), uncc([8] * 3, 0)]
    elif kind == 2:
        rows = ["".join(format(int(s), "010b") for s in row.ravel()) for row in v]
        data = b"".join(int(r.ljust(-(-len(r) // 8) * 8, "0"), 2).to_bytes(-(-len(r) // 8), "big") for r in rows)
        props += [cmpd(4, 5, 6), uncc([10] * 3, 1)]
    elif kind == 3:
        data, props = zlib.compress(v.astype(np.uint8).tobytes()), [*props, cmpd(4, 5, 6), uncc([8] * 3, 1), full("cmpC", 0, b"zlib", b"\0")]
    elif kind == 4:
        data = b"".join(v[:, part].astype(np.uint8).tobytes() for part in (slice(0, w // 2), slice(w // 2, w)))
        props += [cmpd(4, 5, 6), uncc([8] * 3, 1, columns=2)]
    elif kind == 5:
        raw = v.astype(np.uint8).transpose(0, 2, 1).tobytes()
        units = [zlib.compress(raw[: len(raw) // 2])[2:-4], zlib.compress(raw[len(raw) // 2 :])[2:-4]]
        data = b"".join(units)
        props += [cmpd(4, 5, 6), uncc([8] * 3, 3), full("cmpC", 0, b"defl", b"\0"), full("icef", 0, bytes([1 << 5 | 1 << 2]), struct.pack(">I", 2), struct.pack(">HH", 0, len(units[0])), struct.pack(">HH", len(units[0]), len(units[1])))]
    elif kind == 6:
        data, props = v.astype(np.uint8).tobytes(), [*props, cmpd(4, 5, 6), uncc([8] * 3, 1, indexes=[0, 1, 3])]
    else:
        data, props = v.astype(np.uint8).tobytes()[:-1], [*props, cmpd(4, 5, 6), uncc([8] * 3, 1)] if e % 16 == 7 else [*props, uncc([8] * 3, 1)]
    return container([(1, "unci", data, props)])


#: Turns of the orientation files by event_id % 6: none, a turn by 0, by 90, 270, a mirror, a crop.
def turned_file(e: int) -> bytes:
    kind, w, h = e % 6, e % 4 + 3, e % 3 + 2
    turn = {0: [], 1: [box("irot", b"\0")], 2: [box("irot", b"\1")], 3: [box("irot", b"\3")], 4: [box("imir", b"\1")], 5: [box("clap", struct.pack(">IIIIiIiI", w - 2, 1, h, 1, 0, 1, 0, 1))]}[kind]
    y, x = np.meshgrid(np.arange(h), np.arange(w), indexing="ij")
    data = np.stack([sample(e, k, x, y, 8) for k in range(3)], 2).astype(np.uint8).tobytes()
    items = [(1, "unci", data, [ispe(w, h), full("uncC", 1, b"rgb3"), *turn])]
    edges = []
    if e % 7:
        items.append((2, "Exif", exif(e % 10), []))
        edges.append(("cdsc", 2, [1]))
    return container(items, edges)


def hvcc(stream: bytes) -> tuple[bytes, bytes]:
    """A configuration record of a stream's parameter sets, and the payload of its slice, with lengths of four bytes."""
    from rasterquarry.operators import codec as C

    nals = list(C.split_lengths(stream, 4))
    arrays = b"".join(bytes([0x80 | n[0] >> 1, 0, 1]) + struct.pack(">H", len(n)) + n for n in nals[:-1])
    return box("hvcC", bytes([1]) + bytes(20) + bytes([3, len(nals) - 1]) + arrays), len(nals[-1]).to_bytes(4, "big") + nals[-1]


def coded_item(item: int, e: int, seed: int, extra: list[bytes]) -> tuple[int, str, bytes, list[bytes]]:
    """An HEVC item of 16 x 8 grey samples without loss, in 4:0:0."""
    y, x = np.meshgrid(np.arange(8), np.arange(16), indexing="ij")
    luma = sample(e, seed, x, y, 8)
    config, payload = hvcc(S.encode([luma], H.Plan([luma]), format=0)[0])
    return item, "hvc1", payload, [ispe(16, 8), config, box("colr", b"nclx", struct.pack(">HHHB", 1, 13, 6, 128)), *extra]


#: Coded files by event_id % 5: alone, with alpha, with alpha of another size, a grid of two tiles, a grid that lacks one.
def coded_file(e: int) -> bytes:
    kind = e % 5
    if kind < 3:
        items, edges = [coded_item(1, e, 0, [])], []
        if kind:
            alpha = coded_item(2, e, 1, [full("auxC", 0, M.ALPHA[0] + b"\0")])
            if kind == 2:
                luma = np.zeros((8, 8), np.int64)
                config, payload = hvcc(S.encode([luma], H.Plan([luma]), format=0)[0])
                alpha = (2, "hvc1", payload, [ispe(8, 8), config, full("auxC", 0, M.ALPHA[0] + b"\0")])
            items.append(alpha)
            edges.append(("auxl", 2, [1]))
        return container(items, edges)
    tiles = [coded_item(2, e, 0, []), coded_item(3, e, 2, [])][: 2 if kind == 3 else 1]
    grid = (1, "grid", bytes([0, 0, 0, 1]) + struct.pack(">HH", 30, 7), [ispe(30, 7)])
    return container([grid, *tiles], [("dimg", 1, [t[0] for t in tiles])])


#: Profiles by event_id % 4: one, two of which the last counts, none, and a grid that takes its first tile's.
def profile_file(e: int) -> bytes:
    kind = e % 4
    icc = [box("colr", b"prof" if e % 3 else b"rICC", bytes([n % 256]) * n) for n in ([], [e % 50], [e % 50, e % 20])[(1, 2, 0, 1)[kind]]]
    if kind < 3:
        return container([(1, "unci", bytes(6), [ispe(2, 1), full("uncC", 1, b"rgb3"), *icc])])
    return container([(1, "grid", bytes(8), [ispe(2, 1)]), (2, "hvc1", b"", [ispe(2, 1), *icc])], [("dimg", 1, [2])])


MAKERS = {"unci": unci_file, "turned": turned_file, "coded": coded_file, "profile": profile_file}


def _file_batches(batches, kind):
    for batch in B.steps(batches):
        made = [MAKERS[kind](e) for e in batch.column("file_id").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file_id"), pa.array(made, pa.binary())], names=["file_id", "content"])


def files(spark, sf_dir, kind: str, one_in: int = 1):
    """(file_id, content): a file for each event, or for each group of so many."""
    e = F.col("event_id")
    rows = events(spark, sf_dir).select(F.floor(e / one_in).cast("long").alias("file_id")).distinct().repartition(spark.sparkContext.defaultParallelism)
    return rows.mapInArrow(partial(_file_batches, kind=kind), "file_id long, content binary")


def pixels(decoded):
    """(file_id, x, y, r, g, b, a) of decoded images."""
    code = lambda i, k: F.conv(F.substr(F.col("h"), i * 8 + 2 * k + 1, F.lit(2)), 16, 10).cast("int")
    rows = decoded.where("error IS NULL").select("file_id", "width", F.hex("rgba").alias("h"), F.explode(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1)).alias("i"))
    return rows.select("file_id", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), *(code(F.col("i"), k).alias(c) for k, c in enumerate("rgba")))


GROUP = 20
G_SQL = f"f AS (SELECT DISTINCT (event_id // {GROUP})::BIGINT AS e FROM events)"
UNCI_SQL = f"""{G_SQL}, p AS (SELECT e, x, y, k, (e * 31 + x * 7 + y * 13 + k * 57) % (CASE WHEN e % 8 = 2 THEN 1024 ELSE 256 END) AS v FROM f, range(10) a(x), range(3) b(y), range(3) c(k) WHERE e % 8 < 6 AND x < 2 * (e % 5 + 1) AND y < e % 3 + 1),
q AS (SELECT e, x, y, k, CASE WHEN e % 8 = 2 THEN (v * 255 + 511) // 1023 ELSE v END AS v FROM p),
o AS (SELECT e AS file_id, x::INT AS x, y::INT AS y, max(CASE WHEN k = 0 THEN v END)::INT AS r, max(CASE WHEN k = 1 THEN v END)::INT AS g, max(CASE WHEN k = 2 THEN v END)::INT AS b, 255 AS a FROM q GROUP BY e, x, y)"""


@query(f"WITH {UNCI_SQL} SELECT * FROM o")
def x_unci(spark, sf_dir):
    """Uncompressed images: profiles, planes, ten-bit pixels, tiles, rows, zlib and deflated units."""
    return pixels(M.decode(files(spark, sf_dir, "unci", GROUP), as_png=False))


@query(f"""WITH {G_SQL} SELECT e AS file_id, CASE WHEN e % 8 < 6 OR e % 16 = 7 THEN 2 * (e % 5 + 1) END::BIGINT AS width, CASE WHEN e % 8 < 6 OR e % 16 = 7 THEN CASE WHEN e % 8 = 2 THEN '10,10,10' ELSE '8,8,8' END END AS depths,
CASE WHEN e % 8 = 4 THEN 2 WHEN e % 8 < 6 OR e % 16 = 7 THEN 1 END::BIGINT AS tile_columns, CASE WHEN e % 8 = 6 THEN 'MalformedInput: component index out of range' WHEN e % 16 = 15 THEN 'MalformedInput: missing cmpd' END AS error FROM f""")
def props_unci(spark, sf_dir):
    out = M.uncompressed_properties(I.resolve_primary(I.open_container(files(spark, sf_dir, "unci", GROUP))))
    return out.select("file_id", "width", F.array_join(F.col("depths").cast("array<string>"), ",").alias("depths"), "tile_columns", "error")


@query(f"WITH {G_SQL} SELECT e AS file_id, CASE WHEN e % 8 < 6 THEN 'ok' WHEN e % 8 = 6 THEN 'MalformedInput: component index out of range' WHEN e % 16 = 7 THEN 'MalformedInput: payload too short' ELSE 'MalformedInput: missing cmpd' END AS outcome, CASE WHEN e % 8 >= 6 THEN 'Decoding' END AS kind FROM f")
def hook_errors(spark, sf_dir):
    """Errors of broken files as a host sees them."""
    out = M.decode(files(spark, sf_dir, "unci", GROUP), as_png=False)
    return out.select("file_id", F.coalesce("error", F.lit("ok")).alias("outcome"), host.error_kind(F.col("error")).alias("kind"))


@query(f"WITH {G_SQL} SELECT e AS file_id, CASE WHEN 2 * (e % 5 + 1) * (e % 3 + 1) > 12 AND e % 16 <> 15 AND e % 8 <> 6 THEN 'ResourceLimit' WHEN e % 8 >= 6 THEN 'MalformedInput' END AS category FROM f")
def x_guardrails(spark, sf_dir):
    """A limit of 12 pixels, which holds before a payload is looked at."""
    out = M.decode(files(spark, sf_dir, "unci", GROUP), max_pixels=12, as_png=False)
    return out.select("file_id", F.substring_index("error", ":", 1).alias("category"))


@query(f"WITH {G_SQL} SELECT e AS file_id, e % 8 < 6 AS decoded, CASE WHEN e % 8 < 6 THEN 2 * (e % 5 + 1) END::INT AS width, CASE WHEN e % 8 < 6 THEN e % 3 + 1 END::INT AS height, CASE WHEN e % 8 < 6 THEN '89504e470d0a1a0a' END AS head FROM f")
def x_decode_png(spark, sf_dir):
    out = M.decode(files(spark, sf_dir, "unci", GROUP))
    size = lambda at: F.conv(F.hex(F.substring("png", at, 4)), 16, 10).cast("int")
    return out.select("file_id", F.col("png").isNotNull().alias("decoded"), size(17).alias("width"), size(21).alias("height"), F.lower(F.hex(F.substring("png", 1, 8))).alias("head"))


TURNED_SQL = f"""{G_SQL}, s AS (SELECT e, e % 6 AS t, e % 4 + 3 AS w, e % 3 + 2 AS h FROM f),
p AS (SELECT e, t, w, h, x, y, (e * 31 + x * 7 + y * 13) % 256 AS v FROM s, range(6) a(x), range(4) b(y) WHERE x < w AND y < h),
o AS (SELECT e AS file_id, (CASE t WHEN 2 THEN y WHEN 3 THEN h - 1 - y WHEN 4 THEN w - 1 - x WHEN 5 THEN x - 1 ELSE x END)::INT AS x, (CASE t WHEN 2 THEN w - 1 - x WHEN 3 THEN x ELSE y END)::INT AS y, v::INT AS r FROM p WHERE t <> 5 OR x BETWEEN 1 AND w - 2)"""


@query(f"WITH {TURNED_SQL} SELECT * FROM o")
def x_transforms(spark, sf_dir):
    """Turns, mirrors and crops of containers."""
    return pixels(M.decode(files(spark, sf_dir, "turned", GROUP), as_png=False)).select("file_id", "x", "y", "r")


@query(f"WITH {G_SQL} SELECT e AS file_id, CASE WHEN e % 7 > 0 AND e % 6 NOT IN (2, 3, 4) AND e % 10 BETWEEN 1 AND 8 THEN e % 10 END::INT AS orientation FROM f")
def x_exif(spark, sf_dir):
    """The EXIF orientation that is left to apply: hidden by turns and mirrors, but not by a turn of 0 or a crop; none if it isn't 1 to 8."""
    return M.decode(files(spark, sf_dir, "turned", GROUP), as_png=False).select("file_id", "orientation")


@query("""WITH f AS (SELECT event_id::BIGINT AS e FROM events) SELECT e AS file_id, (CASE WHEN e % 6 IN (2, 3) THEN e % 3 + 2 ELSE e % 4 + 3 END)::INT AS width, (CASE WHEN e % 6 IN (2, 3) THEN e % 4 + 3 ELSE e % 3 + 2 END)::INT AS height,
CASE WHEN e % 7 > 0 AND e % 6 NOT IN (2, 3, 4) AND e % 10 BETWEEN 1 AND 8 THEN e % 10 END::INT AS orientation, NULL::VARCHAR AS error FROM f""")
def hook_meta(spark, sf_dir):
    """Sizes and orientations without pixels."""
    return host.metadata(files(spark, sf_dir, "turned")).select("file_id", "width", "height", "orientation", "error")


@query("SELECT event_id::BIGINT AS file_id, CASE event_id % 4 WHEN 0 THEN event_id % 50 WHEN 1 THEN event_id % 20 WHEN 3 THEN event_id % 50 END::BIGINT AS icc_bytes FROM events")
def icc_lookup(spark, sf_dir):
    return I.colour_properties(I.open_container(files(spark, sf_dir, "profile"))).select("file_id", F.octet_length("icc").cast("long").alias("icc_bytes"))


C_GROUP = 200
CODED_SQL = f"""f AS (SELECT DISTINCT (event_id // {C_GROUP})::BIGINT AS e FROM events),
p AS (SELECT e, x, y, (e * 31 + x % 16 * 7 + y * 13 + CASE WHEN x >= 16 THEN 114 ELSE 0 END) % 256 AS v, CASE WHEN e % 5 = 1 THEN (e * 31 + x * 7 + y * 13 + 57) % 256 ELSE 255 END AS a
  FROM f, range(30) t(x), range(8) u(y) WHERE e % 5 < 4 AND (e % 5 = 3 AND y < 7 OR e % 5 < 3 AND x < 16))"""


@query(f"WITH {CODED_SQL} SELECT e AS file_id, x::INT AS x, y::INT AS y, v::INT AS r, v::INT AS g, v::INT AS b, a::INT AS a FROM p")
def x_decode_rgba(spark, sf_dir):
    """Coded images, with alpha, with one that doesn't fit, and grids whose tiles are pasted and cut."""
    return pixels(M.decode(files(spark, sf_dir, "coded", C_GROUP), as_png=False))


@query(f"WITH {CODED_SQL} SELECT e AS file_id, CASE WHEN e % 5 < 4 THEN 'ok' ELSE 'MalformedInput: tile count' END AS outcome FROM f")
def x_errors(spark, sf_dir):
    return M.decode(files(spark, sf_dir, "coded", C_GROUP), as_png=False).select("file_id", F.coalesce("error", F.lit("ok")).alias("outcome"))


@query(f"WITH {CODED_SQL} SELECT e AS file_id, CASE WHEN e % 5 < 3 THEN 3 ELSE 0 END::BIGINT AS n_nals, CASE WHEN e % 5 < 3 THEN '33,34,19' END AS types FROM f")
def x_advanced(spark, sf_dir):
    """Streams assembled from configuration records and payloads: parameter sets first."""
    out = M.coded_streams(files(spark, sf_dir, "coded", C_GROUP))
    from rasterquarry.operators import codec as C

    nals = C.nal_units(out.where("stream IS NOT NULL").select(F.col("file_id").alias("item"), "stream")).groupBy("item").agg(F.count("*").alias("n_nals"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type"))), lambda n: n["type"].cast("string")), ",").alias("types"))
    return out.join(nals, out.file_id == nals.item, "left").select("file_id", F.coalesce("n_nals", F.lit(0)).cast("long").alias("n_nals"), "types")


@query(f"WITH {UNCI_SQL}, d AS (SELECT file_id, sum(r + 2 * g + 3 * b)::BIGINT AS total FROM o GROUP BY file_id) SELECT file_id, 'equal' AS verdict FROM d")
def bench_adapter(spark, sf_dir):
    """The direct RGB8 path against RGBA without its alpha."""
    out = M.decode(files(spark, sf_dir, "unci", GROUP), as_png=False).where("error IS NULL")
    direct = M.rgb8(out).select("file_id", F.col("rgb").alias("samples"))
    other = pixels(out).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b"))), lambda p: F.concat(*(F.lpad(F.hex(p[c].cast("long")), 2, "0") for c in "rgb"))), "").alias("h"))
    return R.equal_images(direct, other.select("file_id", F.unhex("h").alias("samples")), "file_id")


@query("""WITH l AS (SELECT event_id // 16 AS blk, event_id % 16 AS pos, (event_id * 37 + user_id * 101) % 601 - 300 AS v FROM events)
SELECT blk, sum(((v % 65536 + 65536) % 65536) * (pos + 1))::BIGINT AS checksum FROM l GROUP BY blk""")
def dbg_checksum(spark, sf_dir):
    e = F.col("event_id")
    v = ((e * 37 + F.col("user_id") * 101) % 601 - 300).cast("int")
    rows = events(spark, sf_dir).groupBy(F.floor(e / 16).cast("long").alias("blk")).agg(F.array_sort(F.collect_list(F.struct((e % 16).alias("at"), v.alias("v")))).alias("p"))
    return rows.select("blk", R.coefficient_checksum(F.col("p.v")).alias("checksum"))


@query("SELECT event_id::BIGINT AS e, CASE WHEN event_id % 600 NOT BETWEEN 256 AND 510 THEN 'range' WHEN user_id % 512 >= event_id % 600 THEN 'offset' END AS wrong FROM events")
def dbg_track(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_id").alias("e"), R.violations(F.col("event_id") % 600, F.col("user_id") % 512).alias("wrong"))


#: Failures that are expected of another decoder, as (path begins with, reason contains, kind).
EXPECTED = [("corpus/j2k", "unsupported", "codec"), ("corpus/av1", "bit depth", "depth"), ("stress/", "timeout", "slow")]


@query("""WITH r AS (SELECT event_id::BIGINT AS file, ['corpus/j2k', 'corpus/av1', 'stress/x', 'other/y'][(event_id % 4 + 1)::INT] AS path, ['unsupported codec', 'bit depth 12', 'timeout after 9 s'][(event_id % 3 + 1)::INT] AS reason FROM events)
SELECT file, CASE WHEN path = 'corpus/j2k' AND reason LIKE '%unsupported%' THEN 'codec' WHEN path = 'corpus/av1' AND reason LIKE '%bit depth%' THEN 'depth' WHEN path LIKE 'stress/%' AND reason LIKE '%timeout%' THEN 'slow' END AS kind FROM r""")
def h_expected_validator(spark, sf_dir):
    e = F.col("event_id")
    path = F.get(F.array(*map(F.lit, ("corpus/j2k", "corpus/av1", "stress/x", "other/y"))), (e % 4).cast("int"))
    reason = F.get(F.array(*map(F.lit, ("unsupported codec", "bit depth 12", "timeout after 9 s"))), (e % 3).cast("int"))
    return events(spark, sf_dir).select(e.alias("file"), R.expected_kind(path, reason, EXPECTED).alias("kind"))


def _cursor_batches(batches):
    for batch in batches:
        out = []
        for e in batch.column("file_id").to_pylist():
            c = B.Cursor(struct.pack(">HI", e % 65536, e) + b"name%d\0" % (e % 9) + b"rest")
            row = [c.uint(2, "two"), c.uint(4, "four"), c.string().decode(), c.string().decode()]
            try:
                c.take(1, "end")
                row.append(None)
            except ValueError as error:
                row.append(str(error))
            out.append(row)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("file_id"), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds))], names=["file_id", "two", "four", "name", "rest", "error"])


def cursor(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_id").alias("file_id")).mapInArrow(_cursor_batches, "file_id long, two long, four long, name string, rest string, error string")


@query("SELECT event_id::BIGINT AS file_id, (event_id % 65536)::BIGINT AS two, event_id::BIGINT AS four, 'truncated end' AS error FROM events")
def cursor_read(spark, sf_dir):
    return cursor(spark, sf_dir).select("file_id", "two", "four", "error")


@query("SELECT event_id::BIGINT AS file_id, 'name' || event_id % 9 AS name, 'rest' AS rest FROM events")
def cstring_read(spark, sf_dir):
    return cursor(spark, sf_dir).select("file_id", "name", "rest")
