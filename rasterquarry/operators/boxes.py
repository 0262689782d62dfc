"""Box trees of ISO base media files as rows, and the payloads of their boxes as columns."""

from __future__ import annotations

import decimal
import struct
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterquarry.functions.bytes import bits, flags, fourcc, part, signed32, unsigned, version

#: Boxes whose payload is boxes, and the bytes before the first of them.
CONTAINERS = {"meta": 4, "iprp": 0, "ipco": 0, "dinf": 0, "moov": 0, "trak": 0, "iinf": None}
#: Payloads of these types are left in the file; their place is in the row.
BULK = ("mdat", "free", "skip")
MAX_DEPTH = 8


_head = struct.Struct(">I4s").unpack_from


@lru_cache(4096)
def code(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.hex()


def scan(data: bytes, at: int, end: int):
    """Boxes of data[at:end] as (offset, type, size, payload offset, uuid, error). An error is given once and ends the scan."""
    while at < end:
        left = end - at
        if left < 8:
            yield at, None, None, None, None, "truncated box header"
            return
        size, kind, header = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            if left < 16:
                yield at, code(kind), None, None, None, "truncated 64-bit size"
                return
            size, header = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = left
        uuid = None
        if kind == b"uuid":
            if left < header + 16:
                yield at, "uuid", None, None, None, "truncated uuid"
                return
            uuid, header = data[at + header : at + header + 16], header + 16
        if size < header:
            yield at, code(kind), size, None, uuid, "size smaller than header"
            return
        if size > left:
            yield at, code(kind), size, None, uuid, "size beyond its parent"
            return
        yield at, code(kind), size, at + header, uuid, None
        at += size


def _tree(data: bytes, at: int, end: int, parent: int, depth: int, out: list[tuple], top: str | None = None) -> list[tuple]:
    """Adds the boxes of data[at:end] to out, each before those in it, as (parent, pos, depth, offset, type, size, payload offset, uuid, error, type of parent)."""
    pos = 0
    while at < end:
        size, raw = _head(data, at) if end - at >= 8 else (0, b"")
        if 8 <= size <= end - at and raw != b"uuid":
            kind, body, uuid, error = code(raw), at + 8, None, None
        else:
            _, kind, size, body, uuid, error = next(scan(data, at, end))
        out.append((parent, pos, depth, at, kind, size, body, uuid, error, top))
        if error is not None:
            break
        if kind in CONTAINERS and depth < MAX_DEPTH:
            skip = CONTAINERS[kind]
            if skip is None:  # iinf: version, flags, a count of 2 or 4 bytes
                skip = 6 if data[body : body + 1] == b"\0" else 8
            if body + skip <= at + size:
                _tree(data, body + skip, at + size, at, depth + 1, out, kind)
        at += size
        pos += 1
    return out


def tree(data: bytes) -> list[tuple]:
    """A file's boxes as _tree has them."""
    return _tree(data, 0, len(data), -1, 0, [])


_FIELDS = pa.schema([("parent", pa.int64()), ("pos", pa.int32()), ("depth", pa.int32()), ("off", pa.int64()), ("type", pa.string()), ("size", pa.int64()), ("payload_off", pa.int64()), ("uuid", pa.binary()), ("error", pa.string())])


#: Files of a batch that are read at once, so that memory doesn't grow with what a batch holds.
STEP = 1000


def steps(batches, n: int = STEP):
    """Batches of at most n rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def array(rows: list, kind: pa.DataType) -> pa.Array:
    """An Arrow array; lists of structs are given as lists of tuples, and built field by field."""
    if not pa.types.is_list(kind):
        return pa.array(rows, kind)
    at, ends, flat = 0, [], []
    for r in rows:
        ends.append(None if r is None else at)
        if r:
            flat += r
            at += len(r)
    ends.append(at)
    fields = list(kind.value_type)
    columns = list(zip(*flat)) if flat else [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind)


def _scan_batches(batches, key, kinds, parents):
    types = [*_FIELDS.types, pa.binary()]
    for batch in steps(batches):
        ids, rows, payloads, at = batch.column(0), [], [], []
        for i, data in enumerate(batch.column(1).to_pylist()):
            for row in tree(data or b""):
                if kinds is not None and row[4] not in kinds or parents is not None and row[9] not in parents:
                    continue
                rows.append(row)
                payloads.append(data[row[6] : row[3] + row[5]] if row[6] is not None and row[4] not in BULK else None)
                at.append(i)
        columns = list(zip(*rows))[:9] if rows else [()] * 9
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip([*columns, payloads], types))], names=[key, *_FIELDS.names, "payload"])


def boxes(files: DataFrame, key: str = "file_id", kinds: tuple[str, ...] | None = None, parents: tuple[str, ...] | None = None) -> DataFrame:
    """One row a box: key, parent (offset, -1 at the top), pos among its siblings, depth, off, type, size, payload_off, uuid, error, payload.

    Offsets are absolute. A malformed box is a row with an error after which its siblings end; other files go on. Null
    content has no boxes. kinds: only boxes of these types; parents: only those in boxes of these types. One pass over
    each file, no shuffle, and only the boxes that are asked for leave it.
    """
    kind = files.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, parent long, pos int, depth int, off long, type string, size long, payload_off long, uuid binary, error string, payload binary"
    return files.select(key, "content").mapInArrow(partial(_scan_batches, key=key, kinds=kinds, parents=parents), schema)


def header(b: Column) -> Column:
    """struct<type, size, header, error> of the box at the start of a binary: size 1 means a 64-bit one, 0 up to the end."""
    size32, kind, n = unsigned(b, 0, 4), fourcc(b, 4), F.octet_length(b)
    size = F.when(size32 == 1, unsigned(b, 8, 8)).when(size32 == 0, n).otherwise(size32).cast("decimal(20,0)")
    length = F.when(size32 == 1, 16).otherwise(8) + F.when(part(b, 4, 4) == F.lit(b"uuid"), 16).otherwise(0)
    error = F.when((n < 8) | (n < length), "truncated box header").when(size < length, "size smaller than header").when(size > n, "size beyond its parent")
    return F.struct(kind.alias("type"), size.alias("size"), length.alias("header"), error.alias("error"))


# Payload decoders: binary column -> struct column. A payload that is too short or of another version gives an error
# and nulls, never a failed job.


def _checked(fields: dict[str, Column], error: Column) -> Column:
    return F.struct(*(F.when(error.isNull(), v).alias(k) for k, v in fields.items()), error.alias("error"))


def _needs(b: Column, n, *more: tuple[Column, str]) -> Column:
    out = F.when(F.octet_length(b) < n, "truncated payload")
    for bad, why in more:
        out = out.when(bad, why)
    return out


def ftyp(b: Column) -> Column:
    n = F.octet_length(b)
    brands = F.transform(F.sequence(F.lit(0), F.floor((n - 8) / 4).cast("int") - 1), lambda i: fourcc(b, i * 4 + 8))
    brands = F.when(n > 8, brands).otherwise(F.array().cast("array<string>"))
    return _checked({"major_brand": fourcc(b, 0), "minor_version": unsigned(b, 4, 4), "compatible_brands": brands}, _needs(b, 8, (n % 4 != 0, "partial brand")))


def full_box(b: Column) -> Column:
    return _checked({"version": version(b), "flags": flags(b)}, _needs(b, 4))


def meta(b: Column) -> Column:
    return _checked({"version": version(b), "flags": flags(b)}, _needs(b, 4, (version(b) != 0, "unsupported version")))


def pitm(b: Column) -> Column:
    v = version(b)
    return _checked({"item_id": F.when(v == 0, unsigned(b, 4, 2)).otherwise(unsigned(b, 4, 4))}, _needs(b, 4, (v > 1, "unsupported version"), (F.octet_length(b) < F.when(v == 0, 6).otherwise(8), "truncated payload")))


def ispe(b: Column) -> Column:
    return _checked({"width": unsigned(b, 4, 4), "height": unsigned(b, 8, 4)}, _needs(b, 12, (version(b) != 0, "unsupported version")))


def pixi(b: Column) -> Column:
    n = unsigned(b, 4, 1)
    depths = F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: unsigned(b, i + 5, 1))).otherwise(F.array().cast("array<bigint>"))
    return _checked({"bits": depths}, _needs(b, 5, (F.octet_length(b) < n + 5, "truncated payload"), (version(b) != 0, "unsupported version")))


def irot(b: Column) -> Column:
    return _checked({"ccw_degrees": bits(unsigned(b, 0, 1), 0, 2) * 90}, _needs(b, 1))


def imir(b: Column) -> Column:
    return _checked({"axis": F.when(bits(unsigned(b, 0, 1), 0, 1) == 1, "horizontal").otherwise("vertical")}, _needs(b, 1))


def clap(b: Column) -> Column:
    names = ("width", "height", "x", "y")
    fields = {}
    for i, name in enumerate(names):
        read = unsigned if i < 2 else (lambda col, at, _: signed32(col, at))
        fields |= {f"{name}_num": read(b, 8 * i, 4), f"{name}_den": unsigned(b, 8 * i + 4, 4)}
    zero = (unsigned(b, 4, 4) == 0) | (unsigned(b, 12, 4) == 0) | (unsigned(b, 20, 4) == 0) | (unsigned(b, 28, 4) == 0)
    return _checked(fields, _needs(b, 32, (zero, "zero denominator")))


def colr(b: Column) -> Column:
    """kind nclx, nclc or icc; nclc has no range bit: full range goes with the identity matrix."""
    kind, matrix = fourcc(b, 0), unsigned(b, 8, 2)
    icc = kind.isin("prof", "rICC")
    full = F.when(kind == "nclx", unsigned(b, 10, 1) >= 128).otherwise(matrix == 0)
    n = F.when(icc, 4).when(kind == "nclx", 11).otherwise(10)
    fields = {"kind": F.when(icc, "icc").otherwise(kind), "primaries": F.when(~icc, unsigned(b, 4, 2)), "transfer": F.when(~icc, unsigned(b, 6, 2)), "matrix": F.when(~icc, matrix), "full_range": F.when(~icc, full), "icc": F.when(icc, part(b, 4, F.octet_length(b) - 4))}
    return _checked(fields, _needs(b, 4, (~kind.isin("nclx", "nclc", "prof", "rICC"), "unknown colour type"), (F.octet_length(b) < n, "truncated payload")))


def av1c(b: Column) -> Column:
    x, y, z = unsigned(b, 0, 1), unsigned(b, 1, 1), unsigned(b, 2, 1)
    fields = {
        "profile": bits(y, 5, 3), "level": bits(y, 0, 5), "tier": bits(z, 7, 1), "high_bitdepth": bits(z, 6, 1), "twelve_bit": bits(z, 5, 1), "monochrome": bits(z, 4, 1),
        "subsampling_x": bits(z, 3, 1), "subsampling_y": bits(z, 2, 1), "sample_position": bits(z, 0, 2), "config": part(b, 4, F.octet_length(b) - 4),
    }
    return _checked(fields, _needs(b, 4, (bits(x, 7, 1) != 1, "marker bit"), (bits(x, 0, 7) != 1, "unsupported version")))


def hvcc(b: Column) -> Column:
    """The fixed part of an HEVC configuration record; its NAL arrays come from hvcc_nals."""
    y = unsigned(b, 1, 1)
    fields = {
        "profile_space": bits(y, 6, 2), "tier": bits(y, 5, 1), "profile": bits(y, 0, 5), "level": unsigned(b, 12, 1), "chroma_format": bits(unsigned(b, 16, 1), 0, 2),
        "bit_depth_luma": bits(unsigned(b, 17, 1), 0, 3) + 8, "bit_depth_chroma": bits(unsigned(b, 18, 1), 0, 3) + 8, "nal_length_size": bits(unsigned(b, 21, 1), 0, 2) + 1, "n_arrays": unsigned(b, 22, 1),
    }
    return _checked(fields, _needs(b, 23, (version(b) != 1, "unsupported version")))


def grid(b: Column) -> Column:
    """A grid item's descriptor."""
    wide = bits(unsigned(b, 1, 1), 0, 1) == 1
    fields = {"rows": unsigned(b, 2, 1) + 1, "columns": unsigned(b, 3, 1) + 1, "width": F.when(wide, unsigned(b, 4, 4)).otherwise(unsigned(b, 4, 2)), "height": F.when(wide, unsigned(b, 8, 4)).otherwise(unsigned(b, 6, 2))}
    return _checked(fields, _needs(b, 8, (version(b) != 0, "unsupported version"), (wide & (F.octet_length(b) < 12), "truncated payload")))


class Cursor:
    """Reads of a payload in order; a read that passes its end raises ValueError with what was read."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int, what: str) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError(f"truncated {what}")
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self, n: int, what: str) -> int:
        at = self.at
        if at + n > len(self.data):
            raise ValueError(f"truncated {what}")
        self.at = at + n
        return int.from_bytes(self.data[at : at + n], "big")

    def string(self) -> bytes:
        """Bytes up to a NUL, which is taken too, or to the end."""
        end = self.data.find(b"\0", self.at)
        out = self.data[self.at : end if end >= 0 else len(self.data)]
        self.at = end + 1 if end >= 0 else len(self.data)
        return out


def _iloc(data):
    c = Cursor(data)
    v = c.uint(1, "version")
    c.take(3, "flags")
    if v > 2:
        raise ValueError("unsupported version")
    sizes = c.uint(2, "size fields")
    n_off, n_len, n_base, n_index = (sizes >> s & 15 for s in (12, 8, 4, 0))
    n_index = n_index if v else 0
    if any(n not in (0, 4, 8) for n in (n_off, n_len, n_base, n_index)):
        raise ValueError("size field not 0, 4 or 8")
    for _ in range(c.uint(4 if v == 2 else 2, "item count")):
        item = c.uint(4 if v == 2 else 2, "item id")
        method = c.uint(2, "construction method") & 15 if v else 0
        ref, base = c.uint(2, "data reference"), c.uint(n_base, "base offset")
        for k in range(c.uint(2, "extent count")):
            index, off = c.uint(n_index, "extent index"), c.uint(n_off, "extent offset")
            yield item, method, ref, k, index, base + off, c.uint(n_len, "extent length")


def _infe(data):
    if len(data) > 12 and data[0] == 2 and data[8:12] not in (b"mime", b"uri "):  # the usual form, in one step
        name = data[12:].partition(b"\0")[0].decode("utf-8", "replace")
        yield data[4] << 8 | data[5], code(data[8:12]), name, None, None, None, bool(data[3] & 1)
        return
    c = Cursor(data)
    v, fl = c.uint(1, "version"), c.uint(3, "flags")
    if v > 3:
        raise ValueError("unsupported version")
    item = c.uint(4 if v == 3 else 2, "item id")
    c.take(2, "protection index")
    kind = mime = encoding = uri = None
    if v >= 2:
        kind, name = code(c.take(4, "item type")), c.string()
        if kind == "mime":
            mime, encoding = c.string(), c.string()
        elif kind == "uri ":
            uri = c.string()
    else:
        name, mime, encoding = c.string(), c.string(), c.string()
    text = lambda x: None if x is None else x.decode("utf-8", "replace")
    yield item, kind, text(name), text(mime), text(encoding), text(uri), bool(fl & 1)


def _iref(data):
    c = Cursor(data)
    v = c.uint(1, "version")
    c.take(3, "flags")
    if v > 1:
        raise ValueError("unsupported version")
    for off, kind, size, body, _, error in scan(data, 4, len(data)):
        if error:
            raise ValueError(error)
        one, width = Cursor(data[body : off + size]), 4 if v else 2
        source, n = one.uint(width, "from item"), one.uint(2, "reference count")
        if not n:
            raise ValueError("no references")
        for k in range(n):
            yield kind, source, k, one.uint(width, "to item")


def _ipma(data):
    c = Cursor(data)
    v, fl = c.uint(1, "version"), c.uint(3, "flags")
    if v > 1:
        raise ValueError("unsupported version")
    for _ in range(c.uint(4, "entry count")):
        item, n = c.uint(4 if v else 2, "item id"), c.uint(1, "association count")
        if fl & 1:
            own = [(x & 0x7FFF, x > 0x7FFF) for x in (c.uint(2, "association") for _ in range(n))]
        else:
            own = [(x & 127, x > 127) for x in c.take(n, "association")]
        for k, (index, essential) in enumerate(own):
            yield item, k, index, essential


def _cmpd(data):
    c = Cursor(data)
    for k in range(c.uint(4, "component count")):
        kind = c.uint(2, "component type")
        yield k, kind, c.string().decode("utf-8", "replace") if kind >= 0x8000 else None


# The profiles that a version 1 uncC box may name.
UNCC_PROFILES = ("rgb3", "rgba", "abgr", "2vuy", "yuv2", "yvyu", "vyuy", "yuv1", "v308", "v408", "y210", "v410", "v210", "i420", "nv12", "nv21", "yu22", "yv22", "yv20")


def _uncc(data):
    c = Cursor(data)
    v = c.uint(1, "version")
    c.take(3, "flags")
    profile = code(c.take(4, "profile"))
    if v == 1:
        if profile not in UNCC_PROFILES:
            raise ValueError("unknown profile")
        yield v, profile, None, None, None, None, None, None, None
        return
    if v:
        raise ValueError("unsupported version")
    found = []
    for _ in range(c.uint(4, "component count")):
        index, depth, fmt, align = c.uint(2, "component index"), c.uint(1, "bit depth") + 1, c.uint(1, "format"), c.uint(1, "align size")
        found.append({"index": index, "bit_depth": depth, "format": fmt, "align": align})
    sampling, interleave, block, fl = (c.uint(1, x) for x in ("sampling", "interleave", "block size", "flags"))
    pixel, row, tile = (c.uint(4, x) for x in ("pixel size", "row align", "tile align"))
    cols, rows = c.uint(4, "tile columns") + 1, c.uint(4, "tile rows") + 1
    del block, fl, pixel, row, tile
    yield v, profile, found, sampling, interleave, cols, rows, len(found), None


def _hvcc_nals(data):
    c = Cursor(data)
    c.take(22, "record")
    pos = 0
    for _ in range(c.uint(1, "array count")):
        head = c.uint(1, "array header")
        for _ in range(c.uint(2, "NAL count")):
            nal = c.take(c.uint(2, "NAL length"), "NAL")
            if nal:  # empty ones are passed over
                yield pos, head & 63, bool(head >> 7), nal
                pos += 1


#: Decoders that give several rows a payload: the function, and its columns.
ROWS = {
    "iloc": (_iloc, "item_id long, method int, data_reference int, extent int, extent_index decimal(20,0), extent_off decimal(20,0), extent_len decimal(20,0)"),
    "infe": (_infe, "item_id long, item_type string, name string, content_type string, encoding string, uri string, hidden boolean"),
    "iref": (_iref, "ref_type string, from_id long, ref_pos int, to_id long"),
    "ipma": (_ipma, "item_id long, assoc_pos int, prop_index int, essential boolean"),
    "cmpd": (_cmpd, "component int, component_type int, component_uri string"),
    "uncC": (_uncc, "uncc_version int, profile string, components array<struct<index:int,bit_depth:int,format:int,align:int>>, sampling int, interleave int, tile_columns long, tile_rows long, n_components int, uncc_note string"),
    "hvcC": (_hvcc_nals, "nal_pos int, nal_type int, complete boolean, nal binary"),
}


def _decode_batches(batches, kind, keys, fields):
    read, _ = ROWS[kind]
    types = [*(f.type for f in fields), pa.string()]
    wide = [k for k, t in enumerate(types) if t == pa.decimal128(20, 0)]
    for batch in steps(batches):
        at, rows = [], []
        for i, data in enumerate(batch.column("payload").to_pylist()):
            try:
                own = [(*r, None) for r in read(data or b"")]
            except ValueError as e:
                own = [(*(None,) * len(fields), str(e))]
            at += [i] * len(own)
            rows += own
        columns = list(zip(*rows)) if rows else [()] * len(types)
        for k in wide:
            columns[k] = [None if v is None else decimal.Decimal(v) for v in columns[k]]
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in keys), *(pa.array(c, t) for c, t in zip(columns, types))], names=[*keys, *(f.name for f in fields), "error"])


def rows_of(tree: DataFrame, kind: str, key: str = "file_id") -> DataFrame:
    """The rows of every box of one type that ROWS knows: key, the box's off, its columns, error. A bad payload gives one row with an error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = ROWS[kind][1]
    fields = list(to_arrow_schema(StructType.fromDDL(ddl)))
    own = tree.where((F.col("type") == kind) & F.col("error").isNull()).select(key, "off", "payload")
    return own.mapInArrow(partial(_decode_batches, kind=kind, keys=[key, "off"], fields=fields), f"`{key}` {tree.schema[key].dataType.simpleString()}, off long, {ddl}, error string")
