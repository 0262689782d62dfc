"""Whole images: uncompressed and HEVC items to RGBA, grids, alpha, transforms, EXIF orientation, and PNG."""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boxes as B
from . import codec as C
from . import hevc as H
from . import items as I
from . import pixels as P

MAX_PIXELS = 1 << 28
#: Component types by channel: mono, luma and chroma, red, green, blue, alpha.
CHANNELS = {0: "l", 1: "y", 2: "u", 3: "v", 4: "r", 5: "g", 6: "b", 7: "a"}
#: The components of profiles that say them by name alone.
PROFILES = {"rgb3": "rgb", "rgba": "rgba", "abgr": "abgr"}
#: What says that an item is the alpha of another.
ALPHA = (b"urn:mpeg:mpegB:cicp:systems:auxiliary:alpha", b"urn:mpeg:hevc:2015:auxid:1")


def one(properties: list[tuple], kind: str, needed: bool = True) -> bytes | None:
    """The payload of the only property of a kind."""
    own = [p[3] for p in properties if p[1] == kind]
    if len(own) > 1:
        raise ValueError(f"MalformedInput: repeated {kind}")
    if needed and not own:
        raise ValueError(f"MalformedInput: missing {kind}")
    return own[0] if own else None


def size_of(properties: list[tuple]) -> tuple[int, int]:
    b = one(properties, "ispe")
    if len(b) < 12 or b[0]:
        raise ValueError("MalformedInput: ispe")
    width, height = struct.unpack_from(">II", b, 4)
    if not width or not height:
        raise ValueError("MalformedInput: zero extent")
    return width, height


def layout_of(properties: list[tuple]) -> dict:
    """The sample layout of an uncompressed item: uncC is needed, and cmpd unless uncC names a profile; components lie in cmpd."""
    width, height = size_of(properties)
    c = B.Cursor(one(properties, "uncC"))
    version = c.uint(1, "version")
    c.take(3, "flags")
    profile = B.code(c.take(4, "profile"))
    out = {"width": width, "height": height, "columns": 1, "rows": 1, "interleave": 1, "sampling": 0, "little": False, "row_align": 0, "tile_align": 0}
    definition = one(properties, "cmpd", False)
    if version == 1:
        if profile not in PROFILES:
            raise ValueError(f"UnsupportedFeature: profile {profile}")
        return out | {"channels": PROFILES[profile], "depths": [8] * len(PROFILES[profile])}
    if version:
        raise ValueError("UnsupportedFeature: uncC version")
    if definition is None:
        raise ValueError("MalformedInput: missing cmpd")
    types = [kind for _, kind, _ in B._cmpd(definition)]
    channels, depths = [], []
    for _ in range(c.uint(4, "component count")):
        index, depth, form, _ = c.uint(2, "component index"), c.uint(1, "bit depth") + 1, c.uint(1, "format"), c.uint(1, "align size")
        if index >= len(types):
            raise ValueError("MalformedInput: component index out of range")
        if form or depth > 16:
            raise ValueError("UnsupportedFeature: component format")
        channels.append(CHANNELS.get(types[index], "?"))
        depths.append(depth)
    out["sampling"], out["interleave"], block, flags = (c.uint(1, x) for x in ("sampling", "interleave", "block size", "flags"))
    pixel, out["row_align"], out["tile_align"] = (c.uint(4, x) for x in ("pixel size", "row align", "tile align"))
    out["columns"], out["rows"] = c.uint(4, "tile columns") + 1, c.uint(4, "tile rows") + 1
    if not channels:
        raise ValueError("MalformedInput: no components")
    if block or pixel or out["sampling"] or out["interleave"] not in (0, 1, 3):
        raise ValueError("UnsupportedFeature: sample layout")
    if width % out["columns"] or height % out["rows"]:
        raise ValueError("MalformedInput: tiles don't divide the image")
    return out | {"channels": "".join(channels), "depths": depths, "little": bool(flags & 128)}


def unpacked(data: bytes, properties: list[tuple]) -> bytes:
    """An item's payload after generic compression: whole, or unit by unit."""
    kind = one(properties, "cmpC", False)
    if kind is None:
        return data
    kind = kind[4:8]
    if kind not in (b"zlib", b"defl"):
        raise ValueError(f"UnsupportedFeature: compression {B.code(kind)}")
    units, table = [(0, len(data))], one(properties, "icef", False)
    if table is not None:
        c = B.Cursor(table)
        c.take(4, "version")
        codes = c.uint(1, "codes")
        wide, long = (0, 2, 3, 4, 8), (1, 2, 3, 4, 8)
        if codes >> 5 > 4 or codes >> 2 & 7 > 4:
            raise ValueError("MalformedInput: icef")
        units, at = [], 0
        for _ in range(c.uint(4, "unit count")):
            at = c.uint(wide[codes >> 5], "unit offset") if codes >> 5 else at
            n = c.uint(long[codes >> 2 & 7], "unit size")
            units.append((at, n))
            at += n
    out = []
    for at, n in units:
        if at + n > len(data):
            raise ValueError("MalformedInput: compressed unit out of bounds")
        try:
            out.append(zlib.decompress(data[at : at + n], 15 if kind == b"zlib" else -15))
        except zlib.error as e:
            raise ValueError("MalformedInput: compressed data") from e
    return b"".join(out)


def _samples(data: bytes, at: int, n: int, depths: list[int], little: bool) -> tuple[np.ndarray, int]:
    """n times the components of the depths given, packed from a byte on: (n, components), and where the next byte is."""
    bits = n * sum(depths)
    end = at + -(-bits // 8)
    if end > len(data):
        raise ValueError("MalformedInput: payload too short")
    if set(depths) == {8}:
        return np.frombuffer(data, np.uint8, n * len(depths), at).reshape(n, -1).astype(np.int64), end
    if set(depths) == {16}:
        return np.frombuffer(data, "<u2" if little else ">u2", n * len(depths), at).reshape(n, -1).astype(np.int64), end
    if little:
        raise ValueError("UnsupportedFeature: little-endian packed samples")
    flat = np.unpackbits(np.frombuffer(data, np.uint8, end - at, at))[:bits].reshape(n, sum(depths)).astype(np.int64)
    out, first = [], 0
    for depth in depths:
        out.append(flat[:, first : first + depth] @ (1 << np.arange(depth - 1, -1, -1)))
        first += depth
    return np.stack(out, 1), end


def uncompressed(data: bytes, o: dict) -> tuple[np.ndarray, list[int]]:
    """(height, width, components) of a layout: tiles by rows, rows from whole bytes; planes, pixels or rows interleaved."""
    w, h, depths = o["width"] // o["columns"], o["height"] // o["rows"], o["depths"]
    out, at = np.zeros((o["height"], o["width"], len(depths)), np.int64), 0

    def row(groups: list[int]) -> np.ndarray:
        nonlocal at
        values, end = _samples(data, at, w, groups, o["little"])
        at = end if not o["row_align"] else at + -(-(end - at) // o["row_align"]) * o["row_align"]
        return values

    for ty in range(o["rows"]):
        for tx in range(o["columns"]):
            start = at
            tile = out[ty * h : (ty + 1) * h, tx * w : (tx + 1) * w]
            if o["interleave"] == 1 and set(depths) == {8} and not o["row_align"]:
                values, at = _samples(data, at, w * h, depths, False)
                tile[:] = values.reshape(h, w, -1)
            elif o["interleave"] == 1:
                for y in range(h):
                    tile[y] = row(depths)
            else:
                places = ((k, y) for k in range(len(depths)) for y in range(h)) if o["interleave"] == 0 else ((k, y) for y in range(h) for k in range(len(depths)))
                for k, y in places:
                    tile[y, :, k] = row(depths[k : k + 1])[:, 0]
            if o["tile_align"]:
                at = start + -(-(at - start) // o["tile_align"]) * o["tile_align"]
    return out, depths


def to_rgba(samples: np.ndarray, o: dict) -> np.ndarray:
    """(height, width, 4) of 8 bits: mono counts as grey, a missing alpha is opaque, other depths keep their place in the range."""
    channels = o["channels"]
    if "?" in channels or not ({"r", "g", "b"} <= set(channels) or "l" in channels or channels == "y" or {"y", "u", "v"} <= set(channels)):
        raise ValueError("UnsupportedFeature: component types")
    plane = {}
    for k, (c, depth) in enumerate(zip(channels, o["depths"])):
        v = samples[:, :, k]
        plane[c] = v if depth == 8 else (v * 255 + ((1 << depth) - 1) // 2) // ((1 << depth) - 1)
    if {"y", "u", "v"} <= set(channels):
        plane |= dict(zip("rgb", np.moveaxis(rgb_of(plane["y"], plane["u"], plane["v"], 6, True), 2, 0)))
    grey = plane.get("l", plane.get("y"))
    out = np.full((*samples.shape[:2], 4), 255, np.uint8)
    for i, c in enumerate("rgba"):
        if c in plane or c != "a" and grey is not None:
            out[:, :, i] = plane.get(c, grey)
    return out


# Coded pictures


def rgb_of(y: np.ndarray, cb: np.ndarray, cr: np.ndarray, matrix: int, full_range: bool) -> np.ndarray:
    """(height, width, 3) of 8-bit planes of one size by integer arithmetic, as pixels.rgb."""
    cb, cr = cb - 128, cr - 128
    if matrix == 0:
        return np.clip(np.stack([cr + 128, y, cb + 128], 2), 0, 255)
    table = P.FULL if full_range else P.LIMITED
    r, gb, gr, b = table.get(matrix, table[6])
    base, shift = (y << 8, 8) if full_range else ((y - 16) * P.LIMITED_LUMA, 13)
    half = 1 << (shift - 1)
    return np.clip(np.stack([(base + t + half) >> shift for t in (r * cr, gb * cb + gr * cr, b * cb)], 2), 0, 255)


def hevc_stream(config: bytes, payload: bytes) -> bytes:
    """A stream of a configuration record's parameter sets and an item's payload, with lengths of four bytes."""
    if len(config) < 23 or config[0] != 1:
        raise ValueError("MalformedInput: hvcC")
    nals = [nal for _, _, _, nal in B._hvcc_nals(config)]
    nals += C.split_lengths(payload, (config[21] & 3) + 1)
    return b"".join(len(n).to_bytes(4, "big") + n for n in nals)


def colour_of(properties: list[tuple]) -> tuple[int, bool] | None:
    """(matrix, full range) of the last nclx or nclc; none for the undefined one."""
    out = None
    for _, kind, _, b in properties:
        if kind == "colr" and b[:4] in (b"nclx", b"nclc") and len(b) >= 10 + (b[:4] == b"nclx"):
            primaries, transfer, matrix = struct.unpack_from(">HHH", b, 4)
            full = b[10] >= 128 if b[:4] == b"nclx" else matrix == 0
            out = None if (primaries, transfer, matrix, full) == (2, 2, 2, True) else (matrix, full)
    return out


def coded_planes(g: I.FileGraph, item: int, most: int) -> tuple[list[np.ndarray], dict]:
    """The filtered and cropped planes of an HEVC item, and its SPS."""
    properties = g.properties(item)
    width, height = size_of(properties)
    if width * height > most:
        raise ValueError("ResourceLimit: too many pixels")
    config = one(properties, "hvcC")
    _, payload, error = g.payload(item)
    if error:
        raise ValueError(f"MalformedInput: {error}")
    pic = H.decode_picture(hevc_stream(config, payload))
    if pic.s["width"] * pic.s["height"] > 4 * most:
        raise ValueError("ResourceLimit: too many coded pixels")
    return H.cropped(pic.filtered(), pic.s), pic.s


def coded_rgba(planes: list[np.ndarray], s: dict, colour: tuple[int, bool] | None) -> np.ndarray:
    own = s.get("colour", {})
    matrix, full = colour or (own.get("matrix", 6), bool(own.get("full_range", 0)))
    y, *chroma = (p.astype(np.int64) >> (s["bit_depth_luma"] - 8) for p in planes)
    h, w = y.shape
    if chroma:
        sx, sy = (2 if s["chroma_format"] in (1, 2) else 1), (2 if s["chroma_format"] == 1 else 1)
        cb, cr = (c.repeat(sy, 0).repeat(sx, 1)[:h, :w] for c in chroma)
    else:
        cb = cr = np.full((h, w), 128, np.int64)
    out = np.full((h, w, 4), 255, np.uint8)
    out[:, :, :3] = rgb_of(y, cb, cr, matrix, full)
    return out


def item_rgba(g: I.FileGraph, most: int) -> np.ndarray:
    """The primary item's pixels before its transforms: uncompressed, coded, or a grid of coded tiles pasted in order."""
    item, kind, properties = g.primary, g.type_of(g.primary), g.properties(g.primary)
    if kind in I.HEVC_TYPES:
        image = coded_rgba(*coded_planes(g, item, most), colour_of(properties))
    elif kind == "unci":
        o = layout_of(properties)
        if o["width"] * o["height"] > most:
            raise ValueError("ResourceLimit: too many pixels")
        _, payload, error = g.payload(item)
        if error:
            raise ValueError(f"MalformedInput: {error}")
        return to_rgba(uncompressed(unpacked(payload, properties), o)[0], o)
    elif kind == "grid":
        image = grid_rgba(g, most)
    else:
        raise ValueError(f"UnsupportedFeature: item type {kind}")
    alpha = alpha_of(g, most)
    if alpha is not None and alpha.shape == image.shape[:2]:  # one of another size, or a grid of its own, is ignored
        image[:, :, 3] = alpha
    return image


def grid_rgba(g: I.FileGraph, most: int) -> np.ndarray:
    _, data, error = g.payload(g.primary)
    if error or len(data) < 8 or data[0] or data[1] & 1 and len(data) < 12:
        raise ValueError(f"MalformedInput: {error or 'grid descriptor'}")
    rows, columns = data[2] + 1, data[3] + 1
    width, height = struct.unpack_from(">II" if data[1] & 1 else ">HH", data, 4)
    tiles = g.tiles()
    if len(tiles) != rows * columns:
        raise ValueError("MalformedInput: tile count")
    if any(g.type_of(t) not in I.HEVC_TYPES for t in tiles):
        raise ValueError("UnsupportedFeature: tile type")
    if width * height > most:
        raise ValueError("ResourceLimit: too many pixels")
    colour = colour_of(g.properties(g.primary)) or colour_of(g.properties(tiles[0]))
    out = th = tw = None
    for k, tile in enumerate(tiles):
        own = coded_rgba(*coded_planes(g, tile, most), colour)
        if out is None:  # the first tile sets the geometry
            th, tw = own.shape[:2]
            if tw * columns < width or th * rows < height:
                raise ValueError("MalformedInput: tiles don't cover the grid")
            out = np.zeros((height, width, 4), np.uint8)
        if own.shape[:2] != (th, tw):
            raise ValueError("MalformedInput: tile size")
        y, x = k // columns * th, k % columns * tw
        if y < height and x < width:
            out[y : y + th, x : x + tw] = own[: height - y, : width - x]
    return out


def alpha_of(g: I.FileGraph, most: int) -> np.ndarray | None:
    """The samples of the first coded auxiliary item that says it is the primary item's alpha."""
    for kind, source, _, to in g.edges:
        if kind == "auxl" and to == g.primary and g.type_of(source) in I.HEVC_TYPES:
            about = next((p[3][4:] for p in g.properties(source) if p[1] == "auxC"), b"")
            if about.split(b"\0")[0] in ALPHA:
                planes, s = coded_planes(g, source, most)
                return planes[0] >> (s["bit_depth_luma"] - 8)
    return None


def clean_aperture(image: np.ndarray, b: bytes) -> np.ndarray:
    """The part of an image that a clap property leaves: its size, around the centre moved by its offsets, in whole samples."""
    if len(b) < 32:
        raise ValueError("MalformedInput: clap")
    wn, wd, hn, hd, xn, xd, yn, yd = struct.unpack_from(">IIIIiIiI", b)
    if not wd or not hd or not xd or not yd or not wn or not hn:
        raise ValueError("MalformedInput: clap")
    height, width = image.shape[:2]
    w, h = wn // wd, hn // hd
    left = (2 * xn * wd + (width - 1) * xd * wd - (wn - wd) * xd) // (2 * xd * wd)
    top = (2 * yn * hd + (height - 1) * yd * hd - (hn - hd) * yd) // (2 * yd * hd)
    if left < 0 or top < 0 or not w or not h or left + w > width or top + h > height:
        raise ValueError("MalformedInput: clap leaves the image")
    return image[top : top + h, left : left + w]


def transformed(image: np.ndarray, properties: list[tuple]) -> np.ndarray:
    """Crops, rotations (counter-clockwise) and mirrors in association order."""
    for _, kind, _, b in properties:
        if kind == "irot" and b:
            image = np.rot90(image, b[0] & 3)
        elif kind == "imir" and b:
            image = image[:, ::-1] if b[0] & 1 else image[::-1]
        elif kind == "clap":
            image = clean_aperture(image, b)
    return image


def moved(properties: list[tuple]) -> bool:
    """Whether a container turns or mirrors its image, which hides the EXIF orientation; a rotation by 0 doesn't."""
    return any(kind == "imir" or kind == "irot" and b and b[0] & 3 for _, kind, _, b in properties)


def orientation_of(exif: bytes | None) -> int | None:
    """EXIF orientation 1 to 8 of an item's payload: an offset, then TIFF in either byte order."""
    if not exif or len(exif) < 4:
        return None
    tiff = exif[4 + int.from_bytes(exif[:4], "big") :]
    end = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        if end is None or struct.unpack_from(end + "H", tiff, 2)[0] != 42:
            return None
        at = struct.unpack_from(end + "I", tiff, 4)[0]
        for k in range(struct.unpack_from(end + "H", tiff, at)[0]):
            tag, kind, _ = struct.unpack_from(end + "HHI", tiff, at + 2 + 12 * k)
            if tag == 0x0112 and kind == 3:
                v = struct.unpack_from(end + "H", tiff, at + 10 + 12 * k)[0]
                return v if 1 <= v <= 8 else None
    except struct.error:
        pass
    return None


def upright(image: np.ndarray, orientation: int | None) -> np.ndarray:
    """The image as its EXIF orientation means it; 1 or none leaves it."""
    if orientation in (5, 6, 7, 8):
        image = image.transpose(1, 0, 2)
    flip = {2: (1,), 3: (0, 1), 4: (0,), 6: (1,), 7: (0, 1), 8: (0,)}.get(orientation, ())
    return np.flip(image, flip) if flip else image


def png(image: np.ndarray) -> bytes:
    """A PNG file of (height, width, 4) 8-bit samples."""
    height, width, _ = image.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(image).reshape(height, -1)], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode_file(data: bytes, most: int = MAX_PIXELS) -> tuple[np.ndarray, int | None]:
    """A file's image (height, width, 4) with its transforms, and the EXIF orientation that is left to apply. ValueError: category and reason."""
    g = I.FileGraph(data)
    if error := g.error():
        raise ValueError(f"MalformedInput: {error}")
    properties = g.properties(g.primary)
    image = transformed(item_rgba(g, most), properties)
    exif = g.described_by("Exif")
    return image, None if moved(properties) or exif is None else orientation_of(g.payload(exif)[1])


_OUT = "width int, height int, orientation int, rgba binary, png binary, error string"


def _decode_batches(batches, most, as_png):
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string())
    for batch in batches:
        for i, data in enumerate(batch.column(1).to_pylist()):
            try:
                image, orientation = decode_file(data or b"", most)
                row = (image.shape[1], image.shape[0], orientation, image.tobytes(), png(image) if as_png else None, None)
            except (ValueError, struct.error, IndexError) as e:
                why = str(e) if isinstance(e, ValueError) else "syntax out of range"
                row = (*(None,) * 5, why if ": " in why and why.split(": ")[0].isalpha() else f"MalformedInput: {why}")
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *(pa.array([c], t) for c, t in zip(row, types))], names=["file_id", "width", "height", "orientation", "rgba", "png", "error"])


def decode(files: DataFrame, max_pixels: int = MAX_PIXELS, as_png: bool = True) -> DataFrame:
    """(file_id, width, height, orientation, rgba, png, error) of files (file_id, content).

    Primary items may be uncompressed, HEVC coded, or grids of HEVC tiles. Container transforms are applied in order; if
    one turns or mirrors, it hides the EXIF orientation, which is told but not applied. The pixel limit holds before
    anything is decoded. A file that can't be decoded is a row with an error whose first word is its category: AV1 is an
    UnsupportedFeature. Each file is read and decoded by the task that has it, one image at a time.
    """
    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "content").mapInArrow(partial(_decode_batches, most=max_pixels, as_png=as_png), f"file_id {kind}, {_OUT}")


def _stream_batches(batches):
    for batch in batches:
        streams, errors = [], []
        for data in batch.column(1).to_pylist():
            g = I.FileGraph(data or b"")
            try:
                if error := g.error():
                    raise ValueError(f"MalformedInput: {error}")
                if g.type_of(g.primary) not in I.HEVC_TYPES:
                    raise ValueError(f"UnsupportedFeature: item type {g.type_of(g.primary)}")
                _, payload, error = g.payload(g.primary)
                if error:
                    raise ValueError(f"MalformedInput: {error}")
                streams.append(hevc_stream(one(g.properties(g.primary), "hvcC"), payload))
                errors.append(None)
            except ValueError as e:
                streams.append(None)
                errors.append(str(e))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(streams, pa.binary()), pa.array(errors, pa.string())], names=["file_id", "stream", "error"])


def coded_streams(files: DataFrame) -> DataFrame:
    """(file_id, stream, error): the primary HEVC item of each file as a stream, its parameter sets first, lengths of four bytes."""
    return files.select("file_id", "content").mapInArrow(_stream_batches, f"file_id {files.schema['file_id'].dataType.simpleString()}, stream binary, error string")


def rgb8(decoded: DataFrame) -> DataFrame:
    """decode()'s rows with rgb instead of rgba: alpha is left out."""
    digits = F.hex("rgba")
    return decoded.withColumn("rgb", F.unhex(F.regexp_replace(digits, "(.{6})..", "$1"))).drop("rgba")


def _layout_batches(batches):
    for batch in batches:
        rows = []
        for properties in batch.column("properties").to_pylist():
            own = [(p["assoc_pos"], p["prop_type"], p["essential"], p["prop"]) for p in properties or []]
            try:
                o = layout_of(own)
                rows.append((o["width"], o["height"], o["channels"], o["depths"], o["interleave"], o["columns"], o["rows"], None))
            except ValueError as e:
                rows.append((*(None,) * 7, str(e)))
        types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64(), pa.string())
        columns = list(zip(*rows)) if rows else [()] * 8
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["file_id", "width", "height", "channels", "depths", "interleave", "tile_columns", "tile_rows", "error"])


def uncompressed_properties(resolved: DataFrame) -> DataFrame:
    """(file_id, width, height, channels, depths, interleave, tile_columns, tile_rows, error) of resolve_primary's uncompressed items, checked as layout_of does."""
    kind = resolved.schema["file_id"].dataType.simpleString()
    rows = resolved.where("item_type = 'unci'").select("file_id", "properties")
    return rows.mapInArrow(_layout_batches, f"file_id {kind}, width long, height long, channels string, depths array<int>, interleave int, tile_columns long, tile_rows long, error string")
