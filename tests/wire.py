"""Image containers written byte by byte, for tests."""

import struct


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind.encode() + body


def full(kind, version, flags, *parts):
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def u16(*v):
    return struct.pack(f">{len(v)}H", *v)


def u32(*v):
    return struct.pack(f">{len(v)}I", *v)


def infe(item, kind, name=b""):
    return full("infe", 2, 0, u16(item, 0), kind.encode(), name + b"\0")


def container(payload=bytes([10, 20, 30, 200, 150, 100]), width=2, height=1, props=(), exif=None, kind="unci", config=None, iref=b""):
    """An uncompressed 2 x 1 image, with more properties and an Exif item on demand."""
    config = config or full("uncC", 1, 0, b"rgb3")
    own = [full("ispe", 0, 0, u32(width, height)), config, *props]
    items = [(1, payload, infe(1, kind))] + ([(2, exif, infe(2, "Exif"))] if exif else [])
    ftyp = box("ftyp", b"mif1", u32(0), b"mif1")
    at, spans = len(ftyp) + 8, []
    for _, data, _ in items:
        spans.append((at, len(data)))
        at += len(data)
    mdat = box("mdat", *(x[1] for x in items))
    iloc = full("iloc", 1, 0, u16(0x4400, len(items)), *(u16(i, 0, 0) + u16(1) + u32(*span) for (i, _, _), span in zip(items, spans)))
    iinf = full("iinf", 0, 0, u16(len(items)), *(x[2] for x in items))
    if exif:
        iref = full("iref", 0, 0, box("cdsc", u16(2, 1, 1)))
    ipma = full("ipma", 0, 0, u32(1), u16(1), bytes([len(own), *range(1, len(own) + 1)]))
    meta = full("meta", 0, 0, full("pitm", 0, 0, u16(1)), iloc, iinf, iref, box("iprp", box("ipco", *own), ipma))
    return ftyp + mdat + meta


def tiff(orientation, end=">"):
    mark = b"MM" if end == ">" else b"II"
    return u32(0) + mark + struct.pack(end + "HI", 42, 8) + struct.pack(end + "HHHIHH", 1, 0x0112, 3, 1, orientation, 0) + struct.pack(end + "I", 0)
