"""Image files and planes derived from the events table, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def u(value, n: int) -> Column:
    """n bytes of an integer as hex digits."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.lpad(F.hex(value.cast("long")), 2 * n, "0")


def text(s: str) -> Column:
    return F.lit(s.encode().hex().upper())


def box(kind: str, *parts: Column) -> Column:
    body = F.concat(*parts) if parts else F.lit("")
    return F.concat(u(F.length(body) / 2 + 8, 4), text(kind), body)


#: The item type of a file's primary item by event_id % 4.
TYPES = ("hvc1", "av01", "unci", "grid")


def heif_files(events: DataFrame) -> DataFrame:
    """(file_id, content): a small image container for each event, whose fields all follow from event_id.

    ftyp, an mdat with 16 bytes, and a meta box with pitm, iloc (the primary item in two extents of the file, or in
    idat for grids), iinf with three items, iref (dimg for grids, cdsc else), ipco with ispe, pixi, colr, irot, imir,
    the codec's configuration, and ipma.
    """
    forms = [_form(k) for k in range(4)]
    e = F.col("event_id")
    text = F.printf(F.element_at(F.array(*map(F.lit, forms)), (e % 4 + 1).cast("int")), *(F.expr(v) for v in FIELDS.values()))
    return events.select(e.alias("file_id"), F.unhex(text).alias("content"))


#: What the bytes of a file take from its event. One text is formatted from them a file: sizes are known beforehand, so no part is built twice to be measured.
FIELDS = {
    "e": "event_id", "next": "event_id * 3 + 1", "brand": "event_id % 3", "item": "event_id % 5 + 1", "item10": "event_id % 5 + 11", "item20": "event_id % 5 + 21", "e8": "event_id % 8",
    "grid_width": "event_id % 100 + 1", "grid_height": "event_id % 50 + 1", "width": "event_id % 640", "height": "event_id % 480 + 1", "depth": "event_id % 3 + 8",
    "primaries": "event_id % 10", "transfer": "event_id % 9", "full": "IF(event_id % 3 = 0, 128, 0)", "turn": "event_id % 4", "mirror": "event_id % 2",
    "e256": "event_id % 256", "e128": "event_id % 128", "e7": "event_id % 7", "level": "event_id % 200", "chroma": "252 + event_id % 4", "luma_depth": "248 + event_id % 3", "chroma_depth": "248 + event_id % 2",
}


def _form(kind: int) -> str:
    """A file's hex digits as a format of FIELDS, for one event_id % 4."""
    number = {name: k for k, name in enumerate(FIELDS, 1)}

    def n(value: int | str, width: int) -> tuple[str, int]:
        return (f"{value:0{2 * width}X}" if isinstance(value, int) else f"%{number[value]}$0{2 * width}X"), width

    def t(s: str) -> tuple[str, int]:
        return s.encode().hex().upper(), len(s)

    def box(what: str, *parts: tuple[str, int]) -> tuple[str, int]:
        size = 8 + sum(p[1] for p in parts)
        return "".join(p[0] for p in (n(size, 4), t(what), *parts)), size

    def infe(item: str, what: str) -> tuple[str, int]:
        return box("infe", n(2, 1), n(0, 3), n(item, 2), n(0, 2), t(what), t("n"), n(0, 1))

    pitm = box("pitm", n(1, 1), n(0, 3), n("item", 4)) if kind % 2 else box("pitm", n(0, 4), n("item", 2))
    extents = (n("item", 2), n(1, 2), n(0, 2), n(0, 4), n(1, 2), n(0, 4), n(8, 4)) if kind == 3 else (n("item", 2), n(0, 2), n(0, 2), n(32, 4), n(2, 2), n(4, 4), n(4, 4), n(8, 4), n("e8", 4))
    iloc = box("iloc", n(1, 1), n(0, 3), n(0x4440, 2), n(1, 2), *extents)
    iinf = box("iinf", n(0, 4), n(3, 2), infe("item", TYPES[kind]), infe("item10", "hvc1"), infe("item20", "hvc1"))
    edge = box("dimg", n("item", 2), n(2, 2), n("item10", 2), n("item20", 2)) if kind == 3 else box("cdsc", n("item10", 2), n(1, 2), n("item", 2))
    av1c = box("av1C", n(0x81, 1), n("e256", 1), n("e128", 1), n(0, 1), n("e7", 1))
    hvcc = box("hvcC", n(1, 1), n("e256", 1), n(0, 10), n("level", 1), n(0, 3), n("chroma", 1), n("luma_depth", 1), n("chroma_depth", 1), n(0, 2), n(3, 1), n(1, 1), n(0xA1, 1), n(2, 2), n(2, 2), n(0x4201, 2), n(0, 2))
    colr = box("colr", t("nclx"), n("primaries", 2), n("transfer", 2), n("e8", 2), n("full", 1))
    pixi = box("pixi", n(0, 4), n(3, 1), n(8, 1), n(8, 1), n("depth", 1))
    props = [box("ispe", n(0, 4), n("width", 4), n("height", 4)), pixi, colr, box("irot", n("turn", 1)), box("imir", n("mirror", 1)), av1c if kind == 1 else hvcc]
    ipma = box("ipma", n(0, 4), n(2, 4), n("item", 2), n(6, 1), *(n(x, 1) for x in (1, 0x82, 3, 6, 5, 4)), n("item10", 2), n(2, 1), n(3, 1), n(6, 1))
    idat = box("idat", n(0, 1), n(0, 1), n(0, 1), n(1, 1), n("grid_width", 2), n("grid_height", 2))
    meta = box("meta", n(0, 4), pitm, iloc, iinf, box("iref", n(0, 4), edge), box("iprp", box("ipco", *props), ipma), idat)
    return "".join(p[0] for p in (box("ftyp", t("mif1"), n("brand", 4), t("heic"), t("mif1")), box("mdat", n("e", 8), n("next", 8)), meta))


WIDTH, HEIGHT = 25, 16
PIXELS = WIDTH * HEIGHT


def pixels(events: DataFrame) -> DataFrame:
    """(img, x, y, v, cb, cr): 25 x 16 images of 8-bit samples, 400 events each by event_id, so no shuffle deals them out."""
    e, w = F.col("event_id"), F.col("user_id")
    at = e % PIXELS
    return events.select(
        F.floor(e / PIXELS).cast("long").alias("img"), (at % WIDTH).cast("int").alias("x"), F.floor(at / WIDTH).cast("int").alias("y"),
        ((e * 7919 + w * 104729) % 256).cast("int").alias("v"), ((e * 31 + w * 17) % 256).cast("int").alias("cb"), ((e * 57 + w * 13) % 256).cast("int").alias("cr"),
    )


PIXELS_SQL = """px AS (
  SELECT (event_id // 400)::BIGINT AS img, (event_id % 400 % 25)::INT AS x, (event_id % 400 // 25)::INT AS y,
         ((event_id * 7919 + user_id * 104729) % 256)::INT AS v, ((event_id * 31 + user_id * 17) % 256)::INT AS cb, ((event_id * 57 + user_id * 13) % 256)::INT AS cr
  FROM events)"""
