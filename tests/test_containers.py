import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterquarry.functions import bytes as by
from rasterquarry.operators import boxes as B
from rasterquarry.operators import codec as C
from rasterquarry.operators import images, items, pixels
from rasterquarry.sources import files as S

from . import wire
from .wire import box, full, u16, u32


def table(spark, rows):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows], "file_id long, content binary")


def test_the_least_image(spark):
    r = images.decode(table(spark, [(1, wire.container())])).first()
    assert r.error is None and list(r.rgba) == [10, 20, 30, 255, 200, 150, 100, 255] and (r.width, r.height) == (2, 1)
    assert bytes(r.png[:8]) == b"\x89PNG\r\n\x1a\n"


def test_orientation_and_transforms(spark):
    rot = lambda k: (box("irot", bytes([k])),)
    rows = [(1, wire.container(exif=wire.tiff(6))), (2, wire.container(exif=wire.tiff(6), props=rot(1))), (3, wire.container(exif=wire.tiff(6, "<"), props=rot(0))), (4, wire.container(exif=wire.tiff(6, "<"))), (5, wire.container(props=(box("imir", b"\1"),)))]
    got = {r.file_id: r for r in images.decode(table(spark, rows)).collect()}
    assert {k: r.orientation for k, r in got.items()} == {1: 6, 2: None, 3: 6, 4: 6, 5: None}
    assert (got[2].width, got[2].height) == (1, 2) and list(got[2].rgba) == [200, 150, 100, 255, 10, 20, 30, 255]
    assert list(got[5].rgba)[:4] == [200, 150, 100, 255]


def test_bad_files_are_rows_with_errors(spark):
    good = wire.container()
    rows = [(1, good[:-3]), (2, b""), (3, None), (4, wire.container(kind="av01")), (9, wire.container(kind="hvc1")), (5, wire.container(payload=b"abc")), (6, good), (7, b"\0\0\0\1mdat"), (8, wire.container(config=full("uncC", 1, 0, b"zzzz")))]
    got = {r.file_id: r.error for r in images.decode(table(spark, rows)).collect()}
    assert got[6] is None and all(got[k] for k in got if k != 6) and set(got) == set(range(1, 10))
    assert got[4].startswith("UnsupportedFeature") and got[5].startswith("MalformedInput") and got[9] == "MalformedInput: missing hvcC"


def test_planar_components(spark):
    config = full("uncC", 0, 0, b"\0\0\0\0", u32(3), *(u16(i) + bytes([7, 0, 0]) for i in range(3)), bytes([0, 0, 0, 0]), u32(0, 0, 0, 0, 0))
    data = wire.container(config=config, props=(box("cmpd", u32(3), u16(6, 5, 4)),), payload=bytes([1, 2, 3, 4, 5, 6]))
    r = images.decode(table(spark, [(1, data)])).first()
    assert r.error is None and list(r.rgba) == [5, 3, 1, 255, 6, 4, 2, 255]


@pytest.mark.parametrize(
    "data, errors",
    [
        (b"\0\0\0\7free", ["size smaller than header"]),
        (b"\0\0\0\x20free", ["size beyond its parent"]),
        (b"\0\0\0", ["truncated box header"]),
        (b"\0\0\0\1free\0\0", ["truncated 64-bit size"]),
        (b"\0\0\0\1free" + (17).to_bytes(8, "big") + b"x", [None]),
        (b"\0\0\0\0free123", [None]),
        (b"\0\0\0\x18uuid" + b"0123456789abcdef", [None]),
        (b"\0\0\0\x10uuid12345678", ["truncated uuid"]),
        (b"\0\0\0\x08free\0\0\0\2skip", [None, "size smaller than header"]),
    ],
)
def test_box_headers(spark, data, errors):
    got = B.boxes(table(spark, [(1, data), (2, box("free"))])).collect()
    assert [r.error for r in got if r.file_id == 1] == errors and [r.error for r in got if r.file_id == 2] == [None]
    whole = table(spark, [(1, data)]).select(B.header(F.col("content"))["error"].alias("e")).first().e
    assert (whole is None) == (errors[0] is None)


def test_box_payload_errors(spark):
    tree = lambda kind, data: spark.createDataFrame([(1, 0, kind, None, bytearray(data))], "file_id long, off long, type string, error string, payload binary")
    for kind, data, why in (
        ("iloc", b"\3\0\0\0", "unsupported version"), ("iloc", b"\0\0\0\0\x34\0\0\1", "size field"), ("iloc", b"\2\0\0\0\x44\0\xff\xff\xff\xff", "truncated"), ("iref", full("iref", 0, 0, box("dimg", u16(1, 0)))[8:], "no references"),
        ("ipma", b"\2\0\0\0", "unsupported version"), ("uncC", b"\0\0\0\1rgb3", "truncated"), ("infe", b"\4\0\0\0", "unsupported version"), ("hvcC", b"\1", "truncated"),
    ):
        rows = B.rows_of(tree(kind, data), kind).collect()
        assert rows[-1].error and why in rows[-1].error, (kind, rows)


def test_colour_inheritance(spark):
    nclx = lambda *v: box("colr", b"nclx", u16(*v[:3]), bytes([v[3] << 7]))

    def grid(own, tile):
        props = [full("ispe", 0, 0, u32(1, 1)), *own, *tile]
        n, m = len(own), len(tile)
        ipma = full("ipma", 0, 0, u32(2), u16(1), bytes([1 + n, 1, *range(2, 2 + n)]), u16(2), bytes([m, *range(2 + n, 2 + n + m)]))
        iinf = full("iinf", 0, 0, u16(2), wire.infe(1, "grid"), wire.infe(2, "hvc1"))
        iloc = full("iloc", 1, 0, u16(0x4400, 1), u16(1, 0, 0, 1), u32(0, 8))
        return box("ftyp", b"mif1", u32(0)) + full("meta", 0, 0, full("pitm", 0, 0, u16(1)), iloc, iinf, full("iref", 0, 0, box("dimg", u16(1, 1, 2))), box("iprp", box("ipco", *props), ipma))

    none, one, two, icc = (2, 2, 2, 1), (1, 13, 6, 1), (9, 16, 9, 0), box("colr", b"prof", b"\7\7")
    cases = [([], [nclx(*one)], one, None), ([nclx(*two)], [nclx(*one)], two, None), ([nclx(*none)], [nclx(*one)], one, None), ([nclx(*none)], [nclx(*none)], None, None), ([icc], [nclx(*one)], one, b"\7\7"), ([nclx(*two)], [icc], two, b"\7\7"), ([nclx(*one), nclx(*two)], [], two, None), ([], [], None, None)]
    c = items.open_container(table(spark, [(k, grid(own, tile)) for k, (own, tile, _, _) in enumerate(cases)]))
    got = {r.file_id: r for r in items.colour_properties(c).collect()}
    for k, (_, _, nclx_, icc_) in enumerate(cases):
        have = got[k].nclx and (got[k].nclx.primaries, got[k].nclx.transfer, got[k].nclx.matrix, int(got[k].nclx.full_range))
        assert have == nclx_ and (got[k].icc and bytes(got[k].icc)) == icc_


def test_extents_out_of_bounds_and_methods(spark):
    data = wire.container()
    bad = data.replace(u32(28, 6), u32(28, 6000))
    assert bad != data
    c = items.open_container(table(spark, [(1, data), (2, bad)]))
    got = {r.file_id: r for r in items.item_payloads(c, c.pitm).collect()}
    assert bytes(got[1].payload) == bytes([10, 20, 30, 200, 150, 100]) and got[2].payload is None and got[2].error == "extent out of bounds"


def test_limits_and_detection(spark):
    rows = spark.createDataFrame([(1, 5, bytearray(b"12345")), (2, 3, bytearray(b"1234567")), (3, 3, bytearray(b"abc"))], "file_id long, length long, content binary")
    assert {r.file_id: r.error for r in S.limited(rows, 4).collect()} == {1: "ResourceLimit", 2: "ResourceLimit", 3: None}
    kinds = table(spark, [(1, b"\0\0\0\x18ftypavif"), (2, b"\0\0\0\x18ftypheic"), (3, b"\0\0\0\x18ftypmp42"), (4, b"x")])
    assert [r.f for r in kinds.orderBy("file_id").select(S.family(F.col("content")).alias("f")).collect()] == ["avif", "heif", None, None]


def test_files_as_a_stream(spark, tmp_path):
    from rasterquarry.streaming import spool

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.heic").write_bytes(wire.container())
    (tmp_path / "in/b.heic").write_bytes(b"x" * 9000)
    query = spool.spool(spool.image_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), 5000).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.error or "" for r in spark.read.parquet(str(tmp_path / "out/files")).collect()) == ["", "ResourceLimit"]
    assert spark.read.parquet(str(tmp_path / "out/boxes")).where("type = 'pitm'").count() == 1
    told = spool.described(S.read_images(spark, str(tmp_path / "in")), 5000).collect()
    assert sorted((r.family or "", r.error or "") for r in told) == [("", "ResourceLimit"), ("heif", "")]


def test_nal_errors(spark):
    rows = spark.createDataFrame([(1, bytearray(b"")), (2, bytearray(b"\0\0\0\x09\x40\x01")), (3, bytearray(b"\0\0\0\2\xc0\1\0\0\0\2\x40\0")), (4, bytearray(b"\0\0\1\x40\1\7\0\0\1\x42\1"))], "item long, stream binary")
    got = [(r.item, r.type, r.error) for r in C.nal_units(rows).collect()]
    assert sorted(got, key=str) == [(1, None, "empty stream"), (2, None, "NAL length beyond the stream"), (4, 32, None), (4, 33, None)]


def test_transforms_of_single_coefficients():
    c = np.zeros((1, 8, 8), int)
    c[0, 0, 0] = 64
    assert (pixels.inverse_transform(c) == 1).all()
    m = pixels.BASIS
    for size in (4, 8, 16, 32):
        b = m[:: 32 // size, :size].astype(int)
        gram = b @ b.T
        assert (np.abs(gram - np.diag(np.diag(gram))) < 250 * size / 4).all() and (b[0] == 64).all()


def test_prediction_of_a_flat_border_is_flat():
    for size in (4, 8, 16, 32):
        border = np.full((2, 4 * size + 1), 77)
        for mode in range(35):
            assert (pixels.predict(border, mode, size) == 77).all()


def test_exp_golomb_codes(spark):
    codes = [("1", 0, 0), ("010", 1, 1), ("011", 2, -1), ("00100", 3, 2), ("00101", 4, -2), ("000", None, None), ("0010", None, None)]
    df = spark.createDataFrame([(c,) for c, _, _ in codes], "c string")
    assert [(r.u, r.s) for r in df.select(by.ue_bits(F.col("c")).alias("u"), by.se_bits(F.col("c")).alias("s")).collect()] == [(u, s) for _, u, s in codes]
