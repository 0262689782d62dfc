import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterquarry import cli
from rasterquarry.operators import host, images
from rasterquarry.operators import items as I
from rasterquarry.plans import images as made
from rasterquarry.sources import files as S
from rasterquarry.sources import heif
from rasterquarry.streaming import spool

from . import wire


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.heic", made.coded_file(1)), ("b.heif", made.unci_file(2)), ("c.avif", wire.container(kind="av01")), ("d.heic", b"no image"), ("e.png", b"x"), ("f.heic", made.unci_file(0) + bytes(4000))):
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path


def test_data_source(spark, folder):
    name = host.register(spark, max_input_bytes=3000)
    got = {r.file_id.rsplit("/", 1)[1]: r for r in spark.read.format(name).load(str(folder / "in")).collect()}
    assert set(got) == {"a.heic", "b.heif", "c.avif", "d.heic", "f.heic"}
    image, _ = images.decode_file(made.coded_file(1))
    assert bytes(got["a.heic"].rgba) == image.tobytes() and (got["a.heic"].width, got["a.heic"].height) == (16, 8)
    assert got["b.heif"].error is None and got["c.avif"].error.startswith("UnsupportedFeature") and got["d.heic"].error.startswith("MalformedInput") and got["f.heic"].error.startswith("ResourceLimit")
    told = spark.read.format(name).option("metadata_only", "true").option("max_input_bytes", "1000000").load(str(folder / "in"))
    assert "rgba" not in told.columns and {r.width for r in told.collect() if r.error is None} >= {16}
    one = spark.read.format(name).option("max_pixels", "5").load(str(folder / "in" / "a.heic")).first()
    assert one.error.startswith("ResourceLimit")


def test_spans_of_files(folder):
    path = str(folder / "in" / "b.heif")
    data = open(path, "rb").read()
    assert heif.read_span(path, 4, 4) == b"ftyp" and heif.read_span(path, len(data), 0) == b""
    assert heif.gather_span(path, [(8, 4), (0, 0), (4, 4)]) == data[8:12] + data[4:8]
    for at, n in ((-1, 2), (len(data) - 1, 2), (0, -1), (1 << 62, 1)):
        with pytest.raises(ValueError, match="OutOfBounds"):
            heif.read_span(path, at, n)
    g = I.FileGraph(data)
    assert heif.gather_span(path, [(r[5], r[6]) for r in g.extents[1]]) == g.payload(1)[1]


def test_spooled_input(folder):
    data = bytes(range(256)) * 40
    path = heif.spooled(io.BytesIO(data), str(folder), len(data), block=1000)
    assert open(path, "rb").read() == data and path.startswith(str(folder))
    with pytest.raises(ValueError, match="ResourceLimit"):
        heif.spooled(io.BytesIO(data), str(folder), len(data) - 1, block=1000)
    assert len([p for p in folder.iterdir() if p.name.startswith("spool-")]) == 1


def test_standard_input_to_png(spark, folder, monkeypatch, capsys):
    class Stdin:
        buffer = io.BytesIO(made.coded_file(3))

    monkeypatch.setattr("sys.stdin", Stdin)
    assert cli.main(["-", str(folder / "out.png"), "--spool-dir", str(folder)]) == 0
    assert (folder / "out.png").read_bytes()[16:24] == (30).to_bytes(4, "big") + (7).to_bytes(4, "big")
    Stdin.buffer = io.BytesIO(made.coded_file(3))
    assert cli.main(["-", str(folder / "no.png"), "--spool-dir", str(folder), "--max-spool-bytes", "9"]) == 1
    assert "category=ResourceLimit" in capsys.readouterr().err and not [p for p in folder.iterdir() if p.name.startswith("spool-")]


def test_files_that_are_too_long_are_not_read(spark, folder):
    rows = S.read_images(spark, str(folder / "in"))
    out = S.limited(rows, 3000)
    assert {r.file_id.rsplit("/", 1)[1]: r.error for r in out.collect()}["f.heic"] == "ResourceLimit"
    assert "PushedFilters: [IsNotNull(length), LessThanOrEqual(length,3000)]" in out._jdf.queryExecution().executedPlan().toString()


def test_a_stream_of_files_is_spooled_once(spark, folder):
    target, checkpoint = str(folder / "out"), str(folder / "checkpoint")
    for _ in range(2):
        q = spool.spool(spool.image_stream(spark, str(folder / "in")), target, checkpoint, 3000).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.option("recursiveFileLookup", "true").parquet(target + "/files")
    assert got.count() == 5 and got.where("error IS NOT NULL").count() == 1


def test_direct_rgb_and_metadata(spark):
    rows = [(e, bytearray(made.turned_file(e))) for e in range(12)]
    files = spark.createDataFrame(rows, "file_id long, content binary")
    out = {r.file_id: r for r in images.rgb8(images.decode(files)).collect()}
    told = {r.file_id: r for r in host.metadata(files).collect()}
    for e, data in rows:
        image, orientation = images.decode_file(bytes(data))
        assert bytes(out[e].rgb) == np.ascontiguousarray(image[:, :, :3]).tobytes()
        assert told[e].orientation == orientation and (e % 6 == 5 or (told[e].width, told[e].height) == image.shape[1::-1])


def test_payloads_leave_no_shuffle(spark):
    c = I.open_container(spark.createDataFrame([(1, bytearray(made.coded_file(0)))], "file_id long, content binary"))
    for df in (I.resolve_primary(c), I.item_payloads(c), I.extract(c, ("hvc1",)), I.extract_grid(c), I.colour_properties(c), images.decode(c.files)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert host.error_kind(F.lit("Io: x")) is not None
