"""What keeps time and memory of the queries from growing faster than their input."""

import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterquarry.operators import boxes as B
from rasterquarry.operators import codec as C
from rasterquarry.operators import host
from rasterquarry.plans import container, fixtures, registered
from rasterquarry.plans import hevc as PH
from rasterquarry.plans import images as PI
from rasterquarry.plans import streams as S

SF = "/root/testdata/sf0.001"
QUERIES = registered()[0]


def plan(spark, name: str) -> str:
    return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def built(n: int) -> pa.RecordBatch:
    return next(PI._file_batches([pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64())], names=["file_id"])], "turned"))


# the step that makes and reads files


def test_a_file_is_formatted_once(spark):
    text = container.files(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("lpad(") == 0 and len(text) < 20_000


def test_a_scan_gives_only_what_is_asked_for():
    batch = built(3)
    for kind in ("infe", "ipma", "iinf"):
        got = pa.Table.from_batches(B._scan_batches([batch], "file_id", (kind,), None))
        assert set(got.column("type").to_pylist()) == {kind}
    inner = pa.Table.from_batches(B._scan_batches([batch], "file_id", None, ("ipco",)))
    assert "ispe" in inner.column("type").to_pylist() and "ipco" not in inner.column("type").to_pylist()


def test_batches_are_read_in_steps():
    batch = pa.RecordBatch.from_arrays([pa.array(range(2500), pa.int64()), pa.array([b""] * 2500)], names=["file_id", "content"])
    assert max(b.num_rows for b in host._metadata_batches([batch])) <= B.STEP
    made = list(PI._file_batches([batch.select(["file_id"])], "turned"))
    assert len(made) == 3 and sum(b.num_rows for b in made) == 2500


@pytest.mark.parametrize("name", ["dec_iinf", "dec_ipco", "slice_hdr"])
def test_no_join(spark, name):
    assert "Join" not in plan(spark, name)


def test_declared_items_of_each_list(spark):
    files = spark.createDataFrame([(0,)], "event_id long")
    assert fixtures.heif_files(files).count() == 1
    rows = {r.file_id: (r.declared, r.found) for r in QUERIES["dec_iinf"](spark, SF).collect()}
    assert len(rows) > 900 and set(rows.values()) == {(3, 3)}


@pytest.mark.parametrize("name, unread", [("extract_grid", "references"), ("transform_list", "references"), ("props_avif", "references"), ("resolve_heic", "references"), ("extract_heic", "references"), ("grid_tile_props", "references"), ("resolve_primary", "tile_properties"), ("color_inherit", "lambda")])
def test_graphs_read_only_what_a_query_needs(spark, name, unread):
    assert unread not in plan(spark, name)


# parameter sets


def test_reads_of_a_long_payload_take_as_long_as_of_a_short_one():
    def seconds(n):
        r = C.Bits(b"\xff\x35" * (n // 2))
        r.at = 8 * n - 10_000
        began = time.perf_counter()
        for _ in range(500):
            r.ue(), r.u(3)
        return time.perf_counter() - began

    assert seconds(4_000_000) < 20 * max(seconds(4_000), 1e-3)


def test_signed_codes_at_once():
    values = [0, 1, -1, 127, -128, 5, 0, -3] * 8
    data = S.BitWriter().u(3, 5).se(*values).closed()
    r = C.Bits(data)
    r.u(3)
    assert r.ses(len(values)) == values
    for cut in (5, 20, len(data) - 2):
        short = C.Bits(data[:cut])
        short.u(3)
        with pytest.raises(ValueError, match="out of bits"):
            short.ses(len(values))


def test_parameter_sets_are_dealt_to_all_cores(spark):
    assert PH.sps_rows(spark, SF, "lists").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert QUERIES["ps_sps"](spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_a_bit_string_is_not_rebuilt_for_each_byte(spark):
    assert "sequence(" not in plan(spark, "ps_sps")


def test_last_sets_and_missing_ones_of_slices(spark):
    sps, pps = S.parameter_sets(16, 16, S.DEFAULTS)
    head = S.BitWriter().u(1, 1).u(1, 0).ue(0, 2).se(3).closed()
    schema = "item long, pos int, type int, layer int, payload binary"
    rows = [(1, 0, 33, 0, b"\0"), (1, 1, 33, 0, sps), (1, 2, 34, 0, pps), (1, 3, 19, 0, head), (1, 4, 20, 0, head), (1, 5, 19, 1, head), (2, 0, 33, 0, sps), (2, 1, 33, 0, b"\0"), (2, 2, 34, 0, pps), (2, 3, 19, 0, head), (3, 0, 19, 0, head), (4, 0, 33, 0, sps), (None, 0, 33, 0, sps), (None, 1, 34, 0, pps), (None, 2, 19, 0, head)]
    got = C.slice_headers(spark.createDataFrame(rows, schema).withColumn("pos", F.col("pos"))).select("item", "qp", "error").collect()
    missing = "missing parameter set"
    assert sorted(map(str, got)) == sorted(str(type(got[0])(item=i, qp=q, error=e)) for i, q, e in [(1, 29, None), (1, 29, None), (2, None, missing), (3, None, missing), (None, None, missing)])


# pictures


@pytest.mark.parametrize("form", [0, 1, 2], ids=["mode_store", "cu", "tt_chroma"])
def test_few_pictures_are_held_at_once(form):
    sample = [{"at": 0, "v": 1, "cb": 2, "cr": 3}]
    kind = pa.list_(pa.struct([(k, pa.int32()) for k in ("at", "v", "cb", "cr")]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array([sample] * 40, kind)], names=["item", "samples"])
    first = next(PH._write_batches([batch], {"format": form}))
    assert 0 < first.num_rows <= 16


# rows of boxes, read in one step in their usual form


def test_associations_of_both_widths():
    narrow = bytes([0, 0, 0, 0]) + (2).to_bytes(4, "big") + bytes([0, 7, 2, 0x81, 5, 1, 0, 0])
    assert list(B._ipma(narrow)) == [(7, 0, 1, True), (7, 1, 5, False)]
    wide = bytes([1, 0, 0, 1]) + (1).to_bytes(4, "big") + bytes([0, 1, 0, 0, 2, 0x80, 3, 0x01, 0x02])
    assert list(B._ipma(wide)) == [(65536, 0, 3, True), (65536, 1, 258, False)]
    for data in (narrow[:-6], wide[:-1]):
        with pytest.raises(ValueError, match="truncated association"):
            list(B._ipma(data))


def test_associations_leave_a_scan_alone():
    assert set(next(B._scan_batches([built(2)], "file_id", ("ipma",), None)).column("type").to_pylist()) == {"ipma"}


def test_item_entries_in_all_forms():
    def rows(data):
        return list(B._infe(bytes([2, 0, 0, 1, 0, 9, 0, 0]) + data))

    assert rows(b"hvc1name\0rest") == [(9, "hvc1", "name", None, None, None, True)] == rows(b"hvc1name")
    assert rows(b"hvc1") == [(9, "hvc1", "", None, None, None, True)] == rows(b"hvc1\0")
    assert rows(b"\xff\xfe\xfd\xfcn\xff") == [(9, "fffefdfc", "n�", None, None, None, True)]
    assert rows(b"mimen\0text/a\0gzip\0") == [(9, "mime", "n", "text/a", "gzip", None, True)]
    assert rows(b"uri n\0u:x\0") == [(9, "uri ", "n", None, None, "u:x", True)]


def test_item_entries_leave_a_scan_alone():
    assert set(next(B._scan_batches([built(2)], "file_id", ("infe",), None)).column("type").to_pylist()) == {"infe"}
