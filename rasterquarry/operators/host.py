"""What a host asks of a decoder: metadata without pixels, buffer sizes, size-checked buffers, and errors by kind."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boxes as B
from . import images as M
from . import items as I


def rgba_samples(width: Column, height: Column) -> Column:
    """Four samples a pixel; null where 64 bits don't hold the number."""
    return F.try_multiply(F.try_multiply(width.cast("long"), height.cast("long")), F.lit(4).cast("long"))


def rgba_bytes(width: Column, height: Column, bit_depth: Column) -> Column:
    """The bytes of a whole RGBA buffer, two a sample beyond 8 bits."""
    return F.try_multiply(rgba_samples(width, height), F.when(bit_depth > 8, 2).otherwise(1).cast("long"))


def storage(bit_depth: Column) -> Column:
    return F.when(bit_depth > 8, "rgba16").otherwise("rgba8")


def buffer_verdict(width: Column, height: Column, n_samples: Column) -> Column:
    """`ok`, or why a buffer can't hold an image of that size."""
    return F.when(F.coalesce(rgba_samples(width, height) == n_samples, F.lit(False)), "ok").otherwise("Parameter: sample count")


def error_kind(error: Column) -> Column:
    """The kind of a decoder's error for a host: Io, Unsupported, Limits or Decoding; null without one."""
    category = F.substring_index(error, ":", 1)
    return F.when(error.isNull(), None).when(category == "Io", "Io").when(category == "UnsupportedFeature", "Unsupported").when(category == "ResourceLimit", "Limits").otherwise("Decoding")


_METADATA = "width int, height int, bit_depth int, item_type string, orientation int, icc_bytes int, error string"


def _metadata_batches(batches):
    types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
    for batch in B.steps(batches):
        rows = []
        for data in batch.column(1).to_pylist():
            g = I.FileGraph(data or b"")
            try:
                if error := g.error():
                    raise ValueError(f"MalformedInput: {error}")
                own = g.properties(g.primary)
                width, height = M.size_of(own)
                for _, kind, _, b in own:
                    if kind == "irot" and b and b[0] & 1:
                        width, height = height, width
                pixi = M.one(own, "pixi", False)
                exif = g.described_by("Exif")
                turned = M.moved(own)
                icc = next((len(b) - 4 for _, kind, _, b in reversed(own) if kind == "colr" and b[:4] in (b"prof", b"rICC")), None)
                rows.append((width, height, max(pixi[5 : 5 + pixi[4]], default=8) if pixi and len(pixi) > 5 else 8, g.type_of(g.primary), None if turned or exif is None else M.orientation_of(g.payload(exif)[1]), icc, None))
            except (ValueError, struct.error) as e:
                rows.append((*(None,) * 6, str(e)))
        columns = list(zip(*rows)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["file_id", *(c.split()[0] for c in _METADATA.split(", "))])


def metadata(files: DataFrame) -> DataFrame:
    """(file_id, width, height, bit_depth, item_type, orientation, icc_bytes, error) of files: all that is known before a pixel is decoded. A turn or mirror hides the EXIF orientation, a rotation by 0 doesn't."""
    kind = files.schema["file_id"].dataType.simpleString()
    return files.select("file_id", "content").mapInArrow(_metadata_batches, f"file_id {kind}, {_METADATA}")


def register(spark, max_input_bytes: int = 128 << 20, max_pixels: int = M.MAX_PIXELS) -> str:
    """Registers the data source `heif` with its limits and returns the name: spark.read.format("heif").load(folder) gives decoded images."""
    from rasterquarry.sources.heif import heif_source

    spark.dataSource.register(heif_source(max_input_bytes, max_pixels))
    return "heif"
