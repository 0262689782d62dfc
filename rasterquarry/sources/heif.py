"""A Python data source of decoded images: a partition a file, metadata alone where pixels aren't asked for."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EXTENSIONS = (".heic", ".heif", ".avif")


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


def heif_source(max_input_bytes: int, max_pixels: int) -> type[DataSource]:
    """The source class with its default limits. Options: path, max_input_bytes, max_pixels, metadata_only."""

    class HeifSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "heif"

        def schema(self) -> str:
            pixels = "" if self.options.get("metadata_only", "false") == "true" else ", rgba binary"
            return f"file_id string, width int, height int, orientation int, error string{pixels}"

        def reader(self, schema) -> DataSourceReader:
            return HeifReader(self.options, max_input_bytes, max_pixels)

    return HeifSource


class HeifReader(DataSourceReader):
    """Files are listed once on the driver, by name, and each is opened where it is decoded. The path is one that every machine sees."""

    def __init__(self, options, max_input_bytes: int, max_pixels: int):
        self.path = unquote(urlparse(options["path"]).path)
        self.most, self.pixels = int(options.get("max_input_bytes", max_input_bytes)), int(options.get("max_pixels", max_pixels))
        self.metadata_only = options.get("metadata_only", "false") == "true"

    def partitions(self) -> list[File]:
        if os.path.isfile(self.path):
            return [File(self.path)]
        return [File(os.path.join(folder, f)) for folder, _, names in sorted(os.walk(self.path)) for f in sorted(names) if f.lower().endswith(EXTENSIONS)]

    def read(self, partition: File):
        from rasterquarry.operators import images as M
        from rasterquarry.operators import items as I

        none = () if self.metadata_only else (None,)
        try:
            if os.path.getsize(partition.path) > self.most:
                raise ValueError("ResourceLimit: too many bytes")
            with open(partition.path, "rb") as file:
                data = file.read(self.most + 1)  # a reported length may be a lie
            if len(data) > self.most:
                raise ValueError("ResourceLimit: too many bytes")
            if self.metadata_only:
                g = I.FileGraph(data)
                if error := g.error():
                    raise ValueError(f"MalformedInput: {error}")
                width, height = M.size_of(g.properties(g.primary))
                yield (partition.path, width, height, None, None)
            else:
                image, orientation = M.decode_file(data, self.pixels)
                yield (partition.path, image.shape[1], image.shape[0], orientation, None, image.tobytes())
        except (OSError, ValueError) as e:
            yield (partition.path, None, None, None, f"Io: {e}" if isinstance(e, OSError) else str(e), *none)


def read_span(path: str, at: int, n: int) -> bytes:
    """[at, at + n) of a file that may be of any size, without the rest of it; ValueError if it isn't all there."""
    if at < 0 or n < 0 or at + n > os.path.getsize(path):
        raise ValueError("OutOfBounds")
    with open(path, "rb") as file:
        file.seek(at)
        return file.read(n)


def spooled(reader, folder: str, most: int, block: int = 1 << 20) -> str:
    """The path of a file in folder with all that a reader gives, block by block; beyond `most` bytes nothing is left and ValueError is raised."""
    import tempfile

    n = 0
    with tempfile.NamedTemporaryFile(dir=folder, prefix="spool-", delete=False) as out:
        while data := reader.read(block):
            n += len(data)
            if n > most:
                break
            out.write(data)
    if n > most:
        os.unlink(out.name)
        raise ValueError("ResourceLimit: too many bytes to spool")
    return out.name


def gather_span(path: str, extents: list[tuple[int, int]]) -> bytes:
    """The bytes of extents (offset, length) in order, each read by itself; an empty one adds nothing."""
    return b"".join(read_span(path, at, n) for at, n in extents)
