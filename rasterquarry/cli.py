"""Decodes one image file to PNG: 0 done, 1 failed with its category, 2 wrong arguments."""

from __future__ import annotations

import argparse
import sys

CATEGORIES = ("Io", "Parse", "MalformedInput", "UnsupportedFeature", "ResourceLimit", "DecoderBackend", "OutputEncoding")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rasterquarry", description=__doc__)
    p.add_argument("input", help="a file, or - for standard input")
    p.add_argument("output")
    p.add_argument("--max-input-bytes", type=int)
    p.add_argument("--max-pixels", type=int)
    p.add_argument("--max-spool-bytes", type=int, help="how much of standard input is taken")
    p.add_argument("--spool-dir", help="where standard input is kept until it is decoded")
    p.add_argument("--orientation", choices=("auto", "keep"), default="auto", help="apply the EXIF orientation, or leave the pixels as they are")
    return p


def failure(reason: str) -> str:
    """The line that tells of a failure: its category, MalformedInput if it names none, and what it said."""
    category, _, rest = reason.partition(": ")
    known = category in CATEGORIES
    return f"Decode failed [category={category if known else 'MalformedInput'}]: {rest or category if known else reason}"


def main(args: list[str] | None = None) -> int:
    import os
    import tempfile

    a = parser().parse_args(args)
    from .sources.files import MAX_INPUT_BYTES

    path = a.input
    try:
        if path == "-":
            from .sources.heif import spooled

            path = spooled(sys.stdin.buffer, a.spool_dir or tempfile.gettempdir(), a.max_spool_bytes or MAX_INPUT_BYTES)
        return _decode(path, a, MAX_INPUT_BYTES)
    except ValueError as e:
        print(failure(str(e)), file=sys.stderr)
        return 1
    finally:
        if a.input == "-" and path != "-":
            os.unlink(path)


def _decode(path: str, a: argparse.Namespace, most: int) -> int:
    import numpy as np
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import images
    from .sources.files import limited

    spark = SparkSession.builder.getOrCreate()
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "length", "content")
    checked = limited(files, a.max_input_bytes or most)
    over = checked.where("error IS NOT NULL").count()
    row = None if over else images.decode(checked.select("file_id", "content"), a.max_pixels or images.MAX_PIXELS, as_png=False).first()
    if over or row is None or row.error:
        print(failure("ResourceLimit: too many bytes" if over else row.error if row else "Io: no such file"), file=sys.stderr)
        return 1
    image = np.frombuffer(row.rgba, np.uint8).reshape(row.height, row.width, 4)
    if a.orientation == "auto":
        image = images.upright(image, row.orientation)
    with open(a.output, "wb") as out:
        out.write(images.png(image))
    return 0


if __name__ == "__main__":
    sys.exit(main())
