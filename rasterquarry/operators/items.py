"""The item graph of image files: each file is read and resolved once, in one batch function, and nothing is shuffled.

FileGraph resolves one file's boxes; a Container offers the graphs of many files as a row each, and the same facts as
tables (a row an item, extent, reference, property or association) for analytics.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boxes as B

TRANSFORMS = ("clap", "irot", "imir")
MANDATORY = ("pitm", "iloc", "iinf", "iprp")
HEVC_TYPES = ("hvc1", "hev1")


class FileGraph:
    """The items of one file. Boxes that can't be read add nothing; the first match wins among items of one id, and all ipco boxes count as one list."""

    def __init__(self, data: bytes):
        self.data, self.boxes = data, B.tree(data)
        self.by_kind: dict[str | None, list[tuple]] = {}
        for r in self.boxes:
            own = self.by_kind.get(r[4])
            if own is None:
                own = self.by_kind[r[4]] = []
            if r[8] is None:
                own.append(r)
        self.kinds = self.by_kind.keys()
        self.primary = self._primary(next(self._payloads("pitm"), None))

    def _payloads(self, kind: str) -> Iterator[bytes]:
        for r in self.by_kind.get(kind, ()):
            yield self.data[r[6] : r[3] + r[5]]

    def _rows(self, kind: str) -> list[tuple]:
        read, out = B.ROWS[kind][0], []
        for payload in self._payloads(kind):
            try:
                out += list(read(payload))
            except ValueError:
                continue
        return out

    # each kind of fact is read once it is asked for

    @cached_property
    def items(self) -> dict[int, tuple]:
        out: dict[int, tuple] = {}
        for r in self._rows("infe"):
            out.setdefault(r[0], r)
        return out

    @cached_property
    def extents(self) -> dict[int, list[tuple]]:
        out: dict[int, list[tuple]] = {}
        for r in self._rows("iloc"):
            out.setdefault(r[0], []).append(r)
        return out

    @cached_property
    def edges(self) -> list[tuple]:
        return self._rows("iref")

    @cached_property
    def associations(self) -> dict[int, list[tuple[int, bool]]]:
        out: dict[int, list[tuple[int, bool]]] = {}
        for item, _, index, essential in self._rows("ipma"):
            out.setdefault(item, []).append((index, essential))
        return out

    @cached_property
    def props(self) -> list[tuple[str, bytes]]:
        own = [r for r in self.boxes if r[9] == "ipco" and r[8] is None]
        if len(self.by_kind.get("ipco", ())) > 1:
            own.sort(key=lambda r: (r[0], r[1]))
        return [(r[4], self.data[r[6] : r[3] + r[5]]) for r in own]

    @cached_property
    def idat(self) -> bytes | None:
        return next(self._payloads("idat"), None)

    @staticmethod
    def _primary(payload: bytes | None) -> int | None:
        if payload is None or len(payload) < 4 or payload[0] > 1 or len(payload) < (6, 8)[payload[0]]:
            return None
        return int.from_bytes(payload[4 : (6, 8)[payload[0]]], "big")

    def type_of(self, item: int | None) -> str | None:
        return self.items[item][1] if item in self.items else None

    def properties(self, item: int | None) -> list[tuple]:
        """(position, type, essential, payload) in association order; index 0 means none, one beyond the properties has no type."""
        own = self.associations.get(item, ())
        return [(k, *((self.props[i - 1][0], e, self.props[i - 1][1]) if i <= len(self.props) else (None, e, None))) for k, (i, e) in enumerate(own, 1) if i]

    def references(self, item: int | None) -> list[tuple[str, int, int]]:
        return sorted((kind, k, to) for kind, source, k, to in self.edges if source == item)

    def tiles(self) -> list[int]:
        """The primary item's dimg targets, flattened in order."""
        return [to for _, _, to in sorted(((k, n, to) for n, (kind, source, k, to) in enumerate(self.edges) if kind == "dimg" and source == self.primary))]

    def error(self) -> str | None:
        if not self.kinds:
            return "no boxes"
        missing = next((t for t in MANDATORY if t not in self.kinds), None)
        if missing:
            return f"missing {missing}"
        if self.type_of(self.primary) is None:
            return "primary item not in iinf"
        if self.primary not in self.extents:
            return "primary item not in iloc"
        return "property index out of range" if any(p[1] is None for p in self.properties(self.primary)) else None

    def payload(self, item: int) -> tuple[int | None, bytes | None, str | None]:
        """(method, bytes, error): an item's extents in order, of the file (method 0) or the idat box (1); an empty one adds nothing."""
        own = self.extents.get(item)
        if not own:
            return None, None, "no location"
        method = own[0][1]
        if any(r[2] for r in own):
            return method, None, "external data reference"
        if method > 1:
            return method, None, "unsupported construction method"
        source = self.data if method == 0 else self.idat
        if source is None:
            return method, None, "missing idat"
        if any(r[5] + r[6] > len(source) for r in own):
            return method, None, "extent out of bounds"
        return method, b"".join(source[r[5] : r[5] + r[6]] for r in sorted(own, key=lambda r: r[3])), None

    def described_by(self, kind: str) -> int | None:
        """The least item of a type that describes the primary item."""
        return min((source for ref, source, _, to in self.edges if ref == "cdsc" and to == self.primary and self.type_of(source) == kind), default=None)


_PROPERTY = "struct<assoc_pos:int,prop_type:string,essential:boolean,prop:binary>"
_PAYLOAD = "struct<item_id:bigint,method:int,payload:binary,error:string>"
_NCLX = "struct<primaries:bigint,transfer:bigint,matrix:bigint,full_range:boolean>"
_GRAPH = f"item_id bigint, item_type string, hidden boolean, references array<struct<ref_type:string,ref_pos:int,to_id:bigint>>, properties array<{_PROPERTY}>, tiles array<struct<tile_pos:int,item_id:bigint,item_type:string>>, tile_properties array<{_PROPERTY}>, payloads array<{_PAYLOAD}>, error string"
_COLOURS = f"nclx {_NCLX}, icc binary"


def _tile_properties(g: FileGraph) -> list[tuple]:
    tiles = g.tiles()
    return g.properties(tiles[0]) if tiles else []


#: How a graph gives each column; rows of lists are tuples in the order of the struct's fields.
_READ = {
    "item_id": lambda g: g.primary,
    "item_type": lambda g: g.type_of(g.primary),
    "hidden": lambda g: g.items[g.primary][6] if g.primary in g.items else None,
    "references": lambda g: g.references(g.primary) or None,
    "properties": lambda g: g.properties(g.primary) or None,
    "tiles": lambda g: [(k, t, g.type_of(t)) for k, t in enumerate(g.tiles())],
    "tile_properties": _tile_properties,
    "error": lambda g: g.error(),
}
_WANTED = {"none": lambda g: (), "primary": lambda g: (g.primary,), "all": lambda g: g.extents}


def _graph_batches(batches, key, which, fields):
    wanted = _WANTED[which]
    read = _READ | {"payloads": lambda g: [(i, *g.payload(i)) for i in wanted(g) if i in g.extents]}
    own = [read[f.name] for f in fields]
    for batch in B.steps(batches):
        out = [[] for _ in fields]
        for data in batch.column(1).to_pylist():
            g = FileGraph(data or b"")
            for column, f in zip(out, own):
                column.append(f(g))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(B.array(c, f.type) for c, f in zip(out, fields))], names=[key, *(f.name for f in fields)])


def _fields(ddl: str) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return list(to_arrow_schema(StructType.fromDDL(ddl)))


def graphs(files: DataFrame, which: str = "none", columns: tuple[str, ...] | None = None) -> DataFrame:
    """A row a file: the primary item, its references and properties in order, a grid's tiles and its first tile's properties, payloads of no, the primary or all items, error.

    files: (file_id, content). Every file is read once by the task that has it, and only what the row holds leaves it.
    columns: these only, and only what they need is read.
    """
    from pyspark.sql.types import StructType

    kept = [f for f in StructType.fromDDL(_GRAPH) if columns is None or f.name in columns]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return files.select("file_id", "content").mapInArrow(partial(_graph_batches, key="file_id", which=which, fields=_fields(ddl)), f"file_id {files.schema['file_id'].dataType.simpleString()}, {ddl}")


def _first(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of rows that share keys, the first in order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


class Container:
    """Files' graphs, and tables of their facts, each keyed by file_id and read from the files when it is asked for."""

    def __init__(self, files: DataFrame):
        self.files = files

    @cached_property
    def graph(self) -> DataFrame:
        return graphs(self.files)

    @cached_property
    def tree(self) -> DataFrame:
        return B.boxes(self.files)

    @cached_property
    def pitm(self) -> DataFrame:
        return graphs(self.files, columns=("item_id",)).where("item_id IS NOT NULL").select("file_id", "item_id")

    def _rows(self, kind: str) -> DataFrame:
        return B.rows_of(B.boxes(self.files, kinds=(kind,)), kind).where("error IS NULL")

    @cached_property
    def items(self) -> DataFrame:
        return _first(self._rows("infe"), ["file_id", "item_id"], "off").select("file_id", "item_id", "item_type", "name", "content_type", "hidden")

    @cached_property
    def extents(self) -> DataFrame:
        return self._rows("iloc").drop("error", "off")

    @cached_property
    def edges(self) -> DataFrame:
        return self._rows("iref").drop("error", "off")

    @cached_property
    def properties(self) -> DataFrame:
        props = B.boxes(self.files, parents=("ipco",)).where("error IS NULL").select("file_id", "parent", "pos", F.col("type").alias("prop_type"), "payload")
        number = F.row_number().over(Window.partitionBy("file_id").orderBy("parent", "pos"))  # over all ipco boxes, from 1
        return props.withColumn("prop_index", number).select("file_id", "prop_index", "prop_type", F.col("payload").alias("prop"))

    @cached_property
    def associations(self) -> DataFrame:
        return self._rows("ipma").withColumn("assoc_pos", F.row_number().over(Window.partitionBy("file_id", "item_id").orderBy("off", "assoc_pos"))).drop("error", "off")


def open_container(files: DataFrame) -> Container:
    """files: (file_id, content). Nothing is read before a table of the container is used, and nothing stays in memory."""
    return Container(files)


def item_properties(c: Container, items: DataFrame) -> DataFrame:
    """(file_id, item_id, assoc_pos, essential, prop_index, prop_type, prop, error) of items' associations in order; index 0 means none, one beyond the properties is an error."""
    own = c.associations.join(items.select("file_id", "item_id").distinct(), ["file_id", "item_id"]).where("prop_index > 0")
    out = own.join(c.properties, ["file_id", "prop_index"], "left")
    return out.withColumn("error", F.when(F.col("prop_type").isNull(), "property index out of range"))


def resolve_primary(c: Container) -> DataFrame:
    """One row a file: item_id, item_type, hidden, references and properties in order, error. pitm, iloc, iinf and iprp are mandatory; first matches win."""
    return graphs(c.files, columns=("item_id", "item_type", "hidden", "references", "properties", "error"))


def transform_list(resolved: DataFrame) -> DataFrame:
    """(file_id, transforms): clap, irot and imir in association order."""
    def step(p: Column) -> Column:
        kind, b = p["prop_type"], p["prop"]
        return F.struct(kind.alias("kind"), F.when(kind == "irot", B.irot(b)["ccw_degrees"]).alias("ccw_degrees"), F.when(kind == "imir", B.imir(b)["axis"]).alias("axis"))

    clean = F.transform(F.filter("properties", lambda p: p["prop_type"].isin(*TRANSFORMS)), step)
    return resolved.select("file_id", F.coalesce(clean, F.array().cast("array<struct<kind:string,ccw_degrees:bigint,axis:string>>")).alias("transforms"))


def read_colour(b: bytes) -> tuple | None:
    """(icc or None, primaries, transfer, matrix, full range) of a colr box's payload as B.colr reads it, None if it can't be read."""
    kind = b[:4]
    if kind in (b"prof", b"rICC"):
        return b[4:], None, None, None, None
    if kind not in (b"nclx", b"nclc") or len(b) < (11 if kind == b"nclx" else 10):
        return None
    primaries, transfer, matrix = struct.unpack_from(">HHH", b, 4)
    return None, primaries, transfer, matrix, b[10] >= 128 if kind == b"nclx" else matrix == 0


def last_colours(properties: list[tuple]) -> tuple[tuple | None, bytes | None]:
    """(nclx, icc): the last colour of each kind; the undefined nclx (2, 2, 2, full) counts as none."""
    nclx = icc = None
    for _, kind, _, b in properties:
        found = read_colour(b) if kind == "colr" else None
        if found is None:
            continue
        if found[0] is None:
            nclx = found[1:]
        else:
            icc = found[0]
    return None if nclx == (2, 2, 2, True) else nclx, icc


def _colour_batches(batches, fields):
    for batch in B.steps(batches):
        at, out, iccs = [], [], []
        for i, data in enumerate(batch.column(1).to_pylist()):
            g = FileGraph(data or b"")
            kind = g.type_of(g.primary)
            if kind is None:
                continue
            nclx, icc = last_colours(g.properties(g.primary))
            if kind == "grid" and (nclx is None or icc is None):
                tile = last_colours(_tile_properties(g))
                nclx, icc = tile[0] if nclx is None else nclx, tile[1] if icc is None else icc
            at.append(i)
            out.append(nclx)
            iccs.append(icc)
        kinds = list(fields[0].type)
        columns = list(zip(*(n or (None,) * 4 for n in out))) if out else [()] * 4
        struct_of = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], fields=kinds, mask=pa.array([n is None for n in out], pa.bool_()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), struct_of, pa.array(iccs, pa.binary())], names=["file_id", "nclx", "icc"])


def tiles(c: Container) -> DataFrame:
    """(file_id, tile_pos, item_id) of primary grids: their dimg targets, flattened in order."""
    return graphs(c.files, columns=("tiles",)).select("file_id", F.explode("tiles").alias("t")).select("file_id", "t.tile_pos", "t.item_id")


def colour_properties(c: Container) -> DataFrame:
    """(file_id, nclx, icc) of the primary item; a grid takes what it lacks from its first tile, each kind by itself."""
    kind = c.files.schema["file_id"].dataType.simpleString()
    return c.files.select("file_id", "content").mapInArrow(partial(_colour_batches, fields=_fields(_COLOURS)), f"file_id {kind}, {_COLOURS}")


def gather(source: Column, extents: Column) -> Column:
    """struct<payload, error>: the bytes of extents (array of struct off, len) in order; one that leaves the source is an error, an empty one adds nothing."""
    n = F.octet_length(source)
    bad = F.exists(extents, lambda e: e["off"] + e["len"] > n)
    data = F.aggregate(extents, F.lit(b""), lambda a, e: F.concat(a, F.substring(source, e["off"].cast("int") + 1, e["len"].cast("int"))))
    return F.struct(F.when(~bad, data).alias("payload"), F.when(bad, "extent out of bounds").alias("error"))


def item_payloads(c: Container, items: DataFrame | None = None) -> DataFrame:
    """(file_id, item_id, method, payload, error) of the primary items, or of those in items: method 0 reads the file, 1 the idat box; other methods and data references are unsupported.

    Payloads are cut where the file is read. Only a caller's own list of items is joined, to payloads, never to files.
    """
    which = "primary" if items is None or items is c.pitm else "all"
    rows = graphs(c.files, which, ("payloads",)).select("file_id", F.explode("payloads").alias("p")).select("file_id", "p.*")
    return rows if which == "primary" else rows.join(items.select("file_id", "item_id").distinct(), ["file_id", "item_id"], "left_semi")


def extract(c: Container, types: tuple[str, ...]) -> DataFrame:
    """(file_id, item_id, method, payload, error) of primary items of the given types; others get an error."""
    rows = graphs(c.files, "primary", ("item_id", "item_type", "payloads")).where("item_id IS NOT NULL AND item_type IS NOT NULL").select("file_id", "item_id", F.col("item_type").isin(*types).alias("good"), F.get("payloads", F.lit(0)).alias("p"))
    error = F.when(~F.col("good"), "unexpected primary item type").otherwise(F.col("p.error"))
    return rows.select("file_id", "item_id", F.when(F.col("good"), F.col("p.method")).alias("method"), F.when(F.col("good"), F.col("p.payload")).alias("payload"), error.alias("error"))


def extract_grid(c: Container) -> DataFrame:
    """(file_id, rows, columns, width, height, tiles, error) of primary grids: as many tiles as rows times columns, each of a coded HEVC type."""
    rows = graphs(c.files, "primary", ("item_type", "tiles", "payloads")).where("item_type = 'grid'").select("file_id", "tiles", F.get("payloads", F.lit(0))["payload"].alias("payload"))
    rows = rows.where("payload IS NOT NULL").select("file_id", "tiles", B.grid(F.col("payload")).alias("g"))
    error = F.coalesce(F.col("g.error"), F.when(F.size("tiles") != F.col("g.rows") * F.col("g.columns"), "tile count"), F.when(F.exists("tiles", lambda t: ~F.coalesce(t["item_type"], F.lit("")).isin(*HEVC_TYPES)), "tile type"))
    return rows.select("file_id", "g.rows", "g.columns", "g.width", "g.height", F.transform("tiles", lambda t: t["item_id"]).alias("tiles"), error.alias("error"))


def checked_properties(resolved: DataFrame, config: str, strict: bool) -> DataFrame:
    """(file_id, width, height, bits, error): config (av1C or hvcC) and ispe must be there once, pixi at most once, or once if strict; zero sizes and depths are errors."""
    def of(kind: str) -> Column:
        return F.filter("properties", lambda p: p["prop_type"] == kind)

    names = {config: "__config", "ispe": "__ispe", "pixi": "__pixis"}
    resolved = resolved.withColumns({name: of(k) for k, name in names.items()})
    n = {k: F.size(name) for k, name in names.items()}
    error = F.col("error")
    checks = [(n[config] == 0, f"missing {config}"), (n[config] > 1, f"repeated {config}"), (n["ispe"] == 0, "missing ispe"), (n["ispe"] > 1, "repeated ispe"), (n["pixi"] > 1, "repeated pixi")]
    if strict:
        checks.append((n["pixi"] == 0, "missing pixi"))
    bad = F.lit(None).cast("string")
    for when, why in reversed(checks):
        bad = F.when(when, why).otherwise(bad)
    rows = resolved.withColumn("__bad", F.coalesce(error, bad))
    good = F.col("__bad").isNull()
    rows = rows.withColumns({"__size": F.when(good, B.ispe(F.get("__ispe", F.lit(0))["prop"])), "__pixi": F.when(good, B.pixi(F.get("__pixis", F.lit(0))["prop"]))})
    late = F.coalesce("__bad", "__size.error", F.when((F.col("__size.width") == 0) | (F.col("__size.height") == 0), "zero extent"), F.when(F.exists("__pixi.bits", lambda b: b == 0), "zero bit depth"))
    return rows.select("file_id", "__size.width", "__size.height", "__pixi.bits", late.alias("error"))
