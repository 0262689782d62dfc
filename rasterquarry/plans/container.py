"""Queries over container tables, and their SQL: every fixture field follows from event_id, so SQL states it directly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterquarry.functions import bytes as by
from rasterquarry.operators import boxes as B
from rasterquarry.operators import host
from rasterquarry.operators import items as I
from rasterquarry.sources import files as S

from .fixtures import heif_files

QUERIES, ORACLES = {}, {}
#: SQL of the events as files, and of a box's sizes.
F_SQL = "f AS (SELECT event_id::BIGINT AS e, event_id::BIGINT AS file_id, (event_id % 4)::BIGINT AS k, (event_id % 5 + 1)::BIGINT AS item FROM events)"
SIZES_SQL = F_SQL + """, s AS (
  SELECT *, CASE WHEN e % 2 = 0 THEN 14 ELSE 16 END AS pitm, CASE WHEN k = 3 THEN 36 ELSE 44 END AS iloc, 80 AS iinf, CASE WHEN k = 3 THEN 28 ELSE 26 END AS iref,
         8 + 20 + 16 + 19 + 9 + 9 + CASE WHEN k = 1 THEN 13 ELSE 40 END AS ipco, 30 AS ipma, 16 AS idat FROM f),
z AS (SELECT *, 8 + ipco + ipma AS iprp, 12 + pitm + iloc + iinf + iref + (8 + ipco + ipma) + idat AS meta FROM s)"""


def events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")


def dealt(spark, sf_dir) -> DataFrame:
    """Events dealt to all cores: the table is narrow, and what is made of its rows is not."""
    return events(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)


def files(spark, sf_dir) -> DataFrame:
    """A file for each event."""
    return heif_files(dealt(spark, sf_dir))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {SIZES_SQL} SELECT file_id, 0 AS pos, 0::BIGINT AS off, 'ftyp' AS type, 24::BIGINT AS size FROM z UNION ALL SELECT file_id, 1, 24, 'mdat', 24 FROM z UNION ALL SELECT file_id, 2, 48, 'meta', meta::BIGINT FROM z")
def box_next(spark, sf_dir):
    return B.boxes(files(spark, sf_dir)).where("depth = 0").select("file_id", "pos", "off", "type", "size")


def damaged(spark, sf_dir) -> DataFrame:
    """files(), of which some are cut off inside meta, have a first box that is too small, or have no content."""
    e = F.col("file_id")
    small = F.concat(F.unhex(F.lit("00000007")), F.substring("content", 5, 1 << 30))
    content = F.when(e % 11 == 10, F.lit(None).cast("binary")).when(e % 5 == 4, F.substring("content", 1, 60)).when(e % 7 == 6, small).otherwise(F.col("content"))
    return files(spark, sf_dir).withColumn("content", content)


@query(f"WITH {F_SQL} SELECT file_id, CASE WHEN e % 5 = 4 THEN 3 WHEN e % 7 = 6 THEN 1 ELSE 20 END::BIGINT AS n_boxes, CASE WHEN e % 5 = 4 OR e % 7 = 6 THEN 1 ELSE 0 END::BIGINT AS n_errors FROM f WHERE e % 11 <> 10")
def box_list(spark, sf_dir):
    """Boxes and errors of each file that has content; a file that is cut off inside its last box has an error there."""
    return B.boxes(damaged(spark, sf_dir)).groupBy("file_id").agg(F.count("*").alias("n_boxes"), F.count("error").alias("n_errors"))


@query(f"""WITH {SIZES_SQL}
SELECT file_id, pos, (60 + CASE pos WHEN 0 THEN 0 WHEN 1 THEN pitm WHEN 2 THEN pitm + iloc WHEN 3 THEN pitm + iloc + iinf WHEN 4 THEN pitm + iloc + iinf + iref ELSE pitm + iloc + iinf + iref + iprp END)::BIGINT AS off,
       ['pitm', 'iloc', 'iinf', 'iref', 'iprp', 'idat'][pos + 1] AS type, [pitm, iloc, iinf, iref, iprp, idat][pos + 1]::BIGINT AS size
FROM z, (SELECT unnest(range(6))::INT AS pos) p""")
def box_children(spark, sf_dir):
    tree = B.boxes(files(spark, sf_dir))
    return tree.where("depth = 1").select("file_id", "pos", "off", "type", "size")


@query(f"WITH {F_SQL} SELECT file_id, (60)::BIGINT AS off, 'pitm' AS type FROM f")
def box_first_child(spark, sf_dir):
    tree = B.boxes(files(spark, sf_dir), kinds=("pitm",))
    return tree.groupBy("file_id").agg(F.min("off").alias("off"), F.min_by("type", "off").alias("type"))


@query(f"WITH {F_SQL} SELECT file_id, 'ftyp' AS type, 24::BIGINT AS size, 8 AS header FROM f")
def box_header(spark, sf_dir):
    h = B.header(F.col("content"))
    return files(spark, sf_dir).select("file_id", h["type"].alias("type"), h["size"].cast("long").alias("size"), h["header"].alias("header"))


@query(f"WITH {F_SQL} SELECT file_id, 'ftyp' AS good, lower(printf('ff%06X', e)) AS bad FROM f")
def fourcc(spark, sf_dir):
    bad = F.concat(F.lit(b"\xff"), F.unhex(F.lpad(F.hex("file_id"), 6, "0")))
    return files(spark, sf_dir).select("file_id", by.fourcc(F.col("content"), 4).alias("good"), by.fourcc(bad).alias("bad"))


@query(f"WITH {F_SQL} SELECT file_id, (e % 65536) AS u16, e AS u32, e AS u64, CASE WHEN e % 2 = 0 THEN e ELSE -e END AS i32 FROM f")
def be_read(spark, sf_dir):
    e = F.col("file_id")
    twos = F.unhex(F.lpad(F.hex(F.when(e % 2 == 0, e).otherwise(F.lit(1 << 32) - e)), 8, "0"))
    c = F.col("content")
    return files(spark, sf_dir).select("file_id", by.unsigned(c, 38, 2).alias("u16"), by.unsigned(c, 36, 4).alias("u32"), by.unsigned(c, 32, 8).cast("long").alias("u64"), by.signed32(twos, 0).alias("i32"))


@query(f"WITH {F_SQL} SELECT file_id, CASE WHEN e % 70 <= 32 THEN lower(printf('%016X', e)) END AS bytes, CASE WHEN e % 70 > 32 THEN 'OutOfBounds' END AS error FROM (SELECT *, 0 FROM f)")
def src_slice(spark, sf_dir):
    small = files(spark, sf_dir).select("file_id", F.substring("content", 1, 40).alias("content"))
    r = S.read_range(F.col("content"), F.when(F.col("file_id") % 70 <= 32, 32).otherwise(F.col("file_id") % 70), F.lit(8))
    return small.select("file_id", F.lower(F.hex(r["bytes"])).alias("bytes"), r["error"].alias("error"))


@query(f"WITH {F_SQL} SELECT file_id, 'mif1' AS major_brand, e % 3 AS minor_version, 'heic,mif1' AS brands FROM f")
def dec_ftyp(spark, sf_dir):
    d = B.ftyp(F.col("payload"))
    return payloads(spark, sf_dir, "ftyp").select("file_id", d["major_brand"].alias("major_brand"), d["minor_version"].alias("minor_version"), F.array_join(d["compatible_brands"], ",").alias("brands"))


def payloads(spark, sf_dir, kind: str) -> DataFrame:
    return B.boxes(files(spark, sf_dir), kinds=(kind,)).where(F.col("error").isNull())


def decoded(kind: str, read, *columns: str):
    def f(spark, sf_dir):
        d = read(F.col("payload"))
        return payloads(spark, sf_dir, kind).select("file_id", *(d[c].alias(c) for c in columns))

    return f


def simple(name: str, kind: str, read, columns: str, sql: str):
    """A query of a box's fields, whose SQL is an expression for each field."""
    names = columns.split()
    QUERIES[name] = decoded(kind, read, *names)
    ORACLES[name] = f"WITH {F_SQL} SELECT file_id, " + ", ".join(f"{x.strip()} AS {n}" for n, x in zip(names, sql.split(";"))) + " FROM f" + (" WHERE k = 1" if kind == "av1C" else " WHERE k <> 1" if kind == "hvcC" else "")


simple("dec_meta", "meta", B.meta, "version flags", "0::BIGINT; 0::BIGINT")
simple("dec_fullbox", "pitm", B.full_box, "version flags", "e % 2; 0::BIGINT")
simple("dec_pitm", "pitm", B.pitm, "item_id error", "item; NULL::VARCHAR")
simple("dec_ispe", "ispe", B.ispe, "width height", "e % 640; e % 480 + 1")
simple("dec_irot", "irot", B.irot, "ccw_degrees", "e % 4 * 90")
simple("dec_imir", "imir", B.imir, "axis", "CASE WHEN e % 2 = 1 THEN 'horizontal' ELSE 'vertical' END")
simple("dec_colr", "colr", B.colr, "kind primaries transfer matrix full_range", "'nclx'; e % 10; e % 9; e % 8; e % 3 = 0")
simple("dec_av1c", "av1C", B.av1c, "profile level tier high_bitdepth monochrome subsampling_x sample_position", "e % 256 // 32; e % 32; e % 128 // 128; e % 128 // 64; e % 32 // 16; e % 16 // 8; e % 4")
simple("dec_hvcc", "hvcC", B.hvcc, "profile_space tier profile level chroma_format bit_depth_luma bit_depth_chroma nal_length_size", "e % 256 // 64; e % 64 // 32; e % 32; e % 200; e % 4; e % 3 + 8; e % 2 + 8; 4::BIGINT")


@query(f"WITH {F_SQL} SELECT file_id, '8,8,' || (e % 3 + 8) AS bits FROM f")
def dec_pixi(spark, sf_dir):
    return payloads(spark, sf_dir, "pixi").select("file_id", F.array_join(B.pixi(F.col("payload"))["bits"].cast("array<string>"), ",").alias("bits"))


@query("SELECT event_id::BIGINT AS file_id, (event_id % 900)::BIGINT AS width_num, (event_id % 7)::BIGINT AS width_den, -(event_id % 11)::BIGINT AS x_num, 3::BIGINT AS y_den, CASE WHEN event_id % 7 = 0 THEN 'zero denominator' END AS error FROM events WHERE event_id % 7 > 0 UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, 'zero denominator' FROM events WHERE event_id % 7 = 0")
def dec_clap(spark, sf_dir):
    e = F.col("event_id")
    twos = F.when(e % 11 == 0, 0).otherwise((1 << 32) - e % 11)
    from .fixtures import u

    b = F.unhex(F.concat(u(e % 900, 4), u(e % 7, 4), u(5, 4), u(1, 4), u(twos, 4), u(2, 4), u(0, 4), u(3, 4)))
    d = B.clap(b)
    return events(spark, sf_dir).select(e.alias("file_id"), *(d[c].alias(c) for c in ("width_num", "width_den", "x_num", "y_den", "error")))


@query(f"""WITH {F_SQL} SELECT file_id, item AS item_id, CASE WHEN k = 3 THEN 1 ELSE 0 END AS method, x AS extent, (CASE WHEN k = 3 THEN 0 WHEN x = 0 THEN 36 ELSE 40 END)::BIGINT AS extent_off, (CASE WHEN k = 3 THEN 8 WHEN x = 0 THEN 4 ELSE e % 8 END)::BIGINT AS extent_len
FROM f, (SELECT unnest([0, 1])::INT AS x) WHERE k <> 3 OR x = 0""")
def dec_iloc(spark, sf_dir):
    rows = B.rows_of(B.boxes(files(spark, sf_dir), kinds=("iloc",)), "iloc")
    return rows.select("file_id", "item_id", "method", "extent", F.col("extent_off").cast("long").alias("extent_off"), F.col("extent_len").cast("long").alias("extent_len"))


ITEMS_SQL = f"""WITH {F_SQL} SELECT file_id, item + 10 * i AS item_id, CASE WHEN i = 0 THEN ['hvc1', 'av01', 'unci', 'grid'][k + 1] ELSE 'hvc1' END AS item_type, 'n' AS name, false AS hidden FROM f, (SELECT unnest([0, 1, 2])::BIGINT AS i)"""


@query(ITEMS_SQL)
def dec_infe(spark, sf_dir):
    return B.rows_of(B.boxes(files(spark, sf_dir), kinds=("infe",)), "infe").select("file_id", "item_id", "item_type", "name", "hidden")


@query(f"WITH {F_SQL} SELECT file_id, 3::BIGINT AS declared, 3::BIGINT AS found FROM f")
def dec_iinf(spark, sf_dir):
    """Each iinf box with the infe boxes in it. A file's boxes are in one task, so they are summed there before rows are dealt out."""
    own = F.col("type") == "iinf"
    tree = B.boxes(files(spark, sf_dir), kinds=("iinf", "infe"))
    rows = tree.select("file_id", F.when(own, F.col("off")).otherwise(F.col("parent")).alias("box"), own.alias("own"), F.when(own, by.unsigned(F.col("payload"), 4, 2)).alias("declared"))
    sums = rows.groupBy("file_id", "box").agg(F.max("declared").alias("declared"), F.count_if("own").alias("boxes"), F.count_if(~F.col("own")).alias("found"))
    return sums.where("boxes > 0 AND found > 0").groupBy("file_id", "declared").agg(F.sum("found").alias("found"))


@query(f"""WITH {F_SQL} SELECT file_id, 'cdsc' AS ref_type, item + 10 AS from_id, 0 AS ref_pos, item AS to_id FROM f WHERE k <> 3
UNION ALL SELECT file_id, 'dimg', item, i, item + 10 * (i + 1) FROM f, (SELECT unnest([0, 1])::INT AS i) WHERE k = 3""")
def dec_iref(spark, sf_dir):
    return B.rows_of(B.boxes(files(spark, sf_dir), kinds=("iref",)), "iref").select("file_id", "ref_type", "from_id", "ref_pos", "to_id")


@query(f"""WITH {F_SQL} SELECT file_id, p AS pos, ['ispe', 'pixi', 'colr', 'irot', 'imir', CASE WHEN k = 1 THEN 'av1C' ELSE 'hvcC' END][p + 1] AS type FROM f, (SELECT unnest(range(6))::INT AS p)""")
def dec_ipco(spark, sf_dir):
    return B.boxes(files(spark, sf_dir), parents=("ipco",)).select("file_id", "pos", "type")


@query(f"""WITH {F_SQL} SELECT file_id, item AS item_id, i AS assoc_pos, [1, 2, 3, 6, 5, 4][i + 1] AS prop_index, i = 1 AS essential FROM f, (SELECT unnest(range(6))::INT AS i)
UNION ALL SELECT file_id, item + 10, i, [3, 6][i + 1], false FROM f, (SELECT unnest(range(2))::INT AS i)""")
def dec_ipma(spark, sf_dir):
    return B.rows_of(B.boxes(files(spark, sf_dir), kinds=("ipma",)), "ipma").select("file_id", "item_id", "assoc_pos", "prop_index", "essential")


@query(f"WITH {F_SQL} SELECT file_id, 1::BIGINT AS n_ipco, 1::BIGINT AS n_ipma FROM f")
def dec_iprp(spark, sf_dir):
    tree = B.boxes(files(spark, sf_dir), kinds=("ipco", "ipma"))
    return tree.groupBy("file_id").agg(F.count_if(F.col("type") == "ipco").alias("n_ipco"), F.count_if(F.col("type") == "ipma").alias("n_ipma"))


@query("SELECT event_id::BIGINT AS item, i AS component, CASE WHEN i = 0 THEN (event_id % 1000)::INT ELSE 32768 END AS component_type, CASE WHEN i = 1 THEN 'u' || event_id END AS component_uri FROM events, (SELECT unnest([0, 1])::INT AS i)")
def dec_cmpd(spark, sf_dir):
    e = F.col("event_id")
    from .fixtures import u

    payload = F.unhex(F.concat(u(2, 4), u(e % 1000, 2), u(0x8000, 2), F.hex(F.concat(F.lit("u"), e.cast("string"))), u(0, 1)))
    tree = events(spark, sf_dir).select(e.alias("item"), F.lit(0).cast("long").alias("off"), F.lit("cmpd").alias("type"), F.lit(None).cast("string").alias("error"), payload.alias("payload"))
    return B.rows_of(tree, "cmpd", "item").select("item", "component", "component_type", "component_uri")


@query("""SELECT event_id::BIGINT AS item, CASE WHEN event_id % 3 < 2 THEN (event_id % 3 == 0)::INT END AS uncc_version, ['rgb3', 'zzzz', NULL][(event_id % 3 + 1)::INT] AS profile, CASE WHEN event_id % 3 = 1 THEN 1 END AS n_components,
CASE WHEN event_id % 3 = 1 THEN (event_id % 16 + 1)::BIGINT END AS tile_columns, CASE WHEN event_id % 3 = 2 THEN 'unknown profile' END AS error FROM events""")
def dec_uncc(spark, sf_dir):
    e = F.col("event_id")
    from .fixtures import text, u

    known = F.concat(u(1, 1), u(0, 3), text("rgb3"))
    own = F.concat(u(0, 4), text("zzzz"), u(1, 4), u(0, 2), u(7, 1), u(0, 1), u(0, 1), u(0, 4), u(0, 12), u(e % 16, 4), u(0, 4))
    unknown = F.concat(u(1, 1), u(0, 3), text("zzzz"))
    payload = F.unhex(F.when(e % 3 == 0, known).when(e % 3 == 1, own).otherwise(unknown))
    tree = events(spark, sf_dir).select(e.alias("item"), F.lit(0).cast("long").alias("off"), F.lit("uncC").alias("type"), F.lit(None).cast("string").alias("error"), payload.alias("payload"))
    return B.rows_of(tree, "uncC", "item").select("item", "uncc_version", "profile", "n_components", "tile_columns", "error")


# the item graph


PROPS_SQL = "'ispe,pixi,colr,' || CASE WHEN k = 1 THEN 'av1C' ELSE 'hvcC' END || ',imir,irot'"


@query(f"""WITH {F_SQL}, d AS (SELECT *, CASE WHEN e % 11 = 10 THEN 'no boxes' WHEN e % 5 = 4 OR e % 7 = 6 THEN 'missing pitm' END AS error FROM f)
SELECT file_id, CASE WHEN error IS NULL THEN item END AS item_id, CASE WHEN error IS NULL THEN ['hvc1', 'av01', 'unci', 'grid'][k + 1] END AS item_type, CASE WHEN error IS NULL THEN {PROPS_SQL} END AS properties,
CASE WHEN error IS NULL AND k = 3 THEN 'dimg ' || (item + 10) || ',dimg ' || (item + 20) END AS "references", error FROM d""")
def resolve_primary(spark, sf_dir):
    """Primary items of whole files and of damaged ones."""
    r = I.resolve_primary(I.open_container(damaged(spark, sf_dir)))
    props = F.array_join(F.transform("properties", lambda p: p["prop_type"]), ",")
    refs = F.array_join(F.transform("references", lambda p: F.concat(p["ref_type"], F.lit(" "), p["to_id"].cast("string"))), ",")
    return r.select("file_id", "item_id", "item_type", props.alias("properties"), refs.alias("references"), "error")


def resolved_of(types):
    def f(spark, sf_dir):
        r = I.graphs(damaged(spark, sf_dir), columns=("item_id", "item_type", "properties", "error"))
        return r.where(F.col("item_type").isin(*types) | F.col("error").isNotNull()).select("file_id", "item_id", F.size("properties").cast("long").alias("n_properties"), "error")

    return f


QUERIES |= {"resolve_heic": resolved_of(("hvc1", "hev1", "grid")), "resolve_avif": resolved_of(("av01",))}
for _name, _kinds in (("resolve_heic", "0, 3"), ("resolve_avif", "1")):
    ORACLES[_name] = f"""WITH {F_SQL}, d AS (SELECT *, CASE WHEN e % 11 = 10 THEN 'no boxes' WHEN e % 5 = 4 OR e % 7 = 6 THEN 'missing pitm' END AS error FROM f)
SELECT file_id, CASE WHEN error IS NULL THEN item END AS item_id, CASE WHEN error IS NULL THEN 6 ELSE NULL END::BIGINT AS n_properties, error FROM d WHERE k IN ({_kinds}) OR error IS NOT NULL"""


@query(f"WITH {F_SQL} SELECT file_id, 'imir ' || CASE WHEN e % 2 = 1 THEN 'horizontal' ELSE 'vertical' END || ',irot ' || (e % 4 * 90) AS transforms FROM f")
def transform_list(spark, sf_dir):
    t = I.transform_list(I.graphs(files(spark, sf_dir), columns=("properties",)))
    return t.select("file_id", F.array_join(F.transform("transforms", lambda s: F.concat(s["kind"], F.lit(" "), F.coalesce(s["axis"], s["ccw_degrees"].cast("string")))), ",").alias("transforms"))


NCLX_SQL = "e % 10 AS primaries, e % 9 AS transfer, e % 8 AS matrix, e % 3 = 0 AS full_range"


@query(f"""WITH {F_SQL} SELECT file_id, CASE WHEN NOT undefined THEN e % 10 END AS primaries, CASE WHEN NOT undefined THEN e % 9 END AS transfer, CASE WHEN NOT undefined THEN e % 8 END AS matrix, CASE WHEN NOT undefined THEN e % 3 = 0 END AS full_range
FROM (SELECT *, e % 10 = 2 AND e % 9 = 2 AND e % 8 = 2 AND e % 3 = 0 AS undefined FROM f)""")
def color_inherit(spark, sf_dir):
    c = I.colour_properties(I.open_container(files(spark, sf_dir)))
    return c.select("file_id", "nclx.primaries", "nclx.transfer", "nclx.matrix", "nclx.full_range")


@query(f"""WITH {F_SQL} SELECT file_id, item + 10 AS item_id, 2::BIGINT AS n_properties, 1::BIGINT AS n_hvcc, {NCLX_SQL.replace('AS full_range', 'AS full_range')} FROM f WHERE k = 3""")
def grid_tile_props(spark, sf_dir):
    g = I.graphs(files(spark, sf_dir), columns=("item_type", "tiles", "tile_properties")).where("item_type = 'grid'")
    colour = F.try_element_at(F.filter("tile_properties", lambda p: p["prop_type"] == "colr"), F.lit(-1))["prop"]
    d = B.colr(colour)
    n = F.size(F.filter("tile_properties", lambda p: p["prop_type"] == "hvcC")).cast("long")
    return g.select("file_id", F.get("tiles", F.lit(0))["item_id"].alias("item_id"), F.size("tile_properties").cast("long").alias("n_properties"), n.alias("n_hvcc"), *(d[x].alias(x) for x in ("primaries", "transfer", "matrix", "full_range")))


PAYLOAD_SQL = "lower(CASE WHEN k = 3 THEN printf('00000001%04X%04X', e % 100 + 1, e % 50 + 1) ELSE printf('%08X', e) || substr(printf('%016X', 3 * e + 1), 1, (2 * (e % 8))::INT) END)"


@query(f"WITH {F_SQL} SELECT file_id, item AS item_id, CASE WHEN k = 3 THEN 1 ELSE 0 END AS method, {PAYLOAD_SQL} AS payload, NULL::VARCHAR AS error FROM f")
def item_payload(spark, sf_dir):
    c = I.open_container(files(spark, sf_dir))
    return I.item_payloads(c, c.pitm).select("file_id", "item_id", "method", F.lower(F.hex("payload")).alias("payload"), "error")


@query("SELECT event_id::BIGINT AS file_id, CASE WHEN event_id % 9 + 7 <= 16 THEN lower(substr(printf('%016X%016X', event_id, event_id * 3 + 1), (2 * (event_id % 9) + 1)::INT, 14) || substr(printf('%016X', event_id), 1, 4)) END AS payload, NULL::VARCHAR AS error FROM events")
def extent_gather(spark, sf_dir):
    e = F.col("event_id")
    from .fixtures import u

    extents = F.array(F.struct((e % 9).cast("decimal(20,0)").alias("off"), F.lit(7).cast("decimal(20,0)").alias("len")), F.struct(F.lit(0).cast("decimal(20,0)").alias("off"), F.lit(2).cast("decimal(20,0)").alias("len")), F.struct(F.lit(3).cast("decimal(20,0)").alias("off"), F.lit(0).cast("decimal(20,0)").alias("len")))
    g = I.gather(F.unhex(F.concat(u(e, 8), u(e * 3 + 1, 8))), extents)
    return events(spark, sf_dir).select(e.alias("file_id"), F.lower(F.hex(g["payload"])).alias("payload"), g["error"].alias("error"))


def extracted(types):
    def f(spark, sf_dir):
        out = I.extract(I.open_container(files(spark, sf_dir)), types)
        return out.select("file_id", "item_id", F.lower(F.hex("payload")).alias("payload"), "error")

    return f


for name, types, k in (("extract_avif", ("av01",), 1), ("extract_heic", ("hvc1", "hev1"), 0), ("extract_unci", ("unci",), 2)):
    QUERIES[name] = extracted(types)
    ORACLES[name] = f"WITH {F_SQL} SELECT file_id, item AS item_id, CASE WHEN k = {k} THEN {PAYLOAD_SQL} END AS payload, CASE WHEN k <> {k} THEN 'unexpected primary item type' END AS error FROM f"


@query(f"WITH {F_SQL} SELECT file_id, 1::BIGINT AS rows, 2::BIGINT AS columns, e % 100 + 1 AS width, e % 50 + 1 AS height, (item + 10) || ',' || (item + 20) AS tiles, NULL::VARCHAR AS error FROM f WHERE k = 3".replace("AS rows", 'AS "rows"').replace("AS columns", 'AS "columns"'))
def extract_grid(spark, sf_dir):
    out = I.extract_grid(I.open_container(files(spark, sf_dir)))
    return out.select("file_id", "rows", "columns", "width", "height", F.array_join(F.col("tiles").cast("array<string>"), ",").alias("tiles"), "error")


@query("SELECT event_id::BIGINT AS file_id, (event_id % 256 + 1)::BIGINT AS n_rows, 3::BIGINT AS n_columns, (event_id % 60000)::BIGINT AS width, 7::BIGINT AS height FROM events")
def grid_descriptor(spark, sf_dir):
    e = F.col("event_id")
    from .fixtures import u

    wide = F.concat(u(0, 1), u(1, 1), u(e % 256, 1), u(2, 1), u(e % 60000, 4), u(7, 4))
    narrow = F.concat(u(0, 1), u(0, 1), u(e % 256, 1), u(2, 1), u(e % 60000, 2), u(7, 2))
    d = B.grid(F.unhex(F.when(e % 2 == 0, wide).otherwise(narrow)))
    return events(spark, sf_dir).select(e.alias("file_id"), d["rows"].alias("n_rows"), d["columns"].alias("n_columns"), d["width"].alias("width"), d["height"].alias("height"))


def checked(types, config, strict):
    def f(spark, sf_dir):
        r = I.graphs(files(spark, sf_dir), columns=("item_type", "properties", "error")).where(F.col("item_type").isin(*types))
        out = I.checked_properties(r, config, strict)
        return out.select("file_id", "width", "height", F.array_join(F.col("bits").cast("array<string>"), ",").alias("bits"), "error")

    return f


for name, types, config, strict, ks in (("props_avif", ("av01",), "av1C", True, "1"), ("props_avif_pre", ("av01",), "av1C", False, "1"), ("props_heic", ("hvc1",), "hvcC", True, "0"), ("props_heic_pre", ("hvc1", "grid"), "hvcC", False, "0, 3")):
    QUERIES[name] = checked(types, config, strict)
    ORACLES[name] = f"WITH {F_SQL} SELECT file_id, e % 640 AS width, e % 480 + 1 AS height, '8,8,' || (e % 3 + 8) AS bits, CASE WHEN e % 640 = 0 THEN 'zero extent' END AS error FROM f WHERE k IN ({ks})"


# the host side


#: Brands by event: those that are known, and some that aren't.
BRANDS = ("heic", "heix", "hevc", "hevx", "heim", "heis", "mif1", "msf1", "miaf", "avif", "avis", "hevm", "jpeg", "isom")


@query(f"""SELECT event_id::BIGINT AS file_id, CASE WHEN event_id % 5 = 4 OR event_id % 14 > 10 THEN NULL WHEN event_id % 14 IN (9, 10) THEN 'avif' ELSE 'heif' END AS family FROM events""")
def hook_detect(spark, sf_dir):
    """Families by brand; files without ftyp, and cut off ones, have none."""
    from .fixtures import box, text, u

    e = F.col("event_id")
    brand = F.get(F.array(*(text(b) for b in BRANDS)), (e % 14).cast("int"))
    whole = box("ftyp", brand, u(0, 4), text("mif1"))
    head = F.when(e % 10 == 4, F.substr(whole, F.lit(1), F.lit(22))).when(e % 10 == 9, box("free", brand, u(0, 4))).otherwise(whole)
    return events(spark, sf_dir).select(e.alias("file_id"), S.family(F.unhex(head)).alias("family"))


@query(f"WITH {SIZES_SQL} SELECT file_id, CASE WHEN 48 + meta > 360 THEN 'ResourceLimit' END AS error, 48 + meta <= 360 AS has_content FROM z")
def hook_limits(spark, sf_dir):
    rows = files(spark, sf_dir).withColumn("length", F.octet_length("content").cast("long"))
    return S.limited(rows, 360).select("file_id", "error", F.col("content").isNotNull().alias("has_content"))


@query("SELECT event_id::BIGINT AS file_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id * 4 * (event_id % 100) * 2)::BIGINT END AS total_bytes, CASE WHEN event_id % 2 = 0 THEN 'rgba8' ELSE 'rgba16' END AS storage FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, NULL, CASE WHEN event_id % 2 = 0 THEN 'rgba8' ELSE 'rgba16' END FROM events WHERE event_id % 3 = 0")
def hook_sizes(spark, sf_dir):
    e = F.col("event_id")
    w, h = F.when(e % 3 == 0, F.lit(1 << 62)).otherwise(e), F.when(e % 3 == 0, F.lit(4)).otherwise(e % 100)
    return events(spark, sf_dir).select(e.alias("file_id"), host.rgba_bytes(w, h, F.lit(16)).alias("total_bytes"), host.storage((e % 2) * 4 + 8).alias("storage"))
