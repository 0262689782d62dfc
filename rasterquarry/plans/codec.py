"""Queries over streams and syntax formulas, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterquarry.functions import bytes as by
from rasterquarry.operators import codec as C

from .container import dealt, events
from .fixtures import u

QUERIES, ORACLES = {}, {}
E_SQL = "f AS (SELECT event_id::BIGINT AS e, user_id::BIGINT AS w FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def formula(name: str, columns, sql: str):
    """A query of columns computed from e, the event_id; columns gives them once a session is there."""
    QUERIES[name] = lambda spark, sf_dir: events(spark, sf_dir).select(F.col("event_id").alias("e")).select("e", *(v.alias(k) for k, v in columns(F.col("e")).items()))
    ORACLES[name] = f"WITH {E_SQL} SELECT e, {sql} FROM f"


def head(kind, layer=0, tid=1):
    """A NAL unit header's two bytes as hex."""
    return u(kind * 512 + layer * 8 + tid, 2)


def streams(spark, sf_dir):
    """Two units a stream, length-prefixed or after start codes: type event_id % 40, then one that has an emulation prevention byte."""
    k = F.col("event_id")
    one, two = F.concat(head(k % 40, 0, k % 7 + 1), u(k % 250 + 1, 1)), F.concat(head(F.lit(39)), u(0x0000030100FF, 6))
    lengths = F.concat(u(3, 4), one, u(8, 4), two)
    starts = F.concat(u(1, 4), one, u(1, 3), two)
    return events(spark, sf_dir).select(k.alias("item"), F.unhex(F.when(k % 2 == 0, lengths).otherwise(starts)).alias("stream"))


UNITS_SQL = f"""WITH {E_SQL} SELECT e AS item, 0 AS pos, (e % 40)::INT AS type, 0 AS layer, (e % 7)::INT AS temporal_id, lower(printf('%02X', e % 250 + 1)) AS payload, '' AS removed FROM f WHERE e % 2 = {{}}
UNION ALL SELECT e, 1, 39, 0, 0, '00000100ff', '2' FROM f WHERE e % 2 = {{}}"""


def units(framing):
    def f(spark, sf_dir):
        rows = streams(spark, sf_dir).where(C.framing(F.col("stream")) == framing)
        return C.nal_units(rows).select("item", "pos", "type", "layer", "temporal_id", F.lower(F.hex("payload")).alias("payload"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))

    return f


QUERIES |= {"nal_length": units("length"), "nal_annexb": units("annexb")}
ORACLES |= {"nal_length": UNITS_SQL.format(0, 0), "nal_annexb": UNITS_SQL.format(1, 1)}


@query(f"WITH {E_SQL} SELECT e AS item, CASE WHEN e % 2 = 0 THEN 'length' ELSE 'annexb' END AS framing FROM f")
def nal_detect(spark, sf_dir):
    return streams(spark, sf_dir).select("item", C.framing(F.col("stream")).alias("framing"))


@query(f"WITH {E_SQL} SELECT e AS item, '00000100ff' AS payload, 1::BIGINT AS n_removed FROM f")
def epb_strip(spark, sf_dir):
    return C.nal_units(streams(spark, sf_dir)).where("pos = 1").select("item", F.lower(F.hex("payload")).alias("payload"), F.size("removed").cast("long").alias("n_removed"))


formula(
    "nal_header",
    lambda e: {k: C.nal_header(F.unhex(u(e % 65536, 2)))[k] for k in ("type", "layer", "temporal_id", "error")},
    "e % 65536 // 512 % 64 AS type, e % 512 // 8 AS layer, e % 8 - 1 AS temporal_id, CASE WHEN e % 65536 >= 32768 THEN 'forbidden bit' WHEN e % 8 = 0 THEN 'temporal id 0' END AS error",
)
formula(
    "nal_classify",
    lambda e: {k: C.nal_class(e % 64)[k] for k in ("slice", "idr", "rasl", "radl", "irap", "parameter_set")},
    "e % 64 <= 9 OR e % 64 BETWEEN 16 AND 21 AS slice, e % 64 IN (19, 20) AS idr, e % 64 IN (8, 9) AS rasl, e % 64 IN (6, 7) AS radl, e % 64 BETWEEN 16 AND 23 AS irap, e % 64 BETWEEN 32 AND 34 AS parameter_set",
)
formula("bits", lambda e: {"high": by.bits(e, 8, 4), "low": by.bits(e, 0, 3), "text": F.lpad(F.bin(e), 20, "0")}, "e // 256 % 16 AS high, e % 8 AS low, lpad(bin(e), 20, '0') AS text")
formula("exp_golomb", lambda e: {"ue": by.ue_bits(F.concat(ue(e % 500), F.lit("1011"))), "se": by.se_bits(F.concat(ue(e % 500), F.lit("1011")))}, "e % 500 AS ue, CASE WHEN e % 500 % 2 = 1 THEN (e % 500 + 1) // 2 ELSE -(e % 500 // 2) END AS se")
formula("slice_enums", lambda e: {"slice_type": C.slice_type(e % 3), "intra": C.slice_type(e % 3) == "I"}, "['B', 'P', 'I'][(e % 3 + 1)::INT] AS slice_type, e % 3 = 2 AS intra")
formula(
    "chroma_qp",
    lambda e: {"qp": C.chroma_qp(e % 60 - 2).cast("long"), "other": C.chroma_qp(e % 60 - 2, False).cast("long")},
    "(CASE WHEN q < 30 THEN q WHEN q >= 43 THEN q - 6 ELSE [29, 30, 31, 32, 33, 33, 34, 34, 35, 35, 36, 36, 37][(q - 29)::INT] END)::BIGINT AS qp, least(q, 51) AS other FROM (SELECT e, e % 60 - 2 AS q FROM f)\n--",
)
formula(
    "intra_mode_chroma",
    lambda e: {"mode": C.chroma_mode(e % 35, e % 5).cast("long")},
    "CASE WHEN e % 5 = 4 THEN e % 35 WHEN [0, 26, 10, 1][(e % 5 + 1)::INT] = e % 35 THEN 34 ELSE [0, 26, 10, 1][(e % 5 + 1)::INT] END::BIGINT AS mode",
)
formula(
    "mpm",
    lambda e: {"modes": F.array_join(C.most_probable((e % 35).cast("int"), F.floor(e / 35 % 35).cast("int")).cast("array<string>"), ",")},
    "CASE WHEN a = b AND a < 2 THEN '0,1,26' WHEN a = b THEN a || ',' || (2 + (a + 29) % 32) || ',' || (2 + (a - 1) % 32) ELSE a || ',' || b || ',' || CASE WHEN a <> 0 AND b <> 0 THEN 0 WHEN a <> 1 AND b <> 1 THEN 1 ELSE 26 END END AS modes FROM (SELECT e, e % 35 AS a, e // 35 % 35 AS b FROM f)\n--",
)
formula(
    "intra_mode",
    lambda e: {"mode": C.luma_mode(C.most_probable((e % 35).cast("int"), F.floor(e / 35 % 35).cast("int")), F.when(e % 2 == 0, e % 3), e % 32).cast("long")},
    """CASE WHEN e % 2 = 0 THEN m[(e % 3 + 1)::INT] ELSE (SELECT r FROM (SELECT r, row_number() OVER (ORDER BY r) - 1 AS n FROM range(35) t(r) WHERE NOT list_contains(m, r)) WHERE n = e % 32) END::BIGINT AS mode
FROM (SELECT e, CASE WHEN a = b AND a < 2 THEN [0, 1, 26] WHEN a = b THEN [a, 2 + (a + 29) % 32, 2 + (a - 1) % 32] ELSE [a, b, CASE WHEN a <> 0 AND b <> 0 THEN 0 WHEN a <> 1 AND b <> 1 THEN 1 ELSE 26 END] END AS m FROM (SELECT e, e % 35 AS a, e // 35 % 35 AS b FROM f))\n--""",
)
formula(
    "scan_order",
    lambda e: {"scan": C.scan_order(e % 4 + 2, e % 35, e % 3, F.lit(1))},
    "CASE WHEN e % 4 + 2 = 2 OR (e % 4 + 2 = 3 AND e % 3 = 0) THEN CASE WHEN e % 35 BETWEEN 6 AND 14 THEN 'vertical' WHEN e % 35 BETWEEN 22 AND 30 THEN 'horizontal' ELSE 'diagonal' END ELSE 'diagonal' END AS scan",
)
formula(
    "cabac_ctx",
    lambda e: {"state": C.context_state((e % 256).cast("int"), (e % 60 - 4).cast("int"))["state"].cast("long"), "mps": C.context_state((e % 256).cast("int"), (e % 60 - 4).cast("int"))["mps"].cast("long")},
    """CASE WHEN p <= 63 THEN 63 - p ELSE p - 64 END AS state, (p > 63)::BIGINT AS mps
FROM (SELECT e, greatest(1, least(126, (((e % 256 // 16) * 5 - 45) * greatest(0, least(51, e % 60 - 4)) >> 4) + (e % 16) * 8 - 16)) AS p FROM f)\n--""",
)
formula("qp_derive", lambda e: {"qp": C.luma_qp(e % 52, F.floor(e / 52) % 52, e % 53 - 26, F.lit(12)).cast("long")}, "(((e % 52 + e // 52 % 52 + 1) // 2 + e % 53 - 26 + 52 + 24) % 64 - 12)::BIGINT AS qp")
formula(
    "scaling_factor",
    lambda e: {"m": C.scaling_factor(F.lit(32), (e % 32).cast("int"), (F.floor(e / 32) % 32).cast("int"), F.array(*(F.lit(3 * i + 1) for i in range(64))), F.lit(7)).cast("long")},
    "CASE WHEN e % 32 = 0 AND e // 32 % 32 = 0 THEN 7 ELSE ((e // 32 % 32 // 4) * 8 + e % 32 // 4) * 3 + 1 END::BIGINT AS m",
)
formula(
    "ps_derived",
    lambda e: {"ctb": C.derived_sizes(e + 1, e % 4 + 3)["ctb"], "wide": C.derived_sizes(e + 1, e % 4 + 3)["n"], "depth": e % 5 + 8, "array_type": C.chroma_array_type(e % 4, e % 2 == 1)},
    "(1 << (e % 4 + 3)::INT)::BIGINT AS ctb, ((e + (1 << (e % 4 + 3)::INT)) // (1 << (e % 4 + 3)::INT))::BIGINT AS wide, e % 5 + 8 AS depth, CASE WHEN e % 2 = 1 THEN 0 ELSE e % 4 END::BIGINT AS array_type",
)


@query("""WITH c AS (SELECT o, s, (i % s)::INT AS x, (i // s)::INT AS y FROM (SELECT unnest(['horizontal', 'vertical', 'diagonal']) AS o), (SELECT unnest([4, 8]) AS s), range(64) t(i) WHERE i < s * s)
SELECT o AS scan, s AS side, (row_number() OVER (PARTITION BY o, s ORDER BY CASE o WHEN 'horizontal' THEN y WHEN 'vertical' THEN x ELSE x + y END, CASE o WHEN 'horizontal' THEN x WHEN 'vertical' THEN y ELSE x END) - 1)::INT AS pos, x, y FROM c""")
def scan_tables(spark, sf_dir):
    from functools import reduce

    parts = [C.scan_positions(spark, s, o).select(F.lit(o).alias("scan"), F.lit(s).alias("side"), "pos", "x", "y") for o in ("horizontal", "vertical", "diagonal") for s in (4, 8)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def ue(v):
    """An unsigned Exp-Golomb code as a string of bits."""
    b = F.bin(v + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(b) - 1), b)


def packed(*parts):
    """A bit string as bytes, closed by a stop bit. The string is built once, and cut into whole bytes after up to seven zeros."""
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("10000000"))
    octets = F.regexp_extract_all(text, F.lit("[01]{8}"), F.lit(0))
    return F.unhex(F.array_join(F.transform(octets, lambda b: F.lpad(F.conv(b, 2, 16), 2, "0")), ""))


PTL = "00" + "0" + "00011" + "0" * 80 + format(93, "08b")


@query(f"WITH {E_SQL} SELECT e AS item, 3::BIGINT AS profile, 93::BIGINT AS level, 1::BIGINT AS chroma_format, e % 4000 + 8 AS width, e % 2000 + 8 AS height, 8::BIGINT AS bit_depth_luma, 3::BIGINT AS log2_min_cb, 6::BIGINT AS log2_ctb, e % 2 AS sao, (e % 4000 + 8 + 63) // 64 AS ctbs_wide, NULL::VARCHAR AS error FROM f")
def ps_sps(spark, sf_dir):
    k = F.col("event_id")
    bits = packed("0000", "000", "1", PTL, "1", ue(F.lit(1)), ue(k % 4000 + 8), ue(k % 2000 + 8), "0", ue(F.lit(0)), ue(F.lit(0)), ue(F.lit(4)), "1", "1", "1", "1", ue(F.lit(0)), ue(F.lit(3)), ue(F.lit(0)), ue(F.lit(3)), "1", "1", "0", "0", (k % 2).cast("string"), "0")
    nals = dealt(spark, sf_dir).select(k.alias("item"), F.lit(33).alias("type"), bits.alias("payload"))
    return C.parameter_sets(nals, 33).select("item", "profile", "level", "chroma_format", "width", "height", "bit_depth_luma", "log2_min_cb", "log2_ctb", "sao", "ctbs_wide", "error")


@query(f"WITH {E_SQL} SELECT e AS item, e % 4 AS id, 0::BIGINT AS sps_id, e % 2 AS sign_hiding, 26 + e % 5 AS init_qp, -(e % 3) AS cb_qp_offset, 0::BIGINT AS bypass, e % 2 AS wavefront, CASE WHEN e % 2 = 0 THEN 2 * (e % 3) ELSE 0 END AS beta_offset, NULL::VARCHAR AS error FROM f")
def ps_pps(spark, sf_dir):
    k = F.col("event_id")
    deblock = F.when(k % 2 == 0, F.concat(F.lit("100"), ue(F.when(k % 3 == 0, 0).otherwise(2 * (k % 3) - 1)), F.lit("1"))).otherwise("0")
    bits = packed(ue(k % 4), "1", "0", "0", "000", (k % 2).cast("string"), "0", "1", "1", ue(F.when(k % 5 == 0, 0).otherwise(2 * (k % 5) - 1)), "0", "0", "0", ue(2 * (k % 3)), "1", "0", "00", "0", "0", (k % 2).cast("string"), "0", deblock)
    nals = dealt(spark, sf_dir).select(k.alias("item"), F.lit(34).alias("type"), bits.alias("payload"))
    return C.parameter_sets(nals, 34).select("item", "id", "sps_id", "sign_hiding", "init_qp", "cb_qp_offset", "bypass", "wavefront", "beta_offset", "error")


@query(f"WITH {E_SQL} SELECT e AS item, CASE WHEN e % 5 > 0 THEN e % 16 END AS id, CASE WHEN e % 5 > 0 THEN 1 END::BIGINT AS max_layers, CASE WHEN e % 5 > 0 THEN 93 END::BIGINT AS level, CASE WHEN e % 5 = 0 THEN 'reserved bits' END AS error FROM f")
def ps_vps(spark, sf_dir):
    k = F.col("event_id")
    bits = packed(F.lpad(F.bin(k % 16), 4, "0"), "11", "000000", "000", "1", F.when(k % 5 > 0, "1" * 16).otherwise("0" * 16), PTL)
    nals = dealt(spark, sf_dir).select(k.alias("item"), F.lit(32).alias("type"), bits.alias("payload"))
    return C.parameter_sets(nals, 32).select("item", "id", "max_layers", "level", "error")


@query(f"WITH {E_SQL} SELECT e AS item, 2::BIGINT AS profile_space, e % 2 AS tier, e % 32 AS profile, e % 200 AS level FROM f")
def ps_ptl(spark, sf_dir):
    k = F.col("event_id")
    ptl = F.concat(F.lit("10"), (k % 2).cast("string"), F.lpad(F.bin(k % 32), 5, "0"), F.lit("0" * 80), F.lpad(F.bin(k % 200), 8, "0"))
    bits = packed("0000", "11", "000000", "000", "1", "1" * 16, ptl)
    nals = dealt(spark, sf_dir).select(k.alias("item"), F.lit(32).alias("type"), bits.alias("payload"))
    return C.parameter_sets(nals, 32).select("item", "profile_space", "tier", "profile", "level")


@query(f"""WITH {E_SQL} SELECT e AS item, 2::BIGINT AS slice_type, e % 2 AS sao_luma, (1 - e % 2) * (e % 2) AS sao_chroma, 26 - e % 4 AS qp, 10 + e % 7 || ',' || (30 + 2 * (e % 7)) AS entry_points, NULL::VARCHAR AS error FROM f""".replace("(1 - e % 2) * (e % 2)", "e % 2 * (e // 2 % 2)"))
def slice_hdr(spark, sf_dir):
    k = F.col("event_id")
    sps = packed("0000", "000", "1", PTL, "1", ue(F.lit(1)), ue(F.lit(640)), ue(F.lit(480)), "0", ue(F.lit(0)), ue(F.lit(0)), ue(F.lit(4)), "1", "1", "1", "1", ue(F.lit(0)), ue(F.lit(3)), ue(F.lit(0)), ue(F.lit(3)), "1", "1", "0", "0", (k % 2).cast("string"), "0")
    pps = packed("1", "1", "0", "0", "000", "0", "0", "1", "1", "1", "0", "0", "0", "1", "1", "0", "00", "0", "0", "1", "0", "0", "0")
    sao = F.when(k % 2 == 1, F.concat(F.lit("1"), F.expr("event_id div 2 % 2").cast("string"))).otherwise("")
    offset = lambda v: F.lpad(F.bin(v - 1), 6, "0")
    head = packed("1", "0", "1", "011", sao, ue(F.when(k % 4 == 0, 0).otherwise(2 * (k % 4))), ue(F.lit(2)), ue(F.lit(5)), offset(k % 7 + 10), offset(k % 7 + 20))
    one = lambda kind, pos, body: dealt(spark, sf_dir).select(k.alias("item"), F.lit(pos).alias("pos"), F.lit(kind).alias("type"), F.lit(0).alias("layer"), body.alias("payload"))
    nals = one(33, 0, sps).union(one(34, 1, pps)).union(one(19, 2, head))
    return C.slice_headers(nals).select("item", "slice_type", "sao_luma", "sao_chroma", "qp", F.array_join(F.col("entry_points").cast("array<string>"), ",").alias("entry_points"), "error")


def bits_of(value, n):
    """The n low bits of a number as text, nothing for n = 0."""
    return F.when(n > 0, F.lpad(F.bin(value), n.cast("int"), "0")).otherwise("")


def _rice_code(v, rice):
    """How a level is coded: the inverse of golomb_rice, for its query."""
    step = F.pow(F.lit(2), rice).cast("long")
    q = F.floor(v / step)
    wide = F.floor(F.log2((q - 2).cast("double")))
    small = F.concat(F.repeat(F.lit("1"), q.cast("int")), F.lit("0"), bits_of(v % step, rice))
    rest = v - (F.pow(F.lit(2), wide).cast("long") + 2) * step
    large = F.concat(F.repeat(F.lit("1"), (wide + 3).cast("int")), F.lit("0"), bits_of(rest, wide + rice))
    return F.when(q <= 3, small).otherwise(large)


formula("coeff_rem", lambda e: {"level": C.golomb_rice(F.concat(_rice_code(e % 3000, e % 5), F.lit("0110")), (e % 5).cast("int"))}, "e % 3000 AS level")


def _k_code(v, k):
    """The inverse of golomb_k, for its query."""
    ones = F.floor(F.log2(((v + F.pow(F.lit(2), k)) / F.pow(F.lit(2), k)).cast("double")))
    rest = v - (F.pow(F.lit(2), ones + k) - F.pow(F.lit(2), k)).cast("long")
    return F.concat(F.repeat(F.lit("1"), ones.cast("int")), F.lit("0"), bits_of(rest, ones + k))


formula("cabac_bypass", lambda e: {"value": C.golomb_k(F.concat(_k_code(e % 2000, e % 3), F.lit("101")), (e % 3).cast("int"))}, "e % 2000 AS value")
formula(
    "last_sig",
    lambda e: {"at": C.last_position((e % 10).cast("int"), e % 2).cast("long")},
    "CASE WHEN e % 10 < 4 THEN e % 10 ELSE (1 << (e % 10 // 2 - 1)::INT)::BIGINT * (2 + e % 2) + e % 2 END::BIGINT AS at",
)
