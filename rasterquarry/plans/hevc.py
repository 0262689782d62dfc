"""Queries over coded pictures: streams written from the events table by stated choices, and SQL that states what they hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rasterquarry.operators import boxes as B
from rasterquarry.operators import codec as C
from rasterquarry.operators import hevc as H

from . import streams as S
from .container import events

QUERIES, ORACLES = {}, {}
#: A picture has so many events as samples: three coding tree units of 16 samples don't fit whole.
WIDE, HIGH = 24, 32
SAMPLES = WIDE * HIGH
#: SQL of the samples of whole pictures, 0 where an event lacks, and of the choices by place.
S_SQL = f"""i AS (SELECT DISTINCT (event_id // {SAMPLES})::BIGINT AS item FROM events),
s AS (SELECT i.item, (pos % {WIDE})::INT AS x, (pos // {WIDE})::INT AS y, coalesce((e.event_id * 7919 + e.user_id * 104729) % 256, 0)::INT AS v,
  coalesce((e.event_id * 31 + e.user_id * 17) % 256, 0)::INT AS cb, coalesce((e.event_id * 57 + e.user_id * 13) % 256, 0)::INT AS cr
  FROM i CROSS JOIN range({SAMPLES}) t(pos) LEFT JOIN events e ON e.event_id = i.item * {SAMPLES} + pos)"""
#: Coding units (x, y, log2, parts), then their transform blocks (x, y, n).
U_SQL = f"""i AS (SELECT DISTINCT (event_id // {SAMPLES})::BIGINT AS item FROM events),
c AS (SELECT item, x * 16 AS x, y * 16 AS y, x = 0 AND (x + y + item) % 2 = 0 AS whole FROM i, range(2) a(x), range(2) b(y)),
u AS (SELECT item, x, y, 4 AS log2, 1 AS parts FROM c WHERE whole
  UNION ALL SELECT item, x + 8 * dx, y + 8 * dy, 3, CASE WHEN ((x + 8 * dx) // 8 + 2 * ((y + 8 * dy) // 8) + item) % 3 = 0 THEN 4 ELSE 1 END FROM c, range(2) a(dx), range(2) b(dy) WHERE NOT whole AND x + 8 * dx < {WIDE}),
t AS (SELECT item, x, y, CASE WHEN log2 = 4 THEN 16 ELSE 8 END AS n, parts, CASE WHEN log2 = 4 THEN (x // 16 + y // 16 + item) % 4 < 2 ELSE parts = 4 OR (x // 8 + y // 8 + item) % 2 = 0 END AS split FROM u),
tb AS (SELECT item, x, y, n FROM t WHERE NOT split UNION ALL SELECT item, x + dx * n // 2, y + dy * n // 2, n // 2 FROM t, range(2) a(dx), range(2) b(dy) WHERE split)"""


class Rules(S.H.Plan):
    """Choices that follow from the place and the picture's number; without loss."""

    def __init__(self, planes, item):
        super().__init__(planes)
        self.item = item

    def sao(self, rx, ry):
        if rx and self.item % 2 == 0:
            return "left"
        if ry and self.item % 3 == 0:
            return "up"
        kind, k = (rx + ry + self.item) % 3, self.item % 7
        offsets = {0: (0, 0, 0, 0), 1: (k, -1, rx + 1, -ry), 2: (k, rx, -ry, -2)}[kind]
        return [(kind, offsets, (k + c * (kind == 1)) % (4 if kind == 2 else 32) if kind else 0) for c in (0, 1, 2)]

    def split(self, x, y, log2):
        return int((x // 16 + y // 16 + self.item) % 2)

    def quarters(self, x, y):
        return int((x // 8 + 2 * (y // 8) + self.item) % 3 == 0)

    def mode(self, x, y):
        return (x // 4 * 3 + y // 4 * 5 + self.item) % 35

    def chroma(self, x, y):
        return (x // 4 + y // 4 + self.item) % 5

    def split_transform(self, x, y, log2):
        return int((x // 16 + y // 16 + self.item) % 4 < 2 if log2 == 4 else (x // 8 + y // 8 + self.item) % 2 == 0)


def _write_batches(batches, options):
    """A stream a row, of few pictures at once: a batch may hold thousands."""
    kind = options["format"]
    sub = (slice(None, None, 2 if kind == 1 else 1), slice(None, None, 2 if kind in (1, 2) else 1))
    for batch in B.steps(batches, 16):
        lists, out, end = batch.column("samples"), [], 0
        at, *values = (x.to_numpy() for x in lists.flatten().flatten())
        for item, n in zip(batch.column("item").to_pylist(), lists.value_lengths().to_pylist()):
            flat, own = np.zeros((3, SAMPLES), np.int64), slice(end, end + n)
            flat[:, at[own]] = [v[own] for v in values]
            planes = list(flat.reshape(3, HIGH, WIDE))
            planes = planes[:1] + [p[sub] for p in planes[1:]] * bool(kind)
            out.append(S.encode(planes, Rules(planes, item), annexb=item % 2 == 1, **options)[0])
            end += n
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(out, pa.binary())], names=["item", "stream"])


def pictures(spark, sf_dir, **options):
    """(item, stream): pictures of the events' samples, coded without loss."""
    e, w = F.col("event_id"), F.col("user_id")
    sample = F.struct((e % SAMPLES).cast("int").alias("at"), ((e * 7919 + w * 104729) % 256).cast("int").alias("v"), ((e * 31 + w * 17) % 256).cast("int").alias("cb"), ((e * 57 + w * 13) % 256).cast("int").alias("cr"))
    rows = events(spark, sf_dir).groupBy(F.floor(e / SAMPLES).cast("long").alias("item")).agg(F.collect_list(sample).alias("samples"))
    rows = rows.repartition(spark.sparkContext.defaultParallelism)  # few rows, much to do for each
    from functools import partial

    return rows.mapInArrow(partial(_write_batches, options=options), "item long, stream binary")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def samples(decoded, component: int = 0):
    rows = decoded.select("item", "width", F.posexplode(F.get("planes", F.lit(component))).alias("at", "v"))
    return rows.select("item", (F.col("at") % F.col("width")).alias("x"), F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), "v")


@query(f"WITH {S_SQL} SELECT item, x, y, v, cb, cr FROM s")
def hevc_decode(spark, sf_dir):
    """Whole 4:4:4 pictures, split and predicted in every way that the rules give."""
    rows = H.decode(pictures(spark, sf_dir, format=3)).select("item", "width", F.posexplode(F.arrays_zip(*(F.col("planes")[k].alias(c) for k, c in enumerate(("v", "cb", "cr"))))).alias("at", "p"))
    return rows.select("item", (F.col("at") % F.col("width")).alias("x"), F.floor(F.col("at") / F.col("width")).cast("int").alias("y"), "p.v", "p.cb", "p.cr")


@query(f"WITH {S_SQL} SELECT item, x, y, v FROM s")
def ctu_loop(spark, sf_dir):
    """Rows of coding tree units as wavefronts, each with a part and contexts of its own."""
    return samples(H.decode(pictures(spark, sf_dir, format=0, wavefront=1)))


@query(f"""WITH i AS (SELECT DISTINCT (event_id // {SAMPLES})::BIGINT AS item FROM events),
c AS (SELECT item, x::INT AS cx, y::INT AS cy, CASE WHEN x = 1 AND item % 2 = 0 THEN 0 ELSE x END AS sx, y FROM i, range(2) a(x), range(2) b(y)),
m AS (SELECT item, cx, cy, sx, CASE WHEN y = 1 AND item % 3 = 0 THEN 0 ELSE y END AS sy FROM c),
k AS (SELECT *, ((sx + sy + item) % 3)::INT AS kind, (item % 7)::INT AS k FROM m)
SELECT item, cx, cy, component::INT AS component, kind, CASE kind WHEN 0 THEN '0,0,0,0' WHEN 1 THEN concat(k, ',-1,', sx + 1, ',', -sy) ELSE concat(k, ',', sx, ',', -sy, ',-2') END AS offsets,
  (CASE kind WHEN 0 THEN 0 WHEN 1 THEN k + component ELSE k % 4 END)::INT AS place FROM k, range(3) t(component)""")
def ctu(spark, sf_dir):
    """Sample adaptive offset parameters of every coding tree unit and component, own ones and merged ones."""
    rows = H.decode(pictures(spark, sf_dir, format=1, sao=1)).select("item", F.explode("sao").alias("s"))
    s = F.col("s")
    return rows.select("item", s[0].alias("cx"), s[1].alias("cy"), s[2].alias("component"), s[3].alias("kind"), F.array_join(F.slice("s", 5, 4).cast("array<string>"), ",").alias("offsets"), F.when(s[3] == 0, 0).otherwise(s[8]).alias("place"))


@query(f"WITH {U_SQL} SELECT item, x::INT AS x, y::INT AS y, log2::INT AS log2 FROM u")
def quadtree(spark, sf_dir):
    rows = H.decode(pictures(spark, sf_dir, format=0)).select("item", F.explode("units").alias("u"))
    return rows.select("item", *(F.col("u")[k].alias(c) for k, c in enumerate(("x", "y", "log2"))))


@query(f"WITH {U_SQL} SELECT item, parts::INT AS parts, count(*)::BIGINT AS units, sum(x + {WIDE} * y)::BIGINT AS places FROM u GROUP BY item, parts")
def cu(spark, sf_dir):
    """Coding units of one part and of four."""
    rows = H.decode(pictures(spark, sf_dir, format=1)).select("item", F.explode("units").alias("u"))
    u = F.col("u")
    return rows.groupBy("item", u[3].alias("parts")).agg(F.count("*").alias("units"), F.sum(u[0] + WIDE * u[1]).alias("places"))


@query(f"WITH {U_SQL} SELECT item, x::INT AS x, y::INT AS y, n::INT AS n FROM tb")
def tt(spark, sf_dir):
    rows = H.decode(pictures(spark, sf_dir, format=0)).select("item", F.explode("blocks").alias("b"))
    return rows.select("item", F.col("b")[1].alias("x"), F.col("b")[2].alias("y"), F.col("b")[3].alias("n"))


@query(f"""WITH {U_SQL},
m AS (SELECT item, x, y, n FROM tb WHERE n > 4 UNION ALL SELECT DISTINCT item, x // 8 * 8, y // 8 * 8, 8 FROM tb WHERE n = 4),
h AS (SELECT * FROM m, (VALUES (1, 0), (2, 0), (2, 1)) f(format, half))
SELECT format, item, component::INT AS component, (x // 2)::INT AS x, (CASE WHEN format = 1 THEN y // 2 ELSE y + half * n // 2 END)::INT AS y, (n // 2)::INT AS n FROM h, (VALUES (1), (2)) t(component)""")
def tt_chroma(spark, sf_dir):
    """Chroma blocks of 4:2:0 and, two for one, of 4:2:2; four 4 x 4 luma blocks share one."""
    b = F.col("b")
    parts = [H.decode(pictures(spark, sf_dir, format=k)).select(F.lit(k).alias("format"), "item", F.explode("blocks").alias("b")).where(b[0] > 0) for k in (1, 2)]
    return parts[0].unionByName(parts[1]).select("format", "item", b[0].alias("component"), b[1].alias("x"), b[2].alias("y"), b[3].alias("n"))


@query(f"""WITH {U_SQL}, p AS (SELECT item, x + dx * 4 AS px, y + dy * 4 AS py, CASE WHEN parts = 4 THEN x + dx * 4 ELSE x END AS mx, CASE WHEN parts = 4 THEN y + dy * 4 ELSE y END AS my
  FROM u, range(4) a(dx), range(4) b(dy) WHERE dx * 4 < 1 << log2 AND dy * 4 < 1 << log2)
SELECT item, (px // 4)::INT AS x, (py // 4)::INT AS y, ((mx // 4 * 3 + my // 4 * 5 + item) % 35)::INT AS mode FROM p""")
def mode_store(spark, sf_dir):
    """The luma mode of each 4 x 4 block, from candidates of the blocks beside it."""
    rows = H.decode(pictures(spark, sf_dir, format=0)).select("item", F.posexplode("modes").alias("at", "mode"))
    return rows.select("item", (F.col("at") % (WIDE // 4)).alias("x"), F.floor(F.col("at") / (WIDE // 4)).cast("int").alias("y"), "mode")


def _bin_streams(batches):
    for batch in B.steps(batches):
        out = []
        for r in batch.to_pylist():
            w = H.Writer(r["qp"])
            for c, v in zip(r["places"], r["bins"]):
                w.bypass(v) if c < 0 else w.bin(c, v)
            w.terminate(1)
            out.append(b"".join(w.parts))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("item", "qp", "places")), pa.array(out, pa.binary())], names=["item", "qp", "places", "stream"])


@query("SELECT event_id // 100 AS item, (event_id % 100)::INT AS pos, CASE WHEN event_id % 11 = 0 THEN user_id % 2 ELSE (event_id * event_id + user_id) % 5 // 4 END::INT AS bin FROM events")
def cabac_engine(spark, sf_dir):
    """Bins of 100 events by several contexts and none, arithmetically coded and decoded."""
    e, w = F.col("event_id"), F.col("user_id")
    one = F.struct((e % 100).cast("int").alias("at"), F.when(e % 11 == 0, w % 2).otherwise(F.floor((e * e + w) % 5 / 4)).cast("int").alias("v"), F.when(e % 11 == 0, -1).otherwise(e % 3 * 40).cast("int").alias("c"))
    rows = events(spark, sf_dir).groupBy(F.floor(e / 100).cast("long").alias("item")).agg(F.array_sort(F.collect_list(one)).alias("b"))
    rows = rows.select("item", (F.col("item") % 52).cast("int").alias("qp"), F.col("b.c").alias("places"), F.col("b.v").alias("bins"), "b")
    coded = rows.select("item", "qp", "places", "bins").mapInArrow(_bin_streams, "item long, qp int, places array<int>, stream binary")
    at = rows.select("item", F.col("b.at").alias("pos"))
    both = H.read_bins(coded).join(at, "item").select("item", F.explode(F.arrays_zip("pos", "bins")).alias("z"))
    return both.select("item", "z.pos", F.col("z.bins").alias("bin"))


def _level_streams(batches):
    for batch in B.steps(batches):
        out = []
        for r in batch.to_pylist():
            n = 1 << r["log2"]
            w = H.Writer(r["qp"])
            H.residual(w, r["log2"], r["component"], r["scan"], False, np.array(r["levels"]).reshape(n, n))
            w.terminate(1)
            out.append(b"".join(w.parts))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("item", "qp", "log2", "component", "scan")), pa.array(out, pa.binary())], names=["item", "qp", "log2", "component", "scan", "stream"])


@query("""WITH l AS (SELECT event_id // 64 AS item, event_id % 64 AS pos, CASE WHEN event_id % 64 = 0 THEN 1 WHEN event_id % 3 = 0 THEN event_id * 7 % 41 - 20 WHEN event_id % 29 = 1 THEN 3000 - user_id ELSE 0 END AS v FROM events)
SELECT item, sum(v)::BIGINT AS total, sum(v * (pos + 1))::BIGINT AS weighed, count_if(v <> 0)::BIGINT AS found FROM l GROUP BY item""")
def residual(spark, sf_dir):
    """Blocks of 8 x 8 levels from 64 events each, in all scans and components, written and read."""
    e, w = F.col("event_id"), F.col("user_id")
    v = F.when(e % 64 == 0, 1).when(e % 3 == 0, e * 7 % 41 - 20).when(e % 29 == 1, 3000 - w).otherwise(0)
    rows = events(spark, sf_dir).groupBy(F.floor(e / 64).cast("long").alias("item")).agg(F.collect_list(F.struct((e % 64).cast("int").alias("at"), v.cast("int").alias("v"))).alias("p"))
    lacks = F.array_except(F.sequence(F.lit(0), F.lit(63)), F.col("p.at"))
    levels = F.array_sort(F.concat("p", F.transform(lacks, lambda i: F.struct(i.alias("at"), F.lit(0).alias("v")))))["v"]
    rows = rows.select("item", (F.col("item") % 52).cast("int").alias("qp"), F.lit(3).alias("log2"), (F.col("item") % 2).cast("int").alias("component"), (F.col("item") % 3).cast("int").alias("scan"), levels.alias("levels"))
    rows = rows.where(F.exists("levels", lambda x: x != 0))
    coded = rows.mapInArrow(_level_streams, "item long, qp int, log2 int, component int, scan int, stream binary")
    out = H.read_levels(coded).select("item", F.posexplode("levels").alias("at", "v"))
    return out.groupBy("item").agg(F.sum("v").alias("total"), F.sum(F.col("v") * (F.col("at") + 1)).alias("weighed"), F.sum((F.col("v") != 0).cast("long")).alias("found"))


_INITIAL = [v for group in H.INITIAL.values() for v in group]


@query(f"""WITH v AS (SELECT unnest({_INITIAL}) AS v, unnest(range({len(_INITIAL)})) AS place), q AS (SELECT DISTINCT (event_id % 60 - 4)::INT AS qp FROM events),
p AS (SELECT qp, place::INT AS place, greatest(1, least(126, (((v // 16 * 5 - 45) * greatest(0, least(51, qp))) >> 4) + v % 16 * 8 - 16)) AS pre FROM q, v)
SELECT qp, place, (CASE WHEN pre <= 63 THEN 63 - pre ELSE pre - 64 END)::INT AS state, (pre > 63)::INT AS likely FROM p""")
def ctx_reset(spark, sf_dir):
    """All contexts of an intra slice at each QP, also beyond its range."""
    rows = events(spark, sf_dir).select((F.col("event_id") % 60 - 4).cast("int").alias("qp")).distinct()
    out = H.initial_contexts(rows).select("qp", F.posexplode("contexts").alias("place", "c"))
    return out.select("qp", "place", F.shiftright("c", 1).alias("state"), F.col("c").bitwiseAND(1).alias("likely"))


def _sps_batches(batches, kind):
    for batch in B.steps(batches, 100):
        out = []
        for e in batch.column("item").to_pylist():
            o = dict(S.DEFAULTS)
            if kind == "lists":
                o |= {"scaling": 1, "lists": None if e % 4 == 0 else {(s, m): (tuple((e * 3 + s * 7 + m * 11 + i * 5) % 255 + 1 for i in range(16 if s == 0 else 64)), (e + s + m) % 200 + 1) for s in range(4) for m in range(6)}}
            else:
                o |= {"vui": e % 2 == 1, "reference_sets": e % 5, "strong": e % 3 // 2}
            payload = S.parameter_sets(16, 16, o)[0]
            out.append(payload[: len(payload) // 2] if kind == "skip" and e % 7 == 6 else payload)
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(out, pa.binary())], names=["item", "payload"])


def sps_rows(spark, sf_dir, kind: str):
    from functools import partial

    e = F.col("event_id")
    items = events(spark, sf_dir).select((F.floor(e / 20).cast("long") if kind == "lists" else e).alias("item")).distinct()
    items = items.repartition(spark.sparkContext.defaultParallelism)  # few narrow rows, which else are read by as few tasks, and much to do for each
    return items.mapInArrow(partial(_sps_batches, kind=kind), "item long, payload binary")


@query("""WITH k AS (SELECT item, s::INT AS size, m::INT AS matrix, s AS z FROM (SELECT DISTINCT (event_id // 20)::BIGINT AS item FROM events), range(4) a(s), range(6) b(m)),
d AS (SELECT item, size, matrix, CASE WHEN size = 3 AND matrix NOT IN (0, 3) THEN 2 ELSE size END AS s FROM k)
SELECT item, size, matrix,
  (CASE WHEN item % 4 > 0 THEN list_sum([(item * 3 + s * 7 + matrix * 11 + i * 5) % 255 + 1 for i in range(CASE WHEN size = 0 THEN 16 ELSE 64 END)]) WHEN size = 0 THEN 256 WHEN matrix < 3 THEN 1939 ELSE 1752 END)::BIGINT AS total,
  (CASE WHEN item % 4 = 0 OR size < 2 THEN 16 ELSE (item + s + matrix) % 200 + 1 END)::INT AS first FROM d""")
def ps_scaling(spark, sf_dir):
    """Scaling lists: own ones by differences, and the defaults; 32 x 32 chroma takes those of 16 x 16."""
    rows = H.whole_sps(sps_rows(spark, sf_dir, "lists")).select("item", F.explode("lists").alias("l"))
    total = F.aggregate("l.values", F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.select("item", "l.size", "l.matrix", total.alias("total"), "l.first")


@query("""SELECT event_id::BIGINT AS item, CASE WHEN event_id % 7 < 6 THEN event_id % 3 // 2 END::INT AS strong_smoothing, CASE WHEN event_id % 7 < 6 AND event_id % 2 = 1 THEN 1 END::INT AS full_range,
  CASE WHEN event_id % 7 < 6 AND event_id % 2 = 1 THEN 1 END::INT AS primaries, CASE WHEN event_id % 7 = 6 THEN 'out of bits' END AS error FROM events""")
def ps_skip(spark, sf_dir):
    """What stands after reference sets, and usability with decoder parameters; every seventh set is cut off."""
    return H.whole_sps(sps_rows(spark, sf_dir, "skip")).select("item", "strong_smoothing", "full_range", "primaries", "error")


def _slice_batches(batches):
    for batch in B.steps(batches):
        qps, errors = [], []
        for e in batch.column("item").to_pylist():
            o = S.DEFAULTS | {"reference_sets": e % 4}
            sps, pps = (read(x, whole=True) for read, x in zip((C.sps, C.pps), S.parameter_sets(16, 16, o)))
            b = S.BitWriter().u(1, 1).u(1, 0).ue(0, 2).u(8, e % 256)
            if e % 3 == 0:
                b.u(1, 1).u(max(0, e % 4 - 1).bit_length(), 0)
            else:
                b.u(1, 0)
                if e % 4:
                    b.u(1, int(e % 5 == 0))
                b.ue(1, 1).ue(e % 9).u(1, 1).ue(2).u(1, 0)
            b.se(e % 20 - 10)
            try:
                qps.append(C.slice_header(b.closed() + bytes(4), 21, sps, pps, whole=True)["qp"])
                errors.append(None)
            except ValueError as error:
                qps.append(None)
                errors.append(str(error))
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(qps, pa.int32()), pa.array(errors, pa.string())], names=["item", "qp", "error"])


@query("""WITH b AS (SELECT event_id::BIGINT AS item, event_id % 3 > 0 AND event_id % 4 > 0 AND event_id % 5 = 0 AS bad FROM events)
SELECT item, CASE WHEN NOT bad THEN 16 + item % 20 END::INT AS qp, CASE WHEN bad THEN 'UnsupportedFeature: predicted reference picture set' END AS error FROM b""")
def slice_rps(spark, sf_dir):
    """Slices of pictures that aren't IDR: the QP stands after the reference pictures, of which predicted sets are rejected."""
    return events(spark, sf_dir).select(F.col("event_id").alias("item")).mapInArrow(_slice_batches, "item long, qp int, error string")
