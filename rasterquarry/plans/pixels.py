"""Queries over planes, and their SQL. Samples follow from events; images are 25 x 16."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterquarry.operators import host
from rasterquarry.operators import pixels as P
from rasterquarry.operators import reports as R

from .container import events
from .fixtures import HEIGHT, PIXELS_SQL, WIDTH
from .fixtures import pixels as samples

QUERIES, ORACLES = {}, {}
_FORMULA_BASE = "f AS (SELECT event_id::BIGINT AS e FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def px(spark, sf_dir):
    return samples(events(spark, sf_dir))


def formula(name: str, columns, sql: str):
    QUERIES[name] = lambda spark, sf_dir: events(spark, sf_dir).select(F.col("event_id").alias("e")).select("e", *(v.alias(k) for k, v in columns(F.col("e")).items()))
    ORACLES[name] = f"WITH {_FORMULA_BASE} SELECT e, {sql} FROM f"


# scaling and transforms

formula(
    "dequant",
    lambda e: {"low": P.dequantize(e % 2001 - 1000, e % 52, 8, 2), "high": P.dequantize(e % 2001 - 1000, e % 52, 12, 5)},
    "greatest(-32768, least(32767, (c * s + 1) >> 1))::INT AS low, greatest(-32768, least(32767, (c * s + 128) >> 8))::INT AS high FROM (SELECT e, e % 2001 - 1000 AS c, [40, 45, 51, 57, 64, 72][(e % 52 % 6 + 1)::INT]::BIGINT * (1 << (e % 52 // 6)::INT)::BIGINT AS s FROM f)\n--",
)
formula(
    "dequant_scaled",
    lambda e: {"c": P.dequantize(e % 2001 - 1000, e % 52, 8, 3, e % 255 + 1)},
    "greatest(-32768, least(32767, (c * s * (e % 255 + 1) + 32) >> 6))::INT AS c FROM (SELECT e, e % 2001 - 1000 AS c, [40, 45, 51, 57, 64, 72][(e % 52 % 6 + 1)::INT]::BIGINT * (1 << (e % 52 // 6)::INT)::BIGINT AS s FROM f)\n--",
)
formula("residual_add", lambda e: {"v": P.add_residual(e % 256, e % 701 - 350).cast("int")}, "greatest(0, least(255, e % 256 + e % 701 - 350))::INT AS v")


def blocks(spark, sf_dir, size: int):
    """(blk, coeffs): every event is a coefficient, size * size of them by event_id a block; what a block lacks is 0."""
    n = size * size
    e = F.col("event_id")
    own = events(spark, sf_dir).select(F.floor(e / n).cast("long").alias("blk"), F.struct((e % n).cast("int").alias("at"), ((e * 37 + F.col("user_id") * 101) % 601 - 300).cast("int").alias("c")).alias("p"))
    rows = own.groupBy("blk").agg(F.collect_list("p").alias("p"))
    lacks = F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), F.col("p.at"))
    whole = F.concat("p", F.transform(lacks, lambda i: F.struct(i.alias("at"), F.lit(0).alias("c"))))
    return rows.select("blk", F.array_sort(whole)["c"].alias("coeffs"))


# The cosines and sines of the integer transforms, as in the operators.
_COSINES = "[64, 90, 90, 90, 89, 88, 87, 85, 83, 82, 80, 78, 75, 73, 70, 67, 64, 61, 57, 54, 50, 46, 43, 38, 36, 31, 25, 22, 18, 13, 9, 4, 0]"
_SINES = "[[29, 55, 74, 84], [74, 74, 0, -74], [84, -29, -74, 55], [55, -84, 74, -29]]"


def transform_sql(size: int, sine: bool = False) -> str:
    """Two matrix products as joins on the inner index."""
    step = 32 // size
    cosine = f"CASE WHEN k = 0 THEN 64 WHEN a <= 32 THEN {_COSINES}[a + 1] ELSE -{_COSINES}[64 - a + 1] END"
    basis = f"(SELECT k, n, {_SINES}[k + 1][n + 1] AS m FROM range(4) x(k), range(4) y(n))" if sine else f"(SELECT k, n, {cosine} AS m FROM (SELECT k, n, least(k * {step} * (2 * n + 1) % 128, 128 - k * {step} * (2 * n + 1) % 128)::INT AS a FROM range({size}) x(k), range({size}) y(n)))"
    wide = "((s + 2048) >> 12)"
    last = f"(({wide} + 32768) % 65536 + 65536) % 65536 - 32768" if size == 4 else f"greatest(-32768, least(32767, {wide}))"
    return f"""WITH b AS {basis},
c AS (SELECT event_id // {size * size} AS blk, event_id % {size * size} // {size} AS k, event_id % {size} AS x, (event_id * 37 + user_id * 101) % 601 - 300 AS c FROM events),
t AS (SELECT blk, n AS y, x, greatest(-32768, least(32767, (sum(m * c) + 64)::BIGINT >> 7)) AS v FROM c JOIN b USING (k) GROUP BY blk, n, x),
o AS (SELECT blk, y, n AS x, sum(m * v)::BIGINT AS s FROM t JOIN b ON b.k = t.x GROUP BY blk, y, n)
SELECT blk, string_agg({last}, ',' ORDER BY y, x) AS residual FROM o GROUP BY blk"""


def transform(size: int, sine: bool):
    def f(spark, sf_dir):
        out = P.inverse_transforms(blocks(spark, sf_dir, size), size, 8, sine)
        return out.select("blk", F.array_join(F.col("residual").cast("array<string>"), ",").alias("residual"))

    return f


for name, size, sine in (("idst4", 4, True), ("idct4", 4, False), ("idct8", 8, False), ("idct16", 16, False), ("idct32", 32, False)):
    QUERIES[name], ORACLES[name] = transform(size, sine), transform_sql(size, sine)


# intra prediction


def borders(spark, sf_dir, size: int, holes: bool = False):
    e = F.col("event_id")
    v = lambda i: ((e * 53 + i * 29) % 256).cast("int")
    gap = (lambda i: F.when((i + e) % 5 < 2, v(i))) if holes else v
    return events(spark, sf_dir).select(e.alias("blk"), (e % 35).cast("int").alias("mode"), F.transform(F.sequence(F.lit(0), F.lit(4 * size)), gap).alias("border"))


def joined(c: str):
    return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)


@query("""WITH b AS (SELECT event_id AS blk, i, CASE WHEN (i + event_id) % 5 < 2 THEN (event_id * 53 + i * 29) % 256 END AS v FROM events, range(17) t(i))
SELECT blk, string_agg(w, ',' ORDER BY i) AS border FROM (SELECT blk, i, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY blk ORDER BY i), first_value(v IGNORE NULLS) OVER (PARTITION BY blk ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS w FROM b) GROUP BY blk""")
def border_subst(spark, sf_dir):
    return borders(spark, sf_dir, 4, True).select("blk", P.substitute_border(F.col("border"), 128).alias("border")).select("blk", joined("border"))


@query("""WITH b AS (SELECT event_id AS blk, event_id % 35 AS mode, i, (event_id * 53 + i * 29) % 256 AS v FROM events, range(33) t(i)),
n AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS z FROM b WINDOW w AS (PARTITION BY blk ORDER BY i))
SELECT blk, string_agg(CASE WHEN mode <> 1 AND least(abs(mode - 26), abs(mode - 10)) > 7 AND i BETWEEN 1 AND 31 THEN (a + 2 * v + z + 2) >> 2 ELSE v END, ',' ORDER BY i) AS border FROM n GROUP BY blk""")
def border_filter(spark, sf_dir):
    rows = borders(spark, sf_dir, 8)
    return rows.select("blk", P.filter_border(F.col("border"), 8, F.col("mode"), True).alias("border")).select("blk", joined("border"))


def predicted(mode, size: int):
    def f(spark, sf_dir):
        rows = borders(spark, sf_dir, size)
        rows = rows.withColumn("mode", F.lit(mode)) if mode is not None else rows.withColumn("mode", (F.col("blk") % 33 + 2).cast("int"))
        return P.predictions(rows, size).select("blk", "mode", joined("predicted"))

    return f


_BORDER8 = "b AS (SELECT event_id AS blk, i - 16 AS i, (event_id * 53 + i * 29) % 256 AS v FROM events, range(33) t(i)), c AS (SELECT x, y FROM range(8) s(x), range(8) t(y))"
QUERIES["pred_planar"] = predicted(0, 8)
ORACLES["pred_planar"] = f"""WITH {_BORDER8}, e AS (SELECT blk, max(CASE WHEN i = 9 THEN v END) AS r, max(CASE WHEN i = -9 THEN v END) AS d FROM b GROUP BY blk)
SELECT e.blk, 0 AS mode, string_agg(((7 - x) * l.v + (x + 1) * r + (7 - y) * t.v + (y + 1) * d + 8) >> 4, ',' ORDER BY y, x) AS predicted
FROM e, c JOIN b l ON l.i = -1 - y JOIN b t ON t.i = 1 + x WHERE l.blk = e.blk AND t.blk = e.blk GROUP BY e.blk"""
QUERIES["pred_dc"] = predicted(1, 8)
ORACLES["pred_dc"] = f"""WITH {_BORDER8}, e AS (SELECT blk, (sum(v)::BIGINT + 8) >> 4 AS dc FROM b WHERE i BETWEEN -8 AND 8 AND i <> 0 GROUP BY blk)
SELECT e.blk, 1 AS mode, string_agg(CASE WHEN x = 0 AND y = 0 THEN (l.v + 2 * dc + t.v + 2) >> 2 WHEN y = 0 THEN (t.v + 3 * dc + 2) >> 2 WHEN x = 0 THEN (l.v + 3 * dc + 2) >> 2 ELSE dc END, ',' ORDER BY y, x) AS predicted
FROM e, c JOIN b l ON l.i = -1 - y JOIN b t ON t.i = 1 + x WHERE l.blk = e.blk AND t.blk = e.blk GROUP BY e.blk"""
# The angles of modes 2 to 34, and the inverse angles of modes 11 to 25.
_ANGLES = "[32, 26, 21, 17, 13, 9, 5, 2, 0, -2, -5, -9, -13, -17, -21, -26, -32, -26, -21, -17, -13, -9, -5, -2, 0, 2, 5, 9, 13, 17, 21, 26, 32]"
_INVERSE = "[-4096, -1638, -910, -630, -482, -390, -315, -256, -315, -390, -482, -630, -910, -1638, -4096]"
QUERIES["pred_angular"] = predicted(None, 8)
ORACLES["pred_angular"] = f"""WITH {_BORDER8}, m AS (SELECT DISTINCT blk, (blk % 33 + 2)::INT AS mode, {_ANGLES}[(blk % 33 + 1)::INT] AS a, CASE WHEN blk % 33 + 2 BETWEEN 11 AND 25 THEN {_INVERSE}[(blk % 33 - 8)::INT] END AS inv, CASE WHEN blk % 33 >= 16 THEN 1 ELSE -1 END AS up FROM b),
p AS (SELECT m.*, x, y, CASE WHEN up = 1 THEN x ELSE y END AS u, CASE WHEN up = 1 THEN y ELSE x END AS w FROM m, c),
q AS (SELECT *, ((w + 1) * a) >> 5 AS n, ((w + 1) * a) & 31 AS part FROM p),
r AS (SELECT *, u + n + 1 AS k FROM q),
s AS (SELECT *, CASE WHEN k >= 0 THEN up * k ELSE -up * ((k * inv + 128) >> 8) END AS i0, CASE WHEN k + 1 >= 0 THEN up * (k + 1) ELSE -up * (((k + 1) * inv + 128) >> 8) END AS i1 FROM r)
SELECT s.blk, mode, string_agg(CASE WHEN a = 0 AND u = 0 THEN greatest(0, least(255, h.v + ((g.v - z.v) >> 1))) ELSE ((32 - part) * b0.v + part * coalesce(b1.v, 0) + 16) >> 5 END, ',' ORDER BY y, x) AS predicted
FROM s JOIN b b0 ON b0.blk = s.blk AND b0.i = i0 LEFT JOIN b b1 ON b1.blk = s.blk AND b1.i = i1 JOIN b h ON h.blk = s.blk AND h.i = up JOIN b z ON z.blk = s.blk AND z.i = 0 JOIN b g ON g.blk = s.blk AND g.i = -up * (w + 1)
GROUP BY s.blk, mode"""


# in-loop filters

_BETA = "[0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 20, 22, 24, 26, 28, 30, 32, 34, 36, 38, 40, 42, 44, 46, 48, 50, 52, 54, 56, 58, 60, 62, 64]"
_TC = "[0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 5, 5, 6, 6, 7, 8, 9, 10, 11, 13, 14, 16, 18, 20, 22, 24]"
_CL = "greatest(0, least(255, {}))"


def _soft(value: str, by: str) -> str:
    return f"greatest(0, least(255, greatest({by} - 2 * t, least({by} + 2 * t, {value}))))"


@query(f"""WITH {PIXELS_SQL}, g AS (SELECT img, x, y, 100 + v % 23 AS v FROM px),
n AS (SELECT img, x AS edge, y AS line, lag(v, 4) OVER w AS p3, lag(v, 3) OVER w AS p2, lag(v, 2) OVER w AS p1, lag(v, 1) OVER w AS p0, v AS q0, lead(v, 1) OVER w AS q1, lead(v, 2) OVER w AS q2, lead(v, 3) OVER w AS q3 FROM g WINDOW w AS (PARTITION BY img, y ORDER BY x)),
l AS (SELECT *, {_BETA}[(img % 52 + 1)::INT] AS b, {_TC}[least(53, img % 52 + 2)::INT + 1] AS t, abs(p2 - 2 * p1 + p0) AS dp, abs(q2 - 2 * q1 + q0) AS dq FROM n WHERE edge % 8 = 0 AND edge > 0 AND q3 IS NOT NULL),
s AS (SELECT *, count(*) OVER w AS cnt, sum(CASE WHEN line % 4 IN (0, 3) THEN dp END) OVER w AS sp, sum(CASE WHEN line % 4 IN (0, 3) THEN dq END) OVER w AS sq,
  bool_and(line % 4 NOT IN (0, 3) OR (2 * (dp + dq) < b >> 2 AND abs(p3 - p0) + abs(q0 - q3) < b >> 3 AND abs(p0 - q0) < (5 * t + 1) >> 1)) OVER w AS strong FROM l WINDOW w AS (PARTITION BY img, edge, line // 4)),
d AS (SELECT *, cnt = 4 AND t > 0 AND sp + sq < b AS is_on, (9 * (q0 - p0) - 3 * (q1 - p1) + 8) >> 4 AS raw, (b + (b >> 1)) >> 3 AS part FROM s),
k AS (SELECT *, greatest(-t, least(t, raw)) AS d FROM d)
SELECT img, edge, line, p3,
  (CASE WHEN is_on AND strong THEN {_soft('(2 * p3 + 3 * p2 + p1 + p0 + q0 + 4) >> 3', 'p2')} ELSE p2 END)::INT AS p2,
  (CASE WHEN is_on AND strong THEN {_soft('(p2 + p1 + p0 + q0 + 2) >> 2', 'p1')} WHEN is_on AND abs(raw) < 10 * t AND sp < part THEN {_CL.format('p1 + greatest(-(t >> 1), least(t >> 1, (((p2 + p0 + 1) >> 1) - p1 + d) >> 1))')} ELSE p1 END)::INT AS p1,
  (CASE WHEN is_on AND strong THEN {_soft('(p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4) >> 3', 'p0')} WHEN is_on AND abs(raw) < 10 * t THEN {_CL.format('p0 + d')} ELSE p0 END)::INT AS p0,
  (CASE WHEN is_on AND strong THEN {_soft('(p1 + 2 * p0 + 2 * q0 + 2 * q1 + q2 + 4) >> 3', 'q0')} WHEN is_on AND abs(raw) < 10 * t THEN {_CL.format('q0 - d')} ELSE q0 END)::INT AS q0,
  (CASE WHEN is_on AND strong THEN {_soft('(p0 + q0 + q1 + q2 + 2) >> 2', 'q1')} WHEN is_on AND abs(raw) < 10 * t AND sq < part THEN {_CL.format('q1 + greatest(-(t >> 1), least(t >> 1, (((q2 + q0 + 1) >> 1) - q1 - d) >> 1))')} ELSE q1 END)::INT AS q1,
  (CASE WHEN is_on AND strong THEN {_soft('(p0 + q0 + q1 + 3 * q2 + 2 * q3 + 4) >> 3', 'q2')} ELSE q2 END)::INT AS q2, q3 FROM k""")
def deblock_luma(spark, sf_dir):
    smooth = px(spark, sf_dir).withColumn("v", 100 + F.col("v") % 23)
    return P.deblock_luma(P.edge_lines(smooth), F.col("img") % 52)


formula(
    "deblock_chroma",
    lambda e: {k: P.deblock_chroma(e % 256, e % 251, e % 241, e % 239, e % 20)[k] for k in ("p0", "q0")},
    "greatest(0, least(255, e % 251 + d))::INT AS p0, greatest(0, least(255, e % 241 - d))::INT AS q0 FROM (SELECT e, greatest(-(e % 20), least(e % 20, (4 * (e % 241 - e % 251) + e % 256 - e % 239 + 4) >> 3)) AS d FROM f)\n--",
)
formula(
    "sao_band",
    lambda e: {"v": P.sao_band(e % 256, e % 32, F.array(*(F.lit(x) for x in (-5, 3, 7, -2)))).cast("int")},
    "(CASE WHEN k < 4 THEN greatest(0, least(255, e % 256 + [-5, 3, 7, -2][(k + 1)::INT])) ELSE e % 256 END)::INT AS v FROM (SELECT e, ((e % 256 >> 3) - e % 32 + 32) % 32 AS k FROM f)\n--",
)


@query(f"""WITH {PIXELS_SQL}, d AS (SELECT *, (img % 4)::INT AS c, [1, 0, 1, 1][(img % 4 + 1)::INT] AS dx, [0, 1, 1, -1][(img % 4 + 1)::INT] AS dy FROM px)
SELECT d.img, d.x, d.y, (CASE WHEN a.v IS NULL OR b.v IS NULL THEN d.v ELSE greatest(0, least(255, d.v + [6, 2, 0, -2, -6][(3 + sign(d.v - a.v) + sign(d.v - b.v))::INT])) END)::INT AS v
FROM d LEFT JOIN px a ON a.img = d.img AND a.x = d.x - d.dx AND a.y = d.y - d.dy LEFT JOIN px b ON b.img = d.img AND b.x = d.x + d.dx AND b.y = d.y + d.dy""")
def sao_edge(spark, sf_dir):
    offsets = F.array(*map(F.lit, (6, 2, -2, -6)))
    return P.sao_edges(px(spark, sf_dir).select("img", "x", "y", "v"), F.col("img") % 4, offsets, WIDTH, HEIGHT)


@query(f"""WITH {PIXELS_SQL}, s AS (SELECT *, ((img * 7 + x // 16 + y // 16) % 3)::INT AS kind FROM px), w AS (SELECT *, lag(v) OVER (PARTITION BY img, y ORDER BY x) AS a, lead(v) OVER (PARTITION BY img, y ORDER BY x) AS b FROM s)
SELECT img, x, y, (CASE kind WHEN 0 THEN v WHEN 1 THEN CASE WHEN ((v >> 3) - 4 + 32) % 32 < 4 THEN greatest(0, least(255, v + [4, -4, 2, -2][((v >> 3) - 4 + 32) % 32 + 1])) ELSE v END
  ELSE CASE WHEN a IS NULL OR b IS NULL THEN v ELSE greatest(0, least(255, v + [6, 2, 0, -2, -6][(3 + sign(v - a) + sign(v - b))::INT])) END END)::INT AS v FROM w""")
def sao(spark, sf_dir):
    kind = (F.col("img") * 7 + F.floor(F.col("x") / 16) + F.floor(F.col("y") / 16)) % 3
    raw = px(spark, sf_dir).select("img", "x", "y", F.col("v"), F.col("v").alias("plain"))
    edged = P.sao_edges(raw, F.lit(0), F.array(*map(F.lit, (6, 2, -2, -6))), WIDTH, HEIGHT)
    band = P.sao_band(F.col("plain"), F.lit(4), F.array(*map(F.lit, (4, -4, 2, -2))))
    return edged.select("img", "x", "y", F.when(kind == 0, F.col("plain")).when(kind == 1, band).otherwise(F.col("v")).cast("int").alias("v"))


# colour


def _rgb_sql(y="y", cb="cb", cr="cr") -> str:
    one = {"full": ("403,377,359", "-48,-42,-88", "-120,-146,-183", "475,482,454"), "limited": ("14744,13806,13126", "-1754,-1541,-3222", "-4383,-5349,-6686", "17373,17615,16591")}

    def c(kind, i):
        return f"[{one[kind][i]}][mi]"

    full = (f"{y} + (({c('full', 0)} * {cr} + 128) >> 8)", f"{y} + (({c('full', 1)} * {cb} + {c('full', 2)} * {cr} + 128) >> 8)", f"{y} + (({c('full', 3)} * {cb} + 128) >> 8)")
    base = f"({y} - 16) * 9576"
    lim = (f"({base} + {c('limited', 0)} * {cr} + 4096) >> 13", f"({base} + {c('limited', 1)} * {cb} + {c('limited', 2)} * {cr} + 4096) >> 13", f"({base} + {c('limited', 3)} * {cb} + 4096) >> 13")
    return ", ".join(f"greatest(0, least(255, CASE WHEN full_range THEN {a} ELSE {b} END))::INT AS {n}" for n, a, b in zip("rgb", full, lim))


_COLOUR = f"{PIXELS_SQL}, u AS (SELECT p.img, p.x, p.y AS row, p.v AS y, coalesce(c.cb, 128) - 128 AS cb, coalesce(c.cr, 128) - 128 AS cr, [1, 2, 3][(p.img % 3 + 1)::INT] AS mi, p.img % 2 = 0 AS full_range FROM px p LEFT JOIN px c ON c.img = p.img AND c.x = p.x // 2 * 2 AND c.y = p.y // 2 * 2 AND c.x % 2 = 0 AND c.y % 2 = 0)"


def upsampled(spark, sf_dir):
    p = px(spark, sf_dir)
    chroma = p.where("x % 2 = 0 AND y % 2 = 0").select("img", F.expr("x div 2").cast("int").alias("x"), F.expr("y div 2").cast("int").alias("y"), "cb", "cr")
    return P.upsampled(p.select("img", "x", "y", "v"), chroma)


@query(f"WITH {_COLOUR} SELECT img, x, row AS y, cb + 128 AS cb, cr + 128 AS cr FROM u")
def chroma_up(spark, sf_dir):
    return upsampled(spark, sf_dir).select("img", "x", "y", "cb", "cr")


def coloured(spark, sf_dir):
    matrix = F.get(F.array(*map(F.lit, (1, 9, 6))), (F.col("img") % 3).cast("int"))
    return upsampled(spark, sf_dir).withColumn("c", P.rgb(F.col("v"), F.col("cb"), F.col("cr"), matrix, F.col("img") % 2 == 0)).select("img", "x", "y", "c.r", "c.g", "c.b")


_RGB = f"{_COLOUR}, c AS (SELECT img, x, row AS y, {_rgb_sql()} FROM (SELECT img, x, row, y, cb, cr, mi, full_range FROM u))"


@query(f"WITH {_RGB} SELECT * FROM c")
def ycbcr_int(spark, sf_dir):
    return coloured(spark, sf_dir)


def output(order: str):
    def f(spark, sf_dir):
        rows = coloured(spark, sf_dir).withColumn("a", F.lit(255))
        return P.interleaved(rows, order).select("img", F.sha2(F.array_join(F.col("samples").cast("array<string>"), ","), 256).alias("sha256"), F.size("samples").cast("long").alias("n_samples"))

    return f


for name, order in (("out_rgb", "rgb"), ("out_rgba", "rgba"), ("out_bgr", "bgr"), ("out_bgra", "bgra")):
    QUERIES[name] = output(order)
    one = " || ',' || ".join("255" if c == "a" else c for c in order)
    ORACLES[name] = f"WITH {_RGB} SELECT img, sha256(string_agg({one}, ',' ORDER BY y, x)) AS sha256, (count(*) * {len(order)})::BIGINT AS n_samples FROM c GROUP BY img"

formula("bit_replicate", lambda e: {"ten": P.replicate_bits(e % 1024, 10), "twelve": P.replicate_bits(e % 4096, 12), "eight": P.replicate_bits(e % 256, 8)}, "((e % 1024) << 6) | ((e % 1024) >> 4) AS ten, ((e % 4096) << 4) | ((e % 4096) >> 8) AS twelve, (e % 256) * 257 AS eight")
formula("x_decode_rgb8", lambda e: {"v": P.narrowed(e % 65536)}, "(e % 65536 + 128) // 257 AS v")
formula("frame_alloc", lambda e: {"cw": P.chroma_size(e % 4000 + 1, F.lit(True)), "ch": P.chroma_size(e % 3000 + 1, e % 3 == 0)}, "(e % 4000 + 2) // 2 AS cw, CASE WHEN e % 3 = 0 THEN (e % 3000 + 2) // 2 ELSE e % 3000 + 1 END AS ch")


@query(f"WITH {PIXELS_SQL} SELECT img, (x - 3)::INT AS x, (y - 1)::INT AS y, v FROM px WHERE x BETWEEN 3 AND 22 AND y BETWEEN 1 AND 10")
def crop(spark, sf_dir):
    return P.crop(px(spark, sf_dir).select("img", "x", "y", "v"), 3, 2, 1, 5, WIDTH, HEIGHT)


@query(f"WITH {PIXELS_SQL} SELECT a.img, a.x, a.y, coalesce(b.v, 0)::INT AS v FROM px a LEFT JOIN px b ON b.img = a.img AND b.x = a.x + 5 AND b.y = a.y + 5")
def sample_get(spark, sf_dir):
    p = px(spark, sf_dir)
    places = p.select("img", "x", "y", (F.col("x") + 5).alias("at_x"), (F.col("y") + 5).alias("at_y"))
    return P.samples_at(p.select("img", "x", "y", "v"), places).select("img", "x", "y", "v")


# geometry


def moved(move):
    return lambda spark, sf_dir: move(px(spark, sf_dir).select("img", "x", "y", "v")).select("img", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "v")


for name, move, sql in (
    ("rot90", lambda p: P.rotated(p, 90, WIDTH, HEIGHT), "15 - y AS x, x AS y"),
    ("rot180", lambda p: P.rotated(p, 180, WIDTH, HEIGHT), "24 - x AS x, 15 - y AS y"),
    ("rot270", lambda p: P.rotated(p, 270, WIDTH, HEIGHT), "y AS x, 24 - x AS y"),
    ("mirror_h", lambda p: P.mirrored(p, True, WIDTH, HEIGHT), "24 - x AS x, y"),
    ("mirror_v", lambda p: P.mirrored(p, False, WIDTH, HEIGHT), "x, 15 - y AS y"),
    ("exif_orient", lambda p: P.oriented(p, F.col("img") % 10, WIDTH, HEIGHT), "CASE img % 10 WHEN 2 THEN 24 - x WHEN 3 THEN 24 - x WHEN 5 THEN y WHEN 6 THEN 15 - y WHEN 7 THEN 15 - y WHEN 8 THEN y ELSE x END AS x, CASE img % 10 WHEN 3 THEN 15 - y WHEN 4 THEN 15 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 24 - x WHEN 8 THEN 24 - x ELSE y END AS y"),
):
    QUERIES[name] = moved(move)
    ORACLES[name] = f"WITH {PIXELS_SQL} SELECT img, {sql}, v FROM px"


# checksums and reports

_FOLD = f"{PIXELS_SQL}, s AS (SELECT img, list(v ORDER BY y, x) AS a FROM px GROUP BY img), k AS (SELECT img, xor(xor(xor(a[1]::BIGINT << 16, a[len(a) // 2 + 1]::BIGINT << 8), a[len(a)]::BIGINT), len(a)::BIGINT) AS small FROM s)"


def folded(spark, sf_dir):
    one = P.interleaved(px(spark, sf_dir).withColumnRenamed("v", "g"), "g")
    return one.select("img", P.small_checksum(F.col("samples")).alias("small"))


@query(f"WITH {_FOLD} SELECT img, small FROM k")
def checksum_small(spark, sf_dir):
    return folded(spark, sf_dir)


@query(f"WITH {_FOLD} SELECT img, xor(xor(25::BIGINT << 32, 16::BIGINT), small) AS checksum FROM k")
def checksum_image(spark, sf_dir):
    return folded(spark, sf_dir).select("img", P.image_checksum(F.lit(WIDTH), F.lit(HEIGHT), F.col("small")).alias("checksum"))


@query(f"WITH {_FOLD} SELECT img % 4 AS worker, bit_xor(small) AS checksum, count(*)::BIGINT AS n FROM k GROUP BY img % 4")
def bench_workers(spark, sf_dir):
    return folded(spark, sf_dir).groupBy((F.col("img") % 4).alias("worker")).agg(F.bit_xor("small").alias("checksum"), F.count("*").alias("n"))


@query("""WITH o AS (SELECT event_id, event_id % 7 = 0 AS failed, CASE WHEN event_id % 14 = 0 THEN 'unsupported tool' ELSE 'bad box' END AS reason, event_id % 5 = 0 AS differs FROM events)
SELECT CASE WHEN failed AND reason = 'unsupported tool' THEN 'EXPECTED_FAIL' WHEN failed OR differs THEN 'FAIL' ELSE 'PASS' END AS status, count(*)::BIGINT AS n FROM o GROUP BY 1""")
def h_verify(spark, sf_dir):
    e = F.col("event_id")
    rows = events(spark, sf_dir).select((e % 7 == 0).alias("failed"), F.when(e % 14 == 0, "unsupported tool").otherwise("bad box").alias("reason"), (e % 5 == 0).alias("differs"))
    kind = R.expected_kind(F.lit(""), F.col("reason"), [("", "unsupported", "known gap")])
    return rows.groupBy(R.verdict(F.col("failed"), F.col("differs"), kind).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT user_id % 3 AS mode, count(*)::BIGINT AS runs, min(event_id * 7 % 1000)::BIGINT AS fastest_ms, max(event_id * 13 % 5000)::BIGINT AS peak_mb, sum(event_id * 7 % 1000)::BIGINT AS total_ms FROM events GROUP BY 1")
def h_bench_pair(spark, sf_dir):
    e = F.col("event_id")
    return R.compared_modes(events(spark, sf_dir).select((F.col("user_id") % 3).alias("mode"), (e * 7 % 1000).alias("ms"), (e * 13 % 5000).alias("mb")))


# pictures as a whole


def deblocked(spark, sf_dir):
    """Both passes over a plane: all edges across, then, over their result, all edges down."""
    plane = px(spark, sf_dir).select("img", "x", "y", (100 + F.col("v") % 23).alias("v"))
    return P.deblock_plane(plane, F.col("img") % 52)


QUERIES["deblock"] = lambda spark, sf_dir: deblocked(spark, sf_dir).groupBy("img").agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"), F.sum(F.col("v") * (F.col("x") + 1) * (F.col("y") + 3)).cast("long").alias("weighed"))


def _pass_sql(source: str, out: str, across: str, along: str) -> str:
    """One direction of the filter over a plane, sample by sample, as CTEs named by `out`."""
    edge, near = f"({across} + 4) // 8 * 8", f"{across} - ({across} + 4) // 8 * 8"
    taps = ", ".join(f"{f'lag(v, {k + 1})' if side == 'p' else f'lead(v, {k})'} OVER w AS {side}{k}" for side in "pq" for k in range(4))
    new = {
        "p2": f"CASE WHEN is_on AND strong THEN {_soft('(2 * p3 + 3 * p2 + p1 + p0 + q0 + 4) >> 3', 'p2')} ELSE p2 END",
        "p1": f"CASE WHEN is_on AND strong THEN {_soft('(p2 + p1 + p0 + q0 + 2) >> 2', 'p1')} WHEN is_on AND abs(raw) < 10 * t AND sp < part THEN {_CL.format('p1 + greatest(-(t >> 1), least(t >> 1, (((p2 + p0 + 1) >> 1) - p1 + d) >> 1))')} ELSE p1 END",
        "p0": f"CASE WHEN is_on AND strong THEN {_soft('(p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4) >> 3', 'p0')} WHEN is_on AND abs(raw) < 10 * t THEN {_CL.format('p0 + d')} ELSE p0 END",
        "q0": f"CASE WHEN is_on AND strong THEN {_soft('(p1 + 2 * p0 + 2 * q0 + 2 * q1 + q2 + 4) >> 3', 'q0')} WHEN is_on AND abs(raw) < 10 * t THEN {_CL.format('q0 - d')} ELSE q0 END",
        "q1": f"CASE WHEN is_on AND strong THEN {_soft('(p0 + q0 + q1 + q2 + 2) >> 2', 'q1')} WHEN is_on AND abs(raw) < 10 * t AND sq < part THEN {_CL.format('q1 + greatest(-(t >> 1), least(t >> 1, (((q2 + q0 + 1) >> 1) - q1 - d) >> 1))')} ELSE q1 END",
        "q2": f"CASE WHEN is_on AND strong THEN {_soft('(p0 + q0 + q1 + 3 * q2 + 2 * q3 + 4) >> 3', 'q2')} ELSE q2 END",
    }
    pick = f"CASE g.{near} " + " ".join(f"WHEN {k} THEN {out}f.{n}" for n, k in (("p2", -3), ("p1", -2), ("p0", -1), ("q0", 0), ("q1", 1), ("q2", 2))) + " END"
    pick = pick.replace(f"g.{near}", near.replace(across, f"g.{across}"))
    return f"""{out}n AS (SELECT img, {across} AS edge, {along} AS line, {taps} FROM {source} WINDOW w AS (PARTITION BY img, {along} ORDER BY {across})),
{out}l AS (SELECT *, {_BETA}[(img % 52 + 1)::INT] AS b, {_TC}[least(53, img % 52 + 2)::INT + 1] AS t, abs(p2 - 2 * p1 + p0) AS dp, abs(q2 - 2 * q1 + q0) AS dq FROM {out}n WHERE edge % 8 = 0 AND edge > 0 AND q3 IS NOT NULL),
{out}s AS (SELECT *, count(*) OVER w AS cnt, sum(CASE WHEN line % 4 IN (0, 3) THEN dp END) OVER w AS sp, sum(CASE WHEN line % 4 IN (0, 3) THEN dq END) OVER w AS sq,
  bool_and(line % 4 NOT IN (0, 3) OR (2 * (dp + dq) < b >> 2 AND abs(p3 - p0) + abs(q0 - q3) < b >> 3 AND abs(p0 - q0) < (5 * t + 1) >> 1)) OVER w AS strong FROM {out}l WINDOW w AS (PARTITION BY img, edge, line // 4)),
{out}k AS (SELECT *, cnt = 4 AND t > 0 AND sp + sq < b AS is_on, (9 * (q0 - p0) - 3 * (q1 - p1) + 8) >> 4 AS raw, greatest(-t, least(t, (9 * (q0 - p0) - 3 * (q1 - p1) + 8) >> 4)) AS d, (b + (b >> 1)) >> 3 AS part FROM {out}s),
{out}f AS (SELECT img, edge, line, {", ".join(f"({v})::INT AS {k}" for k, v in new.items())} FROM {out}k),
{out} AS (SELECT g.img, g.x, g.y, coalesce({pick}, g.v)::INT AS v FROM {source} g LEFT JOIN {out}f ON {out}f.img = g.img AND {out}f.line = g.{along} AND {out}f.edge = {edge.replace(across, 'g.' + across)})"""


ORACLES["deblock"] = f"""WITH {PIXELS_SQL}, g0 AS (SELECT img, x, y, (100 + v % 23)::INT AS v FROM px), {_pass_sql('g0', 'va', 'x', 'y')}, {_pass_sql('va', 'vb', 'y', 'x')}
SELECT img, count(*)::BIGINT AS n, sum(v)::BIGINT AS total, sum(v * (x + 1) * (y + 3))::BIGINT AS weighed FROM vb GROUP BY img"""


@query(f"""WITH {PIXELS_SQL}, b AS (SELECT img, x // 8 * 8 AS bx, y // 8 * 8 AS by FROM px WHERE (x * 3 + y + img) % 97 = 0 GROUP BY ALL)
SELECT p.img, p.x, p.y, (CASE WHEN b.img IS NULL THEN least(255, p.v + 9) ELSE p.v END)::INT AS v FROM px p LEFT JOIN b ON b.img = p.img AND b.bx = p.x // 8 * 8 AND b.by = p.y // 8 * 8""")
def bypass_map(spark, sf_dir):
    p = px(spark, sf_dir).select("img", "x", "y", "v")
    lossless = p.where("(x * 3 + y + img) % 97 = 0").select("img", F.expr("x div 8 * 8").alias("x"), F.expr("y div 8 * 8").alias("y"), F.lit(8).alias("size"))
    filtered = p.withColumn("filtered", F.least(F.col("v") + 9, F.lit(255)))
    return P.keep_lossless(filtered, lossless).select("img", "x", "y", F.col("v").cast("int").alias("v"))


@query("""WITH t AS (SELECT event_id::BIGINT AS tu, (event_id % 40 * 8)::INT AS x, (event_id // 40 % 30 * 8)::INT AS y, ([4, 8, 16, 32][(event_id % 4 + 1)::INT])::INT AS size FROM events)
SELECT tu, 'left' AS side, x, (y + 4 * i)::INT AS y FROM t, range(8) r(i) WHERE 4 * i < size AND x > 0 UNION ALL SELECT tu, 'top', (x + 4 * i)::INT, y FROM t, range(8) r(i) WHERE 4 * i < size AND y > 0""")
def edge_qp_maps(spark, sf_dir):
    e = F.col("event_id")
    size = F.get(F.array(*map(F.lit, (4, 8, 16, 32))), (e % 4).cast("int"))
    units = events(spark, sf_dir).select(e.alias("tu"), (e % 40 * 8).cast("int").alias("x"), F.expr("int(event_id div 40 % 30 * 8)").alias("y"), size.alias("size"))
    return P.unit_edges(units)


@query(f"""WITH {PIXELS_SQL}, b AS (SELECT DISTINCT img, x AS x0, y AS y0 FROM px WHERE x % 8 = 0 AND y % 8 = 0), i AS (SELECT unnest(range(33))::INT AS i),
c AS (SELECT img, x0, y0, i, CASE WHEN i < 16 THEN x0 - 1 WHEN i = 16 THEN x0 - 1 ELSE x0 + i - 17 END AS x, CASE WHEN i < 16 THEN y0 + 15 - i WHEN i = 16 THEN y0 - 1 ELSE y0 - 1 END AS y FROM b, i)
SELECT c.img, c.x0, c.y0, count(p.v)::BIGINT AS n_available, coalesce(sum(p.v * (c.i + 1)), 0)::BIGINT AS weighed FROM c LEFT JOIN px p ON p.img = c.img AND p.x = c.x AND p.y = c.y GROUP BY c.img, c.x0, c.y0""")
def border_fill(spark, sf_dir):
    p = px(spark, sf_dir).select("img", "x", "y", "v")
    at = p.where("x % 8 = 0 AND y % 8 = 0").select("img", F.col("x").alias("x0"), F.col("y").alias("y0"))
    got = P.borders(p, at, 8)
    weighed = F.aggregate(F.transform("border", lambda v, i: F.coalesce(v.cast("long"), F.lit(0).cast("long")) * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return got.select("img", "x0", "y0", F.size(F.filter("border", lambda v: v.isNotNull())).cast("long").alias("n_available"), weighed.alias("weighed"))


@query(f"""WITH {_COLOUR} SELECT img, x - 3 AS x, row - 1 AS y, greatest(0, least(255, y + ((359 * cr + 128) >> 8)))::INT AS r, greatest(0, least(255, y + ((-88 * cb - 183 * cr + 128) >> 8)))::INT AS g, greatest(0, least(255, y + ((454 * cb + 128) >> 8)))::INT AS b FROM u WHERE x BETWEEN 3 AND 20 AND row BETWEEN 1 AND 11""")
def cc_420_fixed(spark, sf_dir):
    """A region keeps the chroma phase of the whole picture: upsampled first, cropped after."""
    rows = P.crop(upsampled(spark, sf_dir), 3, 4, 1, 4, WIDTH, HEIGHT)
    rows = rows.withColumn("c", P.rgb(F.col("v"), F.col("cb"), F.col("cr"), F.lit(6), F.lit(True)))
    return rows.select("img", "x", "y", "c.r", "c.g", "c.b")


@query(f"""WITH {_COLOUR} SELECT img, x, row AS y, greatest(0, least(255, (y - 16) * 9576 + 13126 * cr + 4096 >> 13))::INT AS r, greatest(0, least(255, (y - 16) * 9576 - 3222 * cb - 6686 * cr + 4096 >> 13))::INT AS g, greatest(0, least(255, (y - 16) * 9576 + 16591 * cb + 4096 >> 13))::INT AS b FROM u""")
def cc_420_rgb(spark, sf_dir):
    """Samples of ten bits, brought to eight by a shift first."""
    rows = upsampled(spark, sf_dir).withColumns({k: F.shiftright(F.col(k) * 4 + 3, 2) for k in ("v", "cb", "cr")})
    rows = rows.withColumn("c", P.rgb(F.col("v"), F.col("cb"), F.col("cr"), F.lit(6), F.lit(False)))
    return rows.select("img", "x", "y", "c.r", "c.g", "c.b")


@query(f"""WITH {PIXELS_SQL} SELECT img // 4 AS img, (x + img % 2 * 25)::INT AS x, (y + img % 4 // 2 * 16)::INT AS y, v FROM px WHERE x + img % 2 * 25 < 45 AND y + img % 4 // 2 * 16 < 30""")
def x_grid(spark, sf_dir):
    """Tiles of 25 x 16 pasted by rows of two into pictures of 45 x 30: what is beyond is cut."""
    tiles = px(spark, sf_dir).select(F.expr("img div 4").alias("img"), (F.col("img") % 4).alias("tile"), "x", "y", "v")
    return P.paste(tiles, 2, WIDTH, HEIGHT, 45, 30)


@query(f"""WITH {PIXELS_SQL}, a AS (SELECT img, x, y, cb AS a FROM px WHERE img % 2 = 0) SELECT p.img, p.x, p.y, p.v, coalesce(a.a, 255)::INT AS a FROM px p LEFT JOIN a USING (img, x, y)""")
def x_alpha(spark, sf_dir):
    p = px(spark, sf_dir)
    alpha = p.where("img % 2 = 0").select("img", "x", "y", F.col("cb").alias("a"))
    return P.with_alpha(p.select("img", "x", "y", "v"), alpha)


# reports over files


@query("SELECT DISTINCT 'f' || (user_id % 40) || ['.heic', '.avif'][(event_id % 2 + 1)::INT] AS path FROM events WHERE event_id % 3 < 2")
def h_gather(spark, sf_dir):
    e = F.col("event_id")
    name = F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string"), F.get(F.array(*map(F.lit, (".heic", ".avif", ".png"))), F.when(e % 3 == 2, 2).otherwise(e % 2).cast("int")))
    rows = events(spark, sf_dir).select(name.alias("path"))
    return R.with_extensions(rows, "heic", "heif", "avif")


@query("SELECT 'f' || lpad(event_id::VARCHAR, 8, '0') AS file_id FROM events WHERE event_id % 7 = 0")
def h_sample(spark, sf_dir):
    from rasterquarry.sources.files import sampled

    return sampled(events(spark, sf_dir).select(F.concat(F.lit("f"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("file_id")), 7)


@query("""SELECT event_id AS file, CASE WHEN event_id % 5 = 0 AND event_id % 7 = 0 THEN 'both absent' WHEN event_id % 5 = 0 THEN 'only ours' WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 11 = 0 THEN 'differs' ELSE 'equal' END AS verdict FROM events""")
def h_icc_compare(spark, sf_dir):
    e = F.col("event_id")
    theirs = F.when(e % 5 != 0, F.sha2(e.cast("string").cast("binary"), 256))
    ours = F.when(e % 7 != 0, F.when(e % 11 == 0, F.lit("x")).otherwise(F.sha2(e.cast("string").cast("binary"), 256)))
    rows = events(spark, sf_dir).select(e.alias("file"), theirs.alias("t"), ours.alias("o"))
    return rows.select("file", R.compared_profiles(F.col("o"), F.col("t")).alias("verdict"))


def _float_sql(depth: int, full: bool) -> str:
    kr, kb = 0.2126, 0.0722
    kg = 1 - kr - kb
    up = 1 << (depth - 8)
    f = lambda v: f"{float(v)!r}::FLOAT"
    s = "" if full else f" * {f(1.1429)}"
    luma = "v::FLOAT" if full else f"(v::FLOAT - {f(16 * up)}) * {f(1.1689)}"
    blue, red = f"(b::FLOAT - {f(128 * up)}){s}", f"(r::FLOAT - {f(128 * up)}){s}"
    parts = {"r": f"{luma} + {f(2 * (1 - kr))} * ({red})", "g": f"{luma} + {f(-2 * kb * (1 - kb) / kg)} * ({blue}) + {f(-2 * kr * (1 - kr) / kg)} * ({red})", "b": f"{luma} + {f(2 * (1 - kb))} * ({blue})"}
    return ", ".join(f"greatest(0, least({(1 << depth) - 1}, trunc({v} + 0.5::FLOAT)::INT))::INT AS {k}" for k, v in parts.items())


@query(f"WITH {PIXELS_SQL} SELECT img, x, y, {_float_sql(8, False)} FROM (SELECT img, x, y, v, cb AS b, cr AS r FROM px)")
def cc_float8(spark, sf_dir):
    c = P.rgb_float(F.col("v"), F.col("cb"), F.col("cr"), 0.2126, 0.0722, 8, False)
    return px(spark, sf_dir).select("img", "x", "y", c.alias("c")).select("img", "x", "y", "c.r", "c.g", "c.b")


@query(f"WITH {PIXELS_SQL}, c AS (SELECT img, x, y, {_float_sql(10, True)} FROM (SELECT img, x, y, v * 4 + 1 AS v, cb * 4 + 2 AS b, cr * 4 + 3 AS r FROM px)) SELECT img, x, y, (r << 6) | (r >> 4) AS r, (g << 6) | (g >> 4) AS g, (b << 6) | (b >> 4) AS b FROM c")
def cc_float16(spark, sf_dir):
    c = P.rgb_float(F.col("v") * 4 + 1, F.col("cb") * 4 + 2, F.col("cr") * 4 + 3, 0.2126, 0.0722, 10, True)
    rows = px(spark, sf_dir).select("img", "x", "y", c.alias("c"))
    return rows.select("img", "x", "y", *(P.replicate_bits(F.col(f"c.{k}"), 10).alias(k) for k in "rgb"))


formula("tskip_bypass", lambda e: {"v": F.when(e % 3 == 0, e % 601 - 300).otherwise(P.skipped_transform(e % 601 - 300)).cast("int")}, "(CASE WHEN e % 3 = 0 THEN e % 601 - 300 ELSE ((e % 601 - 300) * 128 + 2048) >> 12 END)::INT AS v")


@query(f"WITH s AS ({transform_sql(4, True)}), c AS ({transform_sql(4, False)}) SELECT blk, CASE WHEN blk % 4 = 0 THEN s.residual ELSE c.residual END AS residual FROM s JOIN c USING (blk)")
def itrans_dispatch(spark, sf_dir):
    """The sine transform for 4 x 4 intra luma, the cosine transform for the rest."""
    b = blocks(spark, sf_dir, 4)
    out = P.inverse_transforms(b.where("blk % 4 = 0"), 4, 8, True).unionByName(P.inverse_transforms(b.where("blk % 4 <> 0"), 4))
    return out.select("blk", joined("residual"))


@query("SELECT event_id AS image, CASE WHEN (event_id % 9 + 1) * (event_id % 7 + 1) * 4 = event_id % 9 * 4 + 8 THEN 'ok' ELSE 'Parameter: sample count' END AS verdict FROM events")
def hook_convert(spark, sf_dir):
    """A buffer is taken only if it holds four samples a pixel."""
    e = F.col("event_id")
    rows = events(spark, sf_dir).select(e.alias("image"), (e % 9 + 1).alias("w"), (e % 7 + 1).alias("h"), (e % 9 * 4 + 8).alias("n"))
    return rows.select("image", host.buffer_verdict(F.col("w"), F.col("h"), F.col("n")).alias("verdict"))


@query("""SELECT event_id AS file, CASE WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN 'jpeg2000' WHEN event_id % 4 = 1 AND event_id % 3 = 0 THEN 'vvc' END AS kind FROM events""")
def h_expected_rust(spark, sf_dir):
    """Expected failures by path part and reason part: a stated list of a few cases."""
    e = F.col("event_id")
    rows = events(spark, sf_dir).select(e.alias("file"), F.concat(F.get(F.array(*map(F.lit, ("j2k", "vvc", "avc", "hevc"))), (e % 4).cast("int")), F.lit("/"), e.cast("string")).alias("path"), F.when(e % 3 == 0, "item type is unsupported").otherwise("").alias("reason"))
    return rows.select("file", R.expected_kind(F.col("path"), F.col("reason"), [("j2k", "unsupported", "jpeg2000"), ("vvc", "unsupported", "vvc")]).alias("kind"))


@query("SELECT user_id % 10 AS file, count(*)::BIGINT AS runs, sum(event_id % 500)::BIGINT AS ours_ms, sum(event_id % 300 + 1)::BIGINT AS theirs_ms, max(event_id % 900)::BIGINT AS peak_mb, sum(event_id % 500) > 2.5 * sum(event_id % 300 + 1) AS over FROM events GROUP BY 1")
def h_bench_decode(spark, sf_dir):
    e = F.col("event_id")
    runs = events(spark, sf_dir).select((F.col("user_id") % 10).alias("file"), (e % 500).alias("ours_ms"), (e % 300 + 1).alias("theirs_ms"), (e % 900).alias("peak_mb"))
    return R.timings(runs, "file")


@query("SELECT user_id % 8 AS workers, max(event_id % 400)::BIGINT AS slowest_ms, max(event_id % 2000)::BIGINT AS peak_mb, max(event_id % 2000) > 1536 AS over FROM events GROUP BY 1")
def h_bench_stream(spark, sf_dir):
    e = F.col("event_id")
    return R.concurrent(events(spark, sf_dir).select((F.col("user_id") % 8).alias("workers"), (e % 400).alias("ms"), (e % 2000).alias("mb")))


@query(f"""WITH {PIXELS_SQL}, b AS (SELECT DISTINCT img, x AS x0, y AS y0 FROM px WHERE x % 8 = 0 AND y % 8 = 0), i AS (SELECT unnest(range(33))::INT AS i),
c AS (SELECT img, x0, y0, i, CASE WHEN i < 16 THEN x0 - 1 WHEN i = 16 THEN x0 - 1 ELSE x0 + i - 17 END AS x, CASE WHEN i < 16 THEN y0 + 15 - i WHEN i = 16 THEN y0 - 1 ELSE y0 - 1 END AS y FROM b, i)
SELECT c.img, c.x0, c.y0, count(p.v)::BIGINT AS n_available, coalesce(sum(p.v * (c.i + 1)), 0)::BIGINT AS weighed FROM c LEFT JOIN px p ON p.img = c.img AND p.x = c.x AND p.y = c.y GROUP BY c.img, c.x0, c.y0""")
def border_fill(spark, sf_dir):
    p = px(spark, sf_dir).select("img", "x", "y", "v")
    at = p.where("x % 8 = 0 AND y % 8 = 0").select("img", F.col("x").alias("x0"), F.col("y").alias("y0"))
    got = P.borders(p, at, 8)
    weighed = F.aggregate(F.transform("border", lambda v, i: F.coalesce(v.cast("long"), F.lit(0).cast("long")) * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return got.select("img", "x0", "y0", F.size(F.filter("border", lambda v: v.isNotNull())).cast("long").alias("n_available"), weighed.alias("weighed"))


@query(f"""WITH {_COLOUR} SELECT img, x - 3 AS x, row - 1 AS y, greatest(0, least(255, y + ((359 * cr + 128) >> 8)))::INT AS r, greatest(0, least(255, y + ((-88 * cb - 183 * cr + 128) >> 8)))::INT AS g, greatest(0, least(255, y + ((454 * cb + 128) >> 8)))::INT AS b FROM u WHERE x BETWEEN 3 AND 20 AND row BETWEEN 1 AND 11""")
def cc_420_fixed(spark, sf_dir):
    """A region keeps the chroma phase of the whole picture: upsampled first, cropped after."""
    rows = P.crop(upsampled(spark, sf_dir), 3, 4, 1, 4, WIDTH, HEIGHT)
    rows = rows.withColumn("c", P.rgb(F.col("v"), F.col("cb"), F.col("cr"), F.lit(6), F.lit(True)))
    return rows.select("img", "x", "y", "c.r", "c.g", "c.b")


@query(f"""WITH {_COLOUR} SELECT img, x, row AS y, greatest(0, least(255, (y - 16) * 9576 + 13126 * cr + 4096 >> 13))::INT AS r, greatest(0, least(255, (y - 16) * 9576 - 3222 * cb - 6686 * cr + 4096 >> 13))::INT AS g, greatest(0, least(255, (y - 16) * 9576 + 16591 * cb + 4096 >> 13))::INT AS b FROM u""")
def cc_420_rgb(spark, sf_dir):
    """Samples of ten bits, brought to eight by a shift first."""
    rows = upsampled(spark, sf_dir).withColumns({k: F.shiftright(F.col(k) * 4 + 3, 2) for k in ("v", "cb", "cr")})
    rows = rows.withColumn("c", P.rgb(F.col("v"), F.col("cb"), F.col("cr"), F.lit(6), F.lit(False)))
    return rows.select("img", "x", "y", "c.r", "c.g", "c.b")


@query(f"""WITH {PIXELS_SQL} SELECT img // 4 AS img, (x + img % 2 * 25)::INT AS x, (y + img % 4 // 2 * 16)::INT AS y, v FROM px WHERE x + img % 2 * 25 < 45 AND y + img % 4 // 2 * 16 < 30""")
def x_grid(spark, sf_dir):
    """Tiles of 25 x 16 pasted by rows of two into pictures of 45 x 30: what is beyond is cut."""
    tiles = px(spark, sf_dir).select(F.expr("img div 4").alias("img"), (F.col("img") % 4).alias("tile"), "x", "y", "v")
    return P.paste(tiles, 2, WIDTH, HEIGHT, 45, 30)


@query(f"""WITH {PIXELS_SQL}, a AS (SELECT img, x, y, cb AS a FROM px WHERE img % 2 = 0) SELECT p.img, p.x, p.y, p.v, coalesce(a.a, 255)::INT AS a FROM px p LEFT JOIN a USING (img, x, y)""")
def x_alpha(spark, sf_dir):
    p = px(spark, sf_dir)
    alpha = p.where("img % 2 = 0").select("img", "x", "y", F.col("cb").alias("a"))
    return P.with_alpha(p.select("img", "x", "y", "v"), alpha)


# reports over files


@query("SELECT DISTINCT 'f' || (user_id % 40) || ['.heic', '.avif'][(event_id % 2 + 1)::INT] AS path FROM events WHERE event_id % 3 < 2")
def h_gather(spark, sf_dir):
    e = F.col("event_id")
    name = F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string"), F.get(F.array(*map(F.lit, (".heic", ".avif", ".png"))), F.when(e % 3 == 2, 2).otherwise(e % 2).cast("int")))
    rows = events(spark, sf_dir).select(name.alias("path"))
    return R.with_extensions(rows, "heic", "heif", "avif")


@query("SELECT 'f' || lpad(event_id::VARCHAR, 8, '0') AS file_id FROM events WHERE event_id % 7 = 0")
def h_sample(spark, sf_dir):
    from rasterquarry.sources.files import sampled

    return sampled(events(spark, sf_dir).select(F.concat(F.lit("f"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("file_id")), 7)


@query("""SELECT event_id AS file, CASE WHEN event_id % 5 = 0 AND event_id % 7 = 0 THEN 'both absent' WHEN event_id % 5 = 0 THEN 'only ours' WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 11 = 0 THEN 'differs' ELSE 'equal' END AS verdict FROM events""")
def h_icc_compare(spark, sf_dir):
    e = F.col("event_id")
    theirs = F.when(e % 5 != 0, F.sha2(e.cast("string").cast("binary"), 256))
    ours = F.when(e % 7 != 0, F.when(e % 11 == 0, F.lit("x")).otherwise(F.sha2(e.cast("string").cast("binary"), 256)))
    rows = events(spark, sf_dir).select(e.alias("file"), theirs.alias("t"), ours.alias("o"))
    return rows.select("file", R.compared_profiles(F.col("o"), F.col("t")).alias("verdict"))


def _float_sql(depth: int, full: bool) -> str:
    kr, kb = 0.2126, 0.0722
    kg = 1 - kr - kb
    up = 1 << (depth - 8)
    f = lambda v: f"{float(v)!r}::FLOAT"
    s = "" if full else f" * {f(1.1429)}"
    luma = "v::FLOAT" if full else f"(v::FLOAT - {f(16 * up)}) * {f(1.1689)}"
    blue, red = f"(b::FLOAT - {f(128 * up)}){s}", f"(r::FLOAT - {f(128 * up)}){s}"
    parts = {"r": f"{luma} + {f(2 * (1 - kr))} * ({red})", "g": f"{luma} + {f(-2 * kb * (1 - kb) / kg)} * ({blue}) + {f(-2 * kr * (1 - kr) / kg)} * ({red})", "b": f"{luma} + {f(2 * (1 - kb))} * ({blue})"}
    return ", ".join(f"greatest(0, least({(1 << depth) - 1}, trunc({v} + 0.5::FLOAT)::INT))::INT AS {k}" for k, v in parts.items())


@query(f"WITH {PIXELS_SQL} SELECT img, x, y, {_float_sql(8, False)} FROM (SELECT img, x, y, v, cb AS b, cr AS r FROM px)")
def cc_float8(spark, sf_dir):
    c = P.rgb_float(F.col("v"), F.col("cb"), F.col("cr"), 0.2126, 0.0722, 8, False)
    return px(spark, sf_dir).select("img", "x", "y", c.alias("c")).select("img", "x", "y", "c.r", "c.g", "c.b")


@query(f"WITH {PIXELS_SQL}, c AS (SELECT img, x, y, {_float_sql(10, True)} FROM (SELECT img, x, y, v * 4 + 1 AS v, cb * 4 + 2 AS b, cr * 4 + 3 AS r FROM px)) SELECT img, x, y, (r << 6) | (r >> 4) AS r, (g << 6) | (g >> 4) AS g, (b << 6) | (b >> 4) AS b FROM c")
def cc_float16(spark, sf_dir):
    c = P.rgb_float(F.col("v") * 4 + 1, F.col("cb") * 4 + 2, F.col("cr") * 4 + 3, 0.2126, 0.0722, 10, True)
    rows = px(spark, sf_dir).select("img", "x", "y", c.alias("c"))
    return rows.select("img", "x", "y", *(P.replicate_bits(F.col(f"c.{k}"), 10).alias(k) for k in "rgb"))


formula("tskip_bypass", lambda e: {"v": F.when(e % 3 == 0, e % 601 - 300).otherwise(P.skipped_transform(e % 601 - 300)).cast("int")}, "(CASE WHEN e % 3 = 0 THEN e % 601 - 300 ELSE ((e % 601 - 300) * 128 + 2048) >> 12 END)::INT AS v")


@query(f"WITH s AS ({transform_sql(4, True)}), c AS ({transform_sql(4, False)}) SELECT blk, CASE WHEN blk % 4 = 0 THEN s.residual ELSE c.residual END AS residual FROM s JOIN c USING (blk)")
def itrans_dispatch(spark, sf_dir):
    """The sine transform for 4 x 4 intra luma, the cosine transform for the rest."""
    b = blocks(spark, sf_dir, 4)
    out = P.inverse_transforms(b.where("blk % 4 = 0"), 4, 8, True).unionByName(P.inverse_transforms(b.where("blk % 4 <> 0"), 4))
    return out.select("blk", joined("residual"))


@query("SELECT event_id AS image, CASE WHEN (event_id % 9 + 1) * (event_id % 7 + 1) * 4 = event_id % 9 * 4 + 8 THEN 'ok' ELSE 'Parameter: sample count' END AS verdict FROM events")
def hook_convert(spark, sf_dir):
    """A buffer is taken only if it holds four samples a pixel."""
    e = F.col("event_id")
    rows = events(spark, sf_dir).select(e.alias("image"), (e % 9 + 1).alias("w"), (e % 7 + 1).alias("h"), (e % 9 * 4 + 8).alias("n"))
    return rows.select("image", host.buffer_verdict(F.col("w"), F.col("h"), F.col("n")).alias("verdict"))


@query("""SELECT event_id AS file, CASE WHEN event_id % 4 = 0 AND event_id % 3 = 0 THEN 'jpeg2000' WHEN event_id % 4 = 1 AND event_id % 3 = 0 THEN 'vvc' END AS kind FROM events""")
def h_expected_rust(spark, sf_dir):
    """Expected failures by path part and reason part: a stated list of a few cases."""
    e = F.col("event_id")
    rows = events(spark, sf_dir).select(e.alias("file"), F.concat(F.get(F.array(*map(F.lit, ("j2k", "vvc", "avc", "hevc"))), (e % 4).cast("int")), F.lit("/"), e.cast("string")).alias("path"), F.when(e % 3 == 0, "item type is unsupported").otherwise("").alias("reason"))
    return rows.select("file", R.expected_kind(F.col("path"), F.col("reason"), [("j2k", "unsupported", "jpeg2000"), ("vvc", "unsupported", "vvc")]).alias("kind"))


@query("SELECT user_id % 10 AS file, count(*)::BIGINT AS runs, sum(event_id % 500)::BIGINT AS ours_ms, sum(event_id % 300 + 1)::BIGINT AS theirs_ms, max(event_id % 900)::BIGINT AS peak_mb, sum(event_id % 500) > 2.5 * sum(event_id % 300 + 1) AS over FROM events GROUP BY 1")
def h_bench_decode(spark, sf_dir):
    e = F.col("event_id")
    runs = events(spark, sf_dir).select((F.col("user_id") % 10).alias("file"), (e % 500).alias("ours_ms"), (e % 300 + 1).alias("theirs_ms"), (e % 900).alias("peak_mb"))
    return R.timings(runs, "file")


@query("SELECT user_id % 8 AS workers, max(event_id % 400)::BIGINT AS slowest_ms, max(event_id % 2000)::BIGINT AS peak_mb, max(event_id % 2000) > 1536 AS over FROM events GROUP BY 1")
def h_bench_stream(spark, sf_dir):
    e = F.col("event_id")
    sums = events(spark, sf_dir).groupBy((F.col("user_id") % 8).alias("workers")).agg(F.max(e % 400).alias("slowest_ms"), F.max(e % 2000).alias("peak_mb"))
    return sums.withColumn("over", F.col("peak_mb") > 1536)


@query(f"""WITH {PIXELS_SQL}, b AS (SELECT DISTINCT img, x AS x0, y AS y0 FROM px WHERE x % 8 = 0 AND y % 8 = 0 AND x < 24), i AS (SELECT unnest(range(33))::INT AS i),
c AS (SELECT img, x0, y0, i, CASE WHEN i <= 16 THEN x0 - 1 ELSE x0 + i - 17 END AS x, CASE WHEN i < 16 THEN y0 + 15 - i ELSE y0 - 1 END AS y FROM b, i),
v AS (SELECT c.*, p.v FROM c LEFT JOIN px p ON p.img = c.img AND p.x = c.x AND p.y = c.y),
s AS (SELECT img, x0, y0, i - 16 AS i, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY img, x0, y0 ORDER BY i), first_value(v IGNORE NULLS) OVER (PARTITION BY img, x0, y0 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 128) AS v FROM v),
f AS (SELECT img, x0, y0, i, CASE WHEN i BETWEEN -15 AND 15 THEN (lag(v) OVER w + 2 * v + lead(v) OVER w + 2) >> 2 ELSE v END AS v FROM s WINDOW w AS (PARTITION BY img, x0, y0 ORDER BY i)),
e AS (SELECT img, x0, y0, max(CASE WHEN i = 9 THEN v END) AS r, max(CASE WHEN i = -9 THEN v END) AS d FROM f GROUP BY ALL)
SELECT e.img, e.x0, e.y0, sum((((7 - x) * l.v + (x + 1) * r + (7 - y) * t.v + (y + 1) * d + 8) >> 4) * (x + 8 * y + 1))::BIGINT AS weighed
FROM e, range(8) cx(x), range(8) cy(y), f l, f t WHERE l.img = e.img AND l.x0 = e.x0 AND l.y0 = e.y0 AND l.i = -1 - y AND t.img = e.img AND t.x0 = e.x0 AND t.y0 = e.y0 AND t.i = 1 + x GROUP BY e.img, e.x0, e.y0""")
def pred_dispatch(spark, sf_dir):
    """Borders gathered from a plane, filled, smoothed and predicted from: planar 8 x 8 luma blocks."""
    p = px(spark, sf_dir).select("img", "x", "y", "v")
    at = p.where("x % 8 = 0 AND y % 8 = 0 AND x < 24").select("img", F.col("x").alias("x0"), F.col("y").alias("y0"))
    got = P.borders(p, at, 8).withColumn("border", P.substitute_border(F.col("border"), 128))
    got = got.withColumn("border", P.filter_border(F.col("border"), 8, F.lit(0), True))
    rows = got.select(F.concat_ws(",", "img", "x0", "y0").alias("blk"), F.lit(0).alias("mode"), "border")
    out = P.predictions(rows, 8)
    weighed = F.aggregate(F.transform("predicted", lambda v, i: v.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    key = F.split("blk", ",")
    return out.select(key[0].cast("long").alias("img"), key[1].cast("int").alias("x0"), key[2].cast("int").alias("y0"), weighed.alias("weighed"))
