"""Pixel stages over rows (img, x, y, v ...): scaling, transforms, prediction, in-loop filters, colour and geometry."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(v: Column, low, high) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.greatest(low, F.least(high, v))


# Scaling and inverse transforms

# The scale of QP modulo 6.
LEVEL_SCALE = (40, 45, 51, 57, 64, 72)


def dequantize(c: Column, qp: Column, bit_depth: int, log2_size: int, m: Column | None = None) -> Column:
    """A coefficient scaled flat, or by its matrix value m, and clipped to 16 bits; 64-bit arithmetic throughout."""
    scale = F.get(F.array(*(F.lit(x).cast("long") for x in LEVEL_SCALE)), (qp % 6).cast("int"))
    scale = scale * F.pow(F.lit(2), F.floor(qp / 6)).cast("long")
    value, shift = c.cast("long") * scale, bit_depth - 9 + log2_size
    if m is not None:
        value, shift = value * m, bit_depth + log2_size - 5
    value = F.shiftright(value + (1 << shift >> 1), shift) if shift >= 0 else value * (1 << -shift)
    return clamp(value, -32768, 32767).cast("int")


def _basis() -> np.ndarray:
    """The 32 x 32 transform matrix by its rule: row k, column n has the cosine of k (2n + 1) / 64 half turns, in fixed values."""
    # The integer cosines of 0 to 32 sixty-fourths of a half turn.
    cosines = (64, 90, 90, 90, 89, 88, 87, 85, 83, 82, 80, 78, 75, 73, 70, 67, 64, 61, 57, 54, 50, 46, 43, 38, 36, 31, 25, 22, 18, 13, 9, 4, 0)
    k, n = np.meshgrid(np.arange(32), np.arange(32), indexing="ij")
    at = k * (2 * n + 1) % 128
    at = np.minimum(at, 128 - at)
    return np.where(k == 0, 64, np.where(at <= 32, np.take(cosines, np.minimum(at, 32)), -np.take(cosines, np.minimum(64 - at, 32))))


BASIS = _basis()
# The 4 x 4 sine transform.
SINES = np.array([[29, 55, 74, 84], [74, 74, 0, -74], [84, -29, -74, 55], [55, -84, 74, -29]])


def inverse_transform(c: np.ndarray, bit_depth: int = 8, sine: bool = False) -> np.ndarray:
    """Residuals of coefficient blocks (n, size, size): columns, then rows. Sizes from 8 clip after both passes, 4 wraps to 16 bits after the second."""
    size = c.shape[-1]
    m = SINES if sine else BASIS[:: 32 // size, :size]
    tmp = np.clip((np.einsum("kj,nki->nji", m, c.astype(np.int64)) + 64) >> 7, -32768, 32767)
    shift = 20 - bit_depth
    out = (np.einsum("kj,nik->nij", m, tmp) + (1 << shift >> 1)) >> shift
    return (out + 32768) % 65536 - 32768 if size == 4 else np.clip(out, -32768, 32767)


def _transform_batches(batches, size, bit_depth, sine):
    for batch in batches:
        c = batch.column("coeffs").flatten().to_numpy().reshape(-1, size, size)
        out = inverse_transform(c, bit_depth, sine).reshape(len(c), -1).astype(np.int32)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), size * size).cast(pa.list_(pa.int32())) if len(c) else pa.array([], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), flat], names=["blk", "residual"])


def inverse_transforms(blocks: DataFrame, size: int, bit_depth: int = 8, sine: bool = False) -> DataFrame:
    """(blk, residual) of blocks (blk, coeffs array<int> in raster order): matrix products over batches of blocks."""
    kind = blocks.schema["blk"].dataType.simpleString()
    return blocks.select("blk", "coeffs").mapInArrow(partial(_transform_batches, size=size, bit_depth=bit_depth, sine=sine), f"blk {kind}, residual array<int>")


def add_residual(predicted: Column, residual: Column, bit_depth: int = 8) -> Column:
    return clamp(predicted + residual, 0, (1 << bit_depth) - 1)


# Intra prediction over borders: array<int> of 4n + 1 samples from bottom left over the corner (index 2n) to top right


def substitute_border(border: Column, default: int) -> Column:
    """Nulls take the last sample before them from the bottom left on; leading ones the first there is; all null the default."""
    first = F.get(F.filter(border, lambda v: v.isNotNull()), 0)
    start = F.coalesce(first, F.lit(default))
    filled = F.aggregate(border, F.array().cast("array<int>"), lambda a, v: F.concat(a, F.array(F.coalesce(v, F.try_element_at(a, F.lit(-1)), start).cast("int"))))
    return filled


def filter_border(border: Column, size: int, mode: Column, strong: bool, luma: bool = True, bit_depth: int = 8) -> Column:
    """The smoothed border where the mode and size ask for it: [1, 2, 1] / 4, or from corner to corner in smooth 32 x 32 luma."""
    distance = F.least(F.abs(mode - 26), F.abs(mode - 10))
    wanted = (mode != 1) & (distance > F.lit({8: 7, 16: 1, 32: 0}.get(size, 99)))
    at = lambda i: F.get(border, i)
    c, last = 2 * size, 4 * size
    smooth = F.transform(border, lambda v, i: F.when((i == 0) | (i == last), v).otherwise(F.shiftright(F.get(border, i - 1) + 2 * v + F.get(border, i + 1) + 2, 2)))
    if strong and luma and size == 32:
        flat = (F.abs(at(F.lit(c)) + at(F.lit(last)) - 2 * at(F.lit(c + 32))) < 1 << (bit_depth - 5)) & (F.abs(at(F.lit(c)) + at(F.lit(0)) - 2 * at(F.lit(c - 32))) < 1 << (bit_depth - 5))
        line = F.transform(border, lambda v, i: F.when((i == 0) | (i == last) | (i == c), v).when(i < c, at(F.lit(c)) + F.shiftright((c - i) * (at(F.lit(0)) - at(F.lit(c))) + 32, 6)).otherwise(at(F.lit(c)) + F.shiftright((i - c) * (at(F.lit(last)) - at(F.lit(c))) + 32, 6)))
        smooth = F.when(flat, line).otherwise(smooth)
    return F.when(wanted, smooth).otherwise(border)


# The angles of modes 2 to 34.
ANGLES = (32, 26, 21, 17, 13, 9, 5, 2, 0, -2, -5, -9, -13, -17, -21, -26, -32, -26, -21, -17, -13, -9, -5, -2, 0, 2, 5, 9, 13, 17, 21, 26, 32)


def predict(border: np.ndarray, mode: int, size: int, luma: bool = True, bit_depth: int = 8) -> np.ndarray:
    """Blocks (n, size, size) predicted from borders (n, 4 size + 1) by one of the 35 modes."""
    b, c, most = border.astype(np.int64), 2 * size, (1 << bit_depth) - 1
    top, left = b[:, c + 1 :], b[:, c - 1 :: -1]  # (n, 2 size), outward from the corner
    x, y = np.arange(size)[None, None, :], np.arange(size)[None, :, None]
    edge = luma and size < 32
    if mode == 0:
        out = (size - 1 - x) * left[:, :size, None] + (x + 1) * top[:, size, None, None] + (size - 1 - y) * top[:, None, :size] + (y + 1) * left[:, size, None, None] + size
        return np.clip(out >> size.bit_length(), 0, most)
    if mode == 1:
        dc = (top[:, :size].sum(1) + left[:, :size].sum(1) + size) >> size.bit_length()
        out = np.repeat(dc, size * size).reshape(-1, size, size)
        if edge:
            out[:, 0, :] = (top[:, :size] + 3 * dc[:, None] + 2) >> 2
            out[:, :, 0] = (left[:, :size] + 3 * dc[:, None] + 2) >> 2
            out[:, 0, 0] = (left[:, 0] + 2 * dc + top[:, 0] + 2) >> 2
        return np.clip(out, 0, most)
    angle, upright = ANGLES[mode - 2], mode >= 18
    main, side = (top, left) if upright else (left, top)
    ref = np.concatenate([b[:, c : c + 1], main], axis=1)  # ref[i] at index i + size below
    inverse = round(8192 / angle) if angle < 0 else 0
    back = np.zeros((len(b), size), np.int64)
    sides = np.concatenate([b[:, c : c + 1], side], axis=1)
    reach = -(size * angle >> 5)
    for i in range(1, reach + 1 if reach > 1 else 1):  # one step back is the corner, which is there
        back[:, size - i] = sides[:, (-i * inverse + 128) >> 8]
    ref = np.concatenate([back, ref], axis=1)
    rows = np.arange(size)
    whole, part = (rows + 1) * angle >> 5, (rows + 1) * angle & 31
    at = whole[:, None] + rows[None, :] + 1 + size
    out = ((32 - part)[None, :, None] * ref[:, at] + part[None, :, None] * ref[:, np.minimum(at + 1, ref.shape[1] - 1)] + 16) >> 5
    if angle == 0 and edge:
        out[:, :, 0] = main[:, :1] + ((side[:, :size] - b[:, c : c + 1]) >> 1)
    out = np.clip(out, 0, most)
    return out if upright else out.transpose(0, 2, 1)


def _predict_batches(batches, size, luma, bit_depth):
    for batch in batches:
        border = batch.column("border").flatten().to_numpy().reshape(-1, 4 * size + 1)
        mode = batch.column("mode").to_numpy()
        out = np.zeros((len(mode), size * size), np.int32)
        for m in np.unique(mode):
            out[mode == m] = predict(border[mode == m], int(m), size, luma, bit_depth).reshape(-1, size * size)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), size * size).cast(pa.list_(pa.int32())) if len(out) else pa.array([], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("mode"), flat], names=["blk", "mode", "predicted"])


def predictions(blocks: DataFrame, size: int, luma: bool = True, bit_depth: int = 8) -> DataFrame:
    """(blk, mode, predicted) of blocks (blk, mode, border)."""
    kind = blocks.schema["blk"].dataType.simpleString()
    rows = blocks.select("blk", F.col("mode").cast("int").alias("mode"), F.col("border").cast("array<int>").alias("border"))
    return rows.mapInArrow(partial(_predict_batches, size=size, luma=luma, bit_depth=bit_depth), f"blk {kind}, mode int, predicted array<int>")


# In-loop filters

# The thresholds by QP.
BETA = (0,) * 16 + (6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 20, 22, 24, 26, 28, 30, 32, 34, 36, 38, 40, 42, 44, 46, 48, 50, 52, 54, 56, 58, 60, 62, 64)
TC = (0,) * 18 + (1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 5, 5, 6, 6, 7, 8, 9, 10, 11, 13, 14, 16, 18, 20, 22, 24)


def _table(values: tuple[int, ...], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def beta(qp: Column, offset: int = 0, bit_depth: int = 8) -> Column:
    return _table(BETA, clamp(qp + offset, 0, 51)) * (1 << (bit_depth - 8))


def tc(qp: Column, offset: int = 0, bit_depth: int = 8) -> Column:
    return _table(TC, clamp(qp + 2 + offset, 0, 53)) * (1 << (bit_depth - 8))


def edge_lines(px: DataFrame, vertical: bool = True) -> DataFrame:
    """(img, edge, line, p3 .. p0, q0 .. q3): the samples on both sides of each 8-sample edge. Rows of an image stay together."""
    across, along = ("x", "y") if vertical else ("y", "x")
    w = Window.partitionBy("img", along).orderBy(across)
    names = {f"p{k}": F.lag("v", k + 1).over(w) for k in (3, 2, 1, 0)} | {f"q{k}": F.lead("v", k).over(w) if k else F.col("v") for k in range(4)}
    rows = px.repartition("img").withColumns(names).where((F.col(across) % 8 == 0) & (F.col(across) > 0) & F.col("q3").isNotNull())
    return rows.select("img", F.col(across).alias("edge"), F.col(along).alias("line"), *names)


def deblock_luma(lines: DataFrame, qp: Column, beta_offset: int = 0, tc_offset: int = 0, bit_depth: int = 8) -> DataFrame:
    """lines with p2 .. q2 filtered, segments of four lines deciding together by their first and last; a segment that isn't whole stays as it is."""
    most = (1 << bit_depth) - 1
    seg = Window.partitionBy("img", "edge", F.floor(F.col("line") / 4))
    c = {k: F.col(k) for k in ("p3", "p2", "p1", "p0", "q0", "q1", "q2", "q3")}
    rows = lines.withColumns({"b": beta(qp, beta_offset, bit_depth), "t": tc(qp, tc_offset, bit_depth), "dp": F.abs(c["p2"] - 2 * c["p1"] + c["p0"]), "dq": F.abs(c["q2"] - 2 * c["q1"] + c["q0"])})
    b, t = F.col("b"), F.col("t")
    flat = (2 * (F.col("dp") + F.col("dq")) < F.shiftright(b, 2)) & (F.abs(c["p3"] - c["p0"]) + F.abs(c["q0"] - c["q3"]) < F.shiftright(b, 3)) & (F.abs(c["p0"] - c["q0"]) < F.shiftright(5 * t + 1, 1))
    ends = (F.col("line") % 4).isin(0, 3)
    rows = rows.withColumn("flat", flat).withColumns({
        "n": F.count("*").over(seg), "sp": F.sum(F.when(ends, F.col("dp"))).over(seg), "sq": F.sum(F.when(ends, F.col("dq"))).over(seg), "strong": F.min(F.when(ends, F.col("flat"))).over(seg),
    })
    on = (F.col("n") == 4) & (t > 0) & (F.col("sp") + F.col("sq") < b)
    part = F.shiftright(b + F.shiftright(b, 1), 3)
    p3, p2, p1, p0, q0, q1, q2, q3 = c.values()

    def soft(v: Column, by: Column) -> Column:
        return clamp(clamp(v, by - 2 * t, by + 2 * t), 0, most)

    strong = {
        "p2": soft(F.shiftright(2 * p3 + 3 * p2 + p1 + p0 + q0 + 4, 3), p2), "p1": soft(F.shiftright(p2 + p1 + p0 + q0 + 2, 2), p1), "p0": soft(F.shiftright(p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4, 3), p0),
        "q0": soft(F.shiftright(p1 + 2 * p0 + 2 * q0 + 2 * q1 + q2 + 4, 3), q0), "q1": soft(F.shiftright(p0 + q0 + q1 + q2 + 2, 2), q1), "q2": soft(F.shiftright(p0 + q0 + q1 + 3 * q2 + 2 * q3 + 4, 3), q2),
    }
    rows = rows.withColumn("raw", F.shiftright(9 * (q0 - p0) - 3 * (q1 - p1) + 8, 4))
    rows = rows.withColumn("d", clamp(F.col("raw"), -t, t))
    d, half = F.col("d"), F.shiftright(t, 1)
    side_p = clamp(F.shiftright(F.shiftright(p2 + p0 + 1, 1) - p1 + d, 1), -half, half)
    side_q = clamp(F.shiftright(F.shiftright(q2 + q0 + 1, 1) - q1 - d, 1), -half, half)
    weak = {
        "p2": p2, "p1": F.when(F.col("sp") < part, clamp(p1 + side_p, 0, most)).otherwise(p1), "p0": clamp(p0 + d, 0, most),
        "q0": clamp(q0 - d, 0, most), "q1": F.when(F.col("sq") < part, clamp(q1 + side_q, 0, most)).otherwise(q1), "q2": q2,
    }
    new = {k: F.when(on & F.col("strong"), strong[k]).when(on & (F.abs(F.col("raw")) < 10 * t), weak[k]).otherwise(c[k]).cast("int").alias(k) for k in strong}
    return rows.select("img", "edge", "line", "p3", *new.values(), "q3")


def deblock_chroma(p1: Column, p0: Column, q0: Column, q1: Column, t: Column, bit_depth: int = 8) -> Column:
    """struct<p0, q0>: the two samples next to a chroma edge."""
    d = clamp(F.shiftright(4 * (q0 - p0) + p1 - q1 + 4, 3), -t, t)
    most = (1 << bit_depth) - 1
    return F.struct(clamp(p0 + d, 0, most).cast("int").alias("p0"), clamp(q0 - d, 0, most).cast("int").alias("q0"))


def sao_band(v: Column, position: Column, offsets: Column, bit_depth: int = 8) -> Column:
    """v with the offset of its band, if it is one of four from position on, modulo 32."""
    k = F.pmod(F.shiftright(v, bit_depth - 5) - position, F.lit(32))
    return F.when(k < 4, clamp(v + F.get(offsets, k.cast("int")), 0, (1 << bit_depth) - 1)).otherwise(v)


def sao_edges(px: DataFrame, kind: Column, offsets: Column, width: int, height: int, bit_depth: int = 8) -> DataFrame:
    """px with v replaced by its edge offset in the direction of kind (0 across, 1 down, 2 and 3 along the diagonals).

    Neighbours come from windows over unfiltered samples along each direction, all within one partitioning by image;
    the frame's border stays as it is. offsets: array of four, for valleys, half valleys, half peaks and peaks.
    """
    rows = px.repartition("img")
    x, y = F.col("x"), F.col("y")
    ways = [Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y"), Window.partitionBy("img", x - y).orderBy("x"), Window.partitionBy("img", x + y).orderBy("x")]
    for i, w in enumerate(ways):
        rows = rows.withColumns({f"__a{i}": F.lag("v").over(w), f"__b{i}": F.lead("v").over(w)})
    pick = lambda side: F.get(F.array(*(F.col(f"__{side}{i}") for i in range(4))), kind.cast("int"))
    v, sign = F.col("v"), lambda e: F.signum(e.cast("int")).cast("int")
    at = sign(v - pick("a")) + sign(v - pick("b"))
    offset = F.when(at == -2, F.get(offsets, 0)).when(at == -1, F.get(offsets, 1)).when(at == 1, F.get(offsets, 2)).when(at == 2, F.get(offsets, 3)).otherwise(0)
    inside = (kind == 1) | x.between(1, width - 2), (kind == 0) | y.between(1, height - 2)
    new = F.when(inside[0] & inside[1] & (offset != 0), clamp(v + offset, 0, (1 << bit_depth) - 1)).otherwise(v)
    return rows.withColumn("v", new.cast("int")).drop(*(f"__{s}{i}" for s in "ab" for i in range(4)))


# Colour

# Fixed-point coefficients (cr to red, cb and cr to green, cb to blue) by matrix; other matrices take 6's.
FULL = {1: (403, -48, -120, 475), 9: (377, -42, -146, 482), 6: (359, -88, -183, 454)}
LIMITED = {1: (14744, -1754, -4383, 17373), 9: (13806, -1541, -5349, 17615), 6: (13126, -3222, -6686, 16591)}
LIMITED_LUMA = 9576


def rgb(y: Column, cb: Column, cr: Column, matrix: Column, full_range: Column) -> Column:
    """struct<r, g, b> of 8-bit samples by integer arithmetic: shifts of 8 in full and 13 in limited range."""
    cb, cr = cb - 128, cr - 128

    def by(table: dict[int, tuple[int, ...]], i: int) -> Column:
        return F.when(matrix == 1, table[1][i]).when(matrix == 9, table[9][i]).otherwise(table[6][i])

    def three(table, base: Column, shift: int) -> list[Column]:
        terms = (by(table, 0) * cr, by(table, 1) * cb + by(table, 2) * cr, by(table, 3) * cb)
        half = 1 << (shift - 1)
        return [y + F.shiftright(t + half, shift) if base is None else F.shiftright(base + t + half, shift) for t in terms]

    full, limited = three(FULL, None, 8), three(LIMITED, (y - 16) * LIMITED_LUMA, 13)
    return F.struct(*(clamp(F.when(full_range, a).otherwise(b), 0, 255).cast("int").alias(n) for n, a, b in zip("rgb", full, limited)))


def rgb_float(y: Column, cb: Column, cr: Column, kr: float, kb: float, bit_depth: int = 8, full_range: bool = True) -> Column:
    """struct<r, g, b> by 32-bit float arithmetic without fused steps, half added, truncated and clipped.

    kr and kb are the matrix' luma weights. Limited range scales luma by 1.1689 and chroma by 1.1429.
    """
    f = lambda v: F.lit(float(v)).cast("float")
    up = 1 << (bit_depth - 8)
    luma = y.cast("float") if full_range else (y.cast("float") - f(16 * up)) * f(1.1689)
    blue, red = (c.cast("float") - f(128 * up) for c in (cb, cr))
    if not full_range:
        blue, red = blue * f(1.1429), red * f(1.1429)
    kg = 1 - kr - kb
    parts = {"r": luma + f(2 * (1 - kr)) * red, "g": luma + f(-2 * kb * (1 - kb) / kg) * blue + f(-2 * kr * (1 - kr) / kg) * red, "b": luma + f(2 * (1 - kb)) * blue}
    return F.struct(*(clamp((v + f(0.5)).cast("int"), 0, (1 << bit_depth) - 1).alias(k) for k, v in parts.items()))


def replicate_bits(v: Column, bit_depth: int) -> Column:
    """A sample widened to 16 bits by repeating its high bits."""
    up = 16 - bit_depth
    return F.shiftleft(v, up).bitwiseOR(F.shiftright(v, bit_depth - up) if bit_depth >= up else F.lit(0))


def upsampled(luma: DataFrame, chroma: DataFrame, sx: int = 2, sy: int = 2) -> DataFrame:
    """luma's rows with cb and cr of the nearest chroma row (img, x, y, cb, cr); 128 where there is none. Joined within images."""
    c = chroma.select("img", F.col("x").alias("__cx"), F.col("y").alias("__cy"), "cb", "cr")
    rows = luma.withColumns({"__cx": F.floor(F.col("x") / sx).cast("int"), "__cy": F.floor(F.col("y") / sy).cast("int")})
    out = rows.join(c, ["img", "__cx", "__cy"], "left").drop("__cx", "__cy")
    return out.withColumns({k: F.coalesce(k, F.lit(128)) for k in ("cb", "cr")})


def crop(px: DataFrame, left: int, right: int, top: int, bottom: int, width: int, height: int) -> DataFrame:
    inside = F.col("x").between(left, width - right - 1) & F.col("y").between(top, height - bottom - 1)
    return px.where(inside).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def narrowed(v: Column) -> Column:
    """A 16-bit sample as the nearest of 8 bits."""
    return F.floor((v + 128) / 257)


def chroma_size(size: Column, halved: Column) -> Column:
    """A chroma plane's side: half of luma's, rounded up, where the format halves it."""
    return F.when(halved, F.floor((size + 1) / 2)).otherwise(size)


def samples_at(px: DataFrame, places: DataFrame, none: int = 0) -> DataFrame:
    """places (img, at_x, at_y, more) with the sample v of px at each, `none` outside the plane."""
    there = px.select("img", F.col("x").alias("at_x"), F.col("y").alias("at_y"), "v")
    return places.join(there, ["img", "at_x", "at_y"], "left").withColumn("v", F.coalesce("v", F.lit(none)))


def with_alpha(px: DataFrame, alpha: DataFrame) -> DataFrame:
    """px with the a of alpha (img, x, y, a); opaque, 255, where there is none."""
    return px.join(alpha.select("img", "x", "y", "a"), ["img", "x", "y"], "left").withColumn("a", F.coalesce("a", F.lit(255)))


# Geometry: where a pixel goes


def rotated(px: DataFrame, clockwise: int, width: int, height: int) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    to = {0: (x, y), 90: (height - 1 - y, x), 180: (width - 1 - x, height - 1 - y), 270: (y, width - 1 - x)}[clockwise % 360]
    return px.withColumns({"x": to[0], "y": to[1]})


def mirrored(px: DataFrame, horizontal: bool, width: int, height: int) -> DataFrame:
    return px.withColumn("x", width - 1 - F.col("x")) if horizontal else px.withColumn("y", height - 1 - F.col("y"))


def oriented(px: DataFrame, orientation: Column, width: int, height: int) -> DataFrame:
    """Pixels placed by EXIF orientation 1 to 8; any other value leaves them."""
    x, y, fx, fy = F.col("x"), F.col("y"), width - 1 - F.col("x"), height - 1 - F.col("y")
    to = {2: (fx, y), 3: (fx, fy), 4: (x, fy), 5: (y, x), 6: (fy, x), 7: (fy, fx), 8: (y, fx)}
    nx, ny = x, y
    for k, (a, b) in to.items():
        nx, ny = F.when(orientation == k, a).otherwise(nx), F.when(orientation == k, b).otherwise(ny)
    return px.withColumns({"x": nx, "y": ny})


# Output


def interleaved(px: DataFrame, order: str = "rgba") -> DataFrame:
    """(img, samples array<int>): channels of rows (img, x, y, r, g, b, a) in the order named, pixels by rows. An image is one row, as its file is."""
    one = F.struct("y", "x", F.array(*(F.col(c) for c in order)).alias("s"))
    return px.groupBy("img").agg(F.flatten(F.transform(F.array_sort(F.collect_list(one)), lambda p: p["s"])).alias("samples"))


def small_checksum(samples: Column) -> Column:
    """First, middle and last sample and the length in one number; 0 without samples."""
    n = F.size(samples)
    at = lambda i: F.get(samples, i).cast("long")
    value = F.shiftleft(at(F.lit(0)), 16).bitwiseXOR(F.shiftleft(at(F.floor(n / 2).cast("int")), 8)).bitwiseXOR(at(n - 1)).bitwiseXOR(n.cast("long"))
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(value)


def image_checksum(width: Column, height: Column, small: Column) -> Column:
    return F.shiftleft(width.cast("long"), 32).bitwiseXOR(height.cast("long")).bitwiseXOR(small)


# Pictures as a whole


def deblock_plane(px: DataFrame, qp: Column, beta_offset: int = 0, tc_offset: int = 0, bit_depth: int = 8) -> DataFrame:
    """(img, x, y, v) after all edges across and then, over that result, all edges down. qp: an expression of img."""
    for vertical in (True, False):
        across, along = ("x", "y") if vertical else ("y", "x")
        new = deblock_luma(edge_lines(px, vertical), qp, beta_offset, tc_offset, bit_depth)
        spots = F.explode(F.array(*(F.struct((F.col("edge") + k).cast("int").alias("at"), F.col(n).alias("new")) for n, k in (("p2", -3), ("p1", -2), ("p0", -1), ("q0", 0), ("q1", 1), ("q2", 2)))))
        rows = new.select("img", F.col("line").alias(along), spots.alias("s")).select("img", along, F.col("s.at").alias(across), "s.new")
        px = px.join(rows, ["img", "x", "y"], "left").select("img", "x", "y", F.coalesce("new", "v").cast("int").alias("v"))
    return px


def keep_lossless(px: DataFrame, blocks: DataFrame) -> DataFrame:
    """px (img, x, y, v, filtered) with v the filtered sample, but where a lossless block (img, x, y, size) covers it: those are known by cells of 4."""
    cells = F.sequence(F.lit(0), F.col("size") - 1, F.lit(4))
    cover = blocks.select("img", F.explode(F.transform(cells, lambda s: F.col("x") + s)).alias("__x"), "y", "size").select("img", "__x", F.explode(F.transform(cells, lambda s: F.col("y") + s)).alias("__y"))
    cover = cover.select("img", F.floor(F.col("__x") / 4).cast("long").alias("__cx"), F.floor(F.col("__y") / 4).cast("long").alias("__cy"), F.lit(True).alias("__kept")).distinct()
    rows = px.withColumns({"__cx": F.floor(F.col("x") / 4).cast("long"), "__cy": F.floor(F.col("y") / 4).cast("long")}).join(cover, ["img", "__cx", "__cy"], "left")
    return rows.withColumn("v", F.when(F.col("__kept"), F.col("v")).otherwise(F.col("filtered"))).drop("__cx", "__cy", "__kept", "filtered")


def unit_edges(units: DataFrame) -> DataFrame:
    """(tu, side, x, y): the left and top edges of transform units (tu, x, y, size) in cells of 4, those at the picture's border left out."""
    steps = F.sequence(F.lit(0), F.col("size") - 1, F.lit(4))
    left = units.where("x > 0").select("tu", F.lit("left").alias("side"), "x", F.explode(F.transform(steps, lambda s: (F.col("y") + s).cast("int"))).alias("y"))
    top = units.where("y > 0").select("tu", F.lit("top").alias("side"), F.explode(F.transform(steps, lambda s: (F.col("x") + s).cast("int"))).alias("x"), "y")
    return left.unionByName(top)


def borders(px: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """(img, x0, y0, border): the 4 size + 1 neighbours of blocks (img, x0, y0), from bottom left over the corner to top right; null where there is no sample."""
    c = 2 * size
    spots = F.transform(F.sequence(F.lit(0), F.lit(4 * size)), lambda i: F.struct(i.alias("i"), F.when(i <= c, F.col("x0") - 1).otherwise(F.col("x0") + i - c - 1).cast("int").alias("x"), F.when(i < c, F.col("y0") + c - 1 - i).otherwise(F.col("y0") - 1).cast("int").alias("y")))
    rows = blocks.select("img", "x0", "y0", F.explode(spots).alias("s")).select("img", "x0", "y0", "s.i", "s.x", "s.y")
    found = rows.join(px.select("img", "x", "y", "v"), ["img", "x", "y"], "left")
    lists = found.groupBy("img", "x0", "y0").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("b"))
    return lists.select("img", "x0", "y0", F.transform("b", lambda s: s["v"]).alias("border"))


def paste(tiles: DataFrame, columns: int, tile_width: int, tile_height: int, width: int, height: int) -> DataFrame:
    """(img, x, y, v) of tiles (img, tile, x, y, v) laid by rows; what is beyond the picture is cut."""
    x, y = F.col("x") + F.col("tile") % columns * tile_width, F.col("y") + F.floor(F.col("tile") / columns) * tile_height
    return tiles.select("img", x.cast("int").alias("x"), y.cast("int").alias("y"), "v").where((F.col("x") < width) & (F.col("y") < height))


def skipped_transform(c: Column, bit_depth: int = 8) -> Column:
    """A residual whose transform is skipped: the coefficient shifted up by seven, then down as after a transform."""
    shift = 20 - bit_depth
    return F.shiftright(c * 128 + (1 << shift >> 1), shift)
