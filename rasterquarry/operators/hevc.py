"""Intra pictures of HEVC: the arithmetic coder, the coding tree, in-loop filters, and whole pictures in Arrow batches.

The syntax is written once. A Reader takes bins from a stream; a Writer, handed the value that each bin should have, puts
them into one. A Picture walks the coding tree with either: it reads every choice, or asks a Plan for it. A coded item is
a row, so pictures are decoded in parallel and none is shuffled.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boxes as B
from . import codec as C
from . import pixels as P

# The arithmetic coder


def _lps_ranges() -> list[list[int]]:
    """The range of the less probable symbol by state and quarter: its probability falls by a factor a state."""
    # The factor, each quarter's start, the bound, the last state's range, and the one entry off the rule.
    falls, starts, most, last = 0.94922, (143.4, 175.5, 207.6, 239.65), 128, 2
    out = [[int(c * falls**s + 0.5) for c in starts] for s in range(63)] + [[last] * 4]
    for row in out:
        row[0] = min(row[0], most)
    out[35][2] = 33
    return out


LPS = _lps_ranges()
# The state after a less probable symbol.
AFTER_LPS = (
    0, 0, 1, 2, 2, 4, 4, 5, 6, 7, 8, 9, 9, 11, 11, 12, 13, 13, 15, 15, 16, 16, 18, 18, 19, 19, 21, 21, 22, 22, 23, 24,
    24, 25, 26, 26, 27, 27, 28, 29, 29, 30, 30, 30, 31, 32, 32, 33, 33, 33, 34, 34, 35, 35, 35, 36, 36, 36, 37, 37, 37, 38, 38, 63,
)

# The contexts of intra slices by syntax element, as initial values.
INITIAL = {
    "sao_merge": (153,),
    "sao_type": (200,),
    "split_cu": (139, 141, 157),
    "bypass": (154,),
    "part_mode": (184,),
    "prev_mode": (184,),
    "chroma_mode": (63,),
    "split_tt": (153, 138, 138),
    "cbf_luma": (111, 141),
    "cbf_chroma": (94, 138, 182, 154, 154),
    "qp_delta": (154, 154),
    "skip": (139, 139),
    "last_x": (110, 110, 124, 125, 140, 153, 125, 127, 140, 109, 111, 143, 127, 111, 79, 108, 123, 63),
    "last_y": (110, 110, 124, 125, 140, 153, 125, 127, 140, 109, 111, 143, 127, 111, 79, 108, 123, 63),
    "sub_block": (91, 171, 134, 141),
    "significant": (
        111, 111, 125, 110, 110, 94, 124, 108, 124, 107, 125, 141, 179, 153, 125, 107, 125, 141, 179, 153, 125, 107, 125, 141, 179, 153, 125,
        140, 139, 182, 182, 152, 136, 152, 136, 153, 136, 139, 111, 136, 139, 111,
    ),
    "greater1": (140, 92, 137, 138, 140, 152, 138, 139, 153, 74, 149, 92, 139, 107, 122, 152, 140, 179, 166, 182, 140, 227, 122, 197),
    "greater2": (138, 153, 136, 167, 152, 152),
}
FIRST = {name: sum(len(v) for k, v in list(INITIAL.items())[:i]) for i, name in enumerate(INITIAL)}


def contexts(qp: int) -> list[int]:
    """Every context at a slice's QP: twice its state, and its more probable symbol as the lowest bit."""
    out = []
    for value in (v for group in INITIAL.values() for v in group):
        pre = min(126, max(1, (((value >> 4) * 5 - 45) * min(51, max(0, qp)) >> 4) + ((value & 15) << 3) - 16))
        out.append((pre - 64) << 1 | 1 if pre > 63 else (63 - pre) << 1)
    return out


class _Bins:
    """What reading and writing share: contexts, and values made of several bins."""

    def __init__(self, qp: int):
        self.qp, self.ctx = qp, contexts(qp)

    def bits(self, n: int, v: int | None = None) -> int:
        """n bypass bins, the highest first."""
        out = 0
        for k in range(n - 1, -1, -1):
            out = out << 1 | self.bypass(None if v is None else v >> k & 1)
        return out

    def unary(self, most: int, v: int | None = None) -> int:
        """Bypass ones before a zero, at most so many."""
        n = 0
        while n < most and self.bypass(None if v is None else int(n < v)):
            n += 1
        return n

    def golomb(self, k: int, v: int | None = None) -> int:
        """An Exp-Golomb value of order k."""
        base = 0
        while self.bypass(None if v is None else int(v - base >= 1 << k)):
            base += 1 << k
            k += 1
            if k > 32:
                raise ValueError("Exp-Golomb code too long")
        return base + self.bits(k, None if v is None else v - base)

    def remaining(self, rice: int, v: int | None = None) -> int:
        """The rest of a coefficient's level: up to three whole steps, then growing powers of two of them."""
        wide = 0 if v is None or v >> rice < 4 else ((v >> rice) - 2).bit_length() - 1
        ones = None if v is None else (v >> rice if v >> rice < 4 else 3 + wide)
        n = self.unary(32, ones)
        if n < 4:
            return n << rice | self.bits(rice, None if v is None else v & ((1 << rice) - 1))
        base = ((1 << (n - 3)) + 2) << rice
        return base + self.bits(n - 3 + rice, None if v is None else v - base)


class Reader(_Bins):
    """Bins of the bytes from `at` on. Bytes beyond the end are zeros, but only a few: a stream that goes on without them is an error."""

    def __init__(self, data: bytes, qp: int, at: int = 0):
        super().__init__(qp)
        self.data, self.end = data + bytes(8), 8 * len(data) + 32
        self.start(at)

    def start(self, at: int) -> None:
        self.pos, self.range = 8 * at, 510
        self.offset = self._take(9)

    def _take(self, n: int) -> int:
        at = self.pos
        self.pos += n
        if self.pos > self.end:
            raise ValueError("out of bits")
        i = at >> 3
        return int.from_bytes(self.data[i : i + 3], "big") >> (24 - (at & 7) - n) & ((1 << n) - 1)

    def bin(self, c: int, v: int | None = None) -> int:
        state = self.ctx[c]
        s, out = state >> 1, state & 1
        lps = LPS[s][self.range >> 6 & 3]
        self.range -= lps
        if self.offset >= self.range:
            self.offset -= self.range
            self.range = lps
            self.ctx[c] = AFTER_LPS[s] << 1 | (out ^ 1 if s == 0 else out)
            out ^= 1
        elif s < 62:
            self.ctx[c] = state + 2
        n = 9 - self.range.bit_length()
        if n > 0:
            self.range <<= n
            self.offset = self.offset << n | self._take(n)
        return out

    def bypass(self, v: int | None = None) -> int:
        self.offset = self.offset << 1 | self._take(1)
        if self.offset >= self.range:
            self.offset -= self.range
            return 1
        return 0

    def terminate(self, v: int | None = None) -> int:
        self.range -= 2
        if self.offset >= self.range:
            return 1
        if self.range < 256:
            self.range <<= 1
            self.offset = self.offset << 1 | self._take(1)
        return 0


class Writer(_Bins):
    """Puts bins into bytes; each method returns the value that it was handed."""

    def __init__(self, qp: int):
        super().__init__(qp)
        self.parts: list[bytes] = []
        self.start()

    def start(self, at: int = 0) -> None:
        self.low, self.range, self.waiting, self.first, self.out = 0, 510, 0, True, []

    def _put(self, b: int) -> None:
        if self.first:
            self.first = False
        else:
            self.out.append(b)
        self.out += [1 - b] * self.waiting
        self.waiting = 0

    def _shift(self) -> None:
        if self.low < 256:
            self._put(0)
        elif self.low >= 512:
            self.low -= 512
            self._put(1)
        else:
            self.low -= 256
            self.waiting += 1
        self.low <<= 1

    def bin(self, c: int, v: int | None = None) -> int:
        state = self.ctx[c]
        s, likely = state >> 1, state & 1
        lps = LPS[s][self.range >> 6 & 3]
        self.range -= lps
        if v != likely:
            self.low += self.range
            self.range = lps
            self.ctx[c] = AFTER_LPS[s] << 1 | (likely ^ 1 if s == 0 else likely)
        elif s < 62:
            self.ctx[c] = state + 2
        while self.range < 256:
            self.range <<= 1
            self._shift()
        return v

    def bypass(self, v: int | None = None) -> int:
        self.low <<= 1
        if v:
            self.low += self.range
        if self.low >= 1024:
            self._put(1)
            self.low -= 1024
        elif self.low < 512:
            self._put(0)
        else:
            self.low -= 512
            self.waiting += 1
        return v

    def terminate(self, v: int | None = None) -> int:
        self.range -= 2
        if not v:
            if self.range < 256:
                self.range <<= 1
                self._shift()
            return 0
        self.low += self.range
        for _ in range(7):
            self._shift()
        self._put(self.low >> 9 & 1)
        self.out += [self.low >> 8 & 1, 1]
        text = "".join(map(str, self.out))
        text += "0" * (-len(text) % 8)
        self.parts.append(int(text, 2).to_bytes(len(text) // 8, "big"))
        return 1


# Scans and scaling


def _scan(size: int, order: int) -> list[tuple[int, int]]:
    """(x, y) by position: 0 up-right along the diagonals, 1 by rows, 2 by columns."""
    cells = [(x, y) for y in range(size) for x in range(size)]
    return sorted(cells, key=lambda c: (c[0] + c[1], c[0]) if order == 0 else (c[1], c[0]) if order == 1 else c)


SCANS = {(size, order): _scan(size, order) for size in (1, 2, 4, 8) for order in range(3)}


def scan_index(log2: int, mode: int, component: int, chroma_format: int) -> int:
    if log2 == 2 or log2 == 3 and (component == 0 or chroma_format == 3):
        return 2 if 6 <= mode <= 14 else 1 if 22 <= mode <= 30 else 0
    return 0


# The context of a significance flag by its place in a 4 x 4 block.
_PLACE = (0, 1, 4, 5, 2, 3, 4, 5, 6, 6, 8, 8, 7, 7, 8, 8)


def scaling_matrix(lists: dict | None, log2: int, matrix: int) -> np.ndarray | int:
    """m by row and column: 16 without lists, else the list along the diagonals, repeated in larger blocks, whose first value is apart."""
    if lists is None:
        return 16
    values, dc = lists[(log2 - 2, matrix)]
    side = 4 if log2 == 2 else 8
    m = np.zeros((side, side), np.int64)
    for v, (x, y) in zip(values, SCANS[side, 0]):
        m[y, x] = v
    if log2 > 3:
        m = m.repeat(1 << (log2 - 3), 0).repeat(1 << (log2 - 3), 1)
        m[0, 0] = dc
    return m


def scaled(levels: np.ndarray, qp: int, bit_depth: int, m: np.ndarray | int = 16) -> np.ndarray:
    """Coefficients of levels (size, size) at a QP."""
    shift = bit_depth + levels.shape[0].bit_length() - 1 - 5
    v = levels.astype(np.int64) * m * (P.LEVEL_SCALE[qp % 6] << qp // 6)
    return np.clip((v + (1 << shift >> 1)) >> shift, -32768, 32767)


# Prediction borders


def border_of(plane: np.ndarray, have: np.ndarray, x: int, y: int, n: int, bit_depth: int) -> np.ndarray:
    """The 4n + 1 samples around a block from bottom left over the corner to top right; what isn't decoded takes the one before it."""
    h, w = plane.shape
    ys, xs = np.concatenate([np.arange(y + 2 * n - 1, y - 2, -1), np.full(2 * n, y - 1)]), np.concatenate([np.full(2 * n + 1, x - 1), np.arange(x, x + 2 * n)])
    inside = (ys >= 0) & (xs >= 0) & (ys < h) & (xs < w)
    yc, xc = np.minimum(np.maximum(ys, 0), h - 1), np.minimum(np.maximum(xs, 0), w - 1)
    there = inside & have[yc, xc]
    at = np.flatnonzero(there)
    if not len(at):
        return np.full(4 * n + 1, 1 << (bit_depth - 1), np.int64)
    last = np.maximum.accumulate(np.where(there, np.arange(4 * n + 1), -1))
    last[last < 0] = at[0]
    return plane[yc, xc][last].astype(np.int64)


def smoothed(b: np.ndarray, n: int, mode: int, strong: bool, bit_depth: int) -> np.ndarray:
    """A border filtered as its block's mode and size ask for."""
    if mode == 1 or n == 4 or min(abs(mode - 26), abs(mode - 10)) <= {8: 7, 16: 1, 32: 0}[n]:
        return b
    c, last = 2 * n, 4 * n
    near = 1 << (bit_depth - 5)
    if strong and n == 32 and abs(b[c] + b[last] - 2 * b[c + n]) < near and abs(b[c] + b[0] - 2 * b[c - n]) < near:
        k = np.arange(1, 64)
        out = b.copy()
        out[c - k], out[c + k] = ((64 - k) * b[c] + k * b[0] + 32) >> 6, ((64 - k) * b[c] + k * b[last] + 32) >> 6
        return out
    out = b.copy()
    out[1:-1] = (b[:-2] + 2 * b[1:-1] + b[2:] + 2) >> 2
    return out


# Chroma modes of 4:2:2 by luma-like mode.
MODE_422 = (0, 1, 2, 2, 2, 2, 3, 5, 7, 8, 10, 11, 13, 15, 16, 18, 19, 20, 21, 22, 23, 23, 24, 24, 25, 25, 26, 27, 27, 28, 28, 29, 29, 30, 31)


def chroma_qp(qpi: int, chroma_format: int) -> int:
    if chroma_format != 1:
        return min(qpi, 51)
    # The table of 4:2:0 for 30 to 42.
    return qpi if qpi < 30 else qpi - 6 if qpi >= 43 else (29, 30, 31, 32, 33, 33, 34, 34, 35, 35, 36, 36, 37)[qpi - 30]


class Plan:
    """What a Writer's Picture asks: choices by place. This one codes everything in the largest blocks, without loss, from the planes it is given."""

    def __init__(self, planes: list[np.ndarray]):
        self.planes = planes

    def sao(self, rx: int, ry: int):
        """"left" or "up" to merge, or by component (type, offsets, band or class)."""
        return [(0, (0,) * 4, 0)] * 3

    def split(self, x: int, y: int, log2: int) -> int:
        return 0

    def lossless(self, x: int, y: int) -> int:
        return 1

    def quarters(self, x: int, y: int) -> int:
        """Whether a smallest coding unit has four parts."""
        return 0

    def mode(self, x: int, y: int) -> int:
        return 1

    def chroma(self, x: int, y: int) -> int:
        """The chroma choice 0 to 4."""
        return 4

    def split_transform(self, x: int, y: int, log2: int) -> int:
        return 0

    def qp_delta(self, x: int, y: int) -> int:
        return 0

    def skip_transform(self, x: int, y: int, component: int) -> int:
        return 0

    def levels(self, x: int, y: int, n: int, component: int, predicted: np.ndarray) -> np.ndarray:
        """The levels of a block; without loss, what is to be added to the prediction."""
        return self.planes[component][y : y + n, x : x + n].astype(np.int64) - predicted


class Picture:
    """The planes of an intra picture and the state of its decoding (or, with a plan, of its coding)."""

    def __init__(self, s: dict, p: dict, h: dict, coder: _Bins, plan: Plan | None = None):
        self.s, self.p, self.h, self.c, self.plan = s, p, h, coder, plan
        self.format = 0 if s["separate_planes"] else s["chroma_format"]
        self.depth = s["bit_depth_luma"]
        if s["pcm"]:
            raise ValueError("UnsupportedFeature: PCM")
        if self.format and s["bit_depth_chroma"] != self.depth:
            raise ValueError("UnsupportedFeature: unequal bit depths")
        w, height = s["width"], s["height"]
        if w % (1 << s["log2_min_cb"]) or height % (1 << s["log2_min_cb"]):
            raise ValueError("MalformedInput: picture size")
        self.sx, self.sy = int(self.format in (1, 2)), int(self.format == 1)
        sizes = [(height, w)] + [(height >> self.sy, w >> self.sx)] * 2 * bool(self.format)
        self.planes = [np.zeros(size, np.int32) for size in sizes]
        self.have = [np.zeros(size, bool) for size in sizes]
        small = (-(-height // 4), -(-w // 4))
        self.modes, self.qps, self.kept = np.full(small, -1, np.int16), np.zeros(small, np.int16), np.zeros(small, bool)
        self.depths = np.full(small, -1, np.int8)
        self.edges = [np.zeros(small, bool), np.zeros(small, bool)]  # at a block's left, at its top
        self.sao: dict[tuple[int, int], list] = {}
        self.units: list[tuple[int, int, int, int]] = []  # x, y, log2, parts of each coding unit
        self.blocks: list[tuple[int, int, int, int, int]] = []  # component, x, y, size, non-zero levels of each transform block
        self.lists = p.get("lists") or s.get("lists")

    def bin(self, name: str, v, at: int = 0) -> int:
        return self.c.bin(FIRST[name] + at, v)

    def ask(self, what: str, *at):
        return None if self.plan is None else getattr(self.plan, what)(*at)

    # coding tree units

    def decode(self) -> Picture:
        """Every coding tree unit in raster order. With wavefronts a row begins with the contexts after the second unit of the row above, in a part of its own."""
        s, c = self.s, self.c
        wide, high, size = s["ctbs_wide"], s["ctbs_high"], 1 << s["log2_ctb"]
        kept = None
        self.last_qp = self.h["qp"]
        for ry in range(high):
            for rx in range(wide):
                if self.p["wavefront"] and rx == 0 and ry:
                    c.start(self.h["parts"][ry - 1] if self.plan is None else 0)
                    c.ctx = list(kept) if kept is not None else contexts(c.qp)
                    kept, self.last_qp = None, self.h["qp"]
                self._sao(rx, ry)
                self.corner = (rx * size, ry * size)
                self._quadtree(rx * size, ry * size, s["log2_ctb"], 0)
                if rx == min(1, wide - 1) and self.p["wavefront"]:
                    kept = list(c.ctx) if wide > 1 else None
                last = rx == wide - 1 and ry == high - 1
                if c.terminate(int(last)) != last:
                    raise ValueError("MalformedInput: slice ends early" if not last else "MalformedInput: slice goes on")
                if self.p["wavefront"] and rx == wide - 1 and not last and not c.terminate(1):
                    raise ValueError("MalformedInput: row goes on")
        return self

    def _sao(self, rx: int, ry: int) -> None:
        c, want = self.c, self.ask("sao", rx, ry)
        on = (self.h["sao_luma"], self.h["sao_chroma"], self.h["sao_chroma"])
        if not (on[0] or on[1]):
            return
        if rx and self.bin("sao_merge", int(want == "left")):
            self.sao[rx, ry] = self.sao[rx - 1, ry]
            return
        if ry and self.bin("sao_merge", int(want == "up")):
            self.sao[rx, ry] = self.sao[rx, ry - 1]
            return
        out, kind, place = [], 0, 0
        most = (1 << (min(self.depth, 10) - 5)) - 1
        for k in range(len(self.planes)):
            if not on[k]:
                out.append((0, (0,) * 4, 0))
                continue
            w = want[k] if want else None
            if k < 2:
                kind = self.bin("sao_type", int(w[0] > 0) if w else None)
                if kind:
                    kind += c.bypass(w[0] - 1 if w else None)
            offsets = (0,) * 4
            if kind:
                size = [c.unary(most, abs(w[1][i]) if w else None) for i in range(4)]
                if kind == 1:
                    offsets = tuple(-v if v and c.bypass(int(w[1][i] < 0) if w else None) else v for i, v in enumerate(size))
                    place = c.bits(5, w[2] if w else None)
                else:
                    if k < 2:
                        place = c.bits(2, w[2] if w else None)
                    offsets = (size[0], size[1], -size[2], -size[3])
            out.append((kind, offsets, place))
        self.sao[rx, ry] = out

    def _quadtree(self, x: int, y: int, log2: int, depth: int) -> None:
        s, n = self.s, 1 << log2
        fits = x + n <= s["width"] and y + n <= s["height"]
        if fits and log2 > s["log2_min_cb"]:
            left = x > 0 and self.depths[y >> 2, (x - 1) >> 2] > depth
            above = y > 0 and self.depths[(y - 1) >> 2, x >> 2] > depth
            split = self.bin("split_cu", self.ask("split", x, y, log2), int(left) + int(above))
        else:
            split = log2 > s["log2_min_cb"]
        if self.p["cu_qp_delta"] and log2 >= s["log2_ctb"] - self.p["qp_delta_depth"]:
            self._quantum(x, y)
        elif depth == 0:
            self._quantum(x, y)
        if split:
            half = n >> 1
            for dy in (0, half):
                for dx in (0, half):
                    if x + dx < s["width"] and y + dy < s["height"]:
                        self._quadtree(x + dx, y + dy, log2 - 1, depth + 1)
        else:
            self.depths[y >> 2 : (y + n) >> 2, x >> 2 : (x + n) >> 2] = depth
            self._unit(x, y, log2)

    def _quantum(self, x: int, y: int) -> None:
        """A quantization group begins: its predicted QP, from neighbours inside the coding tree unit or the unit before."""
        cx, cy = self.corner
        left = self.qps[y >> 2, (x - 1) >> 2] if x > cx else self.last_qp
        above = self.qps[(y - 1) >> 2, x >> 2] if y > cy else self.last_qp
        self.predicted_qp, self.delta, self.delta_known = (int(left) + int(above) + 1) >> 1, 0, not self.p["cu_qp_delta"]

    def _qp(self) -> int:
        offset = 6 * (self.depth - 8)
        return (self.predicted_qp + self.delta + 52 + 2 * offset) % (52 + offset) - offset

    # coding units

    def _unit(self, x: int, y: int, log2: int) -> None:
        s, c, n = self.s, self.c, 1 << log2
        self.lossless = self.bin("bypass", self.ask("lossless", x, y)) if self.p["bypass"] else 0
        quarters = 0
        if log2 == s["log2_min_cb"]:
            want = self.ask("quarters", x, y)
            quarters = 1 - self.bin("part_mode", None if want is None else 1 - want)
        half = n >> quarters
        places = [(x + dx, y + dy) for dy in range(0, n, half) for dx in range(0, n, half)]
        wants = [self.ask("mode", *q) for q in places]
        likely, previous = [], []
        # a part's candidates need the modes of the parts before it, which its flag doesn't
        guesses = [None] * len(places)
        if self.plan is not None:
            for k, (q, m) in enumerate(zip(places, wants)):
                guesses[k] = self._likely(*q)
                self._store(self.modes, *q, half, m)
        for k in range(len(places)):
            previous.append(self.bin("prev_mode", None if self.plan is None else int(wants[k] in guesses[k])))
        modes = []
        for k, (q, flag) in enumerate(zip(places, previous)):
            likely = guesses[k] or self._likely(*q)
            if flag:
                mode = likely[c.unary(2, likely.index(wants[k]) if self.plan is not None else None)]
            else:
                mode = c.bits(5, wants[k] - sum(m < wants[k] for m in likely) if self.plan is not None else None)
                for m in sorted(likely):
                    mode += mode >= m
            self._store(self.modes, *q, half, mode)
            modes.append(mode)
        chroma = []
        if self.format:
            for q, mode in zip(places if self.format == 3 else places[:1], modes):
                want = self.ask("chroma", *q)
                choice = 4
                if self.bin("chroma_mode", None if want is None else int(want < 4)):
                    choice = c.bits(2, want)
                own = mode if choice == 4 else (0, 26, 10, 1)[choice]
                own = 34 if choice < 4 and own == mode else own
                chroma.append(MODE_422[own] if self.format == 2 else own)
        self.units.append((x, y, log2, len(places)))
        self._store(self.kept, x, y, n, bool(self.lossless))
        self.part_modes = dict(zip(places, modes)), dict(zip(places, chroma)), quarters, (x, y)
        self._tree(x, y, x, y, log2, 0, 0, [(1, 1)] * 2)
        self._store(self.qps, x, y, n, self._qp())
        self.last_qp = self._qp()

    @staticmethod
    def _store(table: np.ndarray, x: int, y: int, n: int, v) -> None:
        table[y >> 2 : (y + n + 3) >> 2, x >> 2 : (x + n + 3) >> 2] = v

    def _likely(self, x: int, y: int) -> list[int]:
        """The three most probable modes; what isn't there, or above the row of units, counts as 1."""
        left = int(self.modes[y >> 2, (x - 1) >> 2]) if x else -1
        above = int(self.modes[(y - 1) >> 2, x >> 2]) if y and (y - 1) >> self.s["log2_ctb"] == y >> self.s["log2_ctb"] else -1
        left, above = (1 if m < 0 else m for m in (left, above))
        if left == above:
            return [0, 1, 26] if left < 2 else [left, 2 + (left + 29) % 32, 2 + (left - 1) % 32]
        return [left, above, next(m for m in (0, 1, 26) if m not in (left, above))]

    # transform trees

    def _mode(self, table: int, x: int, y: int) -> int:
        """The mode of the part that a place is in; of chroma, the unit's if it has one for all."""
        modes, origin = self.part_modes[table], self.part_modes[3]
        if len(modes) == 1:
            return next(iter(modes.values()))
        half = max(max(q[0] - origin[0], q[1] - origin[1]) for q in modes)
        return modes[origin[0] + (half if x >= origin[0] + half else 0), origin[1] + (half if y >= origin[1] + half else 0)]

    def _tree(self, x: int, y: int, bx: int, by: int, log2: int, depth: int, index: int, parents: list[tuple[int, int]]) -> None:
        s, quarters = self.s, self.part_modes[2]
        if s["log2_min_tb"] < log2 <= s["log2_max_tb"] and depth < s["intra_depth"] + quarters and not (quarters and depth == 0):
            split = self.bin("split_tt", self.ask("split_transform", x, y, log2), 5 - log2)
        else:
            split = int(log2 > s["log2_max_tb"] or quarters and depth == 0)
        flags = []
        own_chroma = self.format and (log2 > 2 or self.format == 3)
        leaf = not split or log2 == 3 and self.format != 3
        for k in (0, 1):
            if own_chroma and (parents[k][0] or parents[k][1]):
                flag = [0, 0]
                for half in range(2 if self.format == 2 and leaf else 1):
                    flag[half] = self.bin("cbf_chroma", self._any(x, y, log2, k + 1, half) if leaf else self._yes(), depth)
                flags.append(tuple(flag))
            else:
                flags.append(parents[k] if own_chroma is not True and self.format and log2 == 2 and depth and self.format != 3 else (0, 0))
        if split:
            half = 1 << (log2 - 1)
            for i, (dx, dy) in enumerate(((0, 0), (half, 0), (0, half), (half, half))):
                self._tree(x + dx, y + dy, x, y, log2 - 1, depth + 1, i, flags)
            return
        luma = self.bin("cbf_luma", self._any(x, y, log2, 0, 0), int(depth == 0))
        self._mark(x, y, 1 << log2)
        if (luma or any(map(any, flags))) and not self.delta_known:
            self._read_delta(x, y)
        self._block(x, y, log2, 0, luma)
        if own_chroma:
            self._chroma(x, y, log2, flags)
        elif self.format and index == 3:
            self._chroma(bx, by, 3, flags)

    def _yes(self):
        return None if self.plan is None else 1

    def _any(self, x: int, y: int, log2: int, component: int, half: int):
        """For a plan: whether a block will have levels, as its prediction is known by now."""
        if self.plan is None:
            return None
        if component and self.format != 3:
            log2 -= 1
            x, y = x >> self.sx, (y >> self.sy) + (half << log2)
            if half and self.lossless:  # the block above will be as it was
                above = slice(y - (1 << log2), y), slice(x, x + (1 << log2))
                self.planes[component][above], self.have[component][above] = self.plan.planes[component][above], True
                out = self.plan.levels(x, y, 1 << log2, component, self._predict(x, y, log2, component, half))
                self.have[component][above] = False
                return int(np.any(out))
        return int(np.any(self.plan.levels(x, y, 1 << log2, component, self._predict(x, y, log2, component, half))))

    def _chroma(self, x: int, y: int, log2: int, flags: list[tuple[int, int]]) -> None:
        n = log2 if self.format == 3 else log2 - 1
        for k in (1, 2):
            for half in range(2 if self.format == 2 else 1):
                self._block(x >> self.sx, (y >> self.sy) + (half << n), n, k, flags[k - 1][half])

    def _mark(self, x: int, y: int, n: int) -> None:
        """A transform block's edges, its left and its top, unless they are the picture's."""
        if x:
            self.edges[0][y >> 2 : (y + n) >> 2, x >> 2] = True
        if y:
            self.edges[1][y >> 2, x >> 2 : (x + n) >> 2] = True

    def _read_delta(self, x: int, y: int) -> None:
        want, n = self.ask("qp_delta", x, y), 0
        while n < 5 and self.bin("qp_delta", None if want is None else int(abs(want) > n), int(n > 0)):
            n += 1
        if n == 5:
            n += self.c.golomb(0, None if want is None else abs(want) - 5)
        if n and self.c.bypass(None if want is None else int(want < 0)):
            n = -n
        self.delta, self.delta_known = n, True

    def _predict(self, x: int, y: int, log2: int, component: int, half: int = 0) -> np.ndarray:
        n = 1 << log2
        if component:
            mode = self._mode(1, x << self.sx, (y - (half << log2)) << self.sy if self.format == 2 else y << self.sy)
        else:
            mode = self._mode(0, x, y)
        b = border_of(self.planes[component], self.have[component], x, y, n, self.depth)
        if component == 0 or self.format == 3:
            b = smoothed(b, n, mode, bool(self.s["strong_smoothing"]) and component == 0, self.depth)
        return P.predict(b[None], mode, n, component == 0, self.depth)[0]

    def _block(self, x: int, y: int, log2: int, component: int, coded: int) -> None:
        """One transform block: prediction, then its residual, if it has levels."""
        n = 1 << log2
        out = self._predict(x, y, log2, component)
        found = 0
        if coded:
            mode = self._mode(int(component > 0), x << self.sx if component else x, y << self.sy if component else y)
            want = None if self.plan is None else self.plan.levels(x, y, n, component, out)
            skip = 0
            if self.p["transform_skip"] and not self.lossless and log2 == 2:
                skip = self.bin("skip", self.ask("skip_transform", x, y, component), int(component > 0))
            scan = scan_index(log2, mode, component, self.format)
            levels = residual(self.c, log2, component, scan, bool(self.p["sign_hiding"] and not self.lossless), want)
            found = int(np.count_nonzero(levels))
            out = np.clip(out + self._residual(levels, component, skip), 0, (1 << self.depth) - 1)
        self.planes[component][y : y + n, x : x + n] = out
        self.have[component][y : y + n, x : x + n] = True
        self.blocks.append((component, x, y, n, found))

    def _residual(self, levels: np.ndarray, component: int, skip: int) -> np.ndarray:
        if self.lossless:
            return levels
        n, offset, qp = len(levels), 6 * (self.depth - 8), self._qp()
        if component:
            own = ("cb_qp_offset", "cr_qp_offset")[component - 1]
            qp = chroma_qp(min(57, max(-offset, qp + self.p[own] + self.h[own])), self.format)
        m = scaling_matrix(self.lists if self.s["scaling_lists"] else None, n.bit_length() - 1, component)
        c = scaled(levels, qp + offset, self.depth, m)
        if skip:
            shift = 20 - self.depth
            return ((c << 7) + (1 << shift >> 1)) >> shift
        return P.inverse_transform(c[None], self.depth, n == 4 and component == 0)[0]

    # in-loop filters

    def filtered(self) -> list[np.ndarray]:
        """The planes after deblocking and sample adaptive offsets."""
        planes = [p.astype(np.int64) for p in self.planes]
        if not self.h["deblock_off"]:
            for across in (0, 1):  # all vertical edges, then all horizontal ones
                for k in range(len(planes)):
                    view = planes[k] if across == 0 else planes[k].T
                    self._deblock(view, k, across)
        return self._offsets(planes) if self.sao else planes

    def _deblock(self, plane: np.ndarray, component: int, across: int) -> None:
        """Filters a plane in place across its vertical edges; for horizontal ones it comes transposed, as do the maps."""
        turn = (lambda t: t) if across == 0 else (lambda t: t.T)
        edges, qps, kept = turn(self.edges[across]), turn(self.qps).astype(np.int64), turn(self.kept)
        along, over = (self.sy, self.sx) if across == 0 else (self.sx, self.sy)
        if component == 0:
            along = over = 0
        rows, columns = np.nonzero(edges)
        good = columns * 4 % (8 << over) == 0
        rows, columns = rows[good], columns[good]
        if not len(rows):
            return
        q, kp, kq = (qps[rows, columns] + qps[rows, columns - 1] + 1) >> 1, kept[rows, columns - 1], kept[rows, columns]
        scale, most = 1 << (self.depth - 8), (1 << self.depth) - 1
        x = columns * 4 >> over
        height = 4 >> along
        y = (rows * 4 >> along)[:, None] + np.arange(height)
        if component:
            qp = np.array([chroma_qp(int(v) + self.p[("cb_qp_offset", "cr_qp_offset")[component - 1]], self.format) for v in q])
            tc = np.take(P.TC, np.clip(qp + 2 + self.h["tc_offset"], 0, 53)) * scale
            p1, p0, q0, q1 = (plane[y, (x + d)[:, None]] for d in (-2, -1, 0, 1))
            delta = np.clip((((q0 - p0) << 2) + p1 - q1 + 4) >> 3, -tc[:, None], tc[:, None])
            plane[y, (x - 1)[:, None]] = np.where(kp[:, None], p0, np.clip(p0 + delta, 0, most))
            plane[y, x[:, None]] = np.where(kq[:, None], q0, np.clip(q0 - delta, 0, most))
            return
        beta = np.take(P.BETA, np.clip(q + self.h["beta_offset"], 0, 51)) * scale
        tc = np.take(P.TC, np.clip(q + 2 + self.h["tc_offset"], 0, 53)) * scale
        at = x[:, None, None] + np.arange(-4, 4)
        v = plane[y[:, :, None], at]  # (edges, 4, 8): p3 to q3
        p3, p2, p1, p0, q0, q1, q2, q3 = np.moveaxis(v, 2, 0)
        dp, dq = np.abs(p2 - 2 * p1 + p0), np.abs(q2 - 2 * q1 + q0)
        d = dp[:, 0] + dq[:, 0] + dp[:, 3] + dq[:, 3]
        flat = [(2 * (dp[:, i] + dq[:, i]) < beta >> 2) & (np.abs(p3[:, i] - p0[:, i]) + np.abs(q0[:, i] - q3[:, i]) < beta >> 3) & (np.abs(p0[:, i] - q0[:, i]) < (5 * tc + 1) >> 1) for i in (0, 3)]
        strong, on = (flat[0] & flat[1])[:, None], (d < beta)[:, None]
        t, side = tc[:, None], ((beta + (beta >> 1)) >> 3)[:, None]
        more_p, more_q = (dp[:, 0] + dp[:, 3])[:, None] < side, (dq[:, 0] + dq[:, 3])[:, None] < side
        near = lambda new, old: np.clip(new, old - 2 * t, old + 2 * t)
        delta = (9 * (q0 - p0) - 3 * (q1 - p1) + 8) >> 4
        weak = np.abs(delta) < 10 * t
        delta = np.clip(delta, -t, t)
        half = t >> 1
        one = lambda v: np.clip(v, 0, most)
        dp1, dq1 = np.clip((((p2 + p0 + 1) >> 1) - p1 + delta) >> 1, -half, half), np.clip((((q2 + q0 + 1) >> 1) - q1 - delta) >> 1, -half, half)
        new = {
            -3: np.where(strong, near((2 * p3 + 3 * p2 + p1 + p0 + q0 + 4) >> 3, p2), p2),
            -2: np.where(strong, near((p2 + p1 + p0 + q0 + 2) >> 2, p1), np.where(weak & more_p, one(p1 + dp1), p1)),
            -1: np.where(strong, near((p2 + 2 * p1 + 2 * p0 + 2 * q0 + q1 + 4) >> 3, p0), np.where(weak, one(p0 + delta), p0)),
            0: np.where(strong, near((p1 + 2 * p0 + 2 * q0 + 2 * q1 + q2 + 4) >> 3, q0), np.where(weak, one(q0 - delta), q0)),
            1: np.where(strong, near((p0 + q0 + q1 + q2 + 2) >> 2, q1), np.where(weak & more_q, one(q1 + dq1), q1)),
            2: np.where(strong, near((p0 + q0 + q1 + 3 * q2 + 2 * q3 + 4) >> 3, q2), q2),
        }
        for k, value in new.items():
            own = (kp if k < 0 else kq)[:, None]
            plane[y, (x + k)[:, None]] = np.where(on & ~own, value, v[:, :, k + 4])

    def _offsets(self, planes: list[np.ndarray]) -> list[np.ndarray]:
        """Sample adaptive offsets from the deblocked planes; lossless units and, for edges, the picture's border stay."""
        out = []
        most, log2 = (1 << self.depth) - 1, self.s["log2_ctb"]
        for k, src in enumerate(planes):
            sx, sy = (self.sx, self.sy) if k else (0, 0)
            h, w = src.shape
            new, grow = src.copy(), self.p["sao_scale"][min(k, 1)]
            kept = self.kept.repeat(4 >> sy, 0).repeat(4 >> sx, 1)[:h, :w]
            for (rx, ry), params in self.sao.items():
                kind, offsets, place = params[k]
                if not kind:
                    continue
                y0, x0 = ry << log2 >> sy, rx << log2 >> sx
                y1, x1 = min(h, y0 + (1 << log2 >> sy)), min(w, x0 + (1 << log2 >> sx))
                table = np.array(offsets, np.int64) << grow
                if kind == 1:
                    own = src[y0:y1, x0:x1]
                    band = ((own >> (self.depth - 5)) - place) % 32
                    add = np.where(band < 4, table[np.minimum(band, 3)], 0)
                else:
                    dy, dx = ((0, 1), (1, 0), (1, 1), (1, -1))[place]
                    y0, y1, x0, x1 = max(y0, abs(dy)), min(y1, h - abs(dy)), max(x0, abs(dx)), min(x1, w - abs(dx))
                    if y0 >= y1 or x0 >= x1:
                        continue
                    own = src[y0:y1, x0:x1]
                    index = np.sign(own - src[y0 - dy : y1 - dy, x0 - dx : x1 - dx]) + np.sign(own - src[y0 + dy : y1 + dy, x0 + dx : x1 + dx])
                    add = np.array([table[0], table[1], 0, table[2], table[3]])[index + 2]
                new[y0:y1, x0:x1] = np.where(kept[y0:y1, x0:x1], own, np.clip(own + add, 0, most))
            out.append(new)
        return out


def residual(c: _Bins, log2: int, component: int, scan: int, hiding: bool, want: np.ndarray | None = None) -> np.ndarray:
    """The levels (size, size) of a block that has some, read or, if they are given, written."""
    n = 1 << log2
    inner, outer = SCANS[4, scan], SCANS[n >> 2, scan]
    chroma = int(component > 0)
    out = np.zeros((n, n), np.int64)
    if want is not None:
        order = [(bx * 4 + x, by * 4 + y) for bx, by in outer for x, y in inner]
        last = max(i for i, (x, y) in enumerate(order) if want[y, x])
        lx, ly = order[last]
        lx, ly = (ly, lx) if scan == 2 else (lx, ly)
        parts = [(v if v < 4 else 2 * v.bit_length() - 2 + (v >> (v.bit_length() - 2) & 1)) for v in (lx, ly)]
    offset, shift = (15, log2 - 2) if chroma else (3 * (log2 - 2) + ((log2 - 1) >> 2), (log2 + 1) >> 2)
    prefixes = []
    for k, name in enumerate(("last_x", "last_y")):
        p = 0
        while p < 2 * log2 - 1 and c.bin(FIRST[name] + offset + (p >> shift), None if want is None else int(p < parts[k])):
            p += 1
        prefixes.append(p)
    place = []
    for k, p in enumerate(prefixes):
        if p > 3:
            base = (2 + (p & 1)) << ((p >> 1) - 1)
            p = base + c.bits((p >> 1) - 1, None if want is None else (lx, ly)[k] - base)
        place.append(p)
    if scan == 2:
        place.reverse()
    lx, ly = place
    last_block, last_pos = outer.index((lx >> 2, ly >> 2)), inner.index((lx & 3, ly & 3))
    coded = np.zeros((n // 4 + 1, n // 4 + 1), np.int8)
    first, before = True, 1
    for i in range(last_block, -1, -1):
        bx, by = outer[i]
        near = int(coded[by, bx + 1]) + 2 * int(coded[by + 1, bx])
        own = None if want is None else want[4 * by : 4 * by + 4, 4 * bx : 4 * bx + 4]
        infer = False
        if 0 < i < last_block:
            coded[by, bx] = c.bin(FIRST["sub_block"] + min(1, near) + 2 * chroma, None if want is None else int(own.any()))
            infer = True
        else:
            coded[by, bx] = 1
        if not coded[by, bx]:
            continue
        places = [last_pos] if i == last_block else []
        for k in range(last_pos - 1 if i == last_block else 15, -1, -1):
            x, y = inner[k]
            if k == 0 and infer:
                places.append(0)
                break
            if log2 == 2:
                at = _PLACE[4 * y + x]
            elif x + y == 0 and i == 0:
                at = 0
            else:
                at = (2 if x + y == 0 else 1 if x + y < 3 else 0) if near == 0 else (2, 1, 0, 0)[y] if near == 1 else (2, 1, 0, 0)[x] if near == 2 else 2
                if chroma:
                    at += 9 if log2 == 3 else 12
                else:
                    at += 3 * (i > 0) + ((9 if scan == 0 else 15) if log2 == 3 else 21)
            if c.bin(FIRST["significant"] + at + 27 * chroma, None if want is None else int(own[y, x] != 0)):
                places.append(k)
                infer = False
        if not places:
            continue
        given = None if want is None else [int(own[inner[k][1], inner[k][0]]) for k in places]
        group = (0 if i == 0 or chroma else 2) + (not first and before == 0)
        first, before = False, 1
        base, over = [1] * len(places), None
        for j in range(min(8, len(places))):
            if c.bin(FIRST["greater1"] + 4 * group + before + 16 * chroma, None if want is None else int(abs(given[j]) > 1)):
                base[j], before = 2, 0
                over = j if over is None else over
            elif 0 < before < 3:
                before += 1
        if over is not None:
            base[over] += c.bin(FIRST["greater2"] + group + 4 * chroma, None if want is None else int(abs(given[over]) > 2))
        hidden = hiding and places[0] - places[-1] > 3
        signs = [c.bypass(None if want is None else int(v < 0)) for v in (given if given is not None else places)[: len(places) - hidden]]
        rice, total = 0, 0
        for j, k in enumerate(places):
            level = base[j]
            if level == ((3 if j == over else 2) if j < 8 else 1):
                level += c.remaining(rice, None if want is None else abs(given[j]) - level)
                if level > 3 << rice:
                    rice = min(4, rice + 1)
            total += level
            x, y = inner[k]
            negative = signs[j] if j < len(signs) else total & 1
            out[4 * by + y, 4 * bx + x] = -level if negative else level
    return out


# Streams


def decode_picture(stream: bytes, length_size: int = 4) -> Picture:
    """The decoded, not yet filtered picture of a stream's base layer under its last parameter sets; ValueError for what isn't supported."""
    s = p = done = None
    annexb = stream[:3] == b"\0\0\1" or stream[:4] == b"\0\0\0\1"
    slices = []
    for nal in C.split_annexb(stream) if annexb else C.split_lengths(stream, length_size):
        if len(nal) < 2 or nal[0] >> 7 or not nal[1] & 7 or (nal[0] & 1) << 5 | nal[1] >> 3:
            continue
        kind = nal[0] >> 1
        payload, gone = C.strip_emulation(nal[2:])
        if kind == 33:
            s = C.sps(payload, whole=True)
        elif kind == 34:
            p = C.pps(payload, whole=True)
        elif kind <= 9 or 16 <= kind <= 21:
            slices.append((kind, payload, gone))
    if s is None or p is None or not slices:
        raise ValueError("MalformedInput: no parameter sets or no slice")
    for kind, payload, gone in slices:
        h = C.slice_header(payload, kind, s, p, whole=True)
        # entry points count bytes of the stream, with those that were taken out
        start = h["data_at"]
        raw = start + sum(g <= start for g in (g - i for i, g in enumerate(gone)))
        h["parts"] = [raw + e - sum(g < raw + e for g in gone) for e in h["entry_points"]]
        if p["wavefront"] and len(h["parts"]) < s["ctbs_high"] - 1:
            raise ValueError("MalformedInput: too few entry points")
        done = Picture(s, p, h, Reader(payload, h["qp"], start)).decode()
    return done


def cropped(planes: list[np.ndarray], s: dict) -> list[np.ndarray]:
    """Planes inside the conformance window, which counts chroma samples."""
    left, right, top, bottom = s["window"]
    out = []
    for k, plane in enumerate(planes):
        ux, uy = ((2, 1)[s["chroma_format"] not in (1, 2)], (2, 1)[s["chroma_format"] != 1]) if k == 0 else (1, 1)
        out.append(plane[top * uy : plane.shape[0] - bottom * uy, left * ux : plane.shape[1] - right * ux])
    return out


_SCHEMA = "width int, height int, bit_depth int, chroma_format int, planes array<array<int>>, units array<array<int>>, blocks array<array<int>>, modes array<int>, sao array<array<int>>, error string"


def _flat_sao(pic: Picture) -> list[list[int]]:
    return [[rx, ry, k, kind, *offsets, place] for (rx, ry), params in pic.sao.items() for k, (kind, offsets, place) in enumerate(params)]


def _decode_batches(batches, length_size):
    lists = pa.list_(pa.list_(pa.int32()))
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), lists, lists, lists, pa.list_(pa.int32()), lists, pa.string())
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    for batch in batches:
        for i, stream in enumerate(batch.column("stream")):
            try:
                pic = decode_picture(stream.as_py() or b"", length_size)
                planes = cropped(pic.filtered(), pic.s)
                row = (planes[0].shape[1], planes[0].shape[0], pic.depth, pic.format, [x.ravel().astype(np.int32) for x in planes], pic.units, pic.blocks, pic.modes.ravel().astype(np.int32), _flat_sao(pic), None)
            except (ValueError, IndexError) as e:
                row = (*(None,) * 9, str(e) if isinstance(e, ValueError) else "MalformedInput: syntax out of range")
            yield pa.RecordBatch.from_arrays([batch.column("item").slice(i, 1), *(pa.array([v], t) for v, t in zip(row, types))], names=["item", *names])


def decode(streams: DataFrame, length_size: int = 4) -> DataFrame:
    """(item, width, height, bit_depth, chroma_format, planes, units, blocks, modes, error) of streams (item, stream), a row an item.

    planes are the cropped components in raster order after the in-loop filters; units are coding units (x, y, log2
    size, parts), blocks transform blocks (component, x, y, size, levels that aren't 0), modes the luma modes of 4 x 4
    blocks, sao (column, row, component, type, four offsets, band or class) of coding tree units. A stream that is empty, broken or not supported gives an error and no planes. A task holds one picture.
    """
    kind = streams.schema["item"].dataType.simpleString()
    return streams.select("item", "stream").mapInArrow(partial(_decode_batches, length_size=length_size), f"item {kind}, {_SCHEMA}")


# Parts of the syntax by themselves


def _bin_batches(batches):
    for batch in B.steps(batches):
        out = []
        for r in batch.select(["stream", "qp", "places"]).to_pylist():
            reader = Reader(r["stream"], r["qp"])
            out.append([reader.bypass() if c < 0 else reader.bin(c) for c in r["places"]])
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(out, pa.list_(pa.int32()))], names=["item", "bins"])


def read_bins(rows: DataFrame) -> DataFrame:
    """(item, bins) of rows (item, stream, qp, places): the bins by the context at each place, -1 for a bypass bin."""
    kind = rows.schema["item"].dataType.simpleString()
    return rows.select("item", "stream", "qp", "places").mapInArrow(_bin_batches, f"item {kind}, bins array<int>")


def _level_batches(batches):
    for batch in B.steps(batches):
        out = []
        for r in batch.select(["stream", "qp", "log2", "component", "scan"]).to_pylist():
            out.append(residual(Reader(r["stream"], r["qp"]), r["log2"], r["component"], r["scan"], False).ravel().astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(out, pa.list_(pa.int32()))], names=["item", "levels"])


def read_levels(rows: DataFrame) -> DataFrame:
    """(item, levels) of rows (item, stream, qp, log2, component, scan): the levels of one block each, in raster order."""
    kind = rows.schema["item"].dataType.simpleString()
    return rows.select("item", "stream", "qp", "log2", "component", "scan").mapInArrow(_level_batches, f"item {kind}, levels array<int>")


def _context_batches(batches):
    for batch in batches:
        out = [contexts(qp) for qp in batch.column("qp").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("qp"), pa.array(out, pa.list_(pa.int32()))], names=["qp", "contexts"])


def initial_contexts(rows: DataFrame) -> DataFrame:
    """(qp, contexts) of rows (qp int): all contexts of an intra slice, each twice its state and its more probable symbol."""
    return rows.select("qp").mapInArrow(_context_batches, "qp int, contexts array<int>")


def _list_batches(batches):
    kind = pa.list_(pa.struct([("size", pa.int32()), ("matrix", pa.int32()), ("values", pa.list_(pa.int32())), ("first", pa.int32())]))
    for batch in B.steps(batches, 100):
        out, more, errors = [], [], []
        for payload in batch.column("payload").to_pylist():
            row, error = {}, None
            try:
                row = C.sps(payload or b"", whole=True)
            except ValueError as e:
                error = str(e)
            lists = row.get("lists")
            out.append(None if lists is None else [(s, m, v, d) for (s, m), (v, d) in sorted(lists.items())])
            more.append((row.get("strong_smoothing"), row.get("colour", {}).get("full_range"), row.get("colour", {}).get("primaries")))
            errors.append(error)
        own = list(zip(*more)) if more else [()] * 3
        yield pa.RecordBatch.from_arrays([batch.column("item"), B.array(out, kind), *(pa.array(c, pa.int32()) for c in own), pa.array(errors, pa.string())], names=["item", "lists", "strong_smoothing", "full_range", "primaries", "error"])


def whole_sps(rows: DataFrame) -> DataFrame:
    """(item, lists, strong_smoothing, full_range, primaries, error) of rows (item, payload): what an SPS says after its sizes, past reference sets, usability and decoder parameters."""
    kind = rows.schema["item"].dataType.simpleString()
    return rows.select("item", "payload").mapInArrow(_list_batches, f"item {kind}, lists array<struct<size:int,matrix:int,values:array<int>,first:int>>, strong_smoothing int, full_range int, primaries int, error string")
