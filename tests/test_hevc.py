import numpy as np
import pytest

from rasterquarry.operators import codec as C
from rasterquarry.operators import hevc as H
from rasterquarry.plans import streams as S


class Chance(H.Plan):
    """Choices by chance, the same when asked again."""

    def __init__(self, planes, seed):
        super().__init__(planes)
        self.rng, self.memo = np.random.default_rng(seed), {}

    def draw(self, key, low, high):
        if key not in self.memo:
            self.memo[key] = int(self.rng.integers(low, high))
        return self.memo[key]

    def sao(self, rx, ry):
        k = self.draw(("sao", rx, ry), 0, 5)
        if k < 2 and (rx, ry)[k]:
            return ("left", "up")[k]
        out, kind, place = [], 0, 0
        for c in range(3):
            if c < 2:
                kind, place = self.draw(("kind", rx, ry, c), 0, 3), self.draw(("class", rx, ry, c), 0, 4)
            own = [self.draw(("offset", rx, ry, c, i), -7, 8) for i in range(4)]
            if kind == 2:
                own = [abs(own[0]), abs(own[1]), -abs(own[2]), -abs(own[3])]
            out.append((kind, tuple(own) if kind else (0,) * 4, self.draw(("band", rx, ry, c), 0, 32) if kind == 1 else place))
        return out

    def split(self, x, y, log2):
        return self.draw(("split", x, y, log2), 0, 2)

    def quarters(self, x, y):
        return self.draw(("quarters", x, y), 0, 2)

    def mode(self, x, y):
        return self.draw(("mode", x, y), 0, 35)

    def chroma(self, x, y):
        return self.draw(("chroma", x, y), 0, 5)

    def split_transform(self, x, y, log2):
        return self.draw(("tree", x, y, log2), 0, 2)


class Lossy(Chance):
    """Levels by chance, some units without loss."""

    def lossless(self, x, y):
        return int(self.draw(("lossless", x, y), 0, 4) == 0)

    def qp_delta(self, x, y):
        return self.draw(("delta", x, y), -20, 20)

    def skip_transform(self, x, y, component):
        return self.draw(("skip", x, y, component), 0, 2)

    def levels(self, x, y, n, component, predicted):
        key = ("levels", x, y, n, component)
        if key not in self.memo:
            v = np.zeros((n, n), np.int64)
            for _ in range(int(self.rng.integers(0, n * n // 3 + 2))):
                v[self.rng.integers(0, n), self.rng.integers(0, n)] = self.rng.integers(-9, 10) * self.rng.choice([1, 1, 1, 30, 700])
            self.memo[key] = v
        return self.memo[key]


def planes(form, width, height, depth, seed):
    rng = np.random.default_rng(seed)
    sy, sx = (2 if form == 1 else 1), (2 if form in (1, 2) else 1)
    return [rng.integers(0, 1 << depth, (height, width))] + [rng.integers(0, 1 << depth, (height // sy, width // sx)) for _ in range(2 * (form > 0))]


TOOLS = {
    "plain": {},
    "filters": dict(ctb=5, max_tb=5, intra_depth=2, sao=1, deblock_off=0, strong=1),
    "wavefront": dict(ctb=6, max_tb=5, intra_depth=3, wavefront=1, depth=10, sao=1, deblock_off=0),
    "small transforms": dict(max_tb=3, wavefront=1, vui=True, reference_sets=2),
}


@pytest.mark.parametrize("tools", TOOLS)
@pytest.mark.parametrize("form", range(4))
def test_pictures_come_back(form, tools):
    o = TOOLS[tools]
    for seed, (w, h) in enumerate(((16, 16), (72, 40), (8, 40))):
        own = planes(form, w, h, o.get("depth", 8), seed)
        out = H.decode_picture(S.encode(own, Chance(own, seed), format=form, annexb=bool(seed % 2), **o)[0])
        assert all(np.array_equal(a, b) for a, b in zip(out.planes, own)) and all(np.array_equal(a, b) for a, b in zip(out.filtered(), own))
        for more in (dict(qp_delta=1, qp_delta_depth=1, skip=1, scaling=1), dict(qp=35, cb=3, cr=-4, qp_delta=1)):
            stream, coded = S.encode(own, Lossy(own, seed), format=form, **(o | more))
            out = H.decode_picture(stream)
            assert all(np.array_equal(a, b) for a, b in zip(out.planes, coded.planes)) and np.array_equal(out.qps, coded.qps)
            assert all(np.array_equal(a, b) for a, b in zip(out.filtered(), coded.filtered()))


def test_range_table_and_states():
    assert H.LPS[0] == [128, 176, 208, 240] and H.LPS[10] == [85, 104, 123, 142] and H.LPS[62] == [6, 7, 8, 9] and H.LPS[63] == [2] * 4
    assert all(a >= b for x, y in zip(H.LPS, H.LPS[1:]) for a, b in zip(x, y))


def test_unfiltered_picture_by_hand():
    """One unit of 16 x 16, flat prediction, one level: a constant residual of the transform's first basis."""

    class One(H.Plan):
        def lossless(self, x, y):
            return 0

        def levels(self, x, y, n, component, predicted):
            v = np.zeros((n, n), np.int64)
            v[0, 0] = 8 if component == 0 else 0
            return v

    own = planes(1, 16, 16, 8, 0)
    out = H.decode_picture(S.encode(own, One(own), qp=28, bypass=0)[0])
    coefficient = (8 * 16 * 64 * 16 + 64) >> 7  # scale 64 at QP 28, doubled four times
    assert (out.planes[0] == 128 + (((64 * ((64 * coefficient + 64) >> 7)) + 2048) >> 12)).all()
    assert (out.planes[1] == 128).all() and (out.planes[2] == 128).all()


def test_broken_streams_are_rows_with_errors(spark):
    own = planes(1, 32, 16, 8, 1)
    stream, _ = S.encode(own, Chance(own, 1))
    rows = [(0, stream), (1, None), (2, b""), (3, stream[: len(stream) // 2]), (4, stream[:30]), (5, b"\0\0\0\1" + bytes(40)), (6, bytearray(stream[:-40]) + bytes(40))]
    got = {r.item: r for r in H.decode(spark.createDataFrame(rows, "item int, stream binary")).collect()}
    assert got[0].error is None and got[0].planes == [p.ravel().tolist() for p in own]
    assert all(got[i].error and got[i].planes is None for i in range(1, 6))


def test_unsupported_tools_are_errors():
    own = planes(0, 16, 16, 8, 1)
    s, p = (read(x, whole=True) for read, x in zip((C.sps, C.pps), S.parameter_sets(16, 16, S.DEFAULTS | {"format": 0})))
    h = {"sao_luma": 0, "sao_chroma": 0, "qp": 26}
    with pytest.raises(ValueError, match="PCM"):
        H.Picture(s | {"pcm": 1}, p, h, H.Writer(26), H.Plan(own))
    with pytest.raises(ValueError, match="depths"):
        H.Picture(s | {"chroma_format": 1, "bit_depth_chroma": 10}, p, h, H.Writer(26), H.Plan(own))
