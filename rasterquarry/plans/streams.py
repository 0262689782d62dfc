"""Coded pictures for queries and tests: parameter sets, a slice header and a picture written by a plan."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from rasterquarry.operators import codec as C
from rasterquarry.operators import hevc as H


@lru_cache(1 << 14)
def ue_code(v: int) -> str:
    """An unsigned Exp-Golomb code."""
    b = format(v + 1, "b")
    return "0" * (len(b) - 1) + b


class BitWriter:
    """Bits, the highest first."""

    def __init__(self):
        self.text: list[str] = []

    def u(self, n: int, v: int) -> BitWriter:
        if n:
            self.text.append(format(v, f"0{n}b"))
        return self

    def ue(self, *values: int) -> BitWriter:
        self.text += map(ue_code, values)
        return self

    def se(self, *values: int) -> BitWriter:
        return self.ue(*(2 * v - 1 if v > 0 else -2 * v for v in values))

    def closed(self) -> bytes:
        """The bytes, after a stop bit and zeros."""
        text = "".join(self.text) + "1"
        text += "0" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big")


def escaped(data: bytes) -> bytes:
    """With an emulation prevention byte after two zeros before a byte of up to 3."""
    out, zeros = bytearray(), 0
    for b in data:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        out.append(b)
        zeros = zeros + 1 if b == 0 else 0
    return bytes(out)


def nal(kind: int, payload: bytes) -> bytes:
    return bytes([kind << 1, 1]) + escaped(payload)


#: What a stream is coded with unless a caller says otherwise.
DEFAULTS = dict(
    format=1, depth=8, min_cb=3, ctb=4, min_tb=2, max_tb=4, intra_depth=1, sao=0, strong=0, scaling=0, lists=None, crop=(0, 0, 0, 0), sign_hiding=0, qp=26, qp_delta=0, qp_delta_depth=0,
    cb=0, cr=0, bypass=1, wavefront=0, skip=0, deblock_off=1, beta=0, tc=0, vui=False, reference_sets=0,
)


def parameter_sets(width: int, height: int, o: dict) -> tuple[bytes, bytes]:
    """The payloads of an SPS and a PPS."""
    s = BitWriter().u(4, 0).u(3, 0).u(1, 1).u(8, 3).u(32, 0).u(48, 0).u(8, 93).ue(0, o["format"])
    if o["format"] == 3:
        s.u(1, 0)
    s.ue(width, height).u(1, int(any(o["crop"])))
    if any(o["crop"]):
        s.ue(*o["crop"])
    s.ue(o["depth"] - 8, o["depth"] - 8, 4).u(1, 1).ue(0, 0, 0)
    s.ue(o["min_cb"] - 3, o["ctb"] - o["min_cb"], o["min_tb"] - 2, o["max_tb"] - o["min_tb"], 0, o["intra_depth"]).u(1, o["scaling"])
    if o["scaling"]:
        s.u(1, int(o["lists"] is not None))
        if o["lists"] is not None:
            write_lists(s, o["lists"])
    s.u(1, 0).u(1, o["sao"]).u(1, 0).ue(o["reference_sets"])
    for i in range(o["reference_sets"]):
        if i:
            s.u(1, 0)
        s.ue(1, 1).ue(0).u(1, 1).ue(2).u(1, 0)
    s.u(1, 0).u(1, 0).u(1, o["strong"]).u(1, int(o["vui"]))
    if o["vui"]:
        s.u(1, 1).u(8, 255).u(32, 0x00010001).u(1, 0).u(1, 1).u(3, 5).u(1, 1).u(1, 1).u(8, 1).u(8, 13).u(8, 6).u(1, 0).u(3, 0).u(1, 0)
        s.u(1, 1).u(32, 1).u(32, 25).u(1, 0).u(1, 1).u(2, 0b10).u(1, 0).u(8, 0x11).u(15, 0x1234).u(1, 1).ue(3).ue(1).ue(5, 6).u(1, 0).ue(7, 8).u(1, 1).u(1, 0)
    s.u(1, 0)
    p = BitWriter().ue(0, 0).u(1, 0).u(1, 0).u(3, 0).u(1, o["sign_hiding"]).u(1, 0).ue(0, 0).se(o["qp"] - 26).u(1, 0).u(1, o["skip"]).u(1, o["qp_delta"])
    if o["qp_delta"]:
        p.ue(o["qp_delta_depth"])
    p.se(o["cb"], o["cr"]).u(1, 0).u(2, 0).u(1, o["bypass"]).u(1, 0).u(1, o["wavefront"]).u(1, 0).u(1, 1).u(1, 0).u(1, o["deblock_off"])
    if not o["deblock_off"]:
        p.se(o["beta"] // 2, o["tc"] // 2)
    return s.closed(), p.u(1, 0).u(1, 0).ue(0).u(1, 0).u(1, 0).closed()


def write_lists(s: BitWriter, lists: dict) -> None:
    """Every list by its own differences."""
    for size in range(4):
        for matrix in range(0, 6, 3 if size == 3 else 1):
            values, first = lists[size, matrix]
            s.u(1, 1)
            if size > 1:
                s.se(first - 8)
            before = first if size > 1 else 8
            s.se(*((v - b + 128) % 256 - 128 for b, v in zip((before, *values), values)))


def encode(planes: list[np.ndarray], plan: H.Plan, annexb: bool = False, **options) -> tuple[bytes, H.Picture]:
    """A stream of an IDR picture coded by a plan, and the picture as its decoder will have it. Planes have whole smallest coding units."""
    o = DEFAULTS | options
    height, width = planes[0].shape
    sps, pps = parameter_sets(width, height, o)
    s, p = C.sps(sps, whole=True), C.pps(pps, whole=True)
    head = BitWriter().u(1, 1).u(1, 0).ue(0, 2)
    if o["sao"]:
        head.u(1, 1)
        if o["format"]:
            head.u(1, 1)
    head.se(0)
    h = {"sao_luma": o["sao"], "sao_chroma": o["sao"] if o["format"] else 0, "qp": o["qp"], "cb_qp_offset": 0, "cr_qp_offset": 0, "deblock_off": o["deblock_off"], "beta_offset": o["beta"], "tc_offset": o["tc"]}
    coder = H.Writer(o["qp"])
    picture = H.Picture(s, p, h, coder, plan).decode()
    if o["wavefront"]:
        # an offset counts the bytes of its part as they are in the stream, which the whole slice decides
        sizes = [len(x) for x in coder.parts[:-1]]
        for _ in range(3):
            whole = slice_payload(head, sizes, coder.parts)
            ends = np.cumsum([len(whole) - sum(map(len, coder.parts)), *map(len, coder.parts)])
            at = [len(escaped(whole[:e])) for e in ends]
            sizes = np.diff(at)[:-1].tolist()
        payload = slice_payload(head, sizes, coder.parts)
    else:
        payload = slice_payload(head, None, coder.parts)
    nals = [nal(33, sps), nal(34, pps), nal(19, payload)]
    return b"".join((b"\0\0\1" + n) if annexb else len(n).to_bytes(4, "big") + n for n in nals), picture


def slice_payload(head: BitWriter, sizes: list[int] | None, parts: list[bytes]) -> bytes:
    out = BitWriter()
    out.text = list(head.text)
    if sizes is not None:
        out.ue(len(sizes))
        if sizes:
            out.ue(31)
            for n in sizes:
                out.u(32, n - 1)
    return out.closed() + b"".join(parts)
