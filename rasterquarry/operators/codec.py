"""HEVC streams as rows: NAL units, bit fields, parameter sets, and the closed formulas of the syntax."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterquarry.functions.bytes import bits, part, unsigned

from .boxes import steps


def framing(b: Column) -> Column:
    """`annexb` if the stream starts with a start code, else `length`; null for no bytes."""
    start = (part(b, 0, 3) == F.lit(b"\0\0\1")) | (part(b, 0, 4) == F.lit(b"\0\0\0\1"))
    return F.when(F.octet_length(b) > 0, F.when(F.coalesce(start, F.lit(False)), "annexb").otherwise("length"))


def nal_header(b: Column) -> Column:
    """struct<type, layer, temporal_id, error> of the two bytes at a NAL unit's start."""
    x = unsigned(b, 0, 2)
    error = F.when(F.octet_length(b) < 2, "truncated header").when(bits(x, 15, 1) == 1, "forbidden bit").when(bits(x, 0, 3) == 0, "temporal id 0")
    return F.struct(bits(x, 9, 6).alias("type"), bits(x, 3, 6).alias("layer"), (bits(x, 0, 3) - 1).alias("temporal_id"), error.alias("error"))


def nal_class(kind: Column) -> Column:
    """struct of the predicates on a NAL unit type: slice, idr, rasl, radl, irap, parameter_set."""
    return F.struct(
        (kind.between(0, 9) | kind.between(16, 21)).alias("slice"), kind.isin(19, 20).alias("idr"), kind.isin(8, 9).alias("rasl"),
        kind.isin(6, 7).alias("radl"), kind.between(16, 23).alias("irap"), kind.between(32, 34).alias("parameter_set"),
    )


def split_annexb(data: bytes):
    """The bytes between start codes, trailing zeros of each left out."""
    at = data.find(b"\0\0\1")
    while at >= 0:
        end = data.find(b"\0\0\1", at + 3)
        yield data[at + 3 : end if end >= 0 else len(data)].rstrip(b"\0") if end >= 0 else data[at + 3 :]
        at = end


def split_lengths(data: bytes, width: int):
    at = 0
    while at + width <= len(data):
        n = int.from_bytes(data[at : at + width], "big")
        at += width
        if at + n > len(data):
            raise ValueError("NAL length beyond the stream")
        yield data[at : at + n]
        at += n
    if at < len(data):
        raise ValueError("truncated NAL length")


def strip_emulation(data: bytes) -> tuple[bytes, list[int]]:
    """The payload without the 3 of each 0 0 3, and where those stood."""
    out, gone, at = bytearray(), [], 0
    while (hit := data.find(b"\0\0\3", at)) >= 0:
        out += data[at : hit + 2]
        gone.append(hit + 2)
        at = hit + 3
    out += data[at:]
    return bytes(out), gone


def _nal_batches(batches, width):
    for batch in batches:
        at, rows = [], []
        for i, data in enumerate(batch.column("stream").to_pylist()):
            data, error, found = data or b"", None, []
            try:
                if not data:
                    raise ValueError("empty stream")
                annexb = data[:3] == b"\0\0\1" or data[:4] == b"\0\0\0\1"
                for nal in split_annexb(data) if annexb else split_lengths(data, width):
                    if len(nal) >= 2 and not nal[0] >> 7 and nal[1] & 7:
                        payload, gone = strip_emulation(nal[2:])
                        found.append((len(found), nal[0] >> 1, (nal[0] & 1) << 5 | nal[1] >> 3, (nal[1] & 7) - 1, payload, gone, None))
            except ValueError as e:
                error = str(e)
            if error:
                found.append((None, None, None, None, None, None, error))
            at += [i] * len(found)
            rows += found
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.string())
        columns = list(zip(*rows)) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))], names=["item", "pos", "type", "layer", "temporal_id", "payload", "removed", "error"])


def nal_units(streams: DataFrame, length_size: int = 4) -> DataFrame:
    """(item, pos, type, layer, temporal_id, payload, removed, error) of streams (item, stream). Units with a bad header are passed over; a bad length gives an error row after the units before it."""
    kind = streams.schema["item"].dataType.simpleString()
    return streams.select("item", "stream").mapInArrow(partial(_nal_batches, width=length_size), f"item {kind}, pos int, type int, layer int, temporal_id int, payload binary, removed array<int>, error string")


class Bits:
    """Bits of a payload, most significant first. A read takes the bytes that it needs, so its time doesn't grow with the payload."""

    def __init__(self, data: bytes):
        self.data, self.n, self.at = data, 8 * len(data), 0

    def u(self, n: int) -> int:
        end = self.at + n
        if end > self.n:
            raise ValueError("out of bits")
        first, last = self.at >> 3, (end + 7) >> 3
        self.at = end
        return int.from_bytes(self.data[first:last], "big") >> (8 * last - end) & ((1 << n) - 1)

    def ue(self) -> int:
        at = self.at
        window = self.data[at >> 3 : (at >> 3) + 9]  # the longest code has 65 bits
        have = 8 * len(window) - (at & 7)
        value = int.from_bytes(window, "big") & ((1 << have) - 1) if have > 0 else 0
        zeros = have - value.bit_length()
        if zeros > 32:
            raise ValueError("Exp-Golomb code too long")
        n = 2 * zeros + 1
        if n > have:
            raise ValueError("out of bits")
        self.at = at + n
        return (value >> (have - n)) - 1

    def se(self) -> int:
        k = self.ue()
        return (k + 1) // 2 if k & 1 else -(k // 2)


    def ses(self, n: int) -> list[int]:
        """n signed codes. The digits are made once for all of them."""
        first, skip = self.at >> 3, self.at & 7
        window = self.data[first : first + 9 * n + 1]
        text, at, out = format(int.from_bytes(window, "big"), f"0{8 * len(window)}b") if window else "", skip, []
        for _ in range(n):
            one = text.find("1", at)
            end = 2 * one - at + 1
            if one < 0 or one - at > 32 or end > len(text):  # the slow way has the error
                self.at = 8 * first + at
                out.append(self.se())
                at = self.at - 8 * first
                continue
            k = int(text[one:end], 2) - 1
            out.append((k + 1) // 2 if k & 1 else -(k // 2))
            at = end
        self.at = 8 * first + at
        return out


def _profile_tier_level(r: Bits, layers: int) -> dict:
    out = {"profile_space": r.u(2), "tier": r.u(1), "profile": r.u(5)}
    r.u(32)
    r.u(48)
    out["level"] = r.u(8)
    there = [(r.u(1), r.u(1)) for _ in range(layers)]
    if layers:
        r.u(2 * (8 - layers))
    for has_profile, has_level in there:
        r.u(88 * has_profile + 8 * has_level)
    return out


def vps(data: bytes) -> dict:
    r = Bits(data)
    out = {"id": r.u(4)}
    r.u(2)
    out["max_layers"] = r.u(6) + 1
    layers = r.u(3)
    out |= {"max_sub_layers": layers + 1, "nesting": r.u(1)}
    if r.u(16) != 0xFFFF:
        raise ValueError("reserved bits")
    return out | _profile_tier_level(r, layers)


# The default lists of 8 x 8 and larger blocks along the diagonals, of intra and of other blocks.
DEFAULT_INTRA = (
    16, 16, 16, 16, 16, 16, 16, 16, 16, 16, 17, 16, 17, 16, 17, 18, 17, 18, 18, 17, 18, 21, 19, 20, 21, 20, 19, 21, 24, 22, 22, 24,
    24, 22, 22, 24, 25, 25, 27, 30, 27, 25, 25, 29, 31, 35, 35, 31, 29, 36, 41, 44, 41, 36, 47, 54, 54, 47, 65, 70, 65, 88, 88, 115,
)
DEFAULT_OTHER = (
    16, 16, 16, 16, 16, 16, 16, 16, 16, 16, 17, 17, 17, 17, 17, 18, 18, 18, 18, 18, 18, 20, 20, 20, 20, 20, 20, 20, 24, 24, 24, 24,
    24, 24, 24, 24, 25, 25, 25, 25, 25, 25, 25, 28, 28, 28, 28, 28, 28, 33, 33, 33, 33, 33, 41, 41, 41, 41, 54, 54, 54, 71, 71, 91,
)


def default_lists() -> dict[tuple[int, int], tuple[tuple[int, ...], int]]:
    """(values along the diagonals, first value of larger blocks) by size, 0 for 4 x 4 to 3 for 32 x 32, and matrix."""
    return {(size, matrix): ((16,) * 16 if size == 0 else DEFAULT_INTRA if matrix < 3 else DEFAULT_OTHER, 16) for size in range(4) for matrix in range(6)}


def _scaling_lists(r: Bits) -> dict[tuple[int, int], tuple[tuple[int, ...], int]]:
    """The lists that a parameter set states: own ones by differences, copies of earlier ones, or the defaults."""
    default = default_lists()
    out = {}
    for size in range(4):
        step = 3 if size == 3 else 1
        for matrix in range(0, 6, step):
            if not r.u(1):
                back = r.ue() * step
                if back > matrix:
                    raise ValueError("scaling list before the first")
                out[size, matrix] = out[size, matrix - back] if back else default[size, matrix]
                continue
            value = first = 8 + r.se() if size > 1 else 8
            values = []
            for step_by in r.ses(16 if size == 0 else 64):
                value = (value + step_by) % 256
                values.append(value)
            out[size, matrix] = (tuple(values), first if size > 1 else 16)
    for matrix in (1, 2, 4, 5):  # 32 x 32 chroma, in 4:4:4 only, takes those of 16 x 16
        out[3, matrix] = out[2, matrix]
    return out


def _skip_sub_layer(r: Bits, n: int, low_delay_and_pictures: bool) -> None:
    for _ in range(n):
        r.ue(), r.ue()
        if low_delay_and_pictures:
            r.ue(), r.ue()
        r.u(1)


def _skip_hrd(r: Bits, common: bool, layers: int) -> None:
    """Passes over hypothetical decoder parameters."""
    nal = vcl = pictures = 0
    if common:
        nal, vcl = r.u(1), r.u(1)
        if nal or vcl:
            pictures = r.u(1)
            if pictures:
                r.u(19)
            r.u(8)
            if pictures:
                r.u(4)
            r.u(15)
    for _ in range(layers + 1):
        fixed = r.u(1)
        within = 1 if fixed else r.u(1)
        low = 0
        if within:
            r.ue()
        else:
            low = r.u(1)
        n = 1 if low else r.ue() + 1
        if n > 32:
            raise ValueError("too many decoder buffers")
        _skip_sub_layer(r, n * (nal + vcl), bool(pictures))


def _skip_vui(r: Bits, layers: int) -> dict:
    """Passes over usability information and returns its colour fields."""
    out = {}
    if r.u(1) and r.u(8) == 255:
        r.u(32)
    if r.u(1):
        r.u(1)
    if r.u(1):
        r.u(3)
        out["full_range"] = r.u(1)
        if r.u(1):
            out |= {"primaries": r.u(8), "transfer": r.u(8), "matrix": r.u(8)}
    if r.u(1):
        r.ue(), r.ue()
    r.u(3)
    if r.u(1):
        [r.ue() for _ in range(4)]
    if r.u(1):
        r.u(32), r.u(32)
        if r.u(1):
            r.ue()
        if r.u(1):
            _skip_hrd(r, True, layers)
    if r.u(1):
        r.u(3)
        [r.ue() for _ in range(5)]
    return out


def _skip_reference_sets(r: Bits, n: int) -> None:
    """Passes over short-term reference picture sets; predicted ones need the number of pictures of the set before."""
    if n > 64:
        raise ValueError("too many reference picture sets")
    pictures = 0
    for i in range(n):
        if i and r.u(1):
            r.u(1), r.ue()
            kept = 0
            for _ in range(pictures + 1):
                if r.u(1) or r.u(1):
                    kept += 1
            pictures = kept
            continue
        before, after = r.ue(), r.ue()
        if before + after > 16:
            raise ValueError("too many reference pictures")
        for _ in range(before + after):
            r.ue(), r.u(1)
        pictures = before + after


def sps(data: bytes, whole: bool = False) -> dict:
    """The fields of a sequence parameter set up to its intra tools, and the sizes that follow from them; whole: all that a decoder needs."""
    r = Bits(data)
    r.u(4)
    layers = r.u(3)
    r.u(1)
    out = _profile_tier_level(r, layers)
    out |= {"id": r.ue(), "chroma_format": r.ue()}
    if out["id"] > 15 or out["chroma_format"] > 3:
        raise ValueError("field out of range")
    out["separate_planes"] = r.u(1) if out["chroma_format"] == 3 else 0
    out |= {"width": r.ue(), "height": r.ue()}
    out["window"] = [r.ue() for _ in range(4)] if r.u(1) else [0, 0, 0, 0]
    out |= {"bit_depth_luma": r.ue() + 8, "bit_depth_chroma": r.ue() + 8}
    out["order_count_bits"] = r.ue() + 3
    for _ in range(layers + 1 if r.u(1) else 1):
        r.ue(), r.ue(), r.ue()
    low_cb, more_cb, low_tb, more_tb = r.ue() + 3, r.ue(), r.ue() + 2, r.ue()
    out |= {"log2_min_cb": low_cb, "log2_ctb": low_cb + more_cb, "log2_min_tb": low_tb, "log2_max_tb": low_tb + more_tb}
    r.ue()
    out["intra_depth"] = r.ue()
    out["scaling_lists"] = r.u(1)
    if out["scaling_lists"]:
        out["lists"] = _scaling_lists(r) if r.u(1) else default_lists()
    out |= {"amp": r.u(1), "sao": r.u(1), "pcm": r.u(1)}
    if out["pcm"]:
        r.u(8), r.ue(), r.ue(), r.u(1)
    ctb = 1 << out["log2_ctb"]
    out |= {"ctbs_wide": -(-out["width"] // ctb), "ctbs_high": -(-out["height"] // ctb)}
    if not 0 < out["width"] <= 16384 or not 0 < out["height"] <= 16384:
        raise ValueError("picture size")
    if whole:
        if out["log2_ctb"] > 6 or out["log2_max_tb"] > min(5, out["log2_ctb"]) or out["log2_min_tb"] >= out["log2_min_cb"]:
            raise ValueError("block sizes")
        out["reference_sets"] = r.ue()
        _skip_reference_sets(r, out["reference_sets"])
        out |= {"long_term": r.u(1), "long_term_sets": 0}
        if out["long_term"]:
            out["long_term_sets"] = r.ue()
            for _ in range(out["long_term_sets"]):
                r.u(out["order_count_bits"] + 1)
        out |= {"temporal_prediction": r.u(1), "strong_smoothing": r.u(1)}
        if r.u(1):
            out["colour"] = _skip_vui(r, layers)
        if r.u(1) and r.u(8) >> 7 and r.u(9):
            raise ValueError("UnsupportedFeature: range extension")
    return out


def pps(data: bytes, whole: bool = False) -> dict:
    """The fields of a picture parameter set up to its in-loop filters; more than one tile is rejected. whole: all that a decoder needs."""
    r = Bits(data)
    out = {"id": r.ue(), "sps_id": r.ue(), "dependent_slices": r.u(1), "output_flag": r.u(1), "extra_bits": r.u(3), "sign_hiding": r.u(1), "cabac_init": r.u(1)}
    r.ue(), r.ue()
    out |= {"init_qp": 26 + r.se(), "constrained_intra": r.u(1), "transform_skip": r.u(1), "cu_qp_delta": r.u(1)}
    out["qp_delta_depth"] = r.ue() if out["cu_qp_delta"] else 0
    out |= {"cb_qp_offset": r.se(), "cr_qp_offset": r.se(), "slice_chroma_qp": r.u(1)}
    r.u(2)
    out["bypass"] = r.u(1)
    tiles, out["wavefront"] = r.u(1), r.u(1)
    if tiles:
        raise ValueError("tiles are unsupported")
    out["loop_across_slices"] = r.u(1)
    out |= {"deblock_override": 0, "deblock_off": 0, "beta_offset": 0, "tc_offset": 0}
    if r.u(1):
        out |= {"deblock_override": r.u(1), "deblock_off": r.u(1)}
        if not out["deblock_off"]:
            out |= {"beta_offset": 2 * r.se(), "tc_offset": 2 * r.se()}
    if whole:
        out["lists"] = _scaling_lists(r) if r.u(1) else None
        r.u(1), r.ue()
        out["header_extension"] = r.u(1)
        out["sao_scale"] = (0, 0)
        if r.u(1) and r.u(8) >> 7:
            larger = r.ue() if out["transform_skip"] else 0
            if larger or r.u(1) or r.u(1):
                raise ValueError("UnsupportedFeature: range extension")
            out["sao_scale"] = (r.ue(), r.ue())
    return out


PARSERS = {
    32: (vps, "id long, max_layers long, max_sub_layers long, nesting long, profile_space long, tier long, profile long, level long"),
    33: (sps, "profile_space long, tier long, profile long, level long, id long, chroma_format long, separate_planes long, width long, height long, window array<long>, bit_depth_luma long, bit_depth_chroma long, log2_min_cb long, log2_ctb long, log2_min_tb long, log2_max_tb long, intra_depth long, scaling_lists long, amp long, sao long, pcm long, ctbs_wide long, ctbs_high long"),
    34: (pps, "id long, sps_id long, dependent_slices long, output_flag long, extra_bits long, sign_hiding long, cabac_init long, init_qp long, constrained_intra long, transform_skip long, cu_qp_delta long, qp_delta_depth long, cb_qp_offset long, cr_qp_offset long, slice_chroma_qp long, bypass long, wavefront long, loop_across_slices long, deblock_override long, deblock_off long, beta_offset long, tc_offset long"),
}


def _parameter_batches(batches, kind, names):
    read, _ = PARSERS[kind]
    for batch in steps(batches):
        out = {n: [] for n in names}
        errors = []
        for data in batch.column("payload").to_pylist():
            row, error = {}, None
            try:
                row = read(data or b"")
            except ValueError as e:
                error = str(e)
            for n in names:
                out[n].append(row.get(n))
            errors.append(error)
        lists = {"window": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[n], lists.get(n, pa.int64())) for n in names), pa.array(errors, pa.string())], names=["item", *names, "error"])


def parameter_sets(nals: DataFrame, kind: int) -> DataFrame:
    """The parameter sets of one NAL type (32 VPS, 33 SPS, 34 PPS) of nal_units' rows as columns, with error."""
    ddl = PARSERS[kind][1]
    names = [c.split()[0] for c in ddl.split(", ")]
    return nals.where(F.col("type") == kind).select("item", "payload").mapInArrow(partial(_parameter_batches, kind=kind, names=names), f"item {nals.schema['item'].dataType.simpleString()}, {ddl}, error string")


def _skip_slice_references(r: Bits, s: dict) -> None:
    """Passes over the reference pictures of a slice of a picture that isn't IDR; a set predicted from another is rejected."""
    r.u(s["order_count_bits"] + 1)
    n = s["reference_sets"]
    if r.u(1):
        r.u(max(0, n - 1).bit_length())
    else:
        if n and r.u(1):
            raise ValueError("UnsupportedFeature: predicted reference picture set")
        for _ in range(r.ue() + r.ue()):
            r.ue(), r.u(1)
    if s["long_term"]:
        of_sets = r.ue() if s["long_term_sets"] else 0
        for i in range(of_sets + r.ue()):
            if i < of_sets:
                r.u(max(0, s["long_term_sets"] - 1).bit_length())
            else:
                r.u(s["order_count_bits"] + 2)
            if r.u(1):
                r.ue()
    if s["temporal_prediction"]:
        r.u(1)


def slice_header(data: bytes, kind: int, s: dict, p: dict, whole: bool = False) -> dict:
    """The header of an intra slice under its parameter sets; other slices, and pictures beside IDR unless the sets are whole, are rejected. whole: also where its data begin."""
    r = Bits(data)
    if not r.u(1):
        raise ValueError("only one slice a picture is supported")
    if kind not in (19, 20) and not whole:
        raise ValueError("only IDR pictures are supported")
    out = {"no_output_of_prior": r.u(1) if 16 <= kind <= 23 else 0, "pps_id": r.ue()}
    r.u(p.get("extra_bits") or 0)
    out["slice_type"] = r.ue()
    if out["slice_type"] != 2:
        raise ValueError("only intra slices are supported")
    out["output"] = r.u(1) if p.get("output_flag") else 1
    if s.get("separate_planes"):
        r.u(2)
    if kind not in (19, 20):
        _skip_slice_references(r, s)
    colour = s.get("chroma_format") and not s.get("separate_planes")
    out |= {"sao_luma": r.u(1) if s.get("sao") else 0, "sao_chroma": r.u(1) if s.get("sao") and colour else 0}
    out["qp"] = p["init_qp"] + r.se()
    out |= {"cb_qp_offset": r.se(), "cr_qp_offset": r.se()} if p.get("slice_chroma_qp") else {"cb_qp_offset": 0, "cr_qp_offset": 0}
    out |= {k: p.get(k) or 0 for k in ("deblock_off", "beta_offset", "tc_offset")}
    if p.get("deblock_override") and r.u(1):
        out["deblock_off"] = r.u(1)
        if not out["deblock_off"]:
            out |= {"beta_offset": 2 * r.se(), "tc_offset": 2 * r.se()}
    if p.get("loop_across_slices") and (out["sao_luma"] or out["sao_chroma"] or not out["deblock_off"]):
        r.u(1)
    ends = []
    if p.get("wavefront"):
        n = r.ue()
        if n > 8 * len(data):
            raise ValueError("too many entry points")
        width = r.ue() + 1 if n else 0
        for _ in range(n):
            ends.append((ends[-1] if ends else 0) + r.u(width) + 1)
    if whole:
        if p["header_extension"]:
            r.u(8 * r.ue())
        if not r.u(1):
            raise ValueError("slice header isn't aligned")
        out["data_at"] = -(-r.at // 8)
    return out | {"entry_points": ends}


SLICE = "no_output_of_prior long, pps_id long, slice_type long, output long, sao_luma long, sao_chroma long, qp long, cb_qp_offset long, cr_qp_offset long, deblock_off long, beta_offset long, tc_offset long, entry_points array<long>"


def _set_of(read, payload: bytes | None) -> dict | None:
    """A parameter set, None if it lacks or can't be read."""
    try:
        return None if payload is None else read(payload)
    except ValueError:
        return None


def _slice_batches(batches, names):
    for batch in steps(batches):
        out, errors, at = {n: [] for n in names}, [], []
        for i, (slices, *sets) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("slices", "sps", "pps")))):
            own = [_set_of(read, payload) for read, payload in zip((sps, pps), sets)]
            for one in slices:
                got, error = {}, None
                try:
                    if None in own:
                        raise ValueError("missing parameter set")
                    got = slice_header(one["payload"] or b"", one["type"], *own)
                except ValueError as e:
                    error = str(e)
                for n in names:
                    out[n].append(got.get(n))
                errors.append(error)
                at.append(i)
        lists = {"entry_points": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(out[n], lists.get(n, pa.int64())) for n in names), pa.array(errors, pa.string())], names=["item", *names, "error"])


def slice_headers(nals: DataFrame) -> DataFrame:
    """The slice headers of nal_units' base-layer slices under the item's last SPS and PPS. An item's units meet in one shuffle, and its sets are read once."""
    kind, payload, there = F.col("type"), F.col("payload"), F.col("item").isNotNull()
    coded = nal_class(kind)["slice"] & (F.col("layer") == 0)
    last = lambda k: F.max_by(F.when(kind == k, payload), F.when((kind == k) & there, F.col("pos")))
    own = nals.where(coded | kind.isin(33, 34)).groupBy("item").agg(F.collect_list(F.when(coded, F.struct("type", "payload"))).alias("slices"), last(33).alias("sps"), last(34).alias("pps")).where(F.size("slices") > 0)
    names = [c.split()[0] for c in SLICE.split(", ")]
    return own.mapInArrow(partial(_slice_batches, names=names), f"item {nals.schema['item'].dataType.simpleString()}, {SLICE}, error string")


# Closed formulas


def slice_type(code: Column) -> Column:
    """`B`, `P` or `I`; null for another code."""
    return F.get(F.array(F.lit("B"), F.lit("P"), F.lit("I")), code.cast("int"))


def derived_sizes(size: Column, log2_ctb: Column) -> Column:
    """struct<ctb, n>: the side of a coding tree unit, and how many of them cover a picture's side."""
    ctb = F.call_function("shiftleft", F.lit(1).cast("long"), log2_ctb.cast("int"))
    return F.struct(ctb.alias("ctb"), F.floor((size + ctb - 1) / ctb).alias("n"))


def chroma_array_type(chroma_format: Column, separate_planes: Column) -> Column:
    return F.when(separate_planes, 0).otherwise(chroma_format).cast("long")


def chroma_qp(qpi: Column, subsampled: Column | bool = True) -> Column:
    """Chroma QP of a luma-based index: the table in 4:2:0, else at most 51."""
    # The table for indexes 30 to 42.
    table = F.array(*map(F.lit, (29, 30, 31, 32, 33, 33, 34, 34, 35, 35, 36, 36, 37)))
    own = F.when(qpi < 30, qpi).when(qpi >= 43, qpi - 6).otherwise(F.get(table, (qpi - 30).cast("int")))
    return F.when(subsampled if isinstance(subsampled, Column) else F.lit(subsampled), own).otherwise(F.least(qpi, F.lit(51)))


def chroma_mode(luma: Column, code: Column) -> Column:
    """Chroma intra mode of the coded choice 0 to 4: planar, 26, 10, 1 or the luma mode; a choice that equals luma becomes 34."""
    own = F.get(F.array(*map(F.lit, (0, 26, 10, 1))), code.cast("int"))
    return F.when(code == 4, luma).when(own == luma, 34).otherwise(own)


def most_probable(left: Column, above: Column) -> Column:
    """array<int> of the three most probable luma modes."""
    angular = F.array(left, 2 + (left + 29) % 32, 2 + (left - 1) % 32)
    same = F.when(left < 2, F.array(F.lit(0), F.lit(1), F.lit(26))).otherwise(angular)
    third = F.when((left != 0) & (above != 0), 0).when((left != 1) & (above != 1), 1).otherwise(26)
    return F.when(left == above, same.cast("array<int>")).otherwise(F.array(left, above, third).cast("array<int>"))


def luma_mode(candidates: Column, index: Column, remainder: Column) -> Column:
    """The mode: a candidate by index, or the remainder-th mode that is none (index null)."""
    rest = F.aggregate(F.array_sort(candidates), remainder.cast("int"), lambda m, c: F.when(m >= c, m + 1).otherwise(m))
    return F.when(index.isNotNull(), F.get(candidates, index.cast("int"))).otherwise(rest)


def scan_order(log2_size: Column, mode: Column, component: Column, chroma_format: Column) -> Column:
    """`vertical` for modes 6 to 14, `horizontal` for 22 to 30, in small blocks only; else `diagonal`."""
    small = (log2_size == 2) | (log2_size == 3) & ((component == 0) | (chroma_format == 3))
    return F.when(small & mode.between(6, 14), "vertical").when(small & mode.between(22, 30), "horizontal").otherwise("diagonal")


def scan_positions(spark, size: int, order: str) -> DataFrame:
    """(pos, x, y) of a size x size scan: by rows, by columns, or up-right along the diagonals."""
    cells = spark.range(size * size).select((F.col("id") % size).cast("int").alias("x"), F.floor(F.col("id") / size).cast("int").alias("y"))
    from pyspark.sql import Window

    keys = {"horizontal": ["y", "x"], "vertical": ["x", "y"], "diagonal": [F.col("x") + F.col("y"), "x"]}[order]
    return cells.select((F.row_number().over(Window.orderBy(*keys)) - 1).alias("pos"), "x", "y")  # at most 1,024 rows


def context_state(init_value: Column, qp: Column) -> Column:
    """struct<state, mps> of a context's initial value at a slice's QP."""
    slope, offset = F.shiftright(init_value, 4) * 5 - 45, F.shiftleft(init_value.bitwiseAND(15), 3) - 16
    q = F.greatest(F.lit(0), F.least(F.lit(51), qp))
    pre = F.greatest(F.lit(1), F.least(F.lit(126), F.shiftright(slope * q, 4) + offset))
    return F.struct(F.when(pre <= 63, 63 - pre).otherwise(pre - 64).alias("state"), (pre > 63).cast("int").alias("mps"))


def luma_qp(left: Column, above: Column, delta: Column, offset: Column) -> Column:
    """QpY from the two predictors, the coded delta and the bit depth's QP offset, wrapped."""
    predicted = F.shiftright(left + above + 1, 1)
    return (predicted + delta + 52 + 2 * offset) % (52 + offset) - offset


def scaling_factor(size: Column, x: Column, y: Column, lists: Column, dc: Column) -> Column:
    """m[x][y]: a list of 16 or 64 in raster order, repeated for 16 and 32 wide blocks, whose first value is the dc."""
    k = F.greatest(F.floor(size / 8), F.lit(1)).cast("int")
    side = F.least(size, F.lit(8))
    own = F.get(lists, (F.floor(y / k) * side + F.floor(x / k)).cast("int"))
    return F.when((size > 8) & (x == 0) & (y == 0), dc).otherwise(own)


def golomb_rice(text: Column, rice: Column) -> Column:
    """A coefficient's remaining level from its bits (0s and 1s): up to three leading ones count whole steps, more of them widen the suffix; null beyond 32 of them."""
    ones = F.length(F.regexp_extract(text, "^1*", 0))
    wide = F.greatest(ones - 3, F.lit(0))
    n = wide + rice
    suffix = F.coalesce(F.conv(F.substr(text, ones + 2, n), 2, 10).cast("long"), F.lit(0).cast("long"))
    step = F.pow(F.lit(2), rice).cast("long")
    base = F.when(ones <= 3, ones * step).otherwise((F.pow(F.lit(2), wide).cast("long") + 2) * step)
    return F.when(ones <= 32, base + F.when(n > 0, suffix).otherwise(0))


def golomb_k(text: Column, k: Column) -> Column:
    """A k-th order Exp-Golomb value of bypass bins: leading ones add growing powers of two, then a zero and the suffix."""
    ones = F.length(F.regexp_extract(text, "^1*", 0))
    n = ones + k
    suffix = F.when(n > 0, F.conv(F.substr(text, ones + 2, n), 2, 10).cast("long")).otherwise(0)
    return (F.pow(F.lit(2), n) - F.pow(F.lit(2), k)).cast("long") + suffix


def last_position(prefix: Column, suffix: Column) -> Column:
    """The coordinate of the last significant coefficient from its prefix and suffix."""
    half = F.shiftright(prefix, 1) - 1
    return F.when(prefix < 4, prefix).otherwise(F.pow(F.lit(2), half).cast("long") * (2 + prefix % 2) + suffix)
