"""Big-endian fields, bits and codes of binary columns, as SQL expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(b: Column, at: int | Column, n: int | Column) -> Column:
    """n bytes from byte `at` (0-based); null if they aren't all there."""
    at, n = (x if isinstance(x, Column) else F.lit(x) for x in (at, n))
    return F.when((at >= 0) & (n >= 0) & (at + n <= F.octet_length(b)), F.substring(b, at.cast("int") + 1, n.cast("int")))


def unsigned(b: Column, at: int | Column, width: int) -> Column:
    """The unsigned big-endian integer of 1, 2, 4 or 8 bytes: a long, or decimal(20,0) for 8 bytes; null if it isn't whole."""
    return F.conv(F.hex(part(b, at, width)), 16, 10).cast("decimal(20,0)" if width == 8 else "long")


def signed32(b: Column, at: int | Column) -> Column:
    v = unsigned(b, at, 4)
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)


def fourcc(b: Column, at: int | Column = 0) -> Column:
    """A four-byte code: text, or its lower-case hex digits if it isn't UTF-8."""
    code = part(b, at, 4)
    return F.when(F.is_valid_utf8(code.cast("string")), code.cast("string")).otherwise(F.lower(F.hex(code)))


def bits(value: Column, low: int, n: int) -> Column:
    """n bits of an integer from bit `low`, the least bit being 0."""
    return F.shiftright(value, low).bitwiseAND((1 << n) - 1)


def version(b: Column) -> Column:
    """A full box's version."""
    return unsigned(b, 0, 1)


def flags(b: Column) -> Column:
    """A full box's 24 flags."""
    return unsigned(b, 0, 4).bitwiseAND(0xFFFFFF)


def ue_bits(text: Column) -> Column:
    """The unsigned Exp-Golomb value at the start of a string of 0s and 1s; null if it isn't whole."""
    zeros = F.instr(text, "1") - 1
    return F.when((zeros >= 0) & (F.length(text) >= 2 * zeros + 1), F.conv(F.substr(text, zeros + 1, zeros + 1), 2, 10).cast("long") - 1)


def se_bits(text: Column) -> Column:
    """The signed Exp-Golomb value: odd codes positive."""
    k = ue_bits(text)
    return F.when(k % 2 == 1, F.floor((k + 1) / 2)).otherwise(-F.floor(k / 2)).cast("long")
