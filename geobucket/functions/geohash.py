"""Geohash and its number as native expressions.

A geohash of 6 characters is the base-32 form of the 30-bit Morton code of the
cell, longitude first, so the number is computed from the coordinates directly
and the text only where it is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the geohash alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
CHARS = 6


def cell(value: Column, least: float, width: float, bits: int) -> Column:
    """The number of the cell of a coordinate; the upper end belongs to the last cell."""
    return F.least(F.floor((value - least) / F.lit(width) * F.lit(float(1 << bits))), F.lit((1 << bits) - 1)).cast("long")


def geohash_numeric(lon: Column, lat: Column, chars: int = CHARS, bind: bool = False) -> Column:
    """Morton code of a point; null for null or out-of-range coordinates.

    Generated code computes each cell once, as it stands outside any branch:
    only the zero that nulls out-of-range codes is in one. Inside a
    higher-order function, which is interpreted, bind does the same.
    """
    x_bits, y_bits = (5 * chars + 1) // 2, 5 * chars // 2
    x, y = cell(lon, -180.0, 360.0, x_bits), cell(lat, -90.0, 180.0, y_bits)
    if bind:
        code = F.get(F.transform(F.array(F.struct(x.alias("x"), y.alias("y"))), lambda c: _interleaved(c["x"], c["y"], 5 * chars)), F.lit(0))
    else:
        code = _interleaved(x, y, 5 * chars)
    return code.bitwiseOR(F.when(lon.between(-180, 180) & lat.between(-90, 90), F.lit(0).cast("long")))


def _spread(v: Column, bits: int) -> Column:
    """The bits of v, each followed by a zero bit above it."""
    for shift in (16, 8, 4, 2, 1):
        if shift < bits:
            mask = sum(((1 << shift) - 1) << at for at in range(0, 63, 2 * shift))
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask & (1 << 63) - 1))
    return v


def _interleaved(x: Column, y: Column, bits: int) -> Column:
    """Bits of x and y in turn, from the top, which is one of x."""
    x, y = _spread(x, (bits + 1) // 2), _spread(y, bits // 2)
    return x.bitwiseOR(F.shiftleft(y, 1)) if bits % 2 else F.shiftleft(x, 1).bitwiseOR(y)


def geohash_text(code: Column, chars: int = CHARS) -> Column:
    """The geohash of a Morton code."""
    digit = lambda k: F.substring(F.lit(ALPHABET), (F.shiftright(code, 5 * (chars - 1 - k)).bitwiseAND(31) + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(k) for k in range(chars)])


def geohash_to_long(text: Column) -> Column:
    """The number of a geohash of any length; null for null and empty, an error for a character that is not in the alphabet."""
    value = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    step = lambda a, c: F.when(value(c) < 0, F.raise_error(F.concat(F.lit("not a geohash character: "), c)).cast("long")).otherwise(a * 32 + value(c))
    return F.when(text.isNotNull() & (text != ""), F.aggregate(F.split(text, ""), F.lit(0).cast("long"), step))


def geohash_center(code: Column, chars: int = CHARS) -> tuple[Column, Column]:
    """Longitude and latitude of the middle of a cell."""
    bits = 5 * chars
    x_bits, y_bits = (bits + 1) // 2, bits // 2
    x = y = F.lit(0).cast("long")
    for k in range(bits):
        bit = F.shiftright(code, bits - 1 - k).bitwiseAND(1)
        if k % 2 == 0:
            x = x.bitwiseOR(F.shiftleft(bit, x_bits - 1 - k // 2))
        else:
            y = y.bitwiseOR(F.shiftleft(bit, y_bits - 1 - k // 2))
    return (x + 0.5) * (360.0 / (1 << x_bits)) - 180.0, (y + 0.5) * (180.0 / (1 << y_bits)) - 90.0
