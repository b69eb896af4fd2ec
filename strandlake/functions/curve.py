"""The space-filling curve over (chromosome, position, scale, time), as Spark columns.

The index interleaves the bits of the coordinates: bit b of coordinate d (of four)
is bit 4 b + 3 - d of the index. It grows with every coordinate, so a box of
coordinates lies between the indexes of its corners, and a range predicate on a
column the files are sorted by prunes row groups before the exact predicate.
Coordinates are clamped to [0, 2^order - 1].
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMS = 4
HALF = 15  # bits of a coordinate that fit a bigint


def _clamped(c: Column, order: int) -> Column:
    return F.greatest(F.lit(0), F.least(c.cast("bigint"), F.lit((1 << order) - 1)))


def _interleave(coords: list[Column], first: int, bits: int) -> Column:
    """Bits first to first + bits - 1 of the coordinates, interleaved; spelled out so that it stays in generated code."""
    out = F.lit(0).cast("bigint")
    for d, c in enumerate(coords):
        for b in range(bits):
            bit = F.shiftright(c, first + b).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, DIMS * b + DIMS - 1 - d))
    return out


def encode(chromosome: Column, position: Column, scale: Column, time: Column | None = None, order: int = 20) -> Column:
    """The index as decimal(38,0); a bigint if order is at most 15."""
    coords = [_clamped(c, order) for c in (chromosome, position, scale, F.lit(0) if time is None else time)]
    low = _interleave(coords, 0, min(order, HALF))
    if order <= HALF:
        return low
    high = _interleave(coords, HALF, order - HALF)
    return high.cast("decimal(20,0)") * F.lit(1 << DIMS * HALF).cast("decimal(20,0)") + low.cast("decimal(20,0)")


def decode(index: Column, order: int = 20) -> Column:
    """struct(chromosome, position, scale, time) of an encode() index."""
    if order <= HALF:
        halves = [(index.cast("bigint"), 0, order)]
    else:
        size = F.lit(1 << DIMS * HALF).cast("decimal(38,0)")
        high = F.floor(index.cast("decimal(38,0)") / size).cast("bigint")
        low = F.pmod(index.cast("decimal(38,0)"), size).cast("bigint")
        halves = [(low, 0, HALF), (high, HALF, order - HALF)]
    out = []
    for d in range(DIMS):
        c = F.lit(0).cast("bigint")
        for half, first, bits in halves:
            for b in range(bits):
                c = c.bitwiseOR(F.shiftleft(F.shiftright(half, DIMS * b + DIMS - 1 - d).bitwiseAND(F.lit(1)), first + b))
        out.append(c)
    return F.struct(*(c.alias(n) for c, n in zip(out, ("chromosome", "position", "scale", "time"))))


def encode_number(chromosome: int, position: int, scale: int, time: int = 0, order: int = 20) -> int:
    """encode() of plain numbers, for the bounds of a range."""
    index = 0
    for d, c in enumerate((chromosome, position, scale, time)):
        c = max(0, min(int(c), (1 << order) - 1))
        for b in range(order):
            index |= (c >> b & 1) << DIMS * b + DIMS - 1 - d
    return index


def adaptive_scale(size: int, budget: int | None = None) -> int:
    """The scale level at which a region of this size is read; a small budget takes the next coarser one."""
    scale = next((s for s, limit in enumerate((1_000, 100_000, 10_000_000)) if size < limit), 3)
    return min(scale + 1, 3) if budget is not None and budget < 100 else scale
