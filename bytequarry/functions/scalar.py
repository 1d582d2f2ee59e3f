"""Scalar expressions over columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def printable(v: Column) -> Column:
    return v.between(32, 126) | v.isin(9, 10, 13)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def signed_residual(r: Column) -> Column:
    return F.when(r < 128, r).otherwise(r - 256)


def zigzag(d: Column) -> Column:
    """0, -1, 1, -2, 2, ... as 0, 1, 2, 3, 4, ..."""
    return F.abs(d) * 2 - (d < 0).cast("int")


def unzigzag(z: Column) -> Column:
    return F.when(z % 2 == 0, (z / 2).cast("long")).otherwise(-((z + 1) / 2).cast("long"))


def distance_bytes(x: Column) -> Column:
    """Bytes that a distance takes."""
    return F.when(x < 256, 1).when(x < 65536, 2).otherwise(3)


def length_class(n: Column) -> Column:
    return F.when(n <= 7, 0).when(n <= 31, 1).when(n <= 255, 2).otherwise(3)


def distance_class(x: Column, in_cache: Column) -> Column:
    return F.when(in_cache, 0).otherwise(distance_bytes(x))


def clamped_log2(x: Column, most: int = 65536) -> Column:
    return F.when(x <= 0, 0.0).otherwise(F.log2(F.least(x, F.lit(most)).cast("double")))


def match_cost(length: Column, distance: Column, match: float, penalty: Column | float) -> Column:
    """Estimated bits of a match."""
    penalty = penalty if isinstance(penalty, Column) else F.lit(penalty)
    return match + F.when(length <= 7, 1.0).otherwise(F.log2(length + 1.0)) + penalty * F.log2(distance + 1.0)


FACTOR = 2654435761


def low_bits_hash(h: Column, bits: int = 20) -> Column:
    """The low bits of h times FACTOR, without a product past 64 bits."""
    mask = (1 << bits) - 1
    return (h.bitwiseAND(F.lit(mask)) * F.lit(FACTOR & mask)).bitwiseAND(F.lit(mask))


def top_bits_hash(v: Column, bits: int = 12) -> Column:
    """The top bits of the 32-bit product of v and FACTOR."""
    low = v.bitwiseAND(F.lit(65535)) * F.lit(FACTOR)
    high = F.shiftleft((F.shiftright(v, 16) * F.lit(FACTOR)).bitwiseAND(F.lit(65535)), 16)
    return F.shiftright((low + high).bitwiseAND(F.lit(4294967295)), 32 - bits)


def raw_escape(literals: Column, size: Column) -> Column:
    """So many literals that a chunk is better stored as it is."""
    return literals > F.floor(size * 9 / 10)


def grouped(x: Column, decimals: int = 0) -> Column:
    return F.format_number(x, decimals)


def fixed(x: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", x.cast("double"))


def safe_name(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("/"), F.lit("_")), F.lit(" "), F.lit("_"))


#: What a distance saves by lattice mode: (15..17, 255..257, multiple of 256, multiple of 16).
LATTICE = {
    2: (0.40, 0.70, 0.46, 0.22), 3: (0.0, 0.42, 0.28, 0.12), 4: (0.28, 0.52, 0.32, 0.14), 5: (0.52, 0.90, 0.60, 0.30),
    6: (0.18, 0.92, 0.56, 0.10), 7: (0.65, 1.10, 0.75, 0.38), 8: (0.80, 1.30, 0.90, 0.45), 9: (0.40, 1.20, 0.80, 0.20),
}


#: Modes that also look at the distances before.
RECENT_MODES = (1, 3)


class _Columns:
    """What lattice rules need of columns."""

    choose = staticmethod(lambda rule, yes, no: F.when(rule, F.lit(yes) if isinstance(yes, float) else yes).otherwise(F.lit(no) if isinstance(no, float) else no))
    apart, larger, shift = staticmethod(F.abs), staticmethod(lambda low, x: F.greatest(F.lit(low), x)), staticmethod(F.shiftright)


class _Arrays:
    """The same of NumPy arrays."""

    choose, apart, larger = staticmethod(np.where), staticmethod(np.abs), staticmethod(np.maximum)
    shift = staticmethod(np.right_shift)


def _lattice(on, mode: int, dist, last, older):
    around = lambda x: (dist == x - 1) | (dist == x) | (dist == x + 1)
    bonus = on.choose(dist == 0, 0.0, 0.0)
    if mode in LATTICE:
        line, plane, planes, lines = LATTICE[mode]
        far = on.choose(around(256), plane, on.choose(dist % 256 == 0, planes, on.choose(dist % 16 == 0, lines, 0.0)))
        bonus = on.choose(around(16), line, 0.0) + far
    if mode in RECENT_MODES:
        slack = on.larger(2, on.shift(last, 5 if mode == 1 else 6))
        near = on.apart(dist - last) <= slack
        if mode == 1:
            harmonic = (on.apart(dist - last * 2) <= slack * 2) | (on.apart(dist * 2 - last) <= slack * 2)
            again = on.choose(dist == last, 1.05, on.choose(near, 0.38, 0.0) + on.choose(harmonic, 0.20, 0.0))
        else:
            again = on.choose(dist == last, 0.70, on.choose(near, 0.24, 0.0))
            bonus = bonus + on.choose((older > 0) & (dist == older), 0.18, 0.0)
        bonus = bonus + on.choose(last > 0, again, 0.0)
    return bonus


def lattice_bonus(mode: int, dist: Column, last: Column | None = None, before_last: Column | None = None) -> Column:
    """Bits that a distance saves. Modes 1 and 3 also look at the distances before it (0 or null: none)."""
    known = lambda x: F.coalesce(x if x is not None else F.lit(0), F.lit(0))
    return _lattice(_Columns, mode, dist, known(last), known(before_last))


def lattice_bits(mode: int, dist: np.ndarray, last=0, before_last=0) -> np.ndarray:
    """lattice_bonus of arrays."""
    return _lattice(_Arrays, mode, dist, np.asarray(last), np.asarray(before_last))


def lattice_code(mode: int, x: Column) -> tuple[Column, Column]:
    """(class, quotient) of a distance: anchors (mode 1), quotients (2) or both (3)."""
    anchors = F.lit(None).cast("int")
    for i, at in enumerate((15, 16, 17, 255, 256, 257)):
        anchors = F.when(x == at, i + 1).otherwise(anchors)
    by_plane, by_line = (x % 256 == 0) & (x / 256 <= 255), (x % 16 == 0) & (x / 16 <= 65535)
    first = 1 if mode == 2 else 7
    divided = F.when(by_plane, first).when(by_line, first + 1)
    chosen = {1: anchors, 2: divided, 3: F.coalesce(anchors, divided)}[mode]
    code = F.coalesce(chosen, F.lit(0))
    quotient = F.when(code == first, F.floor(x / 256)).when(code == first + 1, F.floor(x / 16)) if mode > 1 else F.lit(None).cast("long")
    return code, F.coalesce(quotient, F.lit(0).cast("long"))
