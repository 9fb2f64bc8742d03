"""Couplings of the ring Hamiltonian and spacings of parameter sweeps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Local easy axes by sublattice, times the square root of 3.
AXES = [(1, 1, 1), (1, -1, -1), (-1, 1, -1), (-1, -1, 1)]


def axis_fields(b) -> list:
    """sqrt(3) times the field along each axis; numbers or columns."""
    return [sum((x if s > 0 else -x) for s, x in zip(axis[1:], b[1:])) + (b[0] if axis[0] > 0 else -b[0]) for axis in AXES]


def ring_couplings(jpm, b) -> list:
    """g of each sublattice's rings to third order in (jpm, b); numbers or columns.

    With f the fields along the four axes (times sqrt 3): (54 j^3 - 15 j^2 f_k^2 - 35/2 j f0 f1 f2 f3 - 21/4 P_k^2) / 36,
    where P_k is the product of the other three fields.
    """
    f = axis_fields(b)
    quartic = f[0] * f[1] * f[2] * f[3]
    out = []
    for k in range(4):
        others = [f[i] for i in range(4) if i != k]
        product = others[0] * others[1] * others[2]
        out.append((-21 / 4 * (product * product) - 35 / 2 * quartic * jpm - 15 * (f[k] * f[k]) * (jpm * jpm) + 54 * (jpm * jpm * jpm)) / 36)
    return out


def spacing(kind: str, low: float, high: float, step: float) -> list[float]:
    """Sweep points: `linear` by step, `log` as powers of ten, `tanh` even in the arc tangent."""
    n = math.ceil((high - low) / step)
    if kind == "linear":
        return [low + i * step for i in range(n)]
    even = lambda a, z: [a + (z - a) * i / (n - 1) if n > 1 else a for i in range(n)]
    if kind == "log":
        return [10**x for x in even(low, high)]
    if kind == "tanh":
        return [math.tan(x) for x in even(math.atan(low), math.atan(high))]
    raise ValueError(f"no spacing {kind!r}")


def pattern(x: Column, direction: str, rotation: str) -> Column:
    """Four couplings in which one (direction 111) or two (110) sublattices have x and the others 1."""
    # Sublattices that have x.
    which = {"111": {"I": [0], "X": [1], "Y": [2], "Z": [3]}, "110": {"I": [0, 1], "X": [0, 1], "Y": [2, 3], "Z": [2, 3]}}[direction][rotation]
    return F.array(*[x if k in which else F.lit(1.0) for k in range(4)])


def num_cells(vectors) -> int:
    """Cubic cells of 128 volume units spanned by three vectors."""
    a, b, c = vectors
    det = a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    return round(abs(det) / 128)
