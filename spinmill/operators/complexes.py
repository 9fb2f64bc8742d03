"""Sums with complex coefficients, Y factors among them, on vectors of rows (state, re, im)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import OpSum, Term
from ..functions.bits import names
from .apply import apply


def parse(spec: str) -> tuple[complex, Term]:
    """A factor and a real term: like Term.parse with Y allowed, each of them i X Z."""
    factor, out = 1 + 0j, Term()
    for part in spec.split():
        if part[-1:] in "yY":
            factor *= 1j
            out = out * Term.parse(f"{part[:-1]}X") * Term.parse(f"{part[:-1]}Z")
        else:
            out = out * Term.parse(part)
    return factor, out


@dataclass
class ComplexSum:
    """real + i imag, both real sums."""

    real: OpSum = field(default_factory=OpSum)
    imag: OpSum = field(default_factory=OpSum)

    @staticmethod
    def of(*terms: tuple[complex, str]) -> ComplexSum:
        out = ComplexSum()
        for c, spec in terms:
            factor, t = parse(spec)
            z = complex(c) * factor
            for part, x in ((out.real, z.real), (out.imag, z.imag)):
                if x:
                    part.add(x, t)
        return out

    def __add__(self, other: ComplexSum) -> ComplexSum:
        return ComplexSum(self.real + other.real, self.imag + other.imag)

    def __mul__(self, other: ComplexSum) -> ComplexSum:
        real = self.real * other.real + -1.0 * (self.imag * other.imag)
        return ComplexSum(real, self.real * other.imag + self.imag * other.real)

    @property
    def dagger(self) -> ComplexSum:
        return ComplexSum(self.real.dagger, -1.0 * self.imag.dagger)


def apply_complex(v: DataFrame, ops: ComplexSum, n_sites: int, *, basis: DataFrame | None = None) -> DataFrame:
    """y = A v. Both parts of v go through one application of each real sum and meet in one grouped sum."""
    cols = names(n_sites)
    parts = v.select(*cols, F.posexplode(F.array("re", "im")).alias("part", "x"))
    space = basis if basis is not None else v
    real = apply(parts, ops.real, n_sites, basis=space, by=["part"]).select(*cols, "part", "x")
    # i times the imaginary sum turns re into im, and im into re with the sign changed.
    turned = apply(parts, ops.imag, n_sites, basis=space, by=["part"]).select(*cols, (1 - F.col("part")).alias("part"), F.when(F.col("part") == 1, -F.col("x")).otherwise(F.col("x")).alias("x"))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("part") == k, F.col("x"))), F.lit(0.0))
    return real.unionByName(turned).groupBy(*cols).agg(of(0).alias("re"), of(1).alias("im"))


def inner(a: DataFrame, b: DataFrame, n_sites: int) -> DataFrame:
    """One row: <a|b> as value, a struct of re and im. States that one of them lacks count as zero."""
    b = b.withColumnsRenamed({"re": "zr", "im": "zi"})
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    re, im, zr, zi = (F.col(c) for c in ("re", "im", "zr", "zi"))
    return a.join(b, names(n_sites)).agg(F.struct(total(re * zr + im * zi).alias("re"), total(re * zi - im * zr).alias("im")).alias("value"))


def expectation(v: DataFrame, ops: ComplexSum, n_sites: int) -> DataFrame:
    """One row: <v| A |v> as value, a struct of re and im."""
    return inner(v, apply_complex(v, ops, n_sites), n_sites)
