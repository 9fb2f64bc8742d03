"""Strings of spin operators in normal form, and their sums.

A string maps a state to at most one state: it needs some bits up and some down, flips some, and has a sign by the
parity of others. Where the usual tables for this differ (projectors P and Q, the sign of a product), the definitions
P = S+S-, Q = S-S+ and sign(ab) = sign(a) sign(b) are used throughout.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .bits import signed


class BadOperator(ValueError):
    """A specification that names no operator."""


@dataclass(frozen=True)
class Term:
    """flip: bits changed; parity: bits whose downs give a sign, read after the flip; down, up: bits needed 0 and 1."""

    flip: int = 0
    parity: int = 0
    down: int = 0
    up: int = 0
    sign: int = 1

    @staticmethod
    def single(kind: str, site: int) -> Term:
        b = 1 << site
        made = {
            "X": Term(flip=b), "Z": Term(parity=b), "+": Term(flip=b, down=b), "-": Term(flip=b, up=b),
            "P": Term(up=b), "Q": Term(down=b),
        }.get(kind.upper())
        if made is None or site < 0:
            raise BadOperator(f"{site}{kind}")
        return made

    @staticmethod
    def parse(spec: str) -> Term:
        """Factors such as `0+ 1- 64Z`, the last acting first; a missing index is site 0."""
        out = Term()
        for factor in spec.split():
            m = re.fullmatch(r"(\d*)([xXzZ+\-pPqQ])", factor)
            if not m:
                raise BadOperator(factor)
            out = out * Term.single(m[2], int(m[1] or 0))
        return out

    @staticmethod
    def of(kinds: Iterable[str], sites: Iterable[int]) -> Term:
        kinds, sites = list(kinds), list(sites)
        if len(kinds) != len(sites):
            raise BadOperator(f"{len(kinds)} kinds, {len(sites)} sites")
        out = Term()
        for k, s in zip(kinds, sites):
            out = out * Term.single(k, s)
        return out

    def __mul__(self, first: Term) -> Term:
        """self after first. What self needs of flipped bits is needed inverted before."""
        if not self.sign or not first.sign:
            return Term(sign=0)
        down = first.down | (self.down & ~first.flip) | (self.up & first.flip)
        up = first.up | (self.up & ~first.flip) | (self.down & first.flip)
        if down & up:
            return Term(sign=0)
        # first's parity is read before self's flips; bits that self flips count the other way round.
        turned = (first.parity & self.flip).bit_count()
        parity = self.parity ^ first.parity
        return Term(self.flip ^ first.flip, parity, down, up, self.sign * first.sign * (-1) ** turned)._settled()

    def __rmul__(self, k: int) -> Term:
        return Term(self.flip, self.parity, self.down, self.up, self.sign * k)

    def _settled(self) -> Term:
        """Signs of bits that are known become the term's own."""
        after_down = (self.down & ~self.flip) | (self.up & self.flip)
        known = self.parity & (self.down | self.up)
        sign = self.sign * (-1) ** (known & after_down).bit_count()
        return Term(self.flip, self.parity & ~known, self.down, self.up, sign)

    @property
    def dagger(self) -> Term:
        down, up = (self.down & ~self.flip) | (self.up & self.flip), (self.up & ~self.flip) | (self.down & self.flip)
        return Term(self.flip, self.parity, down, up, self.sign * (-1) ** (self.parity & self.flip).bit_count())

    @property
    def diagonal(self) -> bool:
        return not self.flip

    @property
    def highest(self) -> int:
        return (self.flip | self.parity | self.down | self.up).bit_length() - 1

    def apply(self, state: int) -> tuple[int, int]:
        """(state, sign); sign 0 leaves the state as it is."""
        if not self.sign or state & self.down or state & self.up != self.up:
            return state, 0
        out = state ^ self.flip
        return out, self.sign * (-1) ** (~out & self.parity).bit_count()


@dataclass
class OpSum:
    """A sum of coefficients times terms; terms alike are one."""

    parts: dict[Term, float] = field(default_factory=dict)

    @staticmethod
    def of(*terms: tuple[float, Term | str]) -> OpSum:
        out = OpSum()
        for c, t in terms:
            out.add(c, Term.parse(t) if isinstance(t, str) else t)
        return out

    def add(self, c: float, t: Term) -> None:
        if t.sign:
            key = Term(t.flip, t.parity, t.down, t.up)
            self.parts[key] = self.parts.get(key, 0.0) + c * t.sign

    def __add__(self, other: OpSum) -> OpSum:
        out = OpSum(dict(self.parts))
        for t, c in other.parts.items():
            out.add(c, t)
        return out

    def __mul__(self, other: OpSum) -> OpSum:
        out = OpSum()
        for a, x in self.parts.items():
            for b, y in other.parts.items():
                out.add(x * y, a * b)
        return out

    def __rmul__(self, c: float) -> OpSum:
        return OpSum({t: c * x for t, x in self.parts.items()})

    @property
    def dagger(self) -> OpSum:
        out = OpSum()
        for t, c in self.parts.items():
            out.add(c, t.dagger)
        return out

    @property
    def diagonal(self) -> list[tuple[Term, float]]:
        return [(t, c) for t, c in self.parts.items() if t.diagonal]

    @property
    def off_diagonal(self) -> list[tuple[Term, float]]:
        return [(t, c) for t, c in self.parts.items() if not t.diagonal]

    def table(self, spark: SparkSession, off_diagonal_only: bool = False) -> DataFrame:
        """coeff and the masks by word: as many rows as terms, however many states."""
        rows = []
        for k, (t, c) in enumerate(self.off_diagonal if off_diagonal_only else self.parts.items()):
            masks = [signed(m >> s) for m in (t.flip, t.parity, t.down, t.up) for s in (0, 64)]
            rows.append((k, float(c), *masks))
        cols = ", ".join(f"{m}_{w} bigint" for m in ("flip", "parity", "down", "up") for w in ("lo", "hi"))
        return spark.createDataFrame(rows, f"op int, coeff double, {cols}")
