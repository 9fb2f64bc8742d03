"""Column functions on packed states: bit i is site i. Up to 63 sites are one bigint `lo`; up to 128 also have `hi`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_SITES = 128
MASK64 = (1 << 64) - 1


def signed(x: int) -> int:
    """The bigint with the low 64 bits of x."""
    x &= MASK64
    return x - (1 << 64) if x >> 63 else x


def lit(x: int) -> Column:
    return F.lit(signed(x)).cast("bigint")


class State:
    """A state's words as columns, low word first, and what can be done to them without leaving the JVM."""

    def __init__(self, lo: Column | str, hi: Column | str | None = None):
        self.lo = F.col(lo) if isinstance(lo, str) else lo
        self.hi = F.col(hi) if isinstance(hi, str) else hi

    @staticmethod
    def of(n_sites: int, lo: str = "lo", hi: str = "hi") -> State:
        if n_sites > MOST_SITES:
            raise ValueError(f"{n_sites} sites; {MOST_SITES} at most")
        return State(lo, hi if n_sites > 63 else None)

    @property
    def words(self) -> list[Column]:
        return [self.lo] if self.hi is None else [self.lo, self.hi]

    def _each(self, f, *others) -> State:
        made = [f(w, *(o[k] for o in others)) for k, w in enumerate(self.words)]
        return State(*made)

    def _split(self, mask: int) -> list[Column]:
        if self.hi is None and mask >> 64:
            raise ValueError("mask is wider than the state")
        return [lit(mask), lit(mask >> 64)]

    def __and__(self, mask: int) -> State:
        return self._each(lambda w, m: w.bitwiseAND(m), self._split(mask))

    def __or__(self, mask: int) -> State:
        return self._each(lambda w, m: w.bitwiseOR(m), self._split(mask))

    def __xor__(self, mask: int) -> State:
        return self._each(lambda w, m: w.bitwiseXOR(m), self._split(mask))

    def xor(self, words: Sequence[Column]) -> State:
        return self._each(lambda w, m: w.bitwiseXOR(m), words)

    def __invert__(self) -> State:
        return self._each(lambda w: F.bitwise_not(w))

    def __lshift__(self, n: int) -> State:
        if self.hi is None:
            return State(F.shiftleft(self.lo, n) if n < 64 else lit(0))
        if n >= 128:
            return State(lit(0), lit(0))
        if n >= 64:
            return State(lit(0), F.shiftleft(self.lo, n - 64))
        if n == 0:
            return self
        return State(F.shiftleft(self.lo, n), F.shiftleft(self.hi, n).bitwiseOR(F.shiftrightunsigned(self.lo, 64 - n)))

    def __rshift__(self, n: int) -> State:
        if self.hi is None:
            return State(F.shiftrightunsigned(self.lo, n) if n < 64 else lit(0))
        if n >= 128:
            return State(lit(0), lit(0))
        if n >= 64:
            return State(F.shiftrightunsigned(self.hi, n - 64), lit(0))
        if n == 0:
            return self
        return State(F.shiftrightunsigned(self.lo, n).bitwiseOR(F.shiftleft(self.hi, 64 - n)), F.shiftrightunsigned(self.hi, n))

    def popcount(self, mask: int | None = None) -> Column:
        s = self if mask is None else self & mask
        total = F.bit_count(s.words[0]).cast("int")
        for w in s.words[1:]:
            total = total + F.bit_count(w).cast("int")
        return total

    def get(self, i: int) -> Column:
        return F.getbit(self.words[i // 64], F.lit(i % 64)).cast("int")

    def set(self, i: int) -> State:
        return self | (1 << i)

    def flip(self, i: int) -> State:
        return self ^ (1 << i)

    def equals(self, mask: int) -> Column:
        out = F.lit(True)
        for w, m in zip(self.words, self._split(mask)):
            out = out & (w == m)
        return out

    def highest(self) -> Column:
        """Index of the highest set bit, -1 for 0."""
        def top(w):
            return F.when(w == 0, -1).otherwise(F.length(F.bin(w)) - 1)

        return top(self.lo) if self.hi is None else F.when(self.hi == 0, top(self.lo)).otherwise(64 + top(self.hi))

    def permuted(self, to: Sequence[int]) -> State:
        """Bit n moves to bit to[n]. One shift for each distance, not for each bit."""
        out: list[Column] | None = None
        by_shift: dict[int, int] = {}
        for n, m in enumerate(to):
            by_shift[m - n] = by_shift.get(m - n, 0) | 1 << n
        for shift, mask in sorted(by_shift.items()):
            part = self & mask
            part = part << shift if shift >= 0 else part >> -shift
            out = part.words if out is None else [a.bitwiseOR(b) for a, b in zip(out, part.words)]
        return State(*(out or [lit(0)] * len(self.words)))

    def hash(self) -> Column:
        return F.xxhash64(*self.words)

    def order(self) -> list[Column]:
        """Sort keys of the unsigned order, the highest word first."""
        return [w.bitwiseXOR(lit(1 << 63)) for w in self.words[::-1]]

    def below(self, other: State) -> Column:
        a, b = self.order(), other.order()
        out = F.lit(False)
        for x, y in list(zip(a, b))[::-1]:
            out = (x < y) | ((x == y) & out)
        return out

    def to_hex(self) -> Column:
        """0x and 32 digits."""
        hi = lit(0) if self.hi is None else self.hi
        return F.concat(F.lit("0x"), *(F.lower(F.lpad(F.hex(w), 16, "0")) for w in (hi, self.lo)))

    @staticmethod
    def from_hex(text: Column, n_sites: int) -> State:
        digits = F.lpad(F.regexp_replace(F.lower(F.trim(text)), "^0x", ""), 32, "0")
        word = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("bigint")
        join = lambda at: F.shiftleft(word(at), 32).bitwiseOR(word(at + 8))
        return State(join(17), join(1) if n_sites > 63 else None)

    def named(self, prefix: str = "") -> list[Column]:
        return [w.alias(prefix + n) for w, n in zip(self.words, ("lo", "hi"))]


def names(n_sites: int) -> list[str]:
    return ["lo"] if n_sites <= 63 else ["lo", "hi"]


def low_mask(n: int) -> int:
    return (1 << n) - 1


def permute_int(x: int, to: Sequence[int]) -> int:
    return sum(1 << m for n, m in enumerate(to) if x >> n & 1)


def inverse(to: Sequence[int]) -> list[int]:
    out = [0] * len(to)
    for n, m in enumerate(to):
        out[m] = n
    return out
