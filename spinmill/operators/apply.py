"""Operator sums on vectors over states: the diagonal as a projection, the rest as a broadcast join and a grouped sum."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import OpSum, Term
from ..functions.bits import State, lit, names

#: Amplitudes and matrix elements up to these are nothing.
ZERO, ELEMENT = 1e-15, 1e-14


def _flag(words: list[Column], prefix: str) -> list[tuple[Column, Column]]:
    return [(w, F.col(f"o.{prefix}_{n}")) for w, n in zip(words, ("lo", "hi"))]


def survives(words: list[Column]) -> Column:
    """Join condition: a term of table o doesn't annihilate the state."""
    out = F.lit(True)
    for w, m in _flag(words, "down"):
        out = out & (w.bitwiseAND(m) == 0)
    for w, m in _flag(words, "up"):
        out = out & (w.bitwiseAND(m) == m)
    return out


def images(df: DataFrame, ops: OpSum, n_sites: int, *, off_diagonal_only: bool = True) -> DataFrame:
    """A row for each state of df and term that keeps it: df's other columns, from_lo (from_hi), the new state, op, factor.

    The term table is broadcast: it has a row for each term of the sum, which is a matter of the lattice and not of the
    states. No row is made for what annihilates.
    """
    cols = names(n_sites)
    others = [c for c in df.columns if c not in cols]
    table = ops.table(df.sparkSession, off_diagonal_only)
    joined = df.alias("s").join(F.broadcast(table.alias("o")), survives([F.col(f"s.{c}") for c in cols]))
    flips = [F.col(f"s.{c}").bitwiseXOR(F.col(f"o.flip_{c}")) for c in cols]
    odd = None
    for f, c in zip(flips, cols):
        n = F.bit_count(F.bitwise_not(f).bitwiseAND(F.col(f"o.parity_{c}")))
        odd = n if odd is None else odd + n
    factor = F.col("o.coeff") * (1 - 2 * (odd % 2))
    return joined.select(*[F.col(f"s.{c}") for c in others], *[F.col(f"s.{c}").alias(f"from_{c}") for c in cols], *[f.alias(c) for f, c in zip(flips, cols)], F.col("o.op").alias("op"), factor.alias("factor"))


def diagonal(ops: OpSum, n_sites: int) -> Column:
    """Sum of the diagonal terms on the state, as one expression."""
    state, total = State.of(n_sites), F.lit(0.0)
    for t, c in ops.diagonal:
        value = F.lit(float(c))
        if t.parity:
            value = value * (1 - 2 * ((~state).popcount(t.parity) % 2))
        ok = (state & t.down).equals(0) & (state & t.up).equals(t.up)
        total = total + (F.when(ok, value).otherwise(0.0) if t.down or t.up else value)
    return total


def apply(x: DataFrame, ops: OpSum, n_sites: int, *, basis: DataFrame | None = None, value: str = "x", by: list[str] | None = None) -> DataFrame:
    """y = A x over the states (and columns `by`, such as a vector's number). x: state, value.

    Images outside the basis are dropped: basis is x's own states unless given. The sum is partial before the exchange,
    so what is shuffled is at most a row for each image state and task.
    """
    cols, by = names(n_sites), by or []
    live = x.where(F.abs(value) > ZERO)
    parts = [x.select(*by, *cols, (diagonal(ops, n_sites) * F.col(value)).alias("y"))] if ops.diagonal else []
    if ops.off_diagonal:
        made = images(live.select(*by, *cols, value), ops, n_sites)
        made = made.select(*by, *cols, (F.col("factor") * F.col(value)).alias("y"))
        summed = made.groupBy(*by, *cols).agg(F.sum("y").alias("y"))
        space = (basis if basis is not None else x).select(*cols).distinct() if basis is None else basis.select(*cols)
        parts.append(summed.join(space, cols, "left_semi"))
    if not parts:
        return x.select(*by, *cols, F.lit(0.0).alias(value)).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*by, *cols).agg(F.sum("y").alias(value)) if len(parts) > 1 else out.withColumnRenamed("y", value)


def not_annihilated(states: DataFrame, ops: OpSum, n_sites: int) -> DataFrame:
    """States that some term, diagonal or not, keeps."""
    table = ops.table(states.sparkSession)
    cols = names(n_sites)
    return states.alias("s").join(F.broadcast(table.alias("o")), survives([F.col(f"s.{c}") for c in cols]), "left_semi")


def triplets(basis: DataFrame, ops: OpSum, n_sites: int) -> DataFrame:
    """row and col states with the matrix element, duplicates summed; every diagonal element, others above ELEMENT."""
    cols = names(n_sites)
    made = images(basis.select(*cols), ops, n_sites)
    pairs = [f"from_{c}" for c in cols]
    off = made.groupBy(*cols, *pairs).agg(F.sum("factor").alias("val")).where(F.abs("val") > ELEMENT)
    off = off.join(basis.select(*cols), cols, "left_semi")
    own = basis.select(*cols, *[F.col(c).alias(f"from_{c}") for c in cols], diagonal(ops, n_sites).alias("val"))
    return off.unionByName(own) if ops.diagonal else off


class Local:
    """The same sum over a basis that fits on the driver: sorted states and index arrays by term."""

    def __init__(self, states: np.ndarray, ops: OpSum):
        self.states = np.sort(states.astype(np.uint64))
        self.diag = np.zeros(len(self.states))
        self.moves = []
        for t, c in ops.parts.items():
            ok, target, factor = self._term(t)
            if t.diagonal:
                self.diag[ok] += c * factor
            else:
                self.moves.append((ok, target, c * factor))

    def _term(self, t: Term):
        s = self.states
        ok = np.flatnonzero((s & np.uint64(t.down) == 0) & (s & np.uint64(t.up) == np.uint64(t.up)))
        out = s[ok] ^ np.uint64(t.flip)
        at = np.searchsorted(s, out)
        found = at < len(s)
        found[found] = s[at[found]] == out[found]
        ok, at, out = ok[found], at[found], out[found]
        return ok, at, 1.0 - 2.0 * (np.bitwise_count(~out & np.uint64(t.parity)) % 2)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        y = (self.diag * x.T).T.astype(x.dtype)
        for source, target, factor in self.moves:
            # A term's images are distinct, so that no two of its rows meet.
            y[target] += (factor * x[source].T).T
        return y

    def dense(self) -> np.ndarray:
        return self @ np.eye(len(self.states))


def local_states(basis: DataFrame, n_sites: int, most: int) -> np.ndarray | None:
    """The basis as an array, or None if it has more than `most` states or needs two words."""
    if n_sites > 63:
        return None
    rows = basis.select("lo").limit(most + 1).toPandas()["lo"].to_numpy()
    return None if len(rows) > most else np.sort(rows.astype(np.uint64))


def matches(mask: int) -> Column:
    return F.col("lo").bitwiseAND(lit(mask)) == lit(mask)
