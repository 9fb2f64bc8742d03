"""Expectation values and correlations of vectors (state, vec, x) as joins on the state and grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import OpSum, Term
from ..functions.bits import State, names
from .apply import apply, images


def applied(vectors: DataFrame, ops: list[OpSum], n_sites: int, basis: DataFrame | None = None) -> DataFrame:
    """op, vec, state, x: each operator on each vector. All terms go through one join, numbered by their operator."""
    cols = names(n_sites)
    numbered, owner = OpSum(), []
    spark = vectors.sparkSession
    terms = [(k, t, c) for k, o in enumerate(ops) for t, c in o.parts.items()]
    if len({t for _, t, _ in terms}) == len(terms):
        for k, t, c in terms:
            numbered.parts[t] = c
            owner.append(k)
        names_of = spark.createDataFrame(list(enumerate(owner)), "op int, op_sum int")
        made = images(vectors.select("vec", *cols, "x"), numbered, n_sites, off_diagonal_only=False)
        made = made.join(F.broadcast(names_of), "op").select(F.col("op_sum").alias("op"), "vec", *cols, (F.col("factor") * F.col("x")).alias("x"))
        out = made.groupBy("op", "vec", *cols).agg(F.sum("x").alias("x"))
        space = (basis if basis is not None else vectors).select(*cols).distinct()
        return out.join(space, cols, "left_semi").select("op", "vec", *cols, "x")
    out = None
    for k, o in enumerate(ops):
        one = apply(vectors, o, n_sites, basis=basis, by=["vec"]).select(F.lit(k).alias("op"), "vec", *cols, "x")
        out = one if out is None else out.unionByName(one)
    return out


def expectations(vectors: DataFrame, ops: list[OpSum], n_sites: int) -> DataFrame:
    """op, i, j, val = <j| op |i>; pairs that vanish everywhere have no row."""
    right = applied(vectors, ops, n_sites).withColumnRenamed("vec", "i")
    left = vectors.select(F.col("vec").alias("j"), *names(n_sites), F.col("x").alias("z"))
    return right.join(left, names(n_sites)).groupBy("op", "i", "j").agg(F.sum(F.col("x") * F.col("z")).alias("val"))


def cross_correlations(vectors: DataFrame, ops: list[OpSum], n_sites: int) -> DataFrame:
    """l, m, i, j, val = <op_l i | op_m j>, real and so symmetric: one of each two mirrored pairs is summed."""
    a = applied(vectors, ops, n_sites)
    left = a.select(F.col("op").alias("l"), F.col("vec").alias("i"), *names(n_sites), "x")
    right = a.select(F.col("op").alias("m"), F.col("vec").alias("j"), *names(n_sites), F.col("x").alias("z"))
    once = (F.col("l") < F.col("m")) | ((F.col("l") == F.col("m")) & (F.col("i") <= F.col("j")))
    half = left.join(right, names(n_sites)).where(once).groupBy("l", "m", "i", "j").agg(F.sum(F.col("x") * F.col("z")).alias("val"))
    own, other = F.struct("l", "m", "i", "j"), F.struct(F.col("m").alias("l"), F.col("l").alias("m"), F.col("j").alias("i"), F.col("i").alias("j"))
    same = (F.col("l") == F.col("m")) & (F.col("i") == F.col("j"))
    return half.select(F.explode(F.when(same, F.array(own)).otherwise(F.array(own, other))).alias("p"), "val").select("p.l", "p.m", "p.i", "p.j", "val")


def ring_observables(vectors: DataFrame, rings: list[Term], n_sites: int) -> DataFrame:
    """op, vec, ring = <O>, flippability = |O v|^2, first = <O_0 v | O v>."""
    cols = names(n_sites)
    a = applied(vectors, [OpSum.of((1.0, r)) for r in rings], n_sites)
    own = vectors.select("vec", *cols, F.col("x").alias("own"))
    zero = a.where("op = 0").select("vec", *cols, F.col("x").alias("zero"))
    met = a.join(own, ["vec", *cols], "left").join(zero, ["vec", *cols], "left")
    total = lambda c: F.sum(F.col("x") * F.coalesce(F.col(c), F.lit(0.0)))
    return met.groupBy("op", "vec").agg(total("own").alias("ring"), F.sum(F.col("x") * F.col("x")).alias("flippability"), total("zero").alias("first"))


def triple(vectors: DataFrame, a: Column, b: Column, c: Column) -> DataFrame:
    """Sum of a product of three columns."""
    return vectors.agg(F.sum(a * b * c).alias("val"))


def structure_factor(vectors: DataFrame, positions: list[tuple[float, float, float]], waves: DataFrame, n_sites: int, ground: int = 0) -> DataFrame:
    """k, n, re, im = sum over sites of e^(i k.r) <n| S^z |ground>. waves: k, kx, ky, kz, a parameter grid."""
    cols = names(n_sites)
    state = State.of(n_sites)
    first = vectors.where(F.col("vec") == ground).select(*cols, F.col("x").alias("x0"))
    other = vectors.select("vec", *cols, F.col("x").alias("xn"))
    met = other.join(first, cols)
    spins = met.groupBy("vec").agg(*[F.sum(F.col("xn") * F.col("x0") * (state.get(i) - 0.5)).alias(f"z{i}") for i in range(n_sites)])
    rows = spins.crossJoin(F.broadcast(waves))
    phase = [F.col("kx") * x + F.col("ky") * y + F.col("kz") * z for x, y, z in positions]
    re, im = (sum((f(p) * F.col(f"z{i}") for i, p in enumerate(phase)), F.lit(0.0)) for f in (F.cos, F.sin))
    return rows.select("k", F.col("vec").alias("n"), re.alias("re"), im.alias("im"))


def by_sublattice(values: DataFrame, sublattice: DataFrame) -> DataFrame:
    """Mean of val over the operators of a sublattice, with their count. sublattice: op, sl."""
    return values.join(F.broadcast(sublattice), "op").groupBy("sl").agg(F.avg("val").alias("mean"), F.count("*").alias("n"))
