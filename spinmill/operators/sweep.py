"""Results of parameter sweeps: lookups within a tolerance, near-duplicates, best sectors, interpolation, completeness."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.couplings import ring_couplings


def near(a: Column, b: Column, tol: float) -> Column:
    return F.abs(a - b) <= tol


def banded(df: DataFrame, x: str, tol: float, name: str = "band") -> DataFrame:
    """df with the bucket of x, three rows each: values within tol share the bucket of one of them."""
    own = F.floor(F.col(x) / F.lit(tol)).cast("bigint")
    return df.withColumn(name, F.explode(F.array(own - 1, own, own + 1)))


def band_join(left: DataFrame, right: DataFrame, x: str, y: str, tol: float, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows of left and right with equal keys and |x - y| <= tol, as an equi-join on buckets of width tol.

    y and the keys of right are kept under their names with the prefix r_.
    """
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    r = r.withColumn("r_band", F.floor(F.col(f"r_{y}") / F.lit(tol)).cast("bigint"))
    if how in ("left_semi", "left_anti"):
        # The replicated side is the right one, so that a left row is judged once.
        own = left.withColumn("band", F.floor(F.col(x) / F.lit(tol)).cast("bigint"))
        r = r.drop("r_band")
        r = banded(r, f"r_{y}", tol, "r_band")
        cond = (F.col("band") == F.col("r_band")) & (F.abs(F.col(x) - F.col(f"r_{y}")) <= tol)
        for k in keys:
            cond = cond & (F.col(k) == F.col(f"r_{k}"))
        return own.join(r, cond, how).drop("band")
    own = banded(left, x, tol)
    cond = (F.col("band") == F.col("r_band")) & (F.abs(F.col(x) - F.col(f"r_{y}")) <= tol)
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"r_{k}"))
    return own.join(r, cond, how).drop("band", "r_band")


def lookup(results: DataFrame, x: str, value: float, tol: float, **equal) -> DataFrame:
    """Results with x within tol of a value and columns equal to others."""
    out = results.where(F.col(x).between(value - tol, value + tol))
    for c, v in equal.items():
        out = out.where(F.col(c) == v)
    return out


def insert_absent(results: DataFrame, new: DataFrame, x: str, tol: float, keys: list[str]) -> DataFrame:
    """results and those of new that none of them is near to."""
    return results.unionByName(band_join(new, results, x, x, tol, keys, "left_anti").select(results.columns))


def drop_near_duplicates(results: DataFrame, x: str, tol: float, keys: list[str], rank: str) -> DataFrame:
    """Rows without another of lower rank near in x with the same keys. Sectors belong among the keys."""
    mine = banded(results.select(x, rank, *keys), x, tol)
    other = results.select(F.col(x).alias("r_x"), F.col(rank).alias("r_rank"), *[F.col(k).alias(f"r_{k}") for k in keys])
    other = other.withColumn("r_band", F.floor(F.col("r_x") / F.lit(tol)).cast("bigint"))
    cond = (F.col("band") == F.col("r_band")) & near(F.col(x), F.col("r_x"), tol) & (F.col("r_rank") < F.col(rank))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"r_{k}"))
    later = mine.join(other, cond, "left_semi").select(rank, x, *keys).distinct()
    same = F.lit(True)
    for c in (rank, x, *keys):
        same = same & results[c].eqNullSafe(later[c])
    return results.join(later, same, "left_anti")


def drop_adjacent(results: DataFrame, x: str, gap: float = 1e-10, keys: list[str] | None = None) -> DataFrame:
    """The last of each run of values nearer than gap."""
    w = Window.partitionBy(*(keys or [])).orderBy(x)
    return results.withColumn("__next", F.lead(x).over(w)).where(F.col("__next").isNull() | (F.col("__next") - F.col(x) > gap)).drop("__next")


def merged(*results: DataFrame, key: list[str] | None = None) -> DataFrame:
    """All rows; of those with one key, one."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.dropDuplicates(key) if key else out


def lowest(results: DataFrame, e: str, n: int, ties: list[str]) -> DataFrame:
    return results.orderBy(e, *ties).limit(n)


def lowest_by_sector(results: DataFrame, e: str, n: int, ties: list[str], sector: str = "sector") -> DataFrame:
    """How many of the n lowest rows each sector has, and its lowest."""
    return lowest(results, e, n, ties).groupBy(sector).agg(F.count("*").alias("n"), F.min(e).alias("lowest"))


def best_sectors(results: DataFrame, x: str, e: str, n: int, ties: list[str]) -> DataFrame:
    """The n lowest rows of each x, with their place."""
    w = Window.partitionBy(x).orderBy(e, *ties)
    return results.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def ground_states(results: DataFrame, x: str, e: str, tol: float = 1e-10) -> DataFrame:
    """Rows of each x at its lowest energy, degenerate ones included: a grouped minimum joined back."""
    low = results.groupBy(x).agg(F.min(e).alias("__low"))
    return results.join(low, x).where(F.col(e) - F.col("__low") < tol).drop("__low")


def completeness(results: DataFrame, x: str) -> DataFrame:
    """x, n, complete: whether it has as many rows as the fullest."""
    n = results.groupBy(x).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("most")))).select(x, "n", (F.col("n") == F.col("most")).alias("complete"))


def missing(plan: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    """Planned runs without a result."""
    return plan.join(results.select(*on).distinct(), on, "left_anti")


def grid(left: DataFrame, right: DataFrame) -> DataFrame:
    """All combinations of two lists of parameters; the second is broadcast, as a list of sweep points is short."""
    return left.crossJoin(F.broadcast(right))


def phase_diagram(curve: DataFrame, x: str, y: str, jpm: list[float], fields: list[float], direction: tuple[float, float, float]) -> DataFrame:
    """jpm, b, ratio and y over a grid of couplings: y by a spline through the curve at the ratio of the first ring
    coupling to the last, null outside it. The field points along the direction. The grid is a list of parameters."""
    size = sum(c * c for c in direction) ** 0.5
    points = []
    for j in jpm:
        for b in fields:
            g = ring_couplings(j, [b * c / size for c in direction])
            points.append((float(j), float(b), float(g[0] / g[3]) if g[3] else None))
    at = sorted({r for _, _, r in points if r is not None})
    one = interpolated(curve.select(F.lit(0).alias("key"), F.col(x).alias("ratio"), F.col(y).alias("value")), "key", "ratio", "value", at)
    plan = curve.sparkSession.createDataFrame(points, "jpm double, b double, ratio double")
    value = F.when(~F.isnan("value"), F.col("value")).alias(y)
    return plan.join(F.broadcast(one.select("ratio", "value")), "ratio", "left").select("jpm", "b", "ratio", value)


def split_by_size(plan: DataFrame, size: str, least: int = 100_000) -> DataFrame:
    """The plan with large: whether a run's basis has at least so many states."""
    return plan.withColumn("large", F.col(size) >= least)


def supercell_plan(lattices: DataFrame, path: str = "path", cells: str = "cells", below: int = 17) -> DataFrame:
    """The command for each lattice of fewer cells than the bound; cells may end in a sign that isn't a digit."""
    small = F.regexp_extract(F.col(cells).cast("string"), r"^\s*(\d+)", 1).cast("int") < below
    return lattices.where(small).select(path, F.concat(F.lit("python -m spinmill basis "), F.col(path)).alias("command"))


def one_sector(results: DataFrame, sector: str = "sector") -> DataFrame:
    return results.agg((F.count_distinct(sector) == 1).alias("unique"))


def timer_stats(times: DataFrame, by: str, t: str) -> DataFrame:
    return times.groupBy(by).agg(F.count(t).alias("n"), F.avg(t).alias("mean"), F.stddev_pop(t).alias("std"), F.min(t).alias("least"), F.max(t).alias("most"))


def spline_second(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of the not-a-knot cubic spline; natural for fewer than four."""
    n = len(x)
    if n < 3:
        return np.zeros(n)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    below, own, above, r = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(d)
    if n > 3:
        # The ends' conditions put into their neighbours' equations leave three diagonals.
        own[0] += h[0] + h[0] ** 2 / h[1]
        above[0] -= h[0] ** 2 / h[1]
        own[-1] += h[-1] + h[-1] ** 2 / h[-2]
        below[-1] -= h[-1] ** 2 / h[-2]
    for i in range(1, n - 2):
        f = below[i] / own[i - 1]
        own[i] -= f * above[i - 1]
        r[i] -= f * r[i - 1]
    m = np.zeros(n)
    for i in range(n - 3, -1, -1):
        m[i + 1] = (r[i] - (above[i] * m[i + 2] if i < n - 3 else 0.0)) / own[i]
    if n > 3:
        m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
        m[-1] = ((h[-1] + h[-2]) * m[-2] - h[-1] * m[-3]) / h[-2]
    return m


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic spline through the points, NaN outside them."""
    order = np.argsort(x)
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    out = np.full(len(at), np.nan)
    inside = (at >= x[0]) & (at <= x[-1])
    if len(x) == 1:
        out[inside] = y[0]
        return out
    m, t = spline_second(x, y), at[inside]
    i = np.clip(np.searchsorted(x, t, "right") - 1, 0, len(x) - 2)
    h, p, q = x[i + 1] - x[i], x[i + 1] - t, t - x[i]
    out[inside] = (m[i] * p**3 + m[i + 1] * q**3) / (6 * h) + (y[i] / h - m[i] * h / 6) * p + (y[i + 1] / h - m[i + 1] * h / 6) * q
    return out


def interpolated(results: DataFrame, key: str, x: str, y: str, at: list[float]) -> DataFrame:
    """key, x, y at given points: a spline for each key, whose points are one curve of a sweep."""
    kind = results.schema[key].dataType.simpleString()

    def run(pdf):
        import pandas as pd

        own = pdf.groupby(x, as_index=False)[y].mean()
        return pd.DataFrame({key: pdf[key].iloc[0], x: at, y: spline(own[x].to_numpy(), own[y].to_numpy(), np.array(at, float))})

    return results.select(key, x, y).groupBy(key).applyInPandas(run, f"{key} {kind}, {x} double, {y} double")


def gaps(results: DataFrame, x: str, e: str, ties: list[str], scale: Column | None = None) -> DataFrame:
    """x, e0, e1 and their difference, times the size of a coupling if given."""
    best = best_sectors(results, x, e, 2, ties)
    s = F.abs(scale) if scale is not None else F.lit(1.0)
    out = best.groupBy(x).agg(F.min(e).alias("e0"), F.max(F.when(F.col("place") == 2, F.col(e))).alias("e1"), F.first(s).alias("scale"))
    return out.withColumn("gap", (F.col("e1") - F.col("e0")) * F.col("scale")).drop("scale")


def root(f, low: float, high: float, tol: float = 1e-12) -> float | None:
    """A zero of f between low and high by bisection, or None if the signs are alike."""
    a, b = f(low), f(high)
    if a == 0:
        return low
    if b == 0:
        return high
    if (a > 0) == (b > 0):
        return None
    while high - low > tol:
        mid = (low + high) / 2
        c = f(mid)
        if c == 0:
            return mid
        low, high = (mid, high) if (c > 0) == (a > 0) else (low, mid)
    return (low + high) / 2


def runtime_model(size: np.ndarray, seconds: np.ndarray) -> tuple[float, float]:
    """(t0, a) of t0 + a e^size, by least squares."""
    m = np.stack([np.ones(len(size)), np.exp(np.asarray(size, float))], axis=1)
    t0, a = np.linalg.lstsq(m, np.asarray(seconds, float), rcond=None)[0]
    return float(t0), float(a)
