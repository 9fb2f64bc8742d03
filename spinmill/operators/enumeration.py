"""Constrained states: enumerated by expansion with the constraints as filters, or closed under operators."""

from __future__ import annotations

import hashlib
import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import OpSum
from ..functions.bits import State, names, signed
from ..sources.lattice import Lattice
from ..sources.store import checkpoint_folder, written
from .apply import images

#: Levels between exchanges of the frontier. A level is a narrow step; the frontier is dealt out anew now and then.
DEAL_EVERY = 12


#: States that a task grows from an exchange of the frontier on, about.
TASK_ROWS = 500_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut off from its lineage in the shared checkpoint folder, so that lost executors don't matter."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _violated(state: State, constraints, k: int, order_pos: dict[int, int], value_bit: int):
    """SQL condition: some constraint of the site decided k-th can't be met any more."""
    bad = F.lit(False)
    for mask, least, most in constraints:
        if not mask >> value_bit & 1:
            continue
        unknown = sum(1 for b in range(mask.bit_length()) if mask >> b & 1 and order_pos[b] > k)
        q = state.popcount(mask)
        bad = bad | (q + unknown < least) | (q > most)
    return bad


def enumerate_states(
    spark: SparkSession, n_sites: int, constraints: list[tuple[int, int, int]], *, order: list[int] | None = None, budget: int = 0,
    sector: list[tuple[int, int]] | None = None, deal: int | None = None, deal_every: int = DEAL_EVERY, frontiers: str | None = None,
) -> DataFrame:
    """States (lo, hi) that meet the constraints (mask, least, most up), and `pairs`, the violations they were allowed.

    Each level decides the next site of `order` both ways and drops what can't be completed. With a budget, a forbidden
    choice may be taken at the cost of one; the result then depends on the order. sector: (mask, number up) that results
    have exactly; bounds on it prune as well. Bits are set at their sites' places, so nothing is moved back at the end.
    """
    order = order or list(range(n_sites))
    pos = {site: k for k, site in enumerate(order)}
    cols = names(n_sites)
    df = spark.createDataFrame([tuple([0] * (len(cols) + 1))], ", ".join(f"{c} bigint" for c in [*cols, "pairs"]))
    deal = deal or spark.sparkContext.defaultParallelism
    begin = 0
    if frontiers:
        frontiers = f"{frontiers}/{hashlib.sha256(repr((n_sites, constraints, order, budget, sector)).encode()).hexdigest()[:16]}"
        # Reached where the frontier was written to its end.
        begin = max((k + 1 for k in range(n_sites - 1) if (k + 1) % deal_every == 0 and written(spark, f"{frontiers}/{k + 1}")), default=0)
        df = spark.read.parquet(f"{frontiers}/{begin}").select(*df.columns) if begin else df
        df = df.repartition(max(deal, math.ceil(df.count() / TASK_ROWS))) if begin else df
    for k, site in list(enumerate(order))[begin:]:
        state = State.of(n_sites)
        grown = df.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("v"), *cols, "pairs")
        word = state.words[site // 64]
        grown = grown.withColumn(cols[site // 64], word.bitwiseOR(F.shiftleft(F.col("v").cast("bigint"), site % 64)))
        state = State.of(n_sites)
        bad = _violated(state, constraints, k, pos, site)
        for mask, up in sector or []:
            left = sum(1 for b in range(mask.bit_length()) if mask >> b & 1 and pos[b] > k)
            q = state.popcount(mask)
            bad = bad | (q > up) | (q + left < up)
        grown = grown.withColumn("pairs", F.col("pairs") + bad.cast("bigint")).where(F.col("pairs") <= budget)
        df = grown.select(*cols, "pairs")
        if (k + 1) % deal_every == 0 and k + 1 < n_sites:
            # The frontier is spread over the cluster, and the plan cut so that it stays short.
            if frontiers:
                df.write.mode("overwrite").parquet(f"{frontiers}/{k + 1}")
                df = spark.read.parquet(f"{frontiers}/{k + 1}").select(*df.columns)
            else:
                df = checkpointed(df)
            df = df.repartition(max(deal, math.ceil(df.count() / TASK_ROWS)))
    for mask, up in sector or []:
        df = df.where(State.of(n_sites).popcount(mask) == up)
    return df


def ice_states(spark: SparkSession, lat: Lattice, *, order: str = "greedy", budget: int = 0, sector: list[int] | None = None, seed: int = 0, frontiers: str | None = None) -> DataFrame:
    """States of a lattice's tetrahedra; sector: spins up by sublattice; frontiers: folder for going on after a stop."""
    want = None
    if sector is not None:
        masks = lat.sublattice_masks()
        if len(sector) != len(masks):
            raise ValueError(f"the sector has {len(sector)} numbers, the lattice {len(masks)} sublattices")
        want = list(zip(masks, sector))
    return enumerate_states(spark, lat.n_sites, lat.constraints(), order=lat.order(order, seed), budget=budget, sector=want, frontiers=frontiers)


def frontier_sizes(lat: Lattice, order: list[int]) -> list[int]:
    """Nodes by level, counted on the driver: how good an order is, for lattices small enough to count."""
    pos, rows = {s: k for k, s in enumerate(order)}, [0]
    out = []
    for k, site in enumerate(order):
        own = [(m, a, z, sum(1 for b in range(m.bit_length()) if m >> b & 1 and pos[b] > k)) for m, a, z in lat.constraints() if m >> site & 1]
        rows = [s for r in rows for s in (r, r | 1 << site) if all((s & m).bit_count() + u >= a and (s & m).bit_count() <= z for m, a, z, u in own)]
        out.append(len(rows))
    return out


def parse_seed(text: str) -> int:
    """`0xHI,0xLO`, or one hexadecimal number."""
    parts = text.split(",")
    if not 1 <= len(parts) <= 2:
        raise ValueError(f"no state: {text!r}")
    words = [int(p.strip(), 16) for p in parts]
    if any(w >> 64 for w in words) and len(words) == 2:
        raise ValueError(f"a word of {text!r} is wider than 64 bits")
    return words[0] << 64 | words[1] if len(words) == 2 else words[0]


def closure(spark: SparkSession, n_sites: int, seeds: list[int] | DataFrame, ops: OpSum, *, most_rounds: int = 10_000) -> DataFrame:
    """States reachable from the seeds by the off-diagonal terms: semi-naive rounds, each applied to new states only.

    Both the states seen and the new ones are dealt by their hash, and every round is cut off from the last by files in
    the shared folder.
    """
    cols = names(n_sites)
    if not isinstance(seeds, DataFrame):
        rows = [tuple(signed(s >> 64 * k) for k in range(len(cols))) for s in seeds]
        seeds = spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in cols))
    seen = checkpointed(seeds.select(*cols).distinct())
    new = seen
    for _ in range(most_rounds):
        made = images(new, ops, n_sites).select(*cols).distinct()
        new = checkpointed(made.join(seen, cols, "left_anti"))
        if new.isEmpty():
            return seen
        seen = checkpointed(seen.union(new))
    raise RuntimeError(f"not closed after {most_rounds} rounds")


def persisted(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)
