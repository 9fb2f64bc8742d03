"""Sectors by sublattice magnetisation, sorted sets of states, orbits, and load figures."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.algebra import OpSum
from ..functions.bits import State, names
from ..sources.store import checkpoint_folder
from .apply import images


def with_sector(states: DataFrame, masks: list[int], n_sites: int) -> DataFrame:
    """s0, s1, ... (spins up by mask) and sector_id, the counts packed in bytes."""
    counts = [State.of(n_sites).popcount(m) for m in masks]
    packed = None
    for k, c in enumerate(counts):
        part = F.shiftleft(c.cast("bigint"), 8 * k)
        packed = part if packed is None else packed.bitwiseOR(part)
    return states.select("*", *[c.alias(f"s{k}") for k, c in enumerate(counts)], packed.alias("sector_id"))


def histogram(states: DataFrame, masks: list[int], n_sites: int) -> DataFrame:
    keys = [f"s{k}" for k in range(len(masks))]
    return with_sector(states, masks, n_sites).groupBy(*keys, "sector_id").agg(F.count("*").alias("n"))


def sorted_unique(states: DataFrame, n_sites: int) -> DataFrame:
    cols = names(n_sites)
    return states.select(*cols).distinct().orderBy(*State.of(n_sites).order())


def numbered(states: DataFrame, n_sites: int) -> DataFrame:
    """States with their place from 1 in unsigned order, nulls last: places in range partitions, after the rows of those before.

    The partitions are written first, so that counting and numbering see the same; the files stay in the checkpoint folder.
    """
    spark, order = states.sparkSession, [k.asc_nulls_last() for k in State.of(n_sites).order()]
    path = f"{checkpoint_folder(spark)}/numbered-{uuid.uuid4().hex}.parquet"
    dealt = states.select(*names(n_sites)).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    dealt.sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()).write.parquet(path)
    parts = spark.read.parquet(path)
    part = F.shiftrightunsigned("id", 33)
    sizes = parts.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    sizes = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    out = parts.withColumn("part", part).join(F.broadcast(sizes), "part")
    return out.select(*names(n_sites), (F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


def inserted(basis: DataFrame, new: DataFrame, n_sites: int) -> tuple[DataFrame, DataFrame]:
    """(the union, what of `new` wasn't there)."""
    cols = names(n_sites)
    fresh = new.select(*cols).distinct().join(basis, cols, "left_anti")
    return basis.select(*cols).union(fresh), fresh


def range_bounds(states: DataFrame, parts: int, n_sites: int) -> DataFrame:
    """part, first and last row, n: an equal division of the sorted states, by sampled ranges and counts of partitions.

    Rows are numbered by their partition's first number and their place in it, so that none is sorted in one task.
    """
    rows = numbered(states, n_sites).withColumn("row", F.col("place") - 1)
    total = F.broadcast(rows.agg(F.count("*").alias("total")))  # one row
    part = F.least(F.floor(F.col("row") * parts / F.col("total")), F.lit(parts - 1)).cast("int")
    return rows.crossJoin(total).withColumn("part", part).groupBy("part").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("n"))


def prefix_bins(states: DataFrame, mask: int, n_sites: int) -> DataFrame:
    """How evenly a mask divides the states: bins, mean, deviation, its share of the mean in percent, least and most."""
    masked = State.of(n_sites) & mask
    bins = states.groupBy(*masked.named("bin_")).agg(F.count("*").alias("c"))
    return bins.agg(
        F.count("*").alias("bins"), F.avg("c").alias("mean"), F.stddev_pop("c").alias("std"),
        (100 * F.stddev_pop("c") / F.avg("c")).alias("cv_percent"), F.min("c").alias("least"), F.max("c").alias("most"),
    )


def representatives(states: DataFrame, permutations: list[list[int]], n_sites: int) -> DataFrame:
    """states with rep_lo (rep_hi): the least image under the permutations, itself included."""
    cols = names(n_sites)
    images = [State.of(n_sites).permuted(p) for p in [list(range(n_sites)), *permutations]]
    if n_sites <= 63:
        reps = [F.least(*[s.lo for s in images]) if len(images) > 1 else images[0].lo]
    else:
        key = F.array_min(F.array(*[F.struct(*[k.alias(f"k{i}") for i, k in enumerate(s.order())], *s.named()) for s in images]))
        reps = [key[c] for c in cols]
    return states.select("*", *[r.alias(f"rep_{c}") for r, c in zip(reps, cols)])


def orbits(states: DataFrame, permutations: list[list[int]], n_sites: int) -> DataFrame:
    """One row for each orbit: its representative and how many of the states it has."""
    cols = [f"rep_{c}" for c in names(n_sites)]
    return representatives(states, permutations, n_sites).groupBy(*cols).agg(F.count("*").alias("size"))


def load(applied: DataFrame) -> DataFrame:
    """Rows by task: how evenly work is spread."""
    return applied.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("work"))


def weighted_targets(total: int, scores: list[int]) -> list[int]:
    """Rows for each task in proportion to whole-number scores, rounded down; the last has what is left."""
    own = [s * total // sum(scores) for s in scores[:-1]]
    return [*own, total - sum(own)]


def transfers(have: list[int], want: list[int]) -> list[tuple[int, int, int]]:
    """(from, to, rows) that turn one division of the sorted rows into another: how far their ranges overlap."""
    a, b = [0, *accumulate(have)], [0, *accumulate(want)]
    if a[-1] != b[-1]:
        raise ValueError(f"{a[-1]} rows can't be dealt as {b[-1]}")
    over = ((i, j, min(a[i + 1], b[j + 1]) - max(a[i], b[j])) for i in range(len(have)) for j in range(len(want)))
    return [(i, j, n) for i, j, n in over if n > 0]


def weighted_bounds(states: DataFrame, scores: list[int], n_sites: int) -> DataFrame:
    """part, first and last row, n: the sorted states divided in proportion to the scores."""
    rows = numbered(states, n_sites).withColumn("row", F.col("place") - 1)
    ends = list(accumulate(weighted_targets(rows.count(), scores)))
    part = sum((F.when(F.col("row") >= end, 1).otherwise(0) for end in ends[:-1]), F.lit(0))
    return rows.groupBy(part.alias("part")).agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("n"))


def traffic(states: DataFrame, ops: OpSum, n_sites: int, owner: Callable[..., Column]) -> DataFrame:
    """source, target, n: images by the owner of the state they come from and of their own; owner maps a state's words to
    a column."""
    made = images(states.select(*names(n_sites)), ops, n_sites)
    cols = names(n_sites)
    return made.groupBy(owner(*[F.col(f"from_{c}") for c in cols]).alias("source"), owner(*[F.col(c) for c in cols]).alias("target")).agg(F.count("*").alias("n"))
