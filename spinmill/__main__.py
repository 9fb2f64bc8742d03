"""Command line: bases, closures, sectors, eigenpairs and expectation values from lattice files.

    python -m spinmill basis LATTICE [--pairs N] [--order greedy] [--sector 4.4.4.4] [--partition] [--format parquet] [--frontiers FOLDER]
    python -m spinmill closure LATTICE SEED [--out PATH]
    python -m spinmill diag LATTICE (--g A,B,C,D | --jpm J --field X,Y,Z) [--n 1] [--pairs N] [--drop-null] [--save-matrix]
    python -m spinmill observables LATTICE EIGEN [--what ring,cross,flip] [--vector N]
    python -m spinmill merge LATTICE SHARD... [--partition]
    python -m spinmill ring-normed LATTICE [--pairs N]
    python -m spinmill thermal LATTICE (--g A,B,C,D | --jpm J --field X,Y,Z) --betas B,... [--samples N] [--pairs N] [--by-sector]
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.algebra import OpSum
from .functions.bits import names
from .operators import apply, enumeration, hamiltonians, krylov, observables, sectors
from .sources import store
from .sources.lattice import read_json


def numbers(text: str) -> list[float]:
    return [float(x) for x in text.split(",")]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spinmill")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("basis", "closure", "diag", "observables", "merge", "ring-normed", "thermal"):
        c = sub.add_parser(name)
        c.add_argument("lattice")
        c.add_argument("--pairs", type=int, default=0)
        c.add_argument("--out")
        if name == "basis":
            c.add_argument("--order", choices=["none", "greedy", "random"], default="greedy")
            c.add_argument("--seed", type=int, default=0)
            c.add_argument("--sector")
            c.add_argument("--frontiers")
            c.add_argument("--partition", action="store_true")
            c.add_argument("--format", choices=["parquet", "csv"], default="parquet")
        if name == "closure":
            c.add_argument("start")
        if name in ("diag", "thermal"):
            c.add_argument("--g", type=numbers)
            c.add_argument("--jpm", type=float)
            c.add_argument("--field", type=numbers)
        if name == "thermal":
            c.add_argument("--betas", type=numbers, required=True)
            c.add_argument("--samples", type=int, default=10)
            c.add_argument("--by-sector", action="store_true")
        if name == "diag":
            c.add_argument("--n", type=int, default=1)
            c.add_argument("--krylov", type=int, default=200)
            c.add_argument("--tolerance", type=float, default=1e-12)
            c.add_argument("--rng", type=int, default=0)
            c.add_argument("--drop-null", action="store_true")
            c.add_argument("--save-matrix", action="store_true")
        if name == "observables":
            c.add_argument("eigen")
            c.add_argument("--what", default="ring")
            c.add_argument("--vector", type=int)
        if name == "merge":
            c.add_argument("shards", nargs="+")
            c.add_argument("--partition", action="store_true")
    return p


def run(spark: SparkSession, argv: list[str]) -> str:
    """The path written."""
    a = parser().parse_args(argv)
    lat = read_json(spark, a.lattice)
    n = lat.n_sites
    if a.command == "basis":
        sector = [int(x) for x in a.sector.split(".")] if a.sector else None
        states = enumeration.ice_states(spark, lat, order=a.order, budget=a.pairs, sector=sector, seed=a.seed, frontiers=a.frontiers)
        out = a.out or store.basis_path(a.lattice, a.pairs, a.partition, a.format)
        if a.format == "csv":
            store.write_csv(states, out, n)
        else:
            store.write_basis(states.drop("pairs"), out, n, sectors=lat.sublattice_masks() if a.partition else None)
        return out
    if a.command == "closure":
        rings = hamiltonians.ring_hamiltonian(lat, [1.0] * 4)
        out = a.out or store.basis_path(a.lattice, a.pairs)
        store.write_basis(enumeration.closure(spark, n, [enumeration.parse_seed(a.start)], rings), out, n)
        return out
    if a.command in ("diag", "thermal"):
        if (a.g is None) == (a.jpm is None or a.field is None):
            raise SystemExit("either --g, or --jpm and --field")
        ops = hamiltonians.ring_hamiltonian(lat, a.g) if a.g else hamiltonians.field_hamiltonian(lat, a.jpm, tuple(a.field))
        basis = store.read_basis(spark, store.basis_path(a.lattice, a.pairs), n)
    if a.command == "thermal":
        runs = {"all": basis}
        if a.by_sector:
            masks = lat.sublattice_masks()
            marked = sectors.with_sector(basis, masks, n)
            keys = [f"s{k}" for k in range(len(masks))]
            runs = {".".join(map(str, r)): reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), zip(keys, r), marked).select(*names(n)) for r in sorted(tuple(r) for r in marked.select(*keys).distinct().collect())}
        out = a.out or f"{a.lattice.removesuffix('.json')}.{a.pairs}.thermal"
        krylov.thermal_runs(runs, ops, n, a.betas, a.samples, out)
        return out
    if a.command == "diag":
        basis = apply.not_annihilated(basis, ops, n) if a.drop_null else basis
        values, vectors = krylov.eigenpairs(basis, ops, n, a.n, krylov.Settings(krylov_dim=a.krylov, tol_value=a.tolerance, seed=a.rng))
        tag = "g=" + ",".join(map(str, a.g)) if a.g else f"Jpm={a.jpm}%" + "%".join(f"B{k}={b}" for k, b in zip("xyz", a.field))
        out = a.out or f"{a.lattice.removesuffix('.json')}%{tag}%.eigs"
        spark.createDataFrame([(i, float(e)) for i, e in enumerate(values)], "vec int, e double").write.mode("overwrite").parquet(f"{out}/values")
        # By number, so that reading one vector leaves the others' files alone.
        vectors.write.mode("overwrite").partitionBy("vec").parquet(f"{out}/vectors")
        if a.save_matrix:
            rank = sectors.numbered(basis, n)
            rows = apply.triplets(basis, ops, n).join(rank.withColumnRenamed("place", "row"), names(n))
            rows = rows.join(rank.select(F.col("place").alias("col"), *[F.col(c).alias(f"from_{c}") for c in names(n)]), [f"from_{c}" for c in names(n)])
            store.write_matrix_market(rows.select("row", "col", "val"), rank.count(), f"{out}/matrix")
        return out
    if a.command == "merge":
        # Shards in any order, with states in several of them; sorted by a range-partitioned exchange.
        states = sectors.sorted_unique(reduce(DataFrame.unionByName, [store.read_basis(spark, x, n) for x in a.shards]), n)
        out = a.out or store.basis_path(a.lattice, a.pairs, a.partition)
        store.write_basis(states, out, n, sectors=lat.sublattice_masks() if a.partition else None)
        return out
    if a.command == "ring-normed":
        basis = store.read_basis(spark, store.basis_path(a.lattice, a.pairs), n)
        out = a.out or f"{a.lattice.removesuffix('.json')}.{a.pairs}.ring-normed"
        sums = [(k, sl, apply.apply(basis.withColumn("x", F.lit(1.0)), OpSum.of((1.0, o * h)), n)) for k, (o, h, sl) in enumerate(hamiltonians.ring_terms(lat))]
        kept = reduce(DataFrame.unionByName, [x.select(F.lit(k).alias("op"), F.lit(sl).alias("sl"), "x") for k, sl, x in sums])
        kept.groupBy("op", "sl").agg(F.sum("x").alias("states")).write.mode("overwrite").parquet(out)
        return out
    vectors = spark.read.parquet(f"{a.eigen}/vectors")
    if a.vector is not None:
        vectors = vectors.where(F.col("vec") == a.vector)
    rings = hamiltonians.ring_terms(lat)
    ops = [OpSum.of((1.0, o)) for o, _, _ in rings]
    out = a.out or f"{a.eigen}.out"
    made = {"ring": lambda: observables.expectations(vectors, ops, n), "cross": lambda: observables.cross_correlations(vectors, ops, n), "flip": lambda: observables.ring_observables(vectors, [o for o, _, _ in rings], n)}
    for what in a.what.split(","):
        made[what]().withColumn("lattice", F.lit(a.lattice)).write.mode("overwrite").parquet(f"{out}/{what}")
    return out


if __name__ == "__main__":
    import sys

    session = SparkSession.builder.appName("spinmill").getOrCreate()
    print(run(session, sys.argv[1:]))
    session.stop()
