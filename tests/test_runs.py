import functools
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spinmill.__main__ import run
from spinmill.functions.algebra import BadOperator, OpSum, Term
from spinmill.operators import complexes, enumeration, krylov, sectors, sweep
from spinmill.operators.apply import Local
from spinmill.sources import store
from spinmill.sources.lattice import pyrochlore

# Up is bit 1, and stands second in each site's basis.
SINGLE = {
    "X": np.array([[0, 1], [1, 0]], complex), "Y": np.array([[0, 1j], [-1j, 0]]), "Z": np.diag([-1.0 + 0j, 1]),
    "+": np.array([[0, 0], [1, 0]], complex), "-": np.array([[0, 1], [0, 0]], complex),
}


def matrix(spec, n):
    out = np.eye(1 << n, dtype=complex)
    for part in spec.split():
        factors = [np.eye(2)] * n
        factors[int(part[:-1])] = SINGLE[part[-1]]
        # Site 0 is the lowest bit.
        out = out @ functools.reduce(np.kron, factors[::-1])
    return out


def dense(ops, n):
    states = np.arange(1 << n)
    return Local(states, ops.real).dense() + 1j * Local(states, ops.imag).dense()


def test_y_factors_against_matrices():
    for spec in ["0Y", "0Y 1Y", "1Y 1X", "0Y 0Y", "2Y 0+ 1Z", "0Y 1Y 2Y", "0Z 0Y", "1- 1Y"]:
        assert np.allclose(dense(complexes.ComplexSum.of((2 - 1j, spec)), 3), (2 - 1j) * matrix(spec, 3)), spec
    a, b = complexes.ComplexSum.of((1 + 2j, "0Y 1X"), (0.5, "2Z")), complexes.ComplexSum.of((-1j, "1Y"), (3, "0+"))
    assert np.allclose(dense(a * b, 3), dense(a, 3) @ dense(b, 3))
    assert np.allclose(dense(a + b, 3), dense(a, 3) + dense(b, 3))
    assert np.allclose(dense(a.dagger, 3), dense(a, 3).conj().T)
    with pytest.raises(BadOperator):
        Term.parse("0Y")  # a real sum has none


def test_complex_application(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=8) + 1j * rng.normal(size=8)
    df = spark.createDataFrame([(i, float(z.real), float(z.imag)) for i, z in enumerate(v)], "lo bigint, re double, im double")
    ops = complexes.ComplexSum.of((1 - 1j, "0Y 1+"), (0.25j, "2Z"), (2, "1Y 2Y"))
    want = sum(c * matrix(s, 3) for c, s in ((1 - 1j, "0Y 1+"), (0.25j, "2Z"), (2, "1Y 2Y"))) @ v
    got = {r["lo"]: complex(r["re"], r["im"]) for r in complexes.apply_complex(df, ops, 3).collect()}
    assert np.allclose([got.get(i, 0) for i in range(8)], want)
    value = complexes.expectation(df, ops, 3).first()["value"]
    assert np.isclose(complex(value["re"], value["im"]), v.conj() @ want)
    none = complexes.inner(df.limit(0), df, 3).first()["value"]
    assert (none["re"], none["im"]) == (0.0, 0.0)


OPS = OpSum.of((1.0, "0+ 1-"), (1.0, "0- 1+"), (-0.5, "1+ 2-"), (-0.5, "1- 2+"), (0.3, "0Z"))


def test_distributed_exponential(spark):
    basis = spark.createDataFrame([(i,) for i in range(8)], "lo bigint")
    v = basis.withColumn("x", F.col("lo") + 1.0)
    for tau in (0.0, -0.7, 0.4):
        df, grown = krylov.distributed_exponential(v, OPS, 3, tau)
        got = {r["lo"]: r["x"] * np.exp(grown) for r in df.collect()}
        want = krylov.exponential(Local(np.arange(8), OPS).__matmul__, np.arange(8) + 1.0, tau)
        assert np.allclose([got[i] for i in range(8)], want)
    assert krylov.distributed_exponential(v.withColumn("x", F.lit(0.0)), OPS, 3, 1.0)[1] == 0.0


def test_exact_thermal_average_from_unit_vectors(spark):
    """Over DataFrames with a start for each state."""
    basis = spark.createDataFrame([(1,), (2,)], "lo bigint")
    ops = OpSum.of((1.0, "0+ 1-"), (1.0, "0- 1+"), (0.3, "0Z"))
    starts = [basis.withColumn("x", (F.col("lo") == s).cast("double")) for s in (1, 2)]
    got = krylov.distributed_thermal(basis, ops, 2, [OpSum.of((1.0, "0Z"))], [0.6], 0, starts=starts)
    h, z = np.array([[0.3, 1.0], [1.0, -0.3]]), np.diag([1.0, -1.0])
    e, u = np.linalg.eigh(h)
    rho = u @ np.diag(np.exp(-0.6 * e)) @ u.T
    assert np.allclose(got[0]["mean"], [np.trace(rho @ h) / np.trace(rho), np.trace(rho @ z) / np.trace(rho)])


def test_thermal_runs_skip_what_is_there(spark, tmp_path):
    runs = {"a": spark.range(8).select(F.col("id").alias("lo"))}
    path = str(tmp_path / "runs")
    assert krylov.thermal_runs(runs, OPS, 3, [0.5], 2, path) == ["a"]
    assert krylov.thermal_runs(runs, OPS, 3, [0.5], 2, path) == []
    assert spark.read.parquet(path).count() == 1


def test_search_goes_on_from_the_last_frontier(spark, tmp_path):
    lat, path = pyrochlore((1, 0, 0), (0, 1, 0), (0, 0, 2)), str(tmp_path / "f")
    make = lambda **k: enumeration.enumerate_states(spark, lat.n_sites, lat.constraints(), deal_every=3, **k)
    want = sorted(map(tuple, make().collect()))
    assert sorted(map(tuple, make(frontiers=path).collect())) == want
    folder = next((tmp_path / "f").iterdir())
    assert {p.name for p in folder.iterdir()} == {"3", "6"}
    # One that was not written to its end doesn't count; one that was is where the search goes on.
    (folder / "6" / "_SUCCESS").unlink()
    kept = spark.read.parquet(str(folder / "3")).where("lo % 2 = 0")
    rows = kept.collect()
    spark.createDataFrame(rows, kept.schema).write.mode("overwrite").parquet(str(folder / "3"))
    assert sorted(map(tuple, make(frontiers=path).collect())) == [r for r in want if r[0] % 2 == 0]
    # Another search has frontiers of its own.
    assert make(frontiers=path, budget=1).count() > len(want) and len(list((tmp_path / "f").iterdir())) == 2


def test_targets_and_transfers():
    assert sectors.weighted_targets(10, [1, 2, 1]) == [2, 5, 3]
    assert sectors.transfers([4, 4, 2], [2, 5, 3]) == [(0, 0, 2), (0, 1, 2), (1, 1, 3), (1, 2, 1), (2, 2, 2)]
    assert sectors.transfers([0, 3], [3, 0]) == [(1, 0, 3)]
    with pytest.raises(ValueError):
        sectors.transfers([1], [2])
    for have, want in itertools.product([[3, 3], [6, 0], [1, 2, 3]], repeat=2):
        got = sectors.transfers(have, want)
        assert [sum(n for i, _, n in got if i == k) for k in range(len(have))] == have
        assert [sum(n for _, j, n in got if j == k) for k in range(len(want))] == want


def test_values(spark, tmp_path):
    store.write_values(spark, str(tmp_path / "v"), n=3, x=0.5, name="a", z=1 - 2j)
    row = spark.read.parquet(str(tmp_path / "v")).first()
    assert (row["n"], row["x"], row["name"], tuple(row["z"])) == (3, 0.5, "a", (1.0, -2.0))


def test_grid_without_coupling(spark):
    curve = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0), (2.0, 5.0)], "x double, y double")
    got = sweep.phase_diagram(curve, "x", "y", [0.0], [0.0, 0.3], (1, 1, 1)).collect()
    assert len(got) == 2 and any(r["ratio"] is None and r["y"] is None for r in got)


def test_thermal_command(spark, tmp_path):
    lat, path = pyrochlore((1, 0, 0), (0, 1, 0), (0, 0, 2)), str(tmp_path / "pyro.json")
    (tmp_path / "pyro.json").write_text(lat.to_json())
    run(spark, ["basis", path, "--frontiers", str(tmp_path / "f")])
    out = run(spark, ["thermal", path, "--g", "1,-0.2,-0.2,-0.2", "--betas", "0.5,1", "--samples", "3"])
    assert [r["beta"] for r in spark.read.parquet(out).orderBy("beta").collect()] == [0.5, 1.0]
    out = run(spark, ["thermal", path, "--g", "1,-0.2,-0.2,-0.2", "--betas", "1", "--samples", "1", "--by-sector", "--out", str(tmp_path / "s")])
    basis = spark.read.parquet(store.basis_path(path))
    assert spark.read.parquet(out).count() == sectors.with_sector(basis.select("lo"), lat.sublattice_masks(), lat.n_sites).select("sector_id").distinct().count()
