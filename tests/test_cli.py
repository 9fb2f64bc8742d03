import pytest

from spinmill.__main__ import run
from spinmill.sources.lattice import pyrochlore


def test_from_lattice_to_observables(spark, tmp_path):
    lat = pyrochlore((1, 0, 0), (0, 2, 0), (0, 0, 2))
    path = str(tmp_path / "pyro.json")
    (tmp_path / "pyro.json").write_text(lat.to_json())
    basis = run(spark, ["basis", path])
    assert basis.endswith("pyro.0.basis.parquet") and spark.read.parquet(basis).count() == 114
    parts = run(spark, ["basis", path, "--partition"])
    assert spark.read.parquet(parts).select("s0", "s1", "s2", "s3").distinct().count() == 29
    eigs = run(spark, ["diag", path, "--g", "1,-0.2,-0.2,-0.2", "--n", "2"])
    values = [r["e"] for r in spark.read.parquet(f"{eigs}/values").orderBy("vec").collect()]
    assert values[0] <= values[1]
    out = run(spark, ["observables", path, eigs, "--what", "ring,flip"])
    assert spark.read.parquet(f"{out}/ring").count() > 0 and spark.read.parquet(f"{out}/flip").where("flippability < 0").count() == 0
    one = run(spark, ["observables", path, eigs, "--vector", "1", "--out", str(tmp_path / "one")])
    assert spark.read.parquet(f"{one}/ring").count() < spark.read.parquet(f"{out}/ring").count()
    with pytest.raises(SystemExit):
        run(spark, ["diag", path])


def test_shards_matrix_and_norms(spark, tmp_path):
    import numpy as np
    from spinmill.operators import apply, hamiltonians
    from spinmill.sources import store

    lat = pyrochlore((1, 0, 0), (0, 1, 0), (0, 0, 2))
    path = str(tmp_path / "pyro.json")
    (tmp_path / "pyro.json").write_text(lat.to_json())
    basis = spark.read.parquet(run(spark, ["basis", path])).select("lo")
    basis.where("lo % 3 > 0").write.parquet(str(tmp_path / "a.parquet"))
    basis.where("lo % 3 < 2").write.parquet(str(tmp_path / "b.parquet"))
    merged = run(spark, ["merge", path, str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet"), "--out", str(tmp_path / "m.parquet")])
    states = sorted(r["lo"] for r in basis.collect())
    assert sorted(r["lo"] for r in spark.read.parquet(merged).collect()) == states
    eigs = run(spark, ["diag", path, "--jpm", "0.1", "--field", "0.2,0.1,0.3", "--save-matrix"])
    dense = apply.Local(np.array(states), hamiltonians.field_hamiltonian(lat, 0.1, (0.2, 0.1, 0.3))).dense()
    got = np.zeros_like(dense)
    for r in store.read_matrix_market(spark, f"{eigs}/matrix").collect():
        got[r["row"] - 1, r["col"] - 1] = r["val"]
    assert np.allclose(got, dense) and np.abs(dense).max() > 0
    norms = spark.read.parquet(run(spark, ["ring-normed", path])).collect()
    assert all(0 <= r["states"] <= len(states) for r in norms)
