import numpy as np
import pytest

from spinmill.functions.algebra import OpSum, Term
from spinmill.operators import apply as ap
from spinmill.operators import enumeration, hamiltonians, krylov, observables, sweep
from spinmill.sources.lattice import pyrochlore

LAT8, LAT32 = pyrochlore((1, 0, 0), (0, 1, 0), (0, 0, 2)), pyrochlore((2, 0, 0), (0, 2, 0), (0, 0, 2))


@pytest.fixture(scope="module")
def ice32(spark):
    return enumeration.ice_states(spark, LAT32).select("lo").cache()


def test_enumeration_32(ice32):
    rows = sorted(r["lo"] for r in ice32.collect())
    assert len(rows) == len(set(rows)) == 2970 and rows[0] == 0xFFFF and rows[-1] == 0xFFFF0000


@pytest.mark.parametrize(("order", "budget", "n"), [("none", 1, 54), ("greedy", 1, 36), ("none", 2, 144)])
def test_budgets(spark, order, budget, n):
    assert enumeration.ice_states(spark, LAT8, order=order, budget=budget).count() == n


def test_sectors_are_exact(spark):
    assert enumeration.ice_states(spark, LAT8, sector=[2, 1, 1, 0]).count() == 2
    with pytest.raises(ValueError):
        enumeration.ice_states(spark, LAT8, sector=[1])


def test_wide_enumeration(spark):
    """66 sites in pairs of which one is up: two words, and few states."""
    masks = [(1 << i | 1 << (i + 33), 1, 1) for i in range(33)]
    got = enumeration.enumerate_states(spark, 66, [*masks, ((1 << 31) - 1, 0, 0)], order=[i for k in range(33) for i in (k, k + 33)]).collect()
    assert len(got) == 4
    for r in got:
        x = (r["lo"] & (2**64 - 1)) | (r["hi"] & (2**64 - 1)) << 64
        assert all((x & m).bit_count() == 1 for m, _, _ in masks)


def test_ground_energies_and_multiplicity(ice32):
    for g, want in (([1, -0.2, -0.2, -0.2], [-4.13117192, -4.07247262, -4.07247262, -4.07247262, -4.04548912]), ([-1.0] * 4, [-8.0])):
        values, vectors = krylov.eigenpairs(ice32, hamiltonians.ring_hamiltonian(LAT32, g), 32, len(want))
        assert values == pytest.approx(want, abs=1e-7)
    h = hamiltonians.field_hamiltonian(LAT32, 0.02, (0.1, 0.1, 0.1))
    assert krylov.eigenpairs(ice32, h, 32, 1)[0][0] == pytest.approx(-0.00861117791, abs=1e-9)


def test_closure_and_annihilation(spark, ice32):
    h = hamiltonians.ring_hamiltonian(LAT32, [1.0] * 4)
    assert ap.not_annihilated(ice32, h, 32).count() == 2496
    off = ap.triplets(ice32, h, 32)
    assert off.count() == 15360
    with pytest.raises(RuntimeError):
        enumeration.closure(spark, 32, [ap.not_annihilated(ice32, h, 32).orderBy("lo").first()["lo"]], h, most_rounds=1)


def test_apply_against_numpy(spark, ice32):
    h = hamiltonians.field_hamiltonian(LAT32, 0.3, (0.2, -0.1, 0.4)) + OpSum.of((0.7, "0+ 0-"), (0.1, "3Z 5Z 0P"))
    a = ap.Local(np.array([r["lo"] for r in ice32.collect()]), h)
    x = krylov.start_vector(a.states, 4)
    df = spark.createDataFrame([(int(s), float(v)) for s, v in zip(a.states, x)], "lo bigint, x double")
    got = {r["lo"]: r["x"] for r in ap.apply(df, h, 32).collect()}
    want = a @ x
    assert max(abs(got.get(int(s), 0.0) - w) for s, w in zip(a.states, want)) < 1e-12
    dense = a.dense()
    assert np.allclose(dense, dense.T)


def test_local_operator_by_state():
    h = OpSum.of((1.5, "0+ 1-"), (1.5, "1+ 0-"), (2.0, "0Z 1Z"), (1.0, "2X"))
    a = ap.Local(np.arange(8), h)
    want = np.zeros((8, 8))
    for t, c in h.parts.items():
        for s in range(8):
            to, sign = t.apply(s)
            want[to, s] += c * sign
    assert np.allclose(a.dense(), want)


def test_lanczos_on_random_matrices():
    rng = np.random.default_rng(0)
    m = rng.normal(size=(100, 100))
    m = m + m.T
    e, u = np.linalg.eigh(m)
    r = krylov.lanczos(lambda v: m @ v, rng.normal(size=100), 1)
    assert r.values[0] == pytest.approx(e[0], abs=1e-8) and abs(abs(r.vectors[:, 0] @ u[:, 0]) - 1) < 1e-6 and r.converged
    values, vectors = krylov.block_lanczos(lambda v: m @ v, rng.normal(size=(100, 3)), 3, krylov.Settings())
    assert values == pytest.approx(e[:3], abs=1e-8) and np.allclose(m @ vectors, vectors * values, atol=1e-6)


def test_exponentials():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(20, 20))
    m = m + m.T
    e, u = np.linalg.eigh(m)
    v = rng.normal(size=20)
    for tau in (-0.3, 0.0, 0.2):
        assert np.allclose(krylov.exponential(lambda x: m @ x, v, tau), u @ (np.exp(tau * e) * (u.T @ v)), rtol=1e-8)
    assert not krylov.exponential(lambda x: m @ x, np.zeros(20), 1.0).any()
    assert np.allclose(krylov.exponential(lambda x: 3 * x, v, 0.5), np.exp(1.5) * v)
    with pytest.raises(ValueError):
        krylov.exponential(lambda x: np.zeros(3), v, 0.5)


def test_thermal_averages_approach_the_exact_ones():
    rng = np.random.default_rng(2)
    m = rng.normal(size=(60, 60)) / 8
    m = m + m.T
    e = np.linalg.eigvalsh(m)
    got = krylov.thermal(lambda x: m @ x, np.arange(60), [lambda x: x], [0.5, 2.0], 400)
    for r in got:
        w = np.exp(-r["beta"] * (e - e[0]))
        assert r["mean"][0] == pytest.approx((w * e).sum() / w.sum(), abs=5 * r["error"][0] + 1e-3) and r["mean"][1] == pytest.approx(1)


def test_distributed_lanczos_resumes(spark, tmp_path):
    basis = enumeration.ice_states(spark, LAT8).select("lo")
    h = OpSum.of(*[(1.0, f"{a}+ {b}-") for a in range(3) for b in range(3) if a != b], (0.3, "0Z"))
    basis = spark.createDataFrame([(s,) for s in (1, 2, 4)], "lo bigint")
    exact = np.linalg.eigvalsh(ap.Local(np.array([1, 2, 4]), h).dense())
    few = krylov.Settings(krylov_dim=1, min_iterations=1)
    _, state = krylov.distributed_lanczos(basis, h, 8, few)
    krylov.save_state(state, str(tmp_path / "k"))
    r, _ = krylov.distributed_lanczos(basis, h, 8, krylov.Settings(krylov_dim=6, min_iterations=2), resume=krylov.load_state(spark, str(tmp_path / "k")))
    assert r.values[0] == pytest.approx(exact[0], abs=1e-8)


def test_expectations_against_numpy(spark):
    states = np.array([r["lo"] for r in enumeration.ice_states(spark, LAT8).collect()])
    ops = [OpSum.of((1.0, "0+ 2-"), (0.5, "4Z")), OpSum.of((2.0, "2+ 0-")), OpSum.of((1.0, Term.parse("1P")))]
    local = [ap.Local(states, o) for o in ops]
    x = np.stack([krylov.start_vector(local[0].states, k) for k in range(2)], 1)
    df = spark.createDataFrame([(int(s), v, float(x[i, v])) for i, s in enumerate(local[0].states) for v in range(2)], "lo bigint, vec int, x double")
    got = {(r["op"], r["i"], r["j"]): r["val"] for r in observables.expectations(df, ops, 8).collect()}
    cross = {(r["l"], r["m"], r["i"], r["j"]): r["val"] for r in observables.cross_correlations(df, ops, 8).collect()}
    for k, a in enumerate(local):
        m = x.T @ (a @ x)
        for i in range(2):
            for j in range(2):
                assert got.get((k, i, j), 0.0) == pytest.approx(m[j, i])
                for n, b in enumerate(local):
                    assert cross.get((k, n, i, j), 0.0) == pytest.approx((a @ x[:, i]) @ (b @ x[:, j]))


def test_partial_volumes_are_symmetric_sums():
    for total, _ in hamiltonians.partial_volumes(LAT32, 2)[:3]:
        assert all(c > 0 for c in total.parts.values())


def test_field_needs_a_new_file():
    lat = pyrochlore((1, 0, 0), (0, 1, 0), (0, 0, 2))
    lat.version = "1.0"
    with pytest.raises(ValueError):
        hamiltonians.field_hamiltonian(lat, 0.1, (0, 0, 1))


def test_splines_roots_and_fits():
    x = np.array([0.0, 1.0, 2.5, 3.0, 5.0])
    at = np.array([-1.0, 0.0, 0.7, 2.5, 4.9, 6.0])
    got = sweep.spline(x, x**3 - x, at)
    assert np.isnan(got[[0, -1]]).all() and np.allclose(got[1:-1], (at**3 - at)[1:-1])
    assert sweep.root(lambda v: v * v - 2, 0, 2) == pytest.approx(2**0.5) and sweep.root(lambda v: 1.0, 0, 1) is None
    t0, a = sweep.runtime_model(np.array([1.0, 2, 3]), 0.5 + 2 * np.exp([1.0, 2, 3]))
    assert (t0, a) == pytest.approx((0.5, 2.0))


def test_distributed_eigenpairs_are_the_dense_ones(spark):
    lat = pyrochlore((1, 0, 0), (0, 2, 0), (0, 0, 2))
    basis = enumeration.ice_states(spark, lat).select("lo").cache()
    h = hamiltonians.ring_hamiltonian(lat, [1.0, -0.2, -0.2, -0.2], repeated=False) + OpSum.of(*[(0.1 * (k % 3), f"{a}Z {b}Z") for k, (a, b, _) in enumerate(lat.bonds[:20])])
    want, _ = krylov.eigenpairs(basis, h, 16, 2)
    values, vectors = krylov.eigenpairs(basis, h, 16, 2, local=0)
    assert values == pytest.approx(want, abs=1e-9)
    states = np.array([r["lo"] for r in basis.collect()])
    a, v = ap.Local(states, h), np.zeros((len(states), 2))
    place = {int(x): i for i, x in enumerate(a.states)}
    for r in vectors.collect():
        v[place[r["lo"]], r["vec"]] = r["x"]
    assert np.abs(v.T @ v - np.eye(2)).max() < 1e-9
    assert np.abs(a @ v - v * values).max() < 1e-8
    assert all(v[np.abs(v[:, i]).argmax(), i] > 0 for i in range(2))


def test_distributed_eigenpairs_of_two_words(spark):
    """Four states of 66 sites; one pair of sites may swap, so that each value comes twice. More are asked for than there are."""
    masks = [(1 << i | 1 << (i + 33), 1, 1) for i in range(33)]
    basis = enumeration.enumerate_states(spark, 66, [*masks, ((1 << 31) - 1, 0, 0)], order=[i for k in range(33) for i in (k, k + 33)]).select("lo", "hi").cache()
    values, vectors = krylov.eigenpairs(basis, OpSum.of((1.0, "31+ 64-"), (1.0, "31- 64+")), 66, 6)
    assert values == pytest.approx([-1, -1, 1, 1], abs=1e-9)
    rows = vectors.collect()
    assert len(rows) == 16 and sum(r["x"] ** 2 for r in rows) == pytest.approx(4)
