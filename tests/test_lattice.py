import pytest

from spinmill.operators.enumeration import frontier_sizes, parse_seed
from spinmill.sources.lattice import Lattice, constraint_file, group, pyrochlore, random_supercells, smith, symmetries

SMALL = {8: ((1, 0, 0), (0, 1, 0), (0, 0, 2)), 12: ((1, 0, 0), (0, 1, 0), (0, 0, 3)), 16: ((1, 0, 0), (0, 2, 0), (0, 0, 2)), 32: ((2, 0, 0), (0, 2, 0), (0, 0, 2))}


@pytest.mark.parametrize("n", SMALL)
def test_counts_and_incidence(n):
    lat = pyrochlore(*SMALL[n])
    assert lat.n_sites == n == len(lat.rings) == 2 * len(lat.tetras) == 2 * len(lat.volumes) and len(lat.bonds) == 3 * n
    assert all(sum(s in m for _, _, m in lat.tetras) == 2 for s in range(n))
    assert all(len(m) == 4 and len(set(m)) == 4 for _, _, m in lat.tetras)
    for _, sl, members, signs in lat.rings:
        assert len(members) == 6 and sl not in {lat.sites[m][1] for m in members} and signs == [-1, 1] * 3
        # Neighbours around a ring share a tetrahedron.
        for a, b in zip(members, members[1:] + members[:1]):
            assert any(a in t and b in t for _, _, t in lat.tetras) or a == b
    for _, _, faces in lat.volumes:
        assert sorted(lat.rings[f][1] for f in faces) == [0, 1, 2, 3]


@pytest.mark.parametrize(("n", "states"), [(8, 18), (12, 54), (16, 114), (32, 2970)])
def test_states_by_order(n, states):
    lat = pyrochlore(*SMALL[n])
    sizes = frontier_sizes(lat, lat.order("greedy"))
    assert sizes[-1] == states
    if n == 32:
        assert max(sizes) == 3990
    else:
        assert frontier_sizes(lat, lat.order("random", 3))[-1] == frontier_sizes(lat, lat.order("none"))[-1] == states


def test_smith_form():
    for v in random_supercells(30, 40, seed=2):
        d, u = smith([list(r) for r in v])
        det = lambda m: m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
        assert d[0] * d[1] * d[2] == abs(det(v)) and abs(det(u)) == 1
    with pytest.raises(ValueError):
        pyrochlore((1, 0, 0), (2, 0, 0), (0, 0, 1))


def test_oblique_supercell():
    lat = pyrochlore((1, 1, 0), (-1, 1, 0), (0, 0, 1))
    assert lat.n_sites == 8 and all(sum(s in m for _, _, m in lat.tetras) == 2 for s in range(8))


def test_json_round_trip_and_old_files():
    import json

    lat = pyrochlore(*SMALL[8])
    again = Lattice.from_dict(json.loads(lat.to_json()))
    assert again.to_json() == lat.to_json()
    old = json.loads(lat.to_json())
    for r in old["rings"]:
        del r["signs"]
    del old["__version__"]
    assert [r[3] for r in Lattice.from_dict(old).rings] == [r[3] for r in lat.rings] and Lattice.from_dict(old).version is None


def test_symmetries_keep_tetrahedra():
    lat = pyrochlore(*SMALL[16])
    moves = symmetries(lat, inversion=True)
    tetras = {frozenset(m) for _, _, m in lat.tetras}
    assert moves and all({frozenset(p[s] for s in t) for t in tetras} == tetras for p in moves)
    assert len(group(symmetries(lat))) == 4
    cube = pyrochlore((2, 0, 0), (0, 2, 0), (0, 0, 2))
    turn, mirror = ((0, 1, 0), (0, 0, 1), (1, 0, 0)), ((0, 1, 0), (1, 0, 0), (0, 0, 1))
    moves = symmetries(cube, translations=False, linear=(turn, mirror))
    assert len(moves) == 2 and len(group(moves)) == 6


def test_deleted_sites_and_permutations():
    lat = pyrochlore(*SMALL[16])
    less = lat.without({3, 9})
    assert less.n_sites == 14 and sum(len(m) for _, _, m in less.tetras) == 28 and all(len(m) == 6 for _, _, m, _ in less.rings)
    order = lat.order("greedy")
    moved = lat.permuted(order)
    back = {k: s for k, s in enumerate(order)}
    assert [{back[m] for m in t[2]} for t in moved.tetras] == [set(t[2]) for t in lat.tetras]
    with pytest.raises(ValueError):
        lat.order("sideways")


def test_constraint_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"version": 1, "max-id": 4, "constraints": [{"indices": [0, 1, 4], "max-up": 2, "min-up": 1}]}')
    assert constraint_file(spark, str(tmp_path / "c.json")) == (5, [(0b10011, 1, 2)])


def test_seeds():
    assert parse_seed("0x1,0x2") == (1 << 64) + 2 and parse_seed("0xff") == 255
    for bad in ("zz", "1,2,3"):
        with pytest.raises(ValueError):
            parse_seed(bad)
