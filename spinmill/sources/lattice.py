"""Lattices of corner-sharing tetrahedra: generated from a supercell, read from JSON, and as tables."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the geometry: primitive vectors; sites, rings and volumes in the primitive cell, and what surrounds them.
PRIMITIVE = [(0, 4, 4), (4, 0, 4), (4, 4, 0)]
SITES = [(0, 0, 0), (0, 2, 2), (2, 0, 2), (2, 2, 0)]
TETRA = (1, 1, 1)
RINGS = [(4, 4, 4), (4, 2, 2), (2, 4, 2), (2, 2, 4)]
AROUND = [
    [(0, -2, 2), (2, -2, 0), (2, 0, -2), (0, 2, -2), (-2, 2, 0), (-2, 0, 2)],
    [(0, 2, -2), (2, 2, 0), (2, 0, 2), (0, -2, 2), (-2, -2, 0), (-2, 0, -2)],
    [(0, -2, -2), (-2, -2, 0), (-2, 0, 2), (0, 2, 2), (2, 2, 0), (2, 0, -2)],
    [(0, 2, 2), (-2, 2, 0), (-2, 0, -2), (0, -2, -2), (2, -2, 0), (2, 0, 2)],
]
VOLUMES = [(3, 3, 3), (5, 5, 5)]
FACES = [(-1, -1, -1), (-1, 1, 1), (1, -1, 1), (1, 1, -1)]
PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (2, 3), (3, 1)]


def add(a, b, k: int = 1):
    return tuple(x + k * y for x, y in zip(a, b))


def smith(m: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """(d, u): u m v is diagonal with entries d, for some unimodular u and v."""
    a, n = [list(r) for r in m], len(m)
    u = [[int(i == j) for j in range(n)] for i in range(n)]
    for k in range(n):
        while True:
            entries = [(abs(a[i][j]), i, j) for i in range(k, n) for j in range(k, n) if a[i][j]]
            if not entries:
                raise ValueError("the supercell's vectors are dependent")
            _, i, j = min(entries)
            a[k], a[i], u[k], u[i] = a[i], a[k], u[i], u[k]
            for r in a:
                r[k], r[j] = r[j], r[k]
            p = a[k][k]
            for i in range(k + 1, n):
                q = a[i][k] // p
                a[i], u[i] = [x - q * y for x, y in zip(a[i], a[k])], [x - q * y for x, y in zip(u[i], u[k])]
            for j in range(k + 1, n):
                q = a[k][j] // p
                for r in a:
                    r[j] -= q * r[k]
            if not any(a[i][k] for i in range(k + 1, n)) and not any(a[k][j] for j in range(k + 1, n)):
                break
    return [abs(a[k][k]) for k in range(n)], u


@dataclass
class Lattice:
    """sites: (xyz, sublattice); tetras and volumes: (xyz, sublattice, members); rings also have signs; bonds: (from, to, color)."""

    sites: list[tuple]
    tetras: list[tuple]
    rings: list[tuple] = field(default_factory=list)
    volumes: list[tuple] = field(default_factory=list)
    bonds: list[tuple] = field(default_factory=list)
    vectors: list[tuple] = field(default_factory=list)
    neighbour2: list[list[int]] = field(default_factory=list)
    neighbour4: list[list[int]] = field(default_factory=list)
    limits: dict[int, tuple[int, int]] = field(default_factory=dict)
    version: str | None = "1.1"

    @property
    def n_sites(self) -> int:
        return len(self.sites)

    def constraints(self) -> list[tuple[int, int, int]]:
        """(mask, least and most spins up) of each tetrahedron: half its members, unless set otherwise."""
        out = []
        for k, (_, _, members) in enumerate(self.tetras):
            mask = sum(1 << s for s in set(members))
            out.append((mask, *self.limits.get(k, (len(members) // 2, (len(members) + 1) // 2))))
        return out

    def sublattice_masks(self) -> list[int]:
        masks = [0] * (1 + max((s for _, s in self.sites), default=-1))
        for i, (_, s) in enumerate(self.sites):
            masks[s] |= 1 << i
        return masks

    def permuted(self, order: list[int]) -> Lattice:
        """Site order[k] becomes site k."""
        new = {old: k for k, old in enumerate(order)}
        move = lambda xs: [new[x] for x in xs]
        return Lattice(
            [self.sites[i] for i in order], [(x, s, move(m)) for x, s, m in self.tetras], [(x, s, move(m), g) for x, s, m, g in self.rings],
            self.volumes, [(new[a], new[b], c) for a, b, c in self.bonds], self.vectors, [move(m) for m in self.neighbour2],
            [move(m) for m in self.neighbour4], self.limits, self.version,
        )

    def without(self, gone: set[int]) -> Lattice:
        """Without some sites: indices move up, bonds and rings of the lost sites go, tetrahedra lose members."""
        left = [i for i in range(self.n_sites) if i not in gone]
        new = {old: k for k, old in enumerate(left)}
        rings = [(x, s, [new[m] for m in ms], g) for x, s, ms, g in self.rings if not gone & set(ms)]
        return Lattice(
            [self.sites[i] for i in left], [(x, s, [new[m] for m in ms if m in new]) for x, s, ms in self.tetras], rings, [],
            [(new[a], new[b], c) for a, b, c in self.bonds if a in new and b in new], self.vectors, version=self.version,
        )

    def order(self, kind: str = "greedy", seed: int = 0, first: int = 0) -> list[int]:
        """Which site to decide next: as they stand, at random by seed, or by tetrahedra already begun (lowest index in ties)."""
        n = self.n_sites
        if kind == "none":
            return list(range(n))
        if kind == "random":
            return random.Random(seed).sample(range(n), n)
        if kind != "greedy":
            raise ValueError(f"no order {kind!r}")
        of: list[set[int]] = [set() for _ in range(n)]
        for k, (_, _, members) in enumerate(self.tetras):
            for m in members:
                of[m].add(k)
        out, begun, left = [first], set(of[first]), set(range(n)) - {first}
        while left:
            best = min(left, key=lambda i: (-len(of[i] & begun), i))
            out.append(best)
            begun |= of[best]
            left.remove(best)
        return out

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        return {
            "atoms": spark.createDataFrame([(i, *map(float, x), s) for i, (x, s) in enumerate(self.sites)], "idx int, x double, y double, z double, sl int"),
            "tetra_member": spark.createDataFrame([(k, s, m) for k, (_, s, ms) in enumerate(self.tetras) for m in ms], "tetra int, sl int, site int"),
            "ring_member": spark.createDataFrame([(k, s, p, m, g) for k, (_, s, ms, gs) in enumerate(self.rings) for p, (m, g) in enumerate(zip(ms, gs))], "ring int, sl int, pos int, site int, sign int"),
            "vols": spark.createDataFrame([(k, s, list(ms)) for k, (_, s, ms) in enumerate(self.volumes)], "vol int, sl int, rings array<int>"),
            "bonds": spark.createDataFrame([(a, b, c) for a, b, c in self.bonds], "a int, b int, color int"),
        }

    def to_json(self) -> str:
        xyz = lambda x: [float(v) for v in x]
        return json.dumps({
            "__version__": self.version or "1.1", "lattice_vectors": {f"A{i}": xyz(v) for i, v in enumerate(self.vectors)},
            "primitive": {"lattice_vectors": {f"a{i}": xyz(v) for i, v in enumerate(PRIMITIVE)}},
            "atoms": [{"xyz": xyz(x), "sl": str(s)} for x, s in self.sites],
            "bonds": [{"from_idx": a, "to_idx": b, "color": c, "bond_delta": []} for a, b, c in self.bonds],
            "tetrahedra": [{"xyz": xyz(x), "sl": s, "member_spin_idx": list(m)} for x, s, m in self.tetras],
            "rings": [{"xyz": xyz(x), "sl": s, "member_spin_idx": list(m), "signs": list(g)} for x, s, m, g in self.rings],
            "vols": [{"xyz": xyz(x), "sl": s, "member_plaq_idx": list(m)} for x, s, m in self.volumes],
        })

    @staticmethod
    def from_dict(d: dict) -> Lattice:
        """Rings without signs get alternating ones, the first down."""
        signs = lambda r: list(r.get("signs") or [(-1) ** (k + 1) for k in range(len(r["member_spin_idx"]))])
        return Lattice(
            [(tuple(a["xyz"]), int(a["sl"])) for a in d["atoms"]],
            [(tuple(t["xyz"]), int(t["sl"]), list(t["member_spin_idx"])) for t in d["tetrahedra"]],
            [(tuple(r["xyz"]), int(r["sl"]), list(r["member_spin_idx"]), signs(r)) for r in d.get("rings", [])],
            [(tuple(v["xyz"]), int(v["sl"]), list(v["member_plaq_idx"])) for v in d.get("vols", [])],
            [(b["from_idx"], b["to_idx"], b.get("color", 0)) for b in d.get("bonds", [])],
            [tuple(v) for v in d.get("lattice_vectors", {}).values()], d.get("neighbour2", []), d.get("neighbour4", []), version=d.get("__version__"),
        )


def read_json(spark: SparkSession, path: str) -> Lattice:
    """A lattice file from anywhere that Spark reads; it is small by its limit of 128 sites."""
    text = spark.read.text(path, wholetext=True).first()
    if text is None:
        raise ValueError(f"{path} is empty")
    return Lattice.from_dict(json.loads(text[0]))


def constraint_file(spark: SparkSession, path: str) -> tuple[int, list[tuple[int, int, int]]]:
    """(sites, constraints) from the generic format: indices, max-up and min-up of each constraint."""
    d = json.loads(spark.read.text(path, wholetext=True).first()[0])
    made = [(sum(1 << i for i in set(c["indices"])), c["min-up"], c["max-up"]) for c in d["constraints"]]
    return int(d["max-id"]) + 1, made


def pyrochlore(*supercell: tuple[int, int, int]) -> Lattice:
    """The lattice with periods given in primitive vectors, such as (2,0,0), (0,2,0), (0,0,2). Sites are numbered by sublattice."""
    m = [[supercell[j][i] for j in range(3)] for i in range(3)]
    d, u = smith(m)
    n_cells = d[0] * d[1] * d[2]

    def cell(n) -> int:
        i = [sum(u[r][c] * n[c] for c in range(3)) % d[r] for r in range(3)]
        return (i[0] * d[1] + i[1]) * d[2] + i[2]

    def primitive(x) -> tuple[int, int, int]:
        """Coordinates along the primitive vectors of a lattice translation."""
        s = [(-x[0] + x[1] + x[2]), (x[0] - x[1] + x[2]), (x[0] + x[1] - x[2])]
        if any(v % 8 for v in s):
            raise ValueError(f"{x} is no translation")
        return tuple(v // 8 for v in s)

    place: dict[int, tuple] = {}
    most = max(sum(abs(x) for x in v) for v in supercell) + 1
    for r in range(most * 3):
        if len(place) == n_cells:
            break
        for i in range(r + 1):
            for j in range(r + 1 - i):
                n = (r - i - j, j, i)
                place.setdefault(cell(n), n)
    cells = [place[k] for k in range(n_cells)]
    at = lambda n: tuple(sum(n[c] * PRIMITIVE[c][k] for c in range(3)) for k in range(3))

    def index(x, anchors) -> int:
        """Number of the thing at x among those at anchors plus translations, numbered by anchor."""
        for k, p in enumerate(anchors):
            rest = add(x, p, -1)
            s = [(-rest[0] + rest[1] + rest[2]), (rest[0] - rest[1] + rest[2]), (rest[0] + rest[1] - rest[2])]
            if not any(v % 8 for v in s):
                return k * n_cells + cell(primitive(rest))
        raise ValueError(f"nothing at {x}")

    site = lambda x: index(x, SITES)
    sites = [(add(at(n), p), k) for k, p in enumerate(SITES) for n in cells]
    tetras = [(add(at(n), TETRA), 0, [site(add(at(n), p)) for p in SITES]) for n in cells]
    tetras += [(add(at(n), TETRA, -1), 1, [site(add(at(n), p, -1)) for p in SITES]) for n in cells]
    rings = [(add(at(n), p), k, [site(add(add(at(n), p), o)) for o in AROUND[k]], [-1, 1] * 3) for k, p in enumerate(RINGS) for n in cells]
    volumes = [(add(at(n), p), k, [index(add(add(at(n), p), f, -1 if k == 0 else 1), RINGS) for f in FACES]) for k, p in enumerate(VOLUMES) for n in cells]
    bonds = []
    for color, (a, b) in enumerate(PAIRS):
        for sign in (1, -1):
            for n in cells:
                x = add(at(n), SITES[a])
                bonds.append((site(x), site(add(x, add(SITES[b], SITES[a], -1), sign)), color))
    vectors = [at(v) for v in supercell]
    return Lattice(sites, tetras, rings, volumes, bonds, vectors)


def symmetries(lat: Lattice, translations: bool = True, inversion: bool = False, linear: tuple = ()) -> list[list[int]]:
    """Site permutations (site n goes to p[n]) by primitive translations, inversion and other whole-number matrices
    (rotations, reflections) about site 0, as far as they fit the lattice."""
    where = {}
    cells = [v for v in lat.vectors]

    def reduced(x):
        key = []
        det = lambda a, b, c: a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
        total = det(*cells)
        for k in range(3):
            v = list(cells)
            v[k] = x
            key.append(det(*v) * (1 if total > 0 else -1) % abs(total))
        return tuple(key)

    for i, (x, _) in enumerate(lat.sites):
        where[reduced(x)] = i
    moves = [lambda x, v=v: add(x, v) for v in PRIMITIVE] if translations else []
    if inversion:
        moves.append(lambda x: tuple(-v for v in x))
    moves += [lambda x, m=m: tuple(sum(m[r][c] * x[c] for c in range(3)) for r in range(3)) for m in linear]
    made = [[where.get(reduced(f(x)), -1) for x, _ in lat.sites] for f in moves]
    return [p for p in made if sorted(p) == list(range(lat.n_sites))]


def group(generators: list[list[int]], most: int = 100_000) -> list[tuple[int, ...]]:
    """All products of the generators."""
    if not generators:
        return []
    one = tuple(range(len(generators[0])))
    seen, edge = {one}, [one]
    while edge:
        edge = [q for p in edge for g in generators if (q := tuple(g[i] for i in p)) not in seen and not seen.add(q)]
        if len(seen) > most:
            raise ValueError(f"the group has more than {most} members")
    return sorted(seen)


def random_supercells(n: int, most_cells: int, seed: int = 0) -> list[tuple]:
    """Supercells of at most so many primitive cells, by seed."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        v = tuple(tuple(rng.randint(-2, 2) for _ in range(3)) for _ in range(3))
        det = v[0][0] * (v[1][1] * v[2][2] - v[1][2] * v[2][1]) - v[0][1] * (v[1][0] * v[2][2] - v[1][2] * v[2][0]) + v[0][2] * (v[1][0] * v[2][1] - v[1][1] * v[2][0])
        if 0 < abs(det) <= most_cells:
            out.append(v)
    return out


def tetra_pairs(lat: Lattice, spark: SparkSession) -> DataFrame:
    """bonds with the sublattices of both ends."""
    t = lat.tables(spark)
    atoms = t["atoms"].select("idx", "sl")
    joined = t["bonds"].join(atoms.withColumnsRenamed({"idx": "a", "sl": "sl_a"}), "a")
    return joined.join(atoms.withColumnsRenamed({"idx": "b", "sl": "sl_b"}), "b").select("a", "b", "color", "sl_a", "sl_b", F.lit(1).alias("n"))
