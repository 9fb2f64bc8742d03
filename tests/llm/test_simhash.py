import re

import numpy as np
import pytest
import xxhash

from spinmill.llm import simhash as sh


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=4):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(fps))]


@pytest.mark.parametrize("kind", ["odd", "table"])
def test_against_brute_force(spark, frame, rows, odd_rows, kind):
    data = odd_rows if kind == "odd" else rows
    got = sh.near_duplicates(frame(data, extra=("fp", "root", "id") if kind == "odd" else ())).collect()
    fps = [fingerprint(r["text"]) for r in data]
    group = classes(fps)
    least = {}
    for r, g in zip(data, group):
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], f, least.get(g)) for r, f, g in zip(data, fps, group)), key=str)
    assert sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in got), key=str) == want


def test_empty_table(spark, frame):
    assert sh.near_duplicates(frame([])).count() == 0


@pytest.mark.parametrize("step", [1, 7, 64, 1000])
def test_majorities_in_steps(step):
    rng = np.random.default_rng(8)
    counts = np.array([0, 3, 1, 0, 200, 2, 50, 0])
    h = rng.integers(0, 2**63, counts.sum(), dtype=np.uint64)
    ends = np.cumsum(counts)
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[e - c : e]) > c) for c, e in zip(counts, ends)]
    assert sh.majorities(h, counts, step).tolist() == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 6, 7, 8, 26, 63])
def test_counters_agree_with_popcounts(radius):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 150, dtype=np.uint64)
    for flips in range(40):
        a[flips] = a[flips + 100] ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, flips % 9, replace=False).astype(np.uint64)) if flips % 9 else a[flips + 100]
    planes = sh.bit_planes(a)[:, :-1]
    q = a[17]
    bits = [~np.uint64(0) if int(q) >> k & 1 else np.uint64(0) for k in range(64)]
    hit = sh._lanes(sh.within_radius(lambda k: planes[k], lambda k: bits[k], radius), 150)
    assert hit.tolist() == np.flatnonzero(np.bitwise_count(a ^ q) <= radius).tolist()


@pytest.mark.parametrize(("n", "groups"), [(300, 40), (500, 3), (900, 1)])
def test_small_and_large_groups_agree(n, groups):
    rng = np.random.default_rng(n)
    core = rng.integers(0, 2**63, max(2, n // 10), dtype=np.uint64)
    fps = core[rng.integers(0, len(core), n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    group = np.sort(rng.integers(0, groups, n))
    size = np.bincount(group)[group]
    order = np.lexsort((group, -size))
    f, g, s = fps[order], group[order], size[order]
    root = sh.roots_of(n, *sh.small_links(f, g, s, 4))
    for k in np.unique(g):
        own = np.flatnonzero(g == k)
        assert (own[sh.large_roots(f[own], 4)] == root[own]).all()
        want = classes([int(x) for x in f[own]])
        assert len(set(zip(want, root[own].tolist()))) == len(set(want)) == len(set(root[own].tolist()))


@pytest.mark.parametrize("n", [10, 10**7, 10**10])
def test_bands_cover_the_radius(n):
    masks = sh.bands(n)
    rng = np.random.default_rng(2)
    for _ in range(200):
        diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(diff & m == 0 for m in masks)


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(9)
    fps = sorted({int(1 << a | 1 << b) for a, b in rng.integers(0, 40, (150, 2))})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    comps = {r["node"]: r["root"] for r in sh.components(sh.links(df, 4, tile=16)).collect()}
    want = classes(fps)
    got = [comps.get(f, f) for f in fps]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1001 + i) for i in range(30)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in sh.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{1001 + i: 1000 for i in range(30)}}
