import random

import pytest
from pyspark.sql import functions as F

from spinmill.functions.bits import State, inverse, names, permute_int, signed
from spinmill.operators import sectors
from spinmill.sources import store

RNG = random.Random(11)
WIDE = [0, 1, 2**128 - 1, 1 << 127, 1 << 64, (1 << 64) - 1] + [RNG.getrandbits(128) for _ in range(30)]


def table(spark, states, n):
    cols = names(n)
    return spark.createDataFrame([tuple(signed(s >> 64 * k) for k in range(len(cols))) for s in states], ", ".join(f"{c} bigint" for c in cols))


def number(row, prefix=""):
    return (row[prefix + "lo"] & (2**64 - 1)) | ((row[prefix + "hi"] & (2**64 - 1)) << 64)


def test_wide_functions(spark):
    mask, to = RNG.getrandbits(128), RNG.sample(range(128), 128)
    s = State.of(128)
    made = {"and": s & mask, "or": s | mask, "xor": s ^ mask, "not": ~s, "perm": s.permuted(to), "back": s.permuted(to).permuted(inverse(to)), "set": s.set(100), "flip": s.flip(3)}
    for n in (0, 1, 5, 63, 64, 65, 127, 128):
        made[f"l{n}"], made[f"r{n}"] = s << n, s >> n
    cols = [c for k, x in made.items() for c in x.named(k)]
    rows = table(spark, WIDE, 128).select("lo", "hi", *cols, s.popcount().alias("ones"), s.highest().alias("top"), s.get(77).alias("bit"), s.to_hex().alias("hex"), s.equals(WIDE[7]).alias("same")).collect()
    full = 2**128 - 1
    for r in rows:
        x = number(r)
        want = {"and": x & mask, "or": x | mask, "xor": x ^ mask, "not": ~x & full, "perm": permute_int(x, to), "back": x, "set": x | 1 << 100, "flip": x ^ 8}
        want |= {f"l{n}": x << n & full for n in (0, 1, 5, 63, 64, 65, 127, 128)} | {f"r{n}": x >> n for n in (0, 1, 5, 63, 64, 65, 127, 128)}
        assert {k: number(r, k) for k in want} == want
        assert (r["ones"], r["top"], r["bit"], r["hex"], r["same"]) == (x.bit_count(), x.bit_length() - 1, x >> 77 & 1, f"0x{x:032x}", x == WIDE[7])


def test_unsigned_order(spark):
    df = table(spark, WIDE, 128)
    assert [number(r) for r in df.orderBy(*State.of(128).order()).collect()] == sorted(WIDE)
    pairs = df.crossJoin(F.broadcast(df.withColumnsRenamed({"lo": "a", "hi": "b"})))
    for r in pairs.select("*", State("lo", "hi").below(State("a", "b")).alias("lt")).collect():
        assert r["lt"] == (number(r) < ((r["a"] & (2**64 - 1)) | (r["b"] & (2**64 - 1)) << 64))


@pytest.mark.parametrize("n", [40, 128])
def test_files(spark, tmp_path, n):
    states = sorted({x & (2**n - 1) for x in WIDE})
    df = table(spark, states, n)
    store.write_csv(df, str(tmp_path / "b.csv"), n)
    lines = [r[0] for r in spark.read.text(str(tmp_path / "b.csv")).collect()]
    assert sorted(lines) == [f"0x{s:032x}" for s in states]
    store.write_basis(df, str(tmp_path / "b.parquet"), n)
    for path in ("b.csv", "b.parquet"):
        got = store.read_basis(spark, str(tmp_path / path), n)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        store.read_basis(spark, "b.bin", n)


def test_malformed_lines_fail(spark, tmp_path):
    (tmp_path / "x.csv").write_text("0x01\nnonsense\n")
    with pytest.raises(Exception, match="no state"):
        store.read_csv(spark, str(tmp_path / "x.csv"), 8).collect()


def test_sector_folders_prune(spark, tmp_path):
    df = table(spark, range(256), 8)
    store.write_basis(df, str(tmp_path / "s.parquet"), 8, sectors=[0x0F, 0xF0])
    got = store.read_basis(spark, str(tmp_path / "s.parquet"), 8, sector=[1, 4])
    assert sorted(r["lo"] for r in got.collect()) == [0xF1, 0xF2, 0xF4, 0xF8]
    assert "PartitionFilters: [isnotnull(s0" in got._jdf.queryExecution().toString()
    sizes = store.manifest(spark.read.parquet(str(tmp_path / "s.parquet")), ["s0", "s1"]).collect()
    assert sum(r["size"] for r in sizes) == 256 and all(r["shards"] for r in sizes)


def test_paths_and_names():
    p = store.basis_path("a/pyro.json", 2, partitioned=True)
    assert p == "a/pyro.2.basis.partitioned.parquet" and store.lattice_of(p) == ("a/pyro.json", 2)
    assert store.key_values("g=1%x=-2.5%.out") == {"g": "1", "x": "-2.5"}
    with pytest.raises(ValueError):
        store.lattice_of("a.parquet")


def test_matrix_market(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 0.1), (3, 3, -2.0)], "row bigint, col bigint, val double")
    store.write_matrix_market(df, 3, str(tmp_path / "m"))
    assert sorted(map(tuple, store.read_matrix_market(spark, str(tmp_path / "m")).collect())) == [(1, 2, 0.1), (3, 3, -2.0)]


def test_set_operations_and_orbits(spark):
    a, b = table(spark, [1, 2, 3, 3], 8), table(spark, [3, 4, 4], 8)
    union, fresh = sectors.inserted(a.distinct(), b, 8)
    assert sorted(r["lo"] for r in union.collect()) == [1, 2, 3, 4] and [r["lo"] for r in fresh.collect()] == [4]
    turn = [[(i + k) % 8 for i in range(8)] for k in range(1, 8)]
    got = sectors.orbits(table(spark, range(256), 8), turn, 8).collect()
    assert len(got) == 36 and sum(r["size"] for r in got) == 256
    wide = sectors.orbits(table(spark, [1 << 70, 1 << 71, 1], 128), [[(i + k) % 128 for i in range(128)] for k in range(1, 128)][:2], 128)
    assert wide.count() >= 1
