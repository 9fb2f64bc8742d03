"""Further queries: storage round trips, solvers on sums with a known spectrum, Hamiltonians, sweep helpers."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import functions as F

from ..functions.algebra import OpSum
from ..functions.bits import State
from ..functions.couplings import spacing
from ..operators import apply as ap
from ..operators import enumeration, hamiltonians, krylov, sectors, sweep
from ..sources import store
from ..sources.lattice import read_json
from .catalog import CELL16, FULL, MASKS, N, ORACLES, STATES, _wide, _WIDE, applied_sql, query, read, values, vector


def _folder(spark, name: str) -> str:
    return f"{store.checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {STATES} SELECT lo FROM s")
def basis_text(spark, sf):
    """Written as lines of hexadecimal digits and read back."""
    path = _folder(spark, "basis") + ".csv"
    store.write_csv(vector(spark, sf).select("lo"), path, N)
    return store.read_basis(spark, path, N)


@query(f"WITH {STATES} SELECT lo FROM s WHERE " + " AND ".join(f"bit_count(lo & {m}) = 2" for m in MASKS))
def basis_by_sector(spark, sf):
    """Written by sector, and one sector read back."""
    path = _folder(spark, "basis") + ".parquet"
    store.write_basis(vector(spark, sf).select("lo"), path, N, sectors=MASKS)
    return store.read_basis(spark, path, N, [2] * len(MASKS))


@query(f"WITH {STATES} SELECT " + ", ".join(f"CAST(bit_count(lo & {m}) AS INT) AS s{k}" for k, m in enumerate(MASKS)) + ", count(*) AS size, true AS found FROM s GROUP BY ALL")
def sector_manifest(spark, sf):
    """Rows of each sector's files."""
    path = _folder(spark, "basis") + ".parquet"
    store.write_basis(vector(spark, sf).select("lo"), path, N, sectors=MASKS)
    keys = [f"s{k}" for k in range(len(MASKS))]
    return store.manifest(spark.read.parquet(path), keys).select(*keys, "size", (F.size("shards") > 0).alias("found"))


@query(f"SELECT lo + 1 AS row, from_lo + 1 AS col, val FROM ({ORACLES['sparse_triplets']})")
def matrix_market(spark, sf):
    """A matrix written in coordinates and read back."""
    path = _folder(spark, "matrix")
    t = ap.triplets(vector(spark, sf), FULL, N)
    store.write_matrix_market(t.select((F.col("lo") + 1).alias("row"), (F.col("from_lo") + 1).alias("col"), "val"), 1 << N, path)
    return store.read_matrix_market(spark, path)


_RINGS = ", ".join(f"({sl}, {m})" for _, sl, m, _ in CELL16.rings)


@query(f"WITH r(sl, m) AS (VALUES {_RINGS}) SELECT sl, count(*) AS n, count(*) FILTER (len(list_distinct(m)) = len(m)) AS simple FROM r GROUP BY 1")
def ring_members(spark, sf):
    """Rings by sublattice, and those that pass no site twice; the lattice from its file."""
    path = _folder(spark, "lattice")
    spark.createDataFrame([(CELL16.to_json(),)], "value string").coalesce(1).write.text(path)
    lat = read_json(spark, path)
    count = lambda **k: [sl for _, _, sl in hamiltonians.ring_terms(lat, **k)]
    every, simple = count(), count(repeated=False)
    return spark.createDataFrame([(sl, every.count(sl), simple.count(sl)) for sl in sorted(set(every))], "sl int, n bigint, simple bigint")


_VOLUMES = OpSum()
for _part, _sl in hamiltonians.partial_volumes(CELL16, 0):
    for _t, _c in _part.parts.items():
        _VOLUMES.add(float(_c) * (1 + _sl), _t)
_FIELD = hamiltonians.field_hamiltonian(CELL16, 0.31, (0.23, -0.47, 0.71), repeated=False)


@query(f"WITH {STATES}, {values(_VOLUMES)} {applied_sql(_VOLUMES)}")
def partial_volumes(spark, sf):
    df = vector(spark, sf)
    return ap.apply(df, _VOLUMES, N)


@query(f"WITH {STATES}, {values(_FIELD)} SELECT lo, round(x, 5) + 0.0 AS x FROM ({applied_sql(_FIELD)})")
def field_hamiltonian(spark, sf):
    return ap.apply(vector(spark, sf), _FIELD, N).select("lo", (F.round("x", 5) + F.lit(0.0)).alias("x"))


#: Four pairs of sites of which one is up; each may swap, at a cost of its own: all signs of the costs are the spectrum.
_COSTS = [1.0, 2.0, 4.0, 8.0]
_PAIRS = OpSum.of(*[(c, f"{2 * k}{a} {2 * k + 1}{b}") for k, c in enumerate(_COSTS) for a, b in ("+-", "-+")])


def _pairs(spark):
    return enumeration.enumerate_states(spark, 8, [(3 << 2 * k, 1, 1) for k in range(4)]).select("lo")


_SPECTRUM = "SELECT " + " + ".join(f"{c} * s{k}.v" for k, c in enumerate(_COSTS)) + " AS e FROM " + ", ".join(f"(VALUES (-1), (1)) s{k}(v)" for k in range(len(_COSTS)))


@query(f"WITH e AS ({_SPECTRUM}), o AS (SELECT CAST(row_number() OVER (ORDER BY e) - 1 AS INT) AS i, CAST(e AS DOUBLE) AS e FROM e) SELECT method, i, e FROM o, (VALUES ('dense'), ('distributed'), ('krylov'), ('lowest')) m(method) WHERE i < 5 AND (method <> 'lowest' OR i = 0)")
def known_spectrum(spark, sf):
    """The lowest values by each solver."""
    basis = _pairs(spark).cache()
    states = ap.local_states(basis, 8, krylov.LOCAL)
    a = ap.Local(states, _PAIRS)
    found = {
        "dense": krylov.eigenpairs(basis, _PAIRS, 8, 5)[0],
        "distributed": krylov.eigenpairs(basis, _PAIRS, 8, 5, local=0)[0],
        "krylov": krylov.lanczos(a.__matmul__, krylov.start_vector(states), 5, krylov.Settings(min_iterations=16)).values,
        "lowest": krylov.distributed_lanczos(basis, _PAIRS, 8)[0].values,
    }
    return spark.createDataFrame([(m, i, round(float(e), 6) + 0.0) for m, es in found.items() for i, e in enumerate(es)], "method string, i int, e double")


@query("SELECT CAST(i AS INT) AS vec, CAST(j AS INT) AS other, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS overlap, 0.0::DOUBLE AS residual FROM range(3) a(i), range(3) b(j)")
def eigen_residuals(spark, sf):
    """Overlaps of the distributed solver's vectors, and how far the operator is from scaling each."""
    basis = _pairs(spark).cache()
    e, v = krylov.eigenpairs(basis, _PAIRS, 8, 3, local=0)
    v = v.cache()
    scaled = F.element_at(F.array(*[F.lit(float(x)) for x in e]), F.col("vec") + 1) * F.col("x")
    left = ap.apply(v, _PAIRS, 8, basis=basis, by=["vec"]).withColumnRenamed("x", "y").join(v.withColumn("s", scaled), ["vec", "lo"], "full")
    far = left.groupBy("vec").agg(F.round(F.sqrt(F.sum((F.coalesce("y", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))) ** 2)), 6).alias("residual"))
    both = v.join(v.select(F.col("vec").alias("other"), "lo", F.col("x").alias("z")), "lo").groupBy("vec", "other").agg(F.sum(F.col("x") * F.col("z")).alias("overlap"))
    return both.join(far, "vec").select("vec", "other", (F.round("overlap", 6) + F.lit(0.0)).alias("overlap"), (F.col("residual") + F.lit(0.0)).alias("residual"))


_TAU = 0.25


@query("WITH s(lo, x) AS (SELECT " + " + ".join(f"{1 << 2 * k} * (1 + s{k}.v)" for k in range(4)) + ", " + " * ".join(f"CASE WHEN s{k}.v = 0 THEN cosh({_TAU * c}::DOUBLE) ELSE sinh({_TAU * c}::DOUBLE) END" for k, c in enumerate(_COSTS)) + " FROM " + ", ".join(f"(VALUES (0), (1)) s{k}(v)" for k in range(4)) + ") SELECT CAST(lo AS BIGINT) AS lo, round(x, 6) AS x FROM s")
def known_exponential(spark, sf):
    """exp(tau A) of one state: a factor for each pair, by whether it has swapped."""
    states = ap.local_states(_pairs(spark), 8, krylov.LOCAL)
    a, v = ap.Local(states, _PAIRS), (states == states.min()).astype(float)
    out = krylov.exponential(a.__matmul__, v, _TAU)
    return spark.createDataFrame([(int(s), round(float(x), 6)) for s, x in zip(a.states, out)], "lo bigint, x double")


@query(f"WITH {_WIDE} SELECT hi, lo, row_number() OVER (ORDER BY hi, lo) AS place, hi < 549755813888 AS below, lo & 1099511627775 AS low40 FROM w")
def wide_order(spark, sf):
    """Unsigned order of two-word states, a comparison and a mask."""
    s = State("lo", "hi")
    half = State(F.lit(0).cast("bigint"), F.lit(1 << 39).cast("bigint"))
    return sectors.numbered(_wide(spark, sf), 128).select("hi", "lo", "place", s.below(half).alias("below"), F.col("lo").bitwiseAND(F.lit((1 << 40) - 1)).alias("low40"))


_KINDS = [("linear", -1.0, 1.0, 0.25), ("log", -2.0, 2.0, 0.5), ("tanh", -3.0, 3.0, 0.5)]
_POINT = {"linear": "{0} + i * {2}", "log": "pow(10, {0} + ({1} - {0}) * i / ({3} - 1))", "tanh": "tan(atan({0}) + (atan({1}) - atan({0})) * i / ({3} - 1))"}


@query(" UNION ALL ".join("SELECT '{0}' AS kind, CAST(i AS INT) AS i, round(CAST({1} AS DOUBLE), 6) + 0.0 AS x FROM range({2}) r(i)".format(k, _POINT[k].format(f"({a}::DOUBLE)", f"({z}::DOUBLE)", f"({h}::DOUBLE)", math.ceil((z - a) / h)), math.ceil((z - a) / h)) for k, a, z, h in _KINDS))
def sweep_spacings(spark, sf):
    return spark.createDataFrame([(k, i, round(x, 6) + 0.0) for k, a, z, h in _KINDS for i, x in enumerate(spacing(k, a, z, h))], "kind string, i int, x double")


@query("WITH m AS (SELECT o_orderkey % 8 AS size, avg(o_totalprice) / 1000 AS t FROM orders GROUP BY 1) SELECT round(regr_intercept(t, exp(size)), 4) AS t0, round(regr_slope(t, exp(size)), 6) AS a FROM m")
def runtime_fit(spark, sf):
    """t0 + a e^size by least squares; a row for each size comes to the driver."""
    rows = read(spark, sf, "orders").groupBy((F.col("o_orderkey") % 8).alias("size")).agg((F.avg("o_totalprice") / 1000).alias("t")).collect()
    t0, a = sweep.runtime_model(np.array([r["size"] for r in rows]), np.array([r["t"] for r in rows]))
    return spark.createDataFrame([(round(t0, 4), round(a, 6))], "t0 double, a double")


@query("SELECT CAST(i AS INT) AS i, round(sqrt(i), 8) AS root FROM range(1, 10) r(i)")
def roots(spark, sf):
    return spark.createDataFrame([(i, round(sweep.root(lambda x, i=i: x * x - i, 0.0, 10.0), 8)) for i in range(1, 10)], "i int, root double")


@query("SELECT o_orderkey, 'run/' || o_orderkey AS path FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderstatus <> 'F'")
def inputs_without_output(spark, sf):
    named = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.lit("run/"), F.col("o_orderkey").cast("string")).alias("path"))
    return store.without_output(named.drop("o_orderstatus"), named.where("o_orderkey % 3 = 0 AND o_orderstatus = 'F'"))


@query("SELECT count(DISTINCT o_orderstatus) = 1 AS \"unique\" FROM orders")
def unique_sector(spark, sf):
    return sweep.one_sector(read(spark, sf, "orders"), "o_orderstatus")


@query(f"WITH {STATES} SELECT count(*) AS work FROM s")
def work_by_task(spark, sf):
    """Rows by task, which add up to all."""
    return sectors.load(vector(spark, sf)).agg(F.sum("work").cast("bigint").alias("work"))


_AT = [1.25, 3.5, 6.75]


@query("WITH k AS (SELECT c_nationkey % 5 AS key, c_custkey / 20 AS x FROM customer), r AS (SELECT key, min(x) AS a, max(x) AS z FROM k GROUP BY 1), p(x) AS (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in _AT) + ") SELECT CAST(key AS INT) AS key, p.x, round(p.x * p.x * p.x - 2 * p.x, 3) AS y FROM r, p WHERE p.x BETWEEN a AND z")
def spline_of_cubic(spark, sf):
    """A cubic is its own spline."""
    x = F.col("c_custkey") / 20
    c = read(spark, sf, "customer").select((F.col("c_nationkey") % 5).cast("int").alias("key"), x.alias("x"), (x * x * x - 2 * x).alias("y"))
    return sweep.interpolated(c, "key", "x", "y", _AT).where(~F.isnan("y")).withColumn("y", F.round("y", 3))
