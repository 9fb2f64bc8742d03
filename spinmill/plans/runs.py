"""Queries on complex amplitudes, temperature, interrupted searches, and the planning of runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.algebra import OpSum
from ..operators import complexes, enumeration, krylov, sectors, sweep
from ..sources import store
from .catalog import CELL16, FULL, IMAGE, KEEPS, N, STATES, enumerate_sql, query, read, values, vector

_COMPLEX = complexes.ComplexSum.of((1.0, "0Y 1X"), (0.5j, "2+ 3-"), (2 - 1j, "4Y 5Y"), (1.5, "6Z 7Y"))


def _sign(site: int) -> str:
    """1 if the site is up, -1 if down."""
    return f"(2 * ((lo >> {site}) & 1) - 1)"


# The factors are spelled out by site, apart from the library's algebra: Y takes up to i down, and down to -i up.
_TERMS = [
    ("true", 3, "0", _sign(0)),
    ("(lo & 4) = 0 AND (lo & 8) = 8", 12, "0", "0.5"),
    ("true", 48, f"-2 * {_sign(4)} * {_sign(5)}", f"{_sign(4)} * {_sign(5)}"),
    ("true", 128, "0", f"1.5 * {_sign(6)} * {_sign(7)}"),
]
_APPLIED = (
    f"{STATES}, v AS (SELECT lo, x AS re, CAST(lo % 7 AS DOUBLE) AS im FROM s), m AS ("
    + " UNION ALL ".join(f"SELECT xor(lo, {flip}) AS lo, CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b, re, im FROM v WHERE {ok}" for ok, flip, a, b in _TERMS)
    + "), y AS (SELECT CAST(lo AS BIGINT) AS lo, sum(a * re - b * im) AS re, sum(a * im + b * re) AS im FROM m SEMI JOIN v USING (lo) GROUP BY 1)"
)


def _complex_vector(spark, sf):
    return vector(spark, sf).select("lo", F.col("x").alias("re"), (F.col("lo") % 7).cast("double").alias("im"))


@query(f"WITH {_APPLIED} SELECT lo, re + 0.0 AS re, im + 0.0 AS im FROM y")
def apply_complex(spark, sf):
    """A sum with Y factors and complex coefficients on complex amplitudes."""
    out = complexes.apply_complex(_complex_vector(spark, sf), _COMPLEX, N)
    return out.select("lo", (F.col("re") + F.lit(0.0)).alias("re"), (F.col("im") + F.lit(0.0)).alias("im"))


@query(f"WITH {_APPLIED} SELECT sum(v.re * y.re + v.im * y.im) + 0.0 AS re, sum(v.re * y.im - v.im * y.re) + 0.0 AS im FROM v JOIN y USING (lo)")
def complex_expectation(spark, sf):
    """Both parts of an expectation value, written as one struct and read back."""
    path = _folder(spark, "values")
    row = complexes.expectation(_complex_vector(spark, sf), _COMPLEX, N).first()["value"]
    store.write_values(spark, path, value=complex(row["re"], row["im"]))
    return spark.read.parquet(path).select((F.col("value.re") + F.lit(0.0)).alias("re"), (F.col("value.im") + F.lit(0.0)).alias("im"))


def _folder(spark, name: str) -> str:
    return f"{store.checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Three pairs of sites that may swap at a cost each: by symmetry any one state has the averages of all.
_COSTS, _BETAS = [1.0, 2.0, 4.0], [0.25, 0.5]
_PAIRS = OpSum.of(*[(c, f"{2 * k}{a} {2 * k + 1}{b}") for k, c in enumerate(_COSTS) for a, b in ("+-", "-+")])


@query("SELECT beta, round(" + " - ".join(["0", *[f"{c} * tanh(beta * {c})" for c in _COSTS]]) + ", 6) AS energy FROM (VALUES " + ", ".join(f"({b}::DOUBLE)" for b in _BETAS) + ") b(beta)")
def known_thermal(spark, sf):
    """Energies by temperature over DataFrames, from a start whose averages are exact."""
    basis = enumeration.enumerate_states(spark, 6, [(3 << 2 * k, 1, 1) for k in range(3)]).select("lo")
    start = basis.withColumn("x", F.when(F.col("lo") == 21, 1.0).otherwise(0.0))
    out = krylov.distributed_thermal(basis, _PAIRS, 6, [], _BETAS, 1, starts=[start])
    return spark.createDataFrame([(r["beta"], round(r["mean"][0], 6)) for r in out], "beta double, energy double")


@query(enumerate_sql(CELL16, CELL16.order()))
def resumed_search(spark, sf):
    """A search that goes on from the frontier that another has left."""
    path = _folder(spark, "frontiers")
    enumeration.ice_states(spark, CELL16, frontiers=path)
    return enumeration.ice_states(spark, CELL16, frontiers=path)


@query("SELECT o_orderstatus AS sector, count(*) AS n, min(o_totalprice) AS lowest FROM (SELECT * FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 200) GROUP BY 1")
def lowest_by_sector(spark, sf):
    """The 200 lowest, by sector."""
    o = read(spark, sf, "orders").withColumnRenamed("o_orderstatus", "sector")
    return sweep.lowest_by_sector(o, "o_totalprice", 200, ["o_orderkey"])


_JPM, _FIELDS, _ALONG = [-0.09, -0.04, 0.03, 0.07], [0.1, 0.25, 0.4, 0.55], (1.0, 2.0, 4.0)
_B = [c / 21**0.5 for c in _ALONG]
_F = [f"({sx}b * {_B[0]!r} {sy} b * {_B[1]!r} {sz} b * {_B[2]!r})" for sx, sy, sz in (("", "+", "+"), ("", "-", "-"), ("-", "+", "-"), ("-", "-", "+"))]


def _ring_sql(k: int) -> str:
    a, b, c = (_F[i] for i in range(4) if i != k)
    return f"(54 * pow(jpm, 3) - 15 * pow(jpm, 2) * pow({_F[k]}, 2) - 17.5 * jpm * {' * '.join(_F)} - 5.25 * pow({a} * {b} * {c}, 2))"


_GRID = "j(jpm) AS (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in _JPM) + "), f(b) AS (VALUES " + ", ".join(f"({x}::DOUBLE)" for x in _FIELDS) + ")"


@query(f"WITH {_GRID}, r AS (SELECT jpm, b, {_ring_sql(0)} / {_ring_sql(3)} AS ratio FROM j, f), c AS (SELECT min(c_custkey % 150 / 5 - 15) AS a, max(c_custkey % 150 / 5 - 15) AS z FROM customer) SELECT jpm, b, round(ratio, 6) AS ratio, CASE WHEN ratio BETWEEN a AND z THEN round(pow(ratio, 3) - 2 * ratio, 4) END AS y FROM r, c")
def phase_diagram(spark, sf):
    """A cubic curve at the ratios of ring couplings over a grid."""
    x = (F.col("c_custkey") % 150) / 5 - 15
    curve = read(spark, sf, "customer").select(x.alias("x"), (x * x * x - 2 * x).alias("y")).distinct()
    return sweep.phase_diagram(curve, "x", "y", _JPM, _FIELDS, _ALONG).select("jpm", "b", F.round("ratio", 6).alias("ratio"), F.round("y", 4).alias("y"))


_SCORES = [1, 2, 5, 3]
_ENDS = [sum(_SCORES[: k + 1]) for k in range(len(_SCORES))]


@query(f"WITH {STATES}, n AS (SELECT count(*) AS total FROM s), p(part, score) AS (VALUES " + ", ".join(f"({k}, {c})" for k, c in enumerate(_SCORES)) + f"), w AS (SELECT part, total, CASE WHEN part < {len(_SCORES) - 1} THEN score * total // {_ENDS[-1]} END AS own FROM p, n), r AS (SELECT part, total, coalesce(own, total - (SELECT sum(own) FROM w)) AS rows FROM w) SELECT CAST(part AS INT) AS part, CAST(sum(rows) OVER (ORDER BY part) - rows AS BIGINT) AS first_row, CAST(sum(rows) OVER (ORDER BY part) - 1 AS BIGINT) AS last_row, CAST(rows AS BIGINT) AS n FROM r")
def weighted_bounds(spark, sf):
    """The sorted states divided by scores."""
    return sectors.weighted_bounds(vector(spark, sf), _SCORES, N)


@query(f"WITH {STATES}, {values(FULL, off_diagonal=True)} SELECT CAST(s.lo >> 13 AS BIGINT) AS source, CAST({IMAGE} >> 13 AS BIGINT) AS target, count(*) AS n FROM s JOIN t ON {KEEPS} GROUP BY 1, 2")
def image_traffic(spark, sf):
    """Images by the owner of the state they come from and of their own."""
    return sectors.traffic(vector(spark, sf), FULL, N, lambda lo: F.shiftright(lo, 13))


@query("SELECT o_orderkey, o_totalprice >= 100000 AS large FROM orders")
def plan_by_size(spark, sf):
    return sweep.split_by_size(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").drop("o_totalprice")


@query("SELECT 'lat/' || c_custkey || '.json' AS path, 'python -m spinmill basis lat/' || c_custkey || '.json' AS command FROM customer WHERE c_nationkey < 17")
def supercell_plan(spark, sf):
    """Commands for the small lattices of a list in a text file."""
    path = _folder(spark, "lattices")
    name = F.concat(F.lit("lat/"), F.col("c_custkey").cast("string"), F.lit(".json")).alias("path")
    read(spark, sf, "customer").select(name, F.concat(F.col("c_nationkey").cast("string"), F.lit(",")).alias("cells")).write.option("sep", " ").option("header", True).csv(path)
    return sweep.supercell_plan(spark.read.option("sep", " ").option("header", True).csv(path))


@query(f"WITH {STATES} SELECT 'basis_even' AS name, count(*) FILTER (lo % 2 = 0) AS rows FROM s UNION ALL SELECT 'basis_odd', count(*) FILTER (lo % 2 = 1) FROM s")
def basis_listing(spark, sf):
    """Tables of a folder with their rows; others are left out."""
    path, df = _folder(spark, "tables"), vector(spark, sf)
    for name, keep in (("basis_even", "lo % 2 = 0"), ("basis_odd", "lo % 2 = 1"), ("other", "lo = 0")):
        df.where(keep).write.parquet(f"{path}/{name}")
    return store.listing(spark, path)
