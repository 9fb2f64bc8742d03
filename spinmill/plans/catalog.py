"""The library's queries over the test tables, each with its SQL where SQL can say it.

States come from line items: 16 bits by a multiplicative hash of the key, dense enough for operators to map them onto
each other, on the 16-site lattice of 1 x 2 x 2 cells. Their amplitudes are whole numbers, so that sums are exact.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import OpSum
from ..functions.bits import State
from ..functions.couplings import ring_couplings, spacing
from ..operators import apply as ap
from ..operators import enumeration, hamiltonians, krylov, observables, sectors, sweep
from ..sources import store
from ..sources.lattice import Lattice, group, pyrochlore, symmetries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

N = 16
CELL8, CELL16 = pyrochlore((1, 0, 0), (0, 1, 0), (0, 0, 2)), pyrochlore((1, 0, 0), (0, 2, 0), (0, 0, 2))
RING = hamiltonians.ring_hamiltonian(CELL16, [1.0, -2.0, 3.0, -4.0], repeated=False)
ISING = OpSum.of(*[(float(1 + k % 3), f"{a}Z {b}Z") for k, (a, b, _) in enumerate(CELL16.bonds[:24])])
FULL = RING + ISING
MASKS = CELL16.sublattice_masks()
CYCLE = symmetries(CELL16)

STATES = "s AS (SELECT CAST(((l_orderkey * 8 + l_linenumber) * 2654435761) % 65536 AS BIGINT) AS lo, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS x FROM lineitem GROUP BY 1)"


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vector(spark: SparkSession, sf: str) -> DataFrame:
    key = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * F.lit(2654435761)) % 65536
    return read(spark, sf, "lineitem").groupBy(key.cast("bigint").alias("lo")).agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("x"))


def values(ops: OpSum, off_diagonal: bool | None = None) -> str:
    """The terms as a common table expression t."""
    rows = [(k, c, t) for k, (t, c) in enumerate(ops.parts.items()) if off_diagonal is None or t.diagonal != off_diagonal]
    body = ", ".join(f"({k}, CAST({c} AS DOUBLE), {t.flip}, {t.parity}, {t.down}, {t.up})" for k, c, t in rows)
    return f"t(op, c, flip, parity, down, up) AS (VALUES {body})"


KEEPS = "(s.lo & t.down) = 0 AND (s.lo & t.up) = t.up"
IMAGE = "xor(s.lo, t.flip)"
FACTOR = f"t.c * (1 - 2 * (bit_count(xor({IMAGE}, 65535) & t.parity) % 2))"


def applied_sql(ops: OpSum, off_diagonal: bool | None = None, source: str = "s") -> str:
    return f"SELECT CAST(y.lo AS BIGINT) AS lo, CAST(sum(y.v) AS DOUBLE) AS x FROM (SELECT {IMAGE} AS lo, {FACTOR} * s.x AS v FROM {source} s JOIN t ON {KEEPS}) y SEMI JOIN {source} b ON b.lo = y.lo GROUP BY 1"


def bits_sql(terms: str) -> str:
    return f"WITH {STATES} SELECT {terms} FROM s"


@query(bits_sql("lo, CAST(bit_count(lo) AS INT) AS ones, CAST((lo >> 3) & 1 AS INT) AS bit3, lo | 32 AS with5, xor(lo, 4) AS flip2, lo << 3 AS left3, lo >> 2 AS right2, lo & 4095 AS low12, xor(lo, 65535) AS other, CAST(length(bin(lo)) - 1 + CASE WHEN lo = 0 THEN -1 ELSE 0 END AS INT) AS top"))
def state_bits(spark, sf):
    s = State("lo")
    one = lambda x, name: x.lo.alias(name)
    return vector(spark, sf).select("lo", s.popcount().alias("ones"), s.get(3).alias("bit3"), one(s.set(5), "with5"), one(s.flip(2), "flip2"), one(s << 3, "left3"), one(s >> 2, "right2"), one(s & 4095, "low12"), one(s ^ 65535, "other"), s.highest().cast("int").alias("top"))


@query(bits_sql("lo, '0x' || lpad(lower(hex(lo)), 32, '0') AS hex, lo AS back"))
def state_hex(spark, sf):
    df = vector(spark, sf).select("lo", State("lo").to_hex().alias("hex"))
    return df.withColumn("back", State.from_hex(F.col("hex"), N).lo)


_TO = [(5 * i + 3) % N for i in range(N)]


@query(bits_sql("lo, CAST(" + " + ".join(f"(((lo >> {n}) & 1) << {m})" for n, m in enumerate(_TO)) + " AS BIGINT) AS moved"))
def state_permute(spark, sf):
    return vector(spark, sf).select("lo", State("lo").permuted(_TO).lo.alias("moved"))


_WIDE = "w AS (SELECT DISTINCT CAST((l_orderkey * 2654435761) % 1099511627776 AS BIGINT) AS hi, CAST((l_partkey * 40503 + l_linenumber) * 65537 AS BIGINT) AS lo FROM lineitem)"


def _wide(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.select(((F.col("l_orderkey") * F.lit(2654435761)) % F.lit(1 << 40)).cast("bigint").alias("hi"), ((F.col("l_partkey") * 40503 + F.col("l_linenumber")) * 65537).cast("bigint").alias("lo")).distinct()


@query(f"WITH {_WIDE} SELECT hi, lo, CAST(bit_count(hi) + bit_count(lo) AS INT) AS ones, CAST(CASE WHEN hi > 0 THEN 63 + length(bin(hi)) WHEN lo > 0 THEN length(bin(lo)) - 1 ELSE -1 END AS INT) AS top, (hi >> 6) AS right70, '0x' || lpad(lower(hex(hi)), 16, '0') || lpad(lower(hex(lo)), 16, '0') AS hex FROM w")
def wide_bits(spark, sf):
    s = State("lo", "hi")
    return _wide(spark, sf).select("hi", "lo", s.popcount().alias("ones"), s.highest().cast("int").alias("top"), (s >> 70).lo.alias("right70"), s.to_hex().alias("hex"))


_SECTOR = ", ".join(f"CAST(bit_count(lo & {m}) AS INT) AS s{k}" for k, m in enumerate(MASKS))
_SECTOR_ID = "CAST(" + " + ".join(f"(bit_count(lo & {m}) * {1 << 8 * k})" for k, m in enumerate(MASKS)) + " AS BIGINT) AS sector_id"


@query(bits_sql(f"lo, x, {_SECTOR}, {_SECTOR_ID}"))
def polarisation_sectors(spark, sf):
    return sectors.with_sector(vector(spark, sf), MASKS, N)


@query(f"WITH {STATES} SELECT s0, s1, s2, s3, sector_id, count(*) AS n FROM (SELECT {_SECTOR}, {_SECTOR_ID} FROM s) GROUP BY ALL")
def sector_histogram(spark, sf):
    return sectors.histogram(vector(spark, sf), MASKS, N)


@query(f"WITH {STATES} SELECT lo, x FROM s WHERE " + " AND ".join(f"bit_count(lo & {m}) = 2" for m in MASKS))
def sector_filter(spark, sf):
    df = vector(spark, sf)
    for m in MASKS:
        df = df.where(State("lo").popcount(m) == 2)
    return df


@query(f"WITH {STATES}, {values(FULL, False)} SELECT lo, CAST(coalesce((SELECT sum({FACTOR.replace('s.lo', 'q.lo')}) FROM t WHERE {KEEPS.replace('s.lo', 'q.lo')}), 0) * x AS DOUBLE) AS x FROM s q")
def apply_diag(spark, sf):
    return vector(spark, sf).select("lo", (ap.diagonal(FULL, N) * F.col("x")).alias("x"))


@query(f"WITH {STATES}, {values(RING)} {applied_sql(RING)}")
def apply_offdiag(spark, sf):
    return ap.apply(vector(spark, sf), RING, N)


@query(f"WITH {STATES}, {values(FULL)} {applied_sql(FULL)}")
def apply_full(spark, sf):
    return ap.apply(vector(spark, sf), FULL, N)


@query(f"WITH {STATES}, {values(FULL)}, m AS (SELECT {IMAGE} AS lo, s.lo AS from_lo, sum({FACTOR}) AS val, bool_or(t.flip = 0) AS own FROM s JOIN t ON {KEEPS} GROUP BY 1, 2) SELECT CAST(m.lo AS BIGINT) AS lo, m.from_lo, CAST(val AS DOUBLE) AS val FROM m SEMI JOIN s ON s.lo = m.lo WHERE own OR abs(val) > 1e-14")
def sparse_triplets(spark, sf):
    return ap.triplets(vector(spark, sf), FULL, N)


@query(f"WITH {STATES}, {values(RING)} SELECT lo, x FROM s WHERE EXISTS (SELECT 1 FROM t WHERE {KEEPS})")
def remove_null(spark, sf):
    return ap.not_annihilated(vector(spark, sf), RING, N)


_NEW = "n AS (SELECT DISTINCT CAST((o_orderkey * 40503) % 65536 AS BIGINT) AS lo FROM orders)"


def _new(spark, sf):
    return read(spark, sf, "orders").select(((F.col("o_orderkey") * 40503) % 65536).cast("bigint").alias("lo")).distinct()


@query(f"WITH {STATES}, {_NEW} SELECT lo FROM n WHERE lo NOT IN (SELECT lo FROM s)")
def set_insert_new(spark, sf):
    return sectors.inserted(vector(spark, sf).select("lo"), _new(spark, sf), N)[1]


@query(f"WITH {STATES}, {_NEW} SELECT lo FROM s UNION SELECT lo FROM n")
def set_union(spark, sf):
    return sectors.inserted(vector(spark, sf).select("lo"), _new(spark, sf), N)[0]


@query(f"WITH {STATES} SELECT DISTINCT lo FROM s")
def sort_unique(spark, sf):
    return sectors.sorted_unique(vector(spark, sf), N)


def enumerate_sql(lat: Lattice, order: list[int], budget: int = 0, sector: list[int] | None = None) -> str:
    """The same expansion as a recursion: site order, what each level checks, and how many are still unknown, as values."""
    pos = {s: k for k, s in enumerate(order)}
    unknown = lambda m, k: sum(1 for b in range(m.bit_length()) if m >> b & 1 and pos[b] > k)
    checks = []
    for k, site in enumerate(order):
        own = [c for c in lat.constraints() if c[0] >> site & 1]
        bad = [f"bit_count({{s}} & {m}) + {unknown(m, k)} < {a} OR bit_count({{s}} & {m}) > {z}" for m, a, z in own]
        for m, up in zip(lat.sublattice_masks(), sector or []):
            bad.append(f"bit_count({{s}} & {m}) > {up} OR bit_count({{s}} & {m}) + {unknown(m, k)} < {up}")
        checks.append((site, " OR ".join(bad)))
    grown = "(f.lo | (v.b << l.site))"
    case = "CASE f.k " + " ".join(f"WHEN {k} THEN ({bad.format(s=grown)})" for k, (_, bad) in enumerate(checks)) + " END"
    sites = ", ".join(f"({k}, {s})" for k, s in enumerate(order))
    return (
        f"WITH RECURSIVE l(k, site) AS (VALUES {sites}), v(b) AS (VALUES (0), (1)), f(k, lo, pairs) AS (SELECT 0, CAST(0 AS BIGINT), 0 UNION ALL "
        f"SELECT f.k + 1, CAST({grown} AS BIGINT), f.pairs + CASE WHEN {case} THEN 1 ELSE 0 END FROM f JOIN l ON l.k = f.k CROSS JOIN v "
        f"WHERE f.pairs + CASE WHEN {case} THEN 1 ELSE 0 END <= {budget}) SELECT lo, CAST(pairs AS BIGINT) AS pairs FROM f WHERE k = {lat.n_sites}"
    )


@query(enumerate_sql(CELL16, CELL16.order()))
def ice_enumerate(spark, sf):
    return enumeration.ice_states(spark, CELL16)


@query(enumerate_sql(CELL16, CELL16.order(), sector=[2, 2, 2, 2]))
def ice_enumerate_sector(spark, sf):
    return enumeration.ice_states(spark, CELL16, sector=[2, 2, 2, 2])


@query(enumerate_sql(CELL8, CELL8.order(), budget=1))
def ice_budget1(spark, sf):
    return enumeration.ice_states(spark, CELL8, budget=1)


_SEED = 38490


@query(f"WITH RECURSIVE {values(RING)}, s(lo) AS (SELECT CAST({_SEED} AS BIGINT) UNION SELECT CAST({IMAGE} AS BIGINT) FROM s JOIN t ON {KEEPS}) SELECT lo FROM s")
def ring_closure(spark, sf):
    return enumeration.closure(spark, N, [_SEED], RING)


@query(f"WITH {STATES}, z AS (SELECT lo, x + 1 AS z FROM s WHERE lo % 2 = 0) SELECT CAST(sum(x * z) AS DOUBLE) AS inner_product, round(sqrt((SELECT sum(x * x) FROM s)), 6) AS norm FROM s JOIN z USING (lo)")
def vec_dot_norm(spark, sf):
    a = vector(spark, sf)
    b = a.where("lo % 2 = 0").select("lo", (F.col("x") + 1).alias("z"))
    n = a.agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("norm"))
    return a.join(b, "lo").agg(F.sum(F.col("x") * F.col("z")).alias("inner_product")).crossJoin(F.broadcast(n))


@query(f"WITH {STATES} SELECT lo, CAST(sum(x) AS DOUBLE) AS x FROM (SELECT lo, 3 * x AS x FROM s UNION ALL SELECT lo, -2 * (x + 1) FROM s WHERE lo % 2 = 0) GROUP BY 1")
def axpy_scale(spark, sf):
    a = vector(spark, sf)
    b = a.where("lo % 2 = 0").withColumn("x", F.col("x") + 1)
    return krylov.combined([(3.0, a), (-2.0, b)], N)


def _vectors(spark, sf):
    """Two vectors: amplitudes, and their rest by 7."""
    a = vector(spark, sf)
    return a.select("lo", F.lit(0).alias("vec"), "x").unionByName(a.select("lo", F.lit(1).alias("vec"), (F.col("x") % 7).alias("x")))


_RINGS = [o for o, _, _ in hamiltonians.ring_terms(CELL16, repeated=False)]
_VECS = "v AS (SELECT lo, 0 AS vec, x FROM s UNION ALL SELECT lo, 1, x % 7 FROM s)"
_RING_VALUES = values(OpSum.of(*[(1.0, o) for o in _RINGS]))
_APPLIED = f"a AS (SELECT t.op, s.vec, {IMAGE} AS lo, {FACTOR} * s.x AS x FROM v s JOIN t ON {KEEPS})"


@query(f"WITH {STATES}, {_VECS}, {_RING_VALUES}, {_APPLIED} SELECT a.op, a.vec AS i, v.vec AS j, CAST(sum(a.x * v.x) AS DOUBLE) AS val FROM a JOIN v ON v.lo = a.lo GROUP BY ALL")
def expectation(spark, sf):
    return observables.expectations(_vectors(spark, sf), [OpSum.of((1.0, o)) for o in _RINGS], N)


@query(f"WITH {STATES}, {_VECS}, {_RING_VALUES}, {_APPLIED}, k AS (SELECT a.* FROM a SEMI JOIN s ON s.lo = a.lo) SELECT a.op AS l, b.op AS m, a.vec AS i, b.vec AS j, CAST(sum(a.x * b.x) AS DOUBLE) AS val FROM k a JOIN k b ON a.lo = b.lo GROUP BY ALL")
def cross_corr(spark, sf):
    return observables.cross_correlations(_vectors(spark, sf), [OpSum.of((1.0, o)) for o in _RINGS], N)


@query(f"WITH {STATES}, {_VECS}, {_RING_VALUES}, {_APPLIED}, k AS (SELECT a.* FROM a SEMI JOIN s ON s.lo = a.lo) SELECT k.op, k.vec, CAST(sum(k.x * coalesce(v.x, 0)) AS DOUBLE) AS ring, CAST(sum(k.x * k.x) AS DOUBLE) AS flippability, CAST(sum(k.x * coalesce(z.x, 0)) AS DOUBLE) AS first FROM k LEFT JOIN v ON v.lo = k.lo AND v.vec = k.vec LEFT JOIN k z ON z.op = 0 AND z.lo = k.lo AND z.vec = k.vec GROUP BY ALL")
def flippability(spark, sf):
    return observables.ring_observables(_vectors(spark, sf), _RINGS, N)


_NORMED = [hamiltonians.flippability(o, h) for o, h, _ in hamiltonians.ring_terms(CELL16, repeated=False)][:4]
_NORMED_VALUES = "t(op, c, flip, parity, down, up) AS (VALUES " + ", ".join(f"({k}, CAST({c} AS DOUBLE), {t.flip}, {t.parity}, {t.down}, {t.up})" for k, o in enumerate(_NORMED) for t, c in o.parts.items()) + ")"


@query(f"WITH {STATES}, {_VECS}, {_NORMED_VALUES}, {_APPLIED} SELECT a.op, a.vec AS i, v.vec AS j, CAST(sum(a.x * v.x) AS DOUBLE) AS val FROM a JOIN v ON v.lo = a.lo GROUP BY ALL")
def ring_normed(spark, sf):
    return observables.expectations(_vectors(spark, sf), _NORMED, N)


@query(f"WITH {STATES}, {values(FULL)}, w AS ({applied_sql(FULL)}) SELECT round(sum(w.x * s.x) / (SELECT sum(x * x) FROM s), 6) AS alpha, round(sqrt((SELECT sum(x * x) FROM w) / (SELECT sum(x * x) FROM s) - pow(sum(w.x * s.x) / (SELECT sum(x * x) FROM s), 2)), 4) AS beta FROM w JOIN s ON s.lo = w.lo")
def lanczos_step(spark, sf):
    """First coefficients of the recurrence: alpha = <v|A v>, beta = |A v - alpha v| for the unit vector."""
    v = vector(spark, sf)
    w = ap.apply(v, FULL, N).withColumnRenamed("x", "w")
    both = v.join(w, "lo", "left").na.fill(0.0, ["w"])
    n, a = F.sum(F.col("x") * F.col("x")), F.sum(F.col("x") * F.col("w"))
    return both.agg(F.round(a / n, 6).alias("alpha"), F.round(F.sqrt(F.sum(F.col("w") * F.col("w")) / n - F.pow(a / n, F.lit(2))), 4).alias("beta"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_totalprice, o_orderstatus, o_orderkey LIMIT 25")
def lowest_n(spark, sf):
    return sweep.lowest(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_totalprice", 25, ["o_orderstatus", "o_orderkey"])


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS INT) AS place FROM orders) WHERE place <= 5")
def best_sector_per_x(spark, sf):
    return sweep.best_sectors(read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", 5, ["o_orderkey"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, min(o_totalprice) OVER (PARTITION BY o_custkey) AS low FROM orders) WHERE o_totalprice - low < 1e-10")
def degenerate_ground(spark, sf):
    return sweep.ground_states(read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice")


@query("SELECT o_custkey, CAST(min(o_totalprice) AS DOUBLE) AS e0, CAST(max(CASE WHEN place = 2 THEN o_totalprice END) AS DOUBLE) AS e1, CAST(max(CASE WHEN place = 2 THEN o_totalprice END) - min(o_totalprice) AS DOUBLE) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS place FROM orders) WHERE place <= 2 GROUP BY 1")
def sweep_gap(spark, sf):
    return sweep.gaps(read(spark, sf, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 - 5000.0 AND 100000 + 5000.0 AND o_orderstatus = 'O'")
def band_lookup(spark, sf):
    return sweep.lookup(read(spark, sf, "orders"), "o_totalprice", 100000.0, 5000.0, o_orderstatus="O").select("o_orderkey", "o_totalprice")


@query("SELECT a.o_orderkey FROM orders a WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE abs(a.o_totalprice - b.o_totalprice) <= 1 AND a.o_orderstatus = b.o_orderstatus AND b.o_orderkey < a.o_orderkey)")
def band_dedup(spark, sf):
    return sweep.drop_near_duplicates(read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_totalprice", 1.0, ["o_orderstatus"], "o_orderkey").select("o_orderkey")


@query("SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM orders a JOIN orders b ON a.o_orderstatus = b.o_orderstatus AND abs(a.o_totalprice - b.o_totalprice) <= 2 AND a.o_orderkey < b.o_orderkey")
def band_join(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    met = sweep.band_join(o, o, "o_totalprice", "o_totalprice", 2.0, ["o_orderstatus"])
    return met.where("o_orderkey < r_o_orderkey").select(F.col("o_orderkey").alias("a_key"), F.col("r_o_orderkey").alias("b_key"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey FROM orders n WHERE o_orderkey % 3 = 1 AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey % 3 = 0 AND o.o_orderstatus = n.o_orderstatus AND abs(o.o_totalprice - n.o_totalprice) <= 5)")
def insert_absent(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return sweep.insert_absent(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 3 = 1"), "o_totalprice", 5.0, ["o_orderstatus"]).select("o_orderkey")


@query("SELECT c_custkey, c_acctbal FROM (SELECT *, lead(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS n FROM customer) WHERE n IS NULL OR n - c_acctbal > 25")
def adjacent_dedup(spark, sf):
    return sweep.drop_adjacent(read(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal", 25.0, ["c_nationkey"]).select("c_custkey", "c_acctbal")


@query("SELECT DISTINCT o_orderkey, o_orderstatus FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 3 = 0)")
def merge_ignore(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sweep.merged(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), key=["o_orderkey"])


@query("SELECT o_custkey, n, n = max(n) OVER () AS complete FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def completeness(spark, sf):
    return sweep.completeness(read(spark, sf, "orders"), "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def missing_runs(spark, sf):
    plan = read(spark, sf, "customer").select("c_custkey")
    return sweep.missing(plan, read(spark, sf, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def timer_stats(spark, sf):
    out = sweep.timer_stats(read(spark, sf, "events"), "event_type", "value")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(f"WITH {STATES}, b AS (SELECT lo & 255 AS bin, count(*) AS c FROM s GROUP BY 1) SELECT count(*) AS bins, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS std, round(100 * stddev_pop(c) / avg(c), 6) AS cv_percent, min(c) AS least, max(c) AS most FROM b")
def prefix_bin_stats(spark, sf):
    return sectors.prefix_bins(vector(spark, sf), 255, N).withColumns({c: F.round(c, 6) for c in ("mean", "std", "cv_percent")})


@query(f"WITH {STATES}, r AS (SELECT row_number() OVER (ORDER BY lo) - 1 AS row, count(*) OVER () AS total FROM s) SELECT CAST(least(floor(row * 8 / total), 7) AS INT) AS part, min(row) AS first_row, max(row) AS last_row, count(*) AS n FROM r GROUP BY 1")
def range_partition_bounds(spark, sf):
    return sectors.range_bounds(vector(spark, sf), 8, N)


_GROUP = group(CYCLE)


@query(bits_sql("lo, CAST(least(" + ", ".join("CAST(" + " + ".join(f"(((lo >> {n}) & 1) << {m})" for n, m in enumerate(p)) + " AS BIGINT)" for p in _GROUP) + ") AS BIGINT) AS rep_lo"))
def orbit_representative(spark, sf):
    return sectors.representatives(vector(spark, sf).select("lo"), [list(p) for p in _GROUP], N)


@query(f"WITH {STATES}, r AS (SELECT CAST(least(" + ", ".join("CAST(" + " + ".join(f"(((lo >> {n}) & 1) << {m})" for n, m in enumerate(p)) + " AS BIGINT)" for p in _GROUP) + ") AS BIGINT) AS rep_lo FROM s) SELECT rep_lo, count(*) AS size FROM r GROUP BY 1")
def orbit_sizes(spark, sf):
    return sectors.orbits(vector(spark, sf), [list(p) for p in _GROUP], N)


_GRID = [(j, b) for j in spacing("linear", 0.0, 0.1, 0.02) for b in (0.0, 0.1, 0.2, 0.3)]


def _g_sql(k: int) -> str:
    f = ["(b1 + b2 + b3)", "(b1 - b2 - b3)", "(b2 - b1 - b3)", "(b3 - b1 - b2)"]
    rest = [x for i, x in enumerate(f) if i != k]
    return f"round((-5.25 * pow({' * '.join(rest)}, 2) - 17.5 * jpm * {' * '.join(f)} - 15 * pow({f[k]}, 2) * pow(jpm, 2) + 54 * pow(jpm, 3)) / 36, 10) + 0.0 AS g{k}"


@query("WITH p(jpm, bx) AS (VALUES " + ", ".join(f"(CAST({j!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for j, b in _GRID) + f"), q AS (SELECT jpm, bx, bx AS b1, bx / 2 AS b2, bx / 4 AS b3 FROM p) SELECT jpm, bx, {', '.join(map(_g_sql, range(4)))} FROM q")
def ring_coupling_grid(spark, sf):
    left = spark.createDataFrame([(j,) for j in spacing("linear", 0.0, 0.1, 0.02)], "jpm double")
    right = spark.createDataFrame([(b,) for b in (0.0, 0.1, 0.2, 0.3)], "bx double")
    g = ring_couplings(F.col("jpm"), (F.col("bx"), F.col("bx") / 2, F.col("bx") / 4))
    return sweep.grid(left, right).select("jpm", "bx", *[(F.round(x, 10) + F.lit(0.0)).alias(f"g{k}") for k, x in enumerate(g)])


_BETAS = [0.1 * k for k in range(1, 6)]


@query("WITH b(beta) AS (VALUES " + ", ".join(f"(CAST({b!r} AS DOUBLE))" for b in _BETAS) + "), e AS (SELECT o_totalprice / 100000 AS e FROM orders), m AS (SELECT min(e) AS low FROM e) SELECT beta, round(sum(exp(-beta * (e - low))), 4) AS z, round(sum(e * exp(-beta * (e - low))) / sum(exp(-beta * (e - low))), 6) AS mean_e FROM e, m, b GROUP BY 1")
def partition_function(spark, sf):
    betas = spark.createDataFrame([(b,) for b in _BETAS], "beta double")
    out = krylov.partition_function(read(spark, sf, "orders").select((F.col("o_totalprice") / 100000).alias("e")), betas)
    return out.select("beta", F.round("z", 4).alias("z"), F.round("mean_e", 6).alias("mean_e"))


_WAVES = [(k, 0.3 * k, 0.2, 0.1 * k) for k in range(4)]
_PHASE = [(f"({x} * kx + {y} * ky + {z} * kz)", i) for i, ((x, y, z), _) in enumerate(CELL16.sites)]


@query(f"WITH {STATES}, {_VECS}, w(k, kx, ky, kz) AS (VALUES " + ", ".join(f"({k}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE), CAST({c!r} AS DOUBLE))" for k, a, b, c in _WAVES) + "), z AS (SELECT v.vec, " + ", ".join(f"sum(v.x * s.x * (((v.lo >> {i}) & 1) - 0.5)) AS z{i}" for i in range(N)) + " FROM v JOIN s ON s.lo = v.lo GROUP BY 1) SELECT k, vec AS n, round(" + " + ".join(f"cos({p}) * z{i}" for p, i in _PHASE) + ", 2) + 0.0 AS re, round(" + " + ".join(f"sin({p}) * z{i}" for p, i in _PHASE) + ", 2) + 0.0 AS im FROM z, w")
def szz_k(spark, sf):
    waves = spark.createDataFrame(_WAVES, "k int, kx double, ky double, kz double")
    out = observables.structure_factor(_vectors(spark, sf), [x for x, _ in CELL16.sites], waves, N)
    return out.select("k", "n", *[(F.round(c, 2) + F.lit(0.0)).alias(c) for c in ("re", "im")])


_SL = [sl for _, _, sl in hamiltonians.ring_terms(CELL16, repeated=False)]


@query(f"WITH {STATES}, {_VECS}, {_RING_VALUES}, {_APPLIED}, y(op, sl) AS (VALUES " + ", ".join(f"({k}, {s})" for k, s in enumerate(_SL)) + "), q AS (SELECT a.op, sum(a.x * v.x) AS val FROM a JOIN v ON v.lo = a.lo AND v.vec = 0 WHERE a.vec = 0 GROUP BY 1) SELECT sl, round(avg(val), 4) AS mean, count(*) AS n FROM q JOIN y USING (op) GROUP BY 1")
def ring_mean_by_sublattice(spark, sf):
    e = observables.expectations(_vectors(spark, sf).where("vec = 0"), [OpSum.of((1.0, o)) for o in _RINGS], N)
    out = observables.by_sublattice(e, spark.createDataFrame(list(enumerate(_SL)), "op int, sl int"))
    return out.withColumn("mean", F.round("mean", 4))


@query("WITH b(a, b, color) AS (VALUES " + ", ".join(f"({a}, {b}, {c})" for a, b, c in CELL16.bonds) + "), i(idx, sl) AS (VALUES " + ", ".join(f"({i}, {s})" for i, (_, s) in enumerate(CELL16.sites)) + ") SELECT p.sl AS sl_a, q.sl AS sl_b, color, count(*) AS n FROM b JOIN i p ON p.idx = b.a JOIN i q ON q.idx = b.b GROUP BY ALL")
def bond_sublattices(spark, sf):
    from ..sources.lattice import tetra_pairs

    return tetra_pairs(CELL16, spark).groupBy("sl_a", "sl_b", "color").agg(F.sum("n").cast("bigint").alias("n"))


@query("SELECT o_orderkey, CAST(o_custkey AS DOUBLE) / 10 AS \"Jpm\", CAST(o_orderkey % 7 AS DOUBLE) AS \"Bx\", -0.5 + (o_orderkey % 2) AS \"By\", CAST(NULL AS DOUBLE) AS \"Bz\", o_orderkey % 5 || '.' || o_orderkey % 3 AS sector FROM orders".replace("-0.5 + (o_orderkey % 2)", "CAST(-0.5 + (o_orderkey % 2) AS DOUBLE)"))
def path_parameters(spark, sf):
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    made = F.concat(F.lit("out/Jpm="), (F.col("o_custkey") / 10).cast("string"), F.lit("%Bx="), (k % 7).cast("string"), F.lit("%By="), F.when(k % 2 == 0, "-0.5").otherwise("0.5"), F.lit("%_s"), (k % 5).cast("string"), F.lit("."), (k % 3).cast("string"), F.lit(".h5"))
    return store.path_parameters(o.select("o_orderkey", made.alias("path"))).drop("path")


@query()
def ice_enumerate_32(spark, sf):
    """All states of 32 sites."""
    return enumeration.ice_states(spark, pyrochlore((2, 0, 0), (0, 2, 0), (0, 0, 2))).select("lo")


@query()
def lanczos_ground_state(spark, sf):
    """Lowest five values on 32 sites with g = (1, -.2, -.2, -.2)."""
    lat = pyrochlore((2, 0, 0), (0, 2, 0), (0, 0, 2))
    h = hamiltonians.ring_hamiltonian(lat, [1.0, -0.2, -0.2, -0.2])
    values, _ = krylov.eigenpairs(enumeration.ice_states(spark, lat), h, 32, 5)
    return spark.createDataFrame([(i, round(float(e), 8)) for i, e in enumerate(values)], "i int, e double")


@query()
def thermal_average(spark, sf):
    """Energies by temperature on 16 sites from random vectors."""
    basis = enumeration.ice_states(spark, CELL16)
    states = ap.local_states(basis, N, krylov.LOCAL)
    a = ap.Local(states, hamiltonians.ring_hamiltonian(CELL16, [1.0, -0.2, -0.2, -0.2], repeated=False))
    out = krylov.thermal(a.__matmul__, states, [], [0.5, 1.0, 2.0], 8)
    return spark.createDataFrame([(r["beta"], r["mean"][0], r["error"][0]) for r in out], "beta double, energy double, error double")


@query()
def spline_interpolation(spark, sf):
    """Account balances along keys, interpolated within each nation."""
    c = read(spark, sf, "customer").select("c_nationkey", F.col("c_custkey").cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    return sweep.interpolated(c, "c_nationkey", "x", "y", [10.5, 50.5, 100.5])
