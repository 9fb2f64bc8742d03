"""Eigenpairs, exponentials and thermal averages by Krylov spaces: driver loops over distributed applications."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import OpSum
from ..functions.bits import names
from .apply import Local, apply, local_states
from .enumeration import checkpointed

#: States up to which the dense solver, and up to which vectors on the driver, are used.
DENSE, LOCAL = 600, 100_000


@dataclass
class Settings:
    krylov_dim: int = 200
    min_iterations: int = 10
    tol_value: float = 1e-12
    tol_vector: float = 1e-10
    seed: int = 0
    #: Iterations between cuts of the distributed recurrence's lineage.
    cut_every: int = 1


@dataclass
class Result:
    values: np.ndarray
    vectors: object = None
    iterations: int = 0
    converged: bool = True
    alphas: list[float] = field(default_factory=list)
    betas: list[float] = field(default_factory=list)


def start_vector(states: np.ndarray, seed: int = 0) -> np.ndarray:
    """Unit vector from a hash of each state: the same however the states are dealt."""
    x = states.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(k)
    v = (x ^ (x >> np.uint64(31))) / 2.0**63 - 1.0
    return v / np.linalg.norm(v)


def tridiagonal(alphas, betas) -> tuple[np.ndarray, np.ndarray]:
    t = np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1) + np.diag(betas[: len(alphas) - 1], -1)
    return np.linalg.eigh(t)


def lanczos(matvec, v: np.ndarray, k: int = 1, s: Settings | None = None) -> Result:
    """Lowest k pairs of a symmetric matvec, with full re-orthogonalisation; stops once the values and residuals settle."""
    s = s or Settings()
    n = len(v)
    basis, alphas, betas = [v / np.linalg.norm(v)], [], []
    last, done = None, False
    while len(alphas) < min(s.krylov_dim, n):
        w = matvec(basis[-1])
        alphas.append(float(basis[-1] @ w))
        q = np.array(basis)
        for _ in range(2):
            w = w - q.T @ (q @ w)
        beta = float(np.linalg.norm(w))
        e, u = tridiagonal(alphas, betas)
        low = e[:k]
        near = last is not None and len(low) == len(last) and np.all((np.abs(low - last) < s.tol_value) | (np.abs(low - last) < s.tol_value * np.abs(low)))
        if beta < 1e-12:
            done = True
            break
        if len(alphas) >= s.min_iterations and near and np.all(beta * np.abs(u[-1, : len(low)]) < s.tol_vector):
            done = True
            break
        last = low
        betas.append(beta)
        basis.append(w / beta)
    e, u = tridiagonal(alphas, betas)
    vectors = np.array(basis[: len(alphas)]).T @ u[:, :k]
    return Result(e[:k], vectors / np.linalg.norm(vectors, axis=0), len(alphas), done or len(alphas) == n, alphas, betas)


def dot(a: DataFrame, b: DataFrame, n_sites: int) -> float:
    """Sum of products over common states, as one global aggregate."""
    joined = a.join(b.withColumnRenamed("x", "z"), names(n_sites))
    return float(joined.agg(F.coalesce(F.sum(F.col("x") * F.col("z")), F.lit(0.0))).first()[0])


def norm(a: DataFrame) -> float:
    return float(a.agg(F.sqrt(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0)))).first()[0])


def combined(parts: list[tuple[float, DataFrame]], n_sites: int) -> DataFrame:
    """Sum of multiples of vectors; a missing state counts as zero."""
    out = None
    for c, df in parts:
        one = df.select(*names(n_sites), (F.lit(float(c)) * F.col("x")).alias("x"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*names(n_sites)).agg(F.sum("x").alias("x"))


def hashed_start(basis: DataFrame, n_sites: int, seed: int = 0) -> DataFrame:
    """Unit vector from a hash of each state."""
    x = basis.select(*names(n_sites), (F.xxhash64(*names(n_sites), F.lit(seed)) / F.lit(2.0**63)).alias("x"))
    size = norm(x)
    return x.withColumn("x", F.col("x") / F.lit(size))


def distributed_lanczos(basis: DataFrame, ops: OpSum, n_sites: int, s: Settings | None = None, resume: dict | None = None) -> tuple[Result, dict]:
    """Lowest value by the three-term recurrence over DataFrames, and the state from which it can go on.

    Two vectors live at a time, each written to the checkpoint folder, so an iteration costs one application and two
    aggregates whatever came before, and survives lost executors. Values only: without re-orthogonalisation, repeated
    values may show up more often than they are, and only the lowest is reported.
    """
    s = s or Settings()
    state = resume or {"v": checkpointed(hashed_start(basis, n_sites, s.seed)), "u": None, "alphas": [], "betas": []}
    v, u, alphas, betas = state["v"], state["u"], state["alphas"], state["betas"]
    last, done = (float(tridiagonal(alphas, betas)[0][0]) if alphas else None), False
    while len(alphas) < s.krylov_dim:
        w = apply(v, ops, n_sites, basis=basis)
        w = w if u is None else combined([(1.0, w), (-betas[-1], u)], n_sites)
        w = checkpointed(w)
        alpha = dot(v, w, n_sites)
        w = combined([(1.0, w), (-alpha, v)], n_sites)
        w = checkpointed(w)
        alphas.append(alpha)
        beta = norm(w)
        e = float(tridiagonal(alphas, betas)[0][0])
        if beta < 1e-10 or (len(alphas) >= s.min_iterations and last is not None and abs(e - last) < s.tol_value * max(1.0, abs(e))):
            done = True
            break
        last = e
        betas.append(beta)
        u, v = v, w.withColumn("x", F.col("x") / F.lit(beta))
    values = tridiagonal(alphas, betas)[0][:1]
    return Result(values, None, len(alphas), done, alphas, betas), {"v": v, "u": u, "alphas": alphas, "betas": betas}


def save_state(state: dict, path: str) -> None:
    """A recurrence's vectors and coefficients as Parquet."""
    spark = state["v"].sparkSession
    state["v"].write.mode("overwrite").parquet(f"{path}/v")
    if state["u"] is not None:
        state["u"].write.mode("overwrite").parquet(f"{path}/u")
    rows = [(i, a, state["betas"][i] if i < len(state["betas"]) else None) for i, a in enumerate(state["alphas"])]
    spark.createDataFrame(rows, "i int, alpha double, beta double").coalesce(1).write.mode("overwrite").parquet(f"{path}/coefficients")


def load_state(spark: SparkSession, path: str) -> dict:
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{path}/coefficients").collect())
    betas = [b for _, _, b in rows if b is not None]
    return {"v": spark.read.parquet(f"{path}/v"), "u": spark.read.parquet(f"{path}/u") if len(betas) else None, "alphas": [a for _, a, _ in rows], "betas": betas}


def _weighted(q: str, weights: np.ndarray) -> Column:
    """Sum of a row's entries of array q by weight, in compiled code."""
    total = F.lit(0.0)
    for i, w in enumerate(weights):
        total = total + F.get(q, F.lit(i)) * F.lit(float(w))
    return total


def _products(df: DataFrame, q: str, width: int, w: Column) -> tuple[np.ndarray, float]:
    """Inner products of w with each vector of array q, and of w with itself, in one aggregate."""
    row = df.agg(*[F.coalesce(F.sum(F.get(q, F.lit(i)) * w), F.lit(0.0)) for i in range(width)], F.coalesce(F.sum(w * w), F.lit(0.0))).first()
    return np.array(row[:-1], float), float(row[-1])


def distributed_eigenpairs(basis: DataFrame, ops: OpSum, n_sites: int, k: int = 1, s: Settings | None = None) -> tuple[np.ndarray, DataFrame]:
    """Lowest k values and their vectors over DataFrames, for bases of any size and of one or two words.

    A row for each state holds its entries of all Krylov vectors, so that inner products are one aggregate, a new vector
    one join on the state, and Ritz vectors a projection. k starts find multiple values. Every vector is
    orthogonalised against all others twice; beyond the bound on their number the best Ritz vectors are kept and the rest
    goes. Each step is written to the checkpoint folder. Fewer than k pairs if there are fewer states; an error if it
    doesn't converge.
    """
    s, cols = s or Settings(), names(n_sites)
    most = max(3 * k + 24, min(s.krylov_dim, 72))
    starts = F.array(*[F.xxhash64(*cols, F.lit(s.seed + i)) / F.lit(2.0**63) for i in range(k)])
    space = checkpointed(basis.select(*cols, starts.alias("q")))
    gram = np.stack([_products(space, "q", k, F.get("q", F.lit(i)))[0] for i in range(k)])
    size, turn = np.linalg.eigh(gram)
    keep = size > 1e-12 * max(size.max(initial=0.0), 1e-300)
    turn = turn[:, keep] / np.sqrt(size[keep])
    width, done = turn.shape[1], 0
    if not width:
        return np.zeros(0), basis.select(*cols, F.lit(0).alias("vec"), F.lit(0.0).alias("x")).limit(0)
    space = space.select(*cols, F.array(*[_weighted("q", turn[:, i]) for i in range(width)]).alias("q"))
    t = np.zeros((width, width))
    for _ in range(40 * most):
        w = apply(space.select(*cols, F.get("q", F.lit(done)).alias("x")), ops, n_sites, basis=basis).withColumnRenamed("x", "w")
        space = checkpointed(space.join(w, cols, "left").select(*cols, "q", F.coalesce("w", F.lit(0.0)).alias("w")))
        first, _ = _products(space, "q", width, F.col("w"))
        rest = F.col("w") - _weighted("q", first)
        again, left = _products(space, "q", width, rest)
        rest, beta = rest - _weighted("q", again), np.sqrt(max(left - float(again @ again), 0.0))
        t[:, done] = t[done, :] = first + again
        done += 1
        if beta > 1e-10 * max(1.0, np.abs(t).max()):
            space = space.select(*cols, F.array_append("q", rest / F.lit(beta)).alias("q"))
            t = np.pad(t, (0, 1))
            t[width, done - 1] = t[done - 1, width] = beta
            width += 1
        else:
            space = space.select(*cols, "q")
        e, u = np.linalg.eigh(t[:done, :done])
        # What the operator makes of a Ritz vector outside the vectors it has been applied to is its residual.
        gap = np.linalg.norm(t[done:, :done] @ u[:, :k], axis=0)
        if done == width or done >= k and np.all(gap < max(s.tol_vector, 1e-9)):
            break
        if width > most:
            stay = min(done, 2 * k + 8)
            turn = np.zeros((width, stay + width - done))
            turn[:done, :stay] = u[:, :stay]
            turn[done:, stay:] = np.eye(width - done)
            space = space.select(*cols, F.array(*[_weighted("q", turn[:, i]) for i in range(turn.shape[1])]).alias("q"))
            t, width, done = turn.T @ t @ turn, turn.shape[1], stay
    else:
        raise RuntimeError(f"no convergence: residuals {gap}")
    found = min(k, done)
    ritz = space.select(*cols, F.array(*[_weighted("q", u[:, i]) for i in range(found)]).alias("q"))
    ritz = checkpointed(ritz)
    top = ritz.agg(*[F.max_by(F.get("q", F.lit(i)), F.struct(F.abs(F.get("q", F.lit(i))), *cols)) for i in range(found)]).first()
    sign = F.array(*[F.lit(-1.0 if x < 0 else 1.0) for x in top])
    rows = ritz.select(*cols, F.posexplode(F.zip_with("q", sign, lambda a, b: a * b)).alias("vec", "x"))
    return e[:found], rows


def eigenpairs(basis: DataFrame, ops: OpSum, n_sites: int, k: int = 1, s: Settings | None = None, *, local: int = LOCAL) -> tuple[np.ndarray, DataFrame]:
    """Lowest k values, and their vectors as (lo, hi beyond 63 sites, vec, x): dense or Krylov on the driver up to `local`
    states of one word, over DataFrames beyond."""
    s = s or Settings()
    states = local_states(basis, n_sites, local)
    if states is None:
        return distributed_eigenpairs(basis, ops, n_sites, k, s)
    a = Local(states, ops)
    if len(states) <= DENSE:
        values, vectors = np.linalg.eigh(a.dense())
        values, vectors = values[:k], vectors[:, :k]
    else:
        # A block of starts finds multiple eigenvalues, which one start can't.
        values, vectors = block_lanczos(a.__matmul__, np.stack([start_vector(states, s.seed + i) for i in range(k)], 1), k, s)
    import pandas as pd

    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    rows = pd.DataFrame({"lo": np.tile(states.astype(np.int64), len(values)), "vec": np.repeat(np.arange(len(values)), len(states)), "x": (vectors * signs).T.ravel()})
    return values, basis.sparkSession.createDataFrame(rows, "lo bigint, vec int, x double")


def block_lanczos(matvec, v: np.ndarray, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Lowest k pairs from a block of starts, with full re-orthogonalisation and restarts from the best vectors."""
    n, last = len(v), None
    width = max(k, v.shape[1])
    most = min(n, max(4 * width, min(s.krylov_dim, 160)))
    q, _ = np.linalg.qr(v)
    for _ in range(60):
        space, images = [q], []
        while sum(b.shape[1] for b in space) <= most:
            w = matvec(space[-1])
            images.append(w)
            whole = np.concatenate(space, axis=1)
            w = w - whole @ (whole.T @ w)
            w = w - whole @ (whole.T @ w)
            new, r = np.linalg.qr(w)
            keep = np.abs(np.diag(r)) > 1e-10
            if not keep.any() or whole.shape[1] + keep.sum() > n:
                break
            space.append(new[:, keep])
        whole, image = np.concatenate(space[: len(images)], axis=1), np.concatenate(images, axis=1)
        t = whole.T @ image
        e, u = np.linalg.eigh((t + t.T) / 2)
        q = whole @ u[:, :width]
        gap = np.linalg.norm(image @ u[:, :k] - q[:, :k] * e[:k], axis=0)
        if np.all(gap < max(s.tol_vector, 1e-9)) or (last is not None and len(e) >= n):
            break
        last = e[:k]
    return e[:k], q[:, :k]


def _exponential_weights(alphas, betas, tau: float) -> tuple[np.ndarray, float]:
    """exp(tau T) of the first unit vector, less a factor, and that factor's logarithm."""
    e, u = tridiagonal(alphas, betas)
    top = (tau * e).max()
    return u @ (np.exp(tau * e - top) * u[0]), float(top)


def _settled(c: np.ndarray, old: np.ndarray | None) -> bool:
    return old is not None and bool(np.linalg.norm(c - np.append(old, 0.0)) < 1e-13 * np.linalg.norm(c))


def exponential(matvec, v: np.ndarray, tau: float, s: Settings | None = None) -> np.ndarray:
    """exp(tau A) v for a symmetric matvec."""
    s = s or Settings()
    size = float(np.linalg.norm(v))
    if size == 0.0 or tau == 0.0:
        return v.copy()
    basis, alphas, betas, old = [v / size], [], [], None
    while True:
        w = matvec(basis[-1])
        if w.shape != v.shape:
            raise ValueError("the operator and the vector differ in size")
        alphas.append(float(basis[-1] @ w))
        q = np.array(basis)
        for _ in range(2):
            w = w - q.T @ (q @ w)
        beta = float(np.linalg.norm(w))
        c, top = _exponential_weights(alphas, betas, tau)
        if beta < 1e-12 or len(alphas) >= min(s.krylov_dim, len(v)) or _settled(c, old):
            return size * np.exp(top) * (q.T @ c)
        old = c
        betas.append(beta)
        basis.append(w / beta)


def distributed_exponential(v: DataFrame, ops: OpSum, n_sites: int, tau: float, s: Settings | None = None) -> tuple[DataFrame, float]:
    """(u, a) with exp(tau A) v = e^a u over DataFrames; the states of v are the basis.

    A row for each state holds its entries of all Krylov vectors, as in distributed_eigenpairs; each step is one
    application, one join on the state and two aggregates, and is written to the checkpoint folder.
    """
    s, cols = s or Settings(), names(n_sites)
    size = norm(v)
    if size == 0.0 or tau == 0.0:
        return v.select(*cols, "x"), 0.0
    space = checkpointed(v.select(*cols, F.array(F.col("x") / F.lit(size)).alias("q")))
    basis = space.select(*cols)
    alphas, betas, old = [], [], None
    while True:
        done = len(alphas)
        w = apply(space.select(*cols, F.get("q", F.lit(done)).alias("x")), ops, n_sites, basis=basis).withColumnRenamed("x", "w")
        space = checkpointed(space.join(w, cols, "left").select(*cols, "q", F.coalesce("w", F.lit(0.0)).alias("w")))
        first, _ = _products(space, "q", done + 1, F.col("w"))
        rest = F.col("w") - _weighted("q", first)
        again, left = _products(space, "q", done + 1, rest)
        rest, beta = rest - _weighted("q", again), np.sqrt(max(left - float(again @ again), 0.0))
        alphas.append(float(first[done] + again[done]))
        c, top = _exponential_weights(alphas, betas, tau)
        if beta < 1e-10 * max(1.0, np.abs(alphas).max()) or len(alphas) >= s.krylov_dim or _settled(c, old):
            return space.select(*cols, (F.lit(size) * _weighted("q", c)).alias("x")), top
        old = c
        betas.append(beta)
        space = space.select(*cols, F.array_append("q", rest / F.lit(beta)).alias("q"))


def distributed_thermal(basis: DataFrame, ops: OpSum, n_sites: int, observables: list[OpSum], betas: list[float], samples: int, s: Settings | None = None, *, starts: list[DataFrame] | None = None) -> list[dict]:
    """As `thermal`, over DataFrames, for bases of any size. starts: vectors over the basis to take instead of random ones;
    with a unit vector for each state the averages are exact."""
    s = s or Settings()
    tops, bottoms = [], []
    for v in starts or [hashed_start(basis, n_sites, s.seed + r) for r in range(samples)]:
        at, scale, up, down = 0.0, 0.0, [], []
        for b in betas:
            v, grown = distributed_exponential(v, ops, n_sites, -(b - at) / 2, s)
            v = checkpointed(v)
            size = norm(v)
            v, scale, at = v.withColumn("x", F.col("x") / F.lit(size)), scale + grown + np.log(size), b
            up.append([dot(v, apply(v, o, n_sites), n_sites) for o in (ops, *observables)])
            down.append(2 * scale)
        tops.append(up)
        bottoms.append(down)
    return _averaged(tops, bottoms, betas)


def thermal_averages(basis: DataFrame, ops: OpSum, n_sites: int, observables: list[OpSum], betas: list[float], samples: int, s: Settings | None = None, *, local: int = LOCAL) -> list[dict]:
    """Thermal averages: on the driver up to `local` states of one word, over DataFrames beyond."""
    states = local_states(basis, n_sites, local)
    if states is None:
        return distributed_thermal(basis, ops, n_sites, observables, betas, samples, s)
    return thermal(Local(states, ops).__matmul__, states, [Local(states, o).__matmul__ for o in observables], betas, samples, s)


def thermal_runs(runs: dict[str, DataFrame], ops: OpSum, n_sites: int, betas: list[float], samples: int, path: str, s: Settings | None = None, *, local: int = LOCAL) -> list[str]:
    """Energies by temperature of each named basis, such as a sector, as path/run=<name>; those that are there are left
    alone. Returns the names that were run."""
    from ..sources.store import written

    made = []
    for name, basis in runs.items():
        spark = basis.sparkSession
        if written(spark, f"{path}/run={name}"):
            continue
        out = thermal_averages(basis, ops, n_sites, [], betas, samples, s, local=local)
        rows = [(r["beta"], r["mean"][0], r["error"][0]) for r in out]
        spark.createDataFrame(rows, "beta double, energy double, error double").coalesce(1).write.mode("overwrite").parquet(f"{path}/run={name}")
        made.append(name)
    return made


def thermal(matvec, states: np.ndarray, observables: list, betas: list[float], samples: int, s: Settings | None = None) -> list[dict]:
    """Averages by random vectors: sum <r| e^(-bH/2) O e^(-bH/2) |r> over sum <r| e^(-bH) |r>, energy first, with errors.

    Every sample is evolved from one beta to the next; betas ascend. Scales grow apart, so each is kept in its logarithm.
    """
    s = s or Settings()
    tops, bottoms = [], []
    for r in range(samples):
        v, at, scale, up, down = start_vector(states, s.seed + r), 0.0, 0.0, [], []
        for b in betas:
            v = exponential(matvec, v, -(b - at) / 2, s)
            size = float(np.linalg.norm(v))
            v, scale, at = v / size, scale + np.log(size), b
            up.append([float(v @ matvec(v)), *(float(v @ o(v)) for o in observables)])
            down.append(2 * scale)
        tops.append(up)
        bottoms.append(down)
    return _averaged(tops, bottoms, betas)


def _averaged(tops: list, bottoms: list, betas: list[float]) -> list[dict]:
    """Means and errors over samples, whose weights are given by their logarithms."""
    logs, values = np.array(bottoms), np.array(tops)
    weight = np.exp(logs - logs.max(axis=0))
    total = weight.sum(axis=0)
    mean = (weight[:, :, None] * values).sum(axis=0) / total[:, None]
    spread = np.sqrt((weight[:, :, None] ** 2 * (values - mean) ** 2).sum(axis=0)) / total[:, None]
    return [{"beta": b, "mean": mean[i].tolist(), "error": spread[i].tolist()} for i, b in enumerate(betas)]


def partition_function(spectrum: DataFrame, betas: DataFrame, energy: str = "e") -> DataFrame:
    """beta, z (relative to the lowest energy) and mean energy from a whole spectrum. betas is a parameter grid: small."""
    low = spectrum.agg(F.min(energy).alias("low"))
    rows = spectrum.select(F.col(energy).alias("e")).crossJoin(F.broadcast(low)).crossJoin(F.broadcast(betas.select("beta")))
    w = F.exp(-F.col("beta") * (F.col("e") - F.col("low")))
    return rows.groupBy("beta").agg(F.sum(w).alias("z"), (F.sum(w * F.col("e")) / F.sum(w)).alias("mean_e"))
