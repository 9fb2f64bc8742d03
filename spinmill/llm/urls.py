"""URL filters: boosted trees on lexical features behind a list of host and path rules."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, settled

# The contract's rules, as (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Labelled URLs that the trees are fitted on at most; the first by a hash of the URL.
MOST_LABELLED = 20_000
FEATURES = ["length", "host_length", "path_length", "depth", "digits", "hyphens", "parameters", "host_labels", "entropy", "fragment", "suffix_log_count", "suffix_blocked"]


def lexical(url: str, host: str, path: str) -> list[float]:
    """What the URL's characters alone say; the suffix statistics come from all URLs."""
    n = max(len(url), 1)
    counts = np.array([url.count(c) for c in set(url)], np.float64) / n
    return [
        len(url), len(host), len(path), sum(1 for x in path.split("/") if x), sum(c.isdigit() for c in url) / n, url.count("-"),
        (url.partition("?")[2].count("=")), host.count(".") + bool(host), float(-(counts * np.log2(counts)).sum()) if len(counts) else 0.0, float("#" in url),
    ]


class Trees:
    """Gradient-boosted regression trees for the log loss: binned features, exact best splits over the bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, leaf: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.leaf = rounds, depth, rate, bins, leaf
        self.trees: list[list[tuple]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        if not len(y):
            return self
        mean = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(mean / (1 - mean)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        z = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            tree: list[tuple] = []
            node, at = np.zeros(len(y), np.int64), [np.arange(len(y))]
            values = np.zeros(len(y))
            queue = [(0, at[0])]
            for level in range(self.depth + 1):
                below = []
                for k, rows in queue:
                    best = self._split(binned, edges, g, h, rows) if level < self.depth else None
                    if best is None:
                        value = self.rate * g[rows].sum() / (h[rows].sum() + self.leaf)
                        values[rows] = value
                        tree.append((k, -1, 0.0, value))
                        continue
                    f, b = best
                    tree.append((k, f, float(edges[f][b]), 0.0))
                    left = binned[rows, f] <= b
                    below += [(2 * k + 1, rows[left]), (2 * k + 2, rows[~left])]
                queue = below
            self.trees.append(tree)
            z += values
        return self

    def _split(self, binned, edges, g, h, rows):
        best, gain = None, 1e-6
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for f, e in enumerate(edges):
            if not len(e):
                continue
            gs = np.cumsum(np.bincount(binned[rows, f], g[rows], len(e) + 1))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, f], h[rows], len(e) + 1))[:-1]
            n = np.cumsum(np.bincount(binned[rows, f], minlength=len(e) + 1))[:-1]
            own = gs**2 / (hs + self.leaf) + (total_g - gs) ** 2 / (total_h - hs + self.leaf) - total_g**2 / (total_h + self.leaf)
            own[(n == 0) | (n == len(rows))] = -1
            b = int(np.argmax(own))
            if own[b] > gain:
                best, gain = (f, b), float(own[b])
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            for k, f, cut, value in tree:
                here = node == k
                if f < 0:
                    z[here] += value
                else:
                    node[here] = np.where(x[here, f] <= cut, 2 * k + 1, 2 * k + 2)
        return 1 / (1 + np.exp(-z))


def parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host and path as the contract cuts them."""
    cut = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    return pages.withColumns({"host": F.translate(F.regexp_extract(url, cut, 1), UPPER, LOWER), "path": F.regexp_extract(url, cut, 2)})


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages (with host and path) with rule, by_rule: the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return pages.withColumns({"rule": rule, "by_rule": verdict})


def _features(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and x, the features as doubles. df: url, host, path, n, blocked, and those of keep."""
    src = df.select(*keep, F.col("__url").alias("__u"), F.col("host").alias("__h"), F.col("path").alias("__p"), F.log1p("n").alias("__n"), F.col("share").alias("__s"))

    def run(batches):
        for batch in batches:
            urls, hosts, paths = (batch.column(c).to_pylist() for c in ("__u", "__h", "__p"))
            x = [[*lexical(u or "", h, p), n, s] for u, h, p, n, s in zip(urls, hosts, paths, batch.column("__n").to_pylist(), batch.column("__s").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in keep)
    return src.mapInArrow(run, f"{kinds}, x array<double>")


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, labelled: DataFrame | None = None, rules=RULES, most: int = MOST_LABELLED) -> DataFrame:
    """id_col, host, path, rule, verdict, score (the trees' probability of block) for each page.

    labelled: url and blocked (0 or 1) to learn from; without it, the URLs that the rules decide are the labelled ones.
    Suffix statistics (the host's last label: how frequent, what share blocked) count all URLs. A null URL has an empty
    host and path and is scored by its zero features. Without anything to learn from, each score is a half and allows.
    """
    rows = ruled(parts(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("__url")), "__url"), rules).withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0))
    if labelled is None:
        known = rows.where("by_rule is not null").withColumn("y", (F.col("by_rule") == "block").cast("double"))
    else:
        known = parts(labelled.select(F.col(url_col).alias("__url"), F.col("blocked").cast("double").alias("y")), "__url").withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0))
    blocked = known.groupBy("suffix").agg(F.sum("y").alias("bad"), F.count("y").alias("judged"))
    stats = rows.groupBy("suffix").agg(F.count("*").alias("n")).join(blocked, "suffix", "left")
    stats = settled(stats.select("suffix", "n", ((F.coalesce("bad", F.lit(0.0)) + 1) / (F.coalesce("judged", F.lit(0)) + 2)).alias("share")))
    first = known.select("__url", "host", "path", "suffix", "y").orderBy(F.xxhash64("__url"), "__url").limit(most)
    sample = _features(first.join(stats, "suffix", "left").na.fill({"n": 0, "share": 0.5}), ["y"]).collect()
    sample = sorted((tuple(r["x"]), r["y"]) for r in sample)
    x = np.array([s[0] for s in sample], np.float64).reshape(len(sample), len(FEATURES))
    model = Trees().fit(x, np.array([s[1] for s in sample], np.float64))
    keep = ["id", "host", "path", "rule", "by_rule"]
    scored = _features(rows.join(stats, "suffix", "left").na.fill({"n": 0, "share": 0.5}), keep)

    def judge(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(model.predict(x))], [*keep, "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema if f.name in keep)
    out = scored.mapInArrow(judge, f"{kinds}, score double")
    verdict = F.coalesce("by_rule", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "score")
