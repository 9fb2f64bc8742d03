"""Toxicity: a linear classifier whose training penalises score changes under swapped identity terms."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, settled

#: Labelled rows that the classifier is fitted on at most; the first by a hash of their id.
MOST_LABELLED = 20_000
#: Weight of the squared score change under swapped identity terms.
SWAP_WEIGHT = 1.0
#: A word counts as a feature if so many of those rows have it.
MIN_ROWS = 5
#: and if its share of toxic rows is so many standard deviations from the mean.
DEVIATIONS = 3.0
#: Bytes of a word's beginnings that are features too.
PREFIXES = (4, 5, 6, 8)
THRESHOLD = 0.3

# Identity terms by kind; a swap replaces a term with another of its kind.
IDENTITY = {
    "gender": ["women", "men", "woman", "man", "girls", "boys", "transgender", "female", "male"],
    "faith": ["christians", "muslims", "jews", "hindus", "buddhists", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic"],
    "origin": ["americans", "mexicans", "africans", "asians", "europeans", "immigrants", "refugees", "american", "mexican", "african", "asian", "european"],
    "skin": ["black", "white", "brown"],
    "love": ["gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"],
    "body": ["disabled", "blind", "deaf", "autistic", "elderly", "young"],
}
KIND = {w.encode(): [x.encode() for x in terms] for terms in IDENTITY.values() for w in terms}


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def swapped(words: list[bytes], turn: int) -> list[bytes]:
    """The words with every identity term replaced by another of its kind; the same for a term throughout."""
    out = []
    for w in words:
        terms = KIND.get(w)
        if terms:
            w = terms[(terms.index(w) + 1 + (turn + xxhash.xxh64_intdigest(w)) % (len(terms) - 1)) % len(terms)]
        out.append(w)
    return out


def features(word: bytes) -> tuple[int, ...]:
    """Hashes of the word and of its beginnings, which inflected and compound forms share."""
    h = xxhash.xxh3_64_intdigest
    return (h(word), *(h(word[:k], 1) for k in PREFIXES if len(word) > k))


def feature_set(words, memo: dict[bytes, tuple[int, ...]]) -> set[int]:
    """Distinct features; memo keeps those of words met before, and is emptied when large."""
    out: set[int] = set()
    if len(memo) > 300_000:
        memo.clear()
    for w in set(words):
        own = memo.get(w)
        if own is None:
            own = memo[w] = features(w)
        out.update(own)
    return out


def fit(rows: list[tuple[set[int], set[int] | None, int]], *, swap_weight: float = SWAP_WEIGHT, ridge: float = 3.0, rounds: int = 200) -> dict[int, float]:
    """Weights by feature, the bias under -1. rows: (features, features after a swap or None, label).

    Minimises the log loss, plus swap_weight times the squared change of the score under the swap, plus a ridge, by
    gradient steps of Adam from zero: the same rows give the same weights.
    """
    if not rows:
        return {-1: math.log(0.1 / 0.9)}
    vocabulary = sorted(set().union(*(r[0] for r in rows), *(r[1] for r in rows if r[1] is not None)))
    number = {f: i for i, f in enumerate(vocabulary)}

    def matrix(sets):
        own = [sorted(number[f] for f in s) for s in sets]
        counts = np.array([len(x) for x in own], np.int64)
        return np.array([i for x in own for i in x], np.int64), np.repeat(np.arange(len(own)), counts), len(own)

    y = np.array([r[2] for r in rows], np.float64)
    cols, of, n = matrix([r[0] for r in rows])
    pairs = [(r[0], r[1]) for r in rows if r[1] is not None]
    pc, po, pn = matrix([a - b for a, b in pairs])
    mc, mo, _ = matrix([b - a for a, b in pairs])
    d = len(vocabulary)
    w, b = np.zeros(d), math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, rounds + 1):
        z = b + np.bincount(of, w[cols], n)
        r = (1 / (1 + np.exp(-z)) - y) / n
        g = np.bincount(cols, r[of], d) + ridge * w / n
        if pn:
            change = np.bincount(po, w[pc], pn) - np.bincount(mo, w[mc], pn)
            change *= 2 * swap_weight / pn
            g += np.bincount(pc, change[po], d) - np.bincount(mc, change[mo], d)
        g = np.append(g, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return {f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-3} | {-1: float(b)}


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int, swap_weight: float = SWAP_WEIGHT) -> dict[int, float]:
    """Weights from at most `most` labelled rows. Their ids, and the features that tell, are broadcast: bounded by `most`."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    ids = ids.orderBy(F.xxhash64(id_col), id_col).limit(most).select(F.col(id_col).alias("id"), "y")
    src = settled(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id"))
    total = src.agg(F.count("*"), F.sum("y")).first()

    def counts(batches):
        memo: dict = {}
        for batch in batches:
            n: dict[int, int] = {}
            bad: dict[int, int] = {}
            for value, y in zip(batch.column("text"), batch.column("y").to_pylist()):
                for f in feature_set(alnum_words(value.as_py()), memo):
                    n[f] = n.get(f, 0) + 1
                    if y:
                        bad[f] = bad.get(f, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.fromiter(n, np.uint64, len(n)).view(np.int64)), pa.array(n.values(), pa.int64()), pa.array([bad.get(f, 0) for f in n], pa.int64())], ["f", "n", "bad"])

    sums = src.mapInArrow(counts, "f bigint, n bigint, bad bigint").groupBy("f").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= MIN_ROWS)
    p = ((total[1] or 0) + 0.5) / (total[0] + 1)
    sums = sums.where(F.abs(F.col("bad") - F.col("n") * p) >= DEVIATIONS * F.sqrt(F.col("n") * (p * (1 - p))))
    kept = docs.sparkSession.sparkContext.broadcast(frozenset(r["f"] & (2**64 - 1) for r in sums.select("f").collect()))

    def own_features(batches):
        memo: dict = {}
        pack = lambda s: np.fromiter(sorted(s & kept.value), np.uint64).tobytes()
        for batch in batches:
            plain, swaps = [], []
            for i, value in enumerate(batch.column("text")):
                words = alnum_words(value.as_py())
                plain.append(pack(feature_set(words, memo)))
                swaps.append(None if KIND.keys().isdisjoint(words) else pack(feature_set(swapped(words, len(words)), memo)))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), pa.array(plain, pa.binary()), pa.array(swaps, pa.binary()), batch.column("y")], ["id", "own", "swap", "y"])

    unpack = lambda x: None if x is None else set(np.frombuffer(bytes(x), np.uint64).tolist())
    rows = src.mapInArrow(own_features, "id string, own binary, swap binary, y int").collect()
    rows = sorted((r["id"], bytes(r["own"]), r["swap"], r["y"]) for r in rows)[:most]
    return fit([(unpack(own), unpack(swap), y) for _, own, swap, y in rows], swap_weight=swap_weight)


def score(docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1) of each whole text, by the distinct features in it; an empty or null text has the bias alone."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(weights)  # at most what MOST_LABELLED rows hold

    def run(batches):
        w = dict(model.value)
        bias = w.pop(-1, 0.0)
        memo: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            z = []
            for value in batch.column("text"):
                if len(memo) > 500_000:
                    memo.clear()
                found: set[int] = set()
                for word in set(alnum_words(value.as_py())):
                    own = memo.get(word)
                    if own is None:
                        own = memo[word] = tuple(f for f in features(word) if f in w)
                    if own:
                        found.update(own)
                z.append(bias + math.fsum(map(w.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))), pa.float64())], ["id", "score"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def fit_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, most: int = MOST_LABELLED, threshold: float = THRESHOLD, swap_weight: float = SWAP_WEIGHT) -> DataFrame:
    """id_col, held_out, score, predicted. Only labels of rows not held out are learnt from.

    Rows with a null id or label aren't learnt from; all rows are scored, each by itself. Without labels every score is
    a tenth.
    """
    weights = train(docs, labels, id_col, text_col, label_col, most, swap_weight)
    return score(docs, weights, id_col, text_col).withColumns({"held_out": held_out(id_col), "predicted": (F.col("score") >= threshold).cast("int")})
