"""SimHash near-dedup: fingerprints, bit-sliced comparison inside exact bands, connected components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, settled, ws_words

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Members of a band's bucket that one task compares with each other; larger buckets are split into pairs of tiles.
TILE = 2048
#: Groups up to this size are compared many at a time, by shifts; larger ones by rows of queries.
SMALL = 192
#: Mean bucket size up to which fewer and shorter bands are preferred.
BUCKET = 512


def shingle_hashes(words: list[bytes], n: int = SHINGLE, seed: int = SEED) -> list[int]:
    """Hashes of every n words in a row, joined by blanks; of the whole sequence if it has fewer; none if it has none."""
    if not words:
        return []
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    starts = [0, *[e + 1 for e in ends]]
    return [h(joined[a:b], seed) for a, b in zip(starts, ends[n - 1 :])]


def majorities(hashes: np.ndarray, counts: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """For each run of counts[i] hashes: the bits that over half of them have. `step` hashes are spread out at a time."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        size = counts[full]
        ends = np.cumsum(size)
        starts, sums = ends - size, np.zeros((len(full), 64), np.int64)
        for lo in range(0, len(hashes), step):
            part = hashes[lo : lo + step]
            a, z = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, lo + len(part), "left")
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums[a:z] += np.add.reduceat(bits, np.maximum(starts[a:z] - lo, 0), axis=0, dtype=np.uint32)
        over = np.packbits(2 * sums > size[:, None], axis=1, bitorder="little")
        out[full] = over.view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fp (bigint with the fingerprint's bits) for each row; null and empty texts have fp 0."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            fps, part, counts = [], [], []

            def flush():
                fps.append(majorities(np.array(part, np.uint64), np.array(counts, np.int64)))
                part.clear()
                counts.clear()

            for value in batch.column("text"):
                h = shingle_hashes(ws_words(value.as_py()))
                part.extend(h)
                counts.append(len(h))
                if len(part) > 100_000:
                    flush()
            flush()
            fp = np.concatenate(fps).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp)], ["id", "fp"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def within_radius(planes, queries, radius: int = RADIUS, every: int = 16) -> np.ndarray:
    """Lanes (bits of the result's words) whose distance is at most radius.

    planes(k) and queries(k) give bit plane k of both sides as words of 64 lanes. Three planes at a time go through a
    carry-save adder into a vertical counter of as many bits as the radius has; lanes that overflow it are marked. The
    block is abandoned once every lane is above the radius.
    """
    counter: list[np.ndarray] = []
    over = None
    for k in range(0, 64, 3):
        x = [planes(j) ^ queries(j) for j in range(k, min(k + 3, 64))]
        if over is None:
            over = np.zeros_like(x[0])
            counter = [np.zeros_like(x[0]) for _ in range(max(1, radius.bit_length()))]
        if len(x) == 3:
            ab = x[0] ^ x[1]
            low, high = ab ^ x[2], (x[0] & x[1]) | (ab & x[2])
        else:
            low, high = x[0], None
        for add, at in ((low, 0), (high, 1)):
            if add is None:
                continue
            for i in range(at, len(counter)):
                add, counter[i] = counter[i] & add, counter[i] ^ add
            over |= add
        if k % every < 3 and k and np.all(_above(counter, over, radius) == ~np.uint64(0)):
            return np.zeros_like(over)
    return ~_above(counter, over, radius)


def _above(counter: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius: a bitwise comparison from the highest bit down."""
    gt, eq = over.copy(), ~over
    for i in range(len(counter) - 1, -1, -1):
        if radius >> i & 1:
            eq &= counter[i]
        else:
            gt |= eq & counter[i]
            eq &= ~counter[i]
    return gt


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): plane k holds bit k of every fingerprint, 64 of them in a word, with a spare word of zeros."""
    n = len(fps)
    lanes = np.zeros((64, (n + 63) // 64 * 8 + 8), np.uint8)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    lanes[:, : packed.shape[1]] = packed
    return lanes.view("<u8")


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little")[:n])


def small_links(fps: np.ndarray, group: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs inside groups that link. Rows of a group stand together and larger groups first."""
    planes, out_a, out_b = bit_planes(fps), [], []
    for s in range(1, int(size.max(initial=1))):
        n = int(np.searchsorted(-size, -s, "left"))  # rows whose group is larger than s
        if n <= s:
            break
        words, skip, turn = (n + 63) // 64, s // 64, np.uint64(s % 64)
        back = np.uint64(64 - s % 64) if s % 64 else np.uint64(0)
        width = max(0, min(words, planes.shape[1] - 1 - skip))

        def ahead(k):
            a = planes[k, skip : skip + width] >> turn
            return a | planes[k, skip + 1 : skip + 1 + width] << back if back else a

        found = _lanes(within_radius(lambda k: planes[k, :width], ahead, radius), min(n, width * 64))
        found = found[found + s < len(fps)]
        found = found[group[found] == group[found + s]]
        out_a.append(found)
        out_b.append(found + s)
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n can reach over the pairs."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def large_roots(fps: np.ndarray, radius: int, rows: int = 64) -> np.ndarray:
    """Roots of one group: rows of queries against all its bit planes at once."""
    n, planes = len(fps), bit_planes(fps)[:, :-1]
    label = np.arange(n)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.where(bits, ~np.uint64(0), np.uint64(0))
    for at in range(0, n, rows):
        q = full[at : at + rows]
        hit = within_radius(lambda k: planes[k][None, :], lambda k: q[:, k][:, None], radius)
        for i in np.flatnonzero(hit.any(axis=1)):
            own = _lanes(hit[i], n)
            touched = np.unique(label[own])
            if len(touched) > 1:
                label[np.isin(label, touched)] = touched[0]
    return label


def bands(n: int, radius: int = RADIUS, bucket: int = BUCKET) -> list[int]:
    """Masks of which two fingerprints within the radius agree on one at least.

    64 bits in radius + c blocks: at least c of them are alike. More blocks, and so longer masks, as n grows.
    """
    c = 1
    while n > bucket * 2 ** (64 * c / (radius + c)) and c < 5:
        c += 1
    blocks = radius + c
    cut = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(cut, cut[1:])]
    return [sum(x) for x in combinations(part, c)]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: pairs that span every class of fingerprints linked in some band's bucket; no bucket gives all its pairs.

    fps: fp, distinct. A bucket of m members gives m - 1 pairs at most, or that by pair of tiles where it is split.
    """
    n = fps.count()
    masks = bands(n, radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")) for m in masks])).alias("band", "key"))
    counts = keyed.groupBy("band", "key").count().where("count > 1")
    met = keyed.join(counts, ["band", "key"])
    tiles = F.ceil(F.col("count") / tile).cast("int")
    met = met.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), tiles).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    met = met.select("band", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    met = met.repartition(partitions(fps.sparkSession), "band", "key", "lo", "hi").sortWithinPartitions("band", "key", "lo", "hi")

    def compare(columns, fp):
        """Links of whole groups; group: an id for each row, rows of a group together."""
        group, size = columns
        a_out, b_out = [], []
        big = size > SMALL
        for g in np.unique(group[big]):
            own = fp[group == g]
            root = large_roots(own, radius)
            off = np.flatnonzero(root != np.arange(len(own)))
            a_out.append(own[off])
            b_out.append(own[root[off]])
        keep = np.flatnonzero(~big & (size > 1))
        keep = keep[np.lexsort((group[keep], -size[keep]))]
        if len(keep):
            own = fp[keep]
            root = roots_of(len(own), *small_links(own, group[keep], size[keep], radius))
            off = np.flatnonzero(root != np.arange(len(own)))
            a_out.append(own[off])
            b_out.append(own[root[off]])
        if a_out:
            a, b = (np.concatenate(x).view(np.int64) for x in (a_out, b_out))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if held.num_rows < 30_000:
                continue
            at = change(held)
            last = int(at[-1])
            if last:
                yield from whole_groups(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from whole_groups(held)

    def change(batch):
        """Rows at which a group begins."""
        new = np.zeros(batch.num_rows, bool)
        new[:1] = True
        for c in ("band", "key", "lo", "hi"):
            x = batch.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    def whole_groups(batch):
        at = change(batch)
        size = np.diff(np.append(at, batch.num_rows))
        group = np.repeat(np.arange(len(at)), size)
        yield from compare((group, np.repeat(size, size)), batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))

    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node it can reach) of each node with an edge, by alternating large and small stars.

    Each round joins edges with a minimum by node, so that no node's neighbours meet in one task, and is kept in the
    shared folder.
    """

    def mark(df):
        r = df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftrightunsigned(F.xxhash64("b", "a"), 20))).first()
        return tuple(r)

    edges = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = mark(edges)
    for _ in range(most_rounds):
        if not was[0]:
            break
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        edges = settled(small)
        now = mark(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = RADIUS) -> DataFrame:
    """id_col, fp, component_id (the smallest id reachable over fingerprints within the radius) for each row.

    Rows of one fingerprint are one node, however many. Null and empty texts have fingerprint 0 and link as any other.
    Null ids get their component's smallest id, or null if it has none; repeated rows get the same. No rows: none.
    """
    rows = settled(fingerprints(docs, id_col, text_col))
    nodes = settled(rows.groupBy("fp").agg(F.min(id_col).alias("first")))
    comps = components(links(nodes.select("fp"), radius))
    linked = comps.select(F.col("node").alias("fp"), "root").union(comps.select(F.col("root").alias("fp"), "root").distinct())
    named = nodes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(settled(best), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(id_col, "fp", "component_id")
