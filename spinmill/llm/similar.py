"""SimHash near-dedup by shingle similarity: fingerprints compared by bit planes, then shingle sets exactly.

Two sets within a Jaccard threshold share one of their rarest shingles (prefix filtering), so only rows that meet at such
a shingle are compared: all fingerprints of a group at once, by bit planes and carry-save counters. What is within the
wide radius is verified on the texts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, scratch, settled, sized, ws_words
from .linededup import mixed, word_hashes
from .simhash import SMALL, _lanes, bit_planes, components, majorities, small_links, within_radius

SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which fingerprints may differ. At a similarity of 0.8 they differ in 9.7 of 64 on average, with a deviation of
#: 2.9, so that fewer than one pair in 100,000 is farther apart; unrelated ones differ in 32.
RADIUS = 26
#: Buckets of the shingle counts that give the order of shingles; any order is right, rarer shingles first are quick.
COUNTS = 1 << 16
#: Nodes of a shingle that are compared with each other in the first round.
TILE = 2048
#: Pairs of small groups that are made at once.
MOST_PAIRS = 400_000
#: Words whose shingles are made at once.
CHUNK = 200_000


def shingle_sets(values, n: int, memo: dict):
    """(first text, hashes, sizes) of some texts at a time: the distinct shingles of each text, ascending.

    A text of fewer words than n is one shingle, of its words and blanks; one without a word has none.
    """
    words, counts, first, last = [], [], 0, len(values) - 1
    for i, value in enumerate(values):
        own = ws_words(value.as_py())
        words += own
        counts.append(len(own))
        if len(words) < CHUNK and i < last:
            continue
        h = np.concatenate((word_hashes(words, memo), np.zeros(n, np.uint64)))
        c = np.array(counts, np.int64)
        ends = np.cumsum(c)
        number = np.where(c > 0, np.maximum(c - n + 1, 1), 0)
        text = np.repeat(np.arange(len(c)), number)
        at = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number) + (ends - c)[text]
        out = np.zeros(len(at), np.uint64)
        for k in range(n):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + np.where(at + k < ends[text], h[at + k], np.uint64(0)))
        order = np.lexsort((out, text))
        out, text = out[order], text[order]
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
        yield first, out[new], np.bincount(text[new], minlength=len(c))
        words, counts, first = [], [], i + 1


def prefix_length(n, threshold: float):
    """Of two sets within the threshold, the first so many in any common order share one at least."""
    return np.where(np.asarray(n) > 0, n - np.ceil(threshold * np.asarray(n) - 1e-9).astype(np.int64) + 1, 0)


def node_of(own: np.ndarray) -> int:
    """A signed number for a set; texts of one set are one node."""
    import xxhash

    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _bounds(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]))


def shingle_counts(src: DataFrame, shingle: int) -> np.ndarray:
    """How often shingles of each bucket occur; a row for each bucket and task is summed."""

    def run(batches):
        counts, memo = np.zeros(COUNTS, np.int64), {}
        for batch in batches:
            for _, own, _ in shingle_sets(batch.column("text"), shingle, memo):
                counts += np.bincount((own & np.uint64(COUNTS - 1)).astype(np.int64), minlength=COUNTS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["bucket", "count"])

    order = np.zeros(COUNTS, np.int64)
    for r in src.select("text").mapInArrow(run, "bucket bigint, count bigint").groupBy("bucket").agg(F.sum("count").alias("c")).collect():  # COUNTS rows at most
        order[r["bucket"]] = r["c"]
    return order


def _nodes(src: DataFrame, order: np.ndarray, shingle: int, threshold: float, path: str) -> DataFrame:
    """id, node, n (shingles), fp and keys (the rarest shingles) of each row; a task gives the keys of a node once."""
    rank = src.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        seen, memo = set(), {}
        for batch in batches:
            for first, own, sizes in shingle_sets(batch.column("text"), shingle, memo):
                ends = np.cumsum(sizes)
                text = np.repeat(np.arange(len(sizes)), sizes)
                by_rank = np.lexsort((own, rank.value[(own & np.uint64(COUNTS - 1)).astype(np.int64)], text))
                keep = prefix_length(sizes, threshold)
                node = [node_of(own[a:b]) for a, b in zip(ends - sizes, ends)]
                keys = [None if x in seen or seen.add(x) else own[by_rank[a : a + k]].view(np.int64) for x, a, k in zip(node, ends - sizes, keep)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, len(sizes)), pa.array(node, pa.int64()), pa.array(sizes, pa.int64()), pa.array(majorities(own, sizes).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "node", "n", "fp", "keys"],
                )

    kind = src.schema["id"].dataType.simpleString()
    src.mapInArrow(run, f"id {kind}, node bigint, n bigint, fp bigint, keys array<bigint>").write.parquet(path)
    return src.sparkSession.read.parquet(path)


def _met(nodes: DataFrame, path: str) -> DataFrame:
    """key, tile, node: nodes that meet others at a key, by TILE of them; the first of a key is in each of its tiles.

    Keys are sorted and read in a stream, so that one of very many nodes needs no more memory.
    """
    rows = nodes.select(F.explode("keys").alias("key"), "node").repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key", "node")

    def run(batches):
        key = first = last = None
        n = 0
        for batch in batches:
            k, v = (batch.column(c).to_numpy() for c in ("key", "node"))
            if not len(k):
                continue
            new = np.ones(len(k), bool)  # rows of one node come once
            new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
            new[0] = key is None or k[0] != key or v[0] != last
            last_key, last_node = int(k[-1]), int(v[-1])
            k, v = k[new], v[new]
            b = _bounds(k) if len(k) else np.array([0])
            size = np.diff(b)
            nth = np.arange(len(k)) - np.repeat(b[:-1], size)
            head = np.repeat(v[b[:-1]], size) if len(k) else v
            out = []
            if len(k) and key is not None and k[0] == key:  # the last batch's key goes on
                own = slice(0, int(size[0]))
                nth[own] += n
                head[own] = first
                if n == 1:
                    out.append((np.array([key]), np.array([0]), np.array([first])))
            total = np.repeat(nth[b[1:] - 1] + 1, size) if len(k) else nth
            many = total > 1
            out.append((k[many], nth[many] // TILE, v[many]))
            begin = many & (nth % TILE == 0) & (nth > 0)
            out.append((k[begin], nth[begin] // TILE, head[begin]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], ["key", "tile", "node"])
            if len(k):
                key, first, n = int(k[-1]), int(head[-1]), int(nth[-1]) + 1
            last = last_node
            assert key == last_key

    rows.mapInArrow(run, "key bigint, tile bigint, node bigint").write.parquet(path)
    return nodes.sparkSession.read.parquet(path)


def _pieces(group: np.ndarray, part: np.ndarray):
    """Ranges of rows of about one part each that don't cut a group."""
    if not len(group):
        return
    begin = _bounds(group)[:-1]
    first = begin[np.concatenate(([True], part[begin][1:] != part[begin][:-1]))]
    yield from zip(first, np.append(first[1:], len(group)))


def close_pairs(group: np.ndarray, fp: np.ndarray, n: np.ndarray, threshold: float, radius: int):
    """(i, j, distance), i and j of one group (groups stand together), whose fingerprints and sizes allow the threshold."""

    def fit(i, j):
        d = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64)
        ok = (d <= radius) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)
        return i[ok], j[ok], d[ok]

    b = _bounds(group)
    size = np.diff(b)
    for lo, hi in zip(b[:-1][size > SMALL], b[1:][size > SMALL]):
        planes = bit_planes(fp[lo:hi])[:, :-1]
        full = np.where(np.unpackbits(fp[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), ~np.uint64(0), np.uint64(0))
        for at in range(0, hi - lo, 64):
            q = full[at : at + 64]
            hit = within_radius(lambda k: planes[k][None, :], lambda k: q[:, k][:, None], radius)
            found = [_lanes(hit[r], hi - lo) for r in range(len(q))]
            found = [x[x < at + r] for r, x in enumerate(found)]
            yield fit(lo + at + np.repeat(np.arange(len(q)), [len(x) for x in found]), lo + np.concatenate(found))
    sizes = np.repeat(size, size)
    keep = np.flatnonzero((sizes <= SMALL) & (sizes > 1))
    keep = keep[np.lexsort((group[keep], -sizes[keep]))]
    # As many whole groups at a time as make about MOST_PAIRS pairs.
    part = (np.cumsum(sizes[keep] / 2) // MOST_PAIRS).astype(np.int64)
    for lo, hi in _pieces(group[keep], part):
        own = keep[lo:hi]
        i, j = small_links(fp[own], group[own], sizes[own], radius)
        yield fit(own[i], own[j])


def _in_groups(rows: DataFrame, by: list[str], compare, schema: str) -> DataFrame:
    """compare over Arrow tables of whole groups, dealt and sorted by `by`."""
    rows = rows.repartition(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)

    def run(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < 30_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            edge = np.flatnonzero(_group(table)[1:] != _group(table)[:-1])
            if len(edge):
                yield from compare(table.slice(0, int(edge[-1]) + 1))
                table = table.slice(int(edge[-1]) + 1)
            held = table.combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield from compare(pa.Table.from_batches(held).combine_chunks())

    def _group(table):
        new = np.zeros(table.num_rows, bool)
        for c in by:
            x = table.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    return rows.mapInArrow(run, schema)


def _columns(table, *names):
    return [table.column(c).to_numpy() for c in names]


def _runs(*columns):
    new = np.zeros(len(columns[0]), bool)
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _nearest(met: DataFrame, threshold: float, radius: int) -> DataFrame:
    """a, b: each node b with the nearest smaller one that it may be similar to, if any, in its tiles."""

    def compare(table):
        key, tile, node, n, fp = _columns(table, "key", "tile", "node", "n", "fp")
        out = []
        for i, j, d in close_pairs(_runs(key, tile), fp.view(np.uint64), n, threshold, radius):
            a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
            order = np.lexsort((a, d, b))
            order = order[_bounds(b[order])[:-1]] if len(order) else order
            out.append((a[order], b[order], d[order]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b", "d"])

    found = _in_groups(met, ["key", "tile"], compare, "a bigint, b bigint, d bigint").where("a <> b")
    return found.groupBy("b").agg(F.min(F.struct("d", "a")).alias("x")).select("x.a", "b")


def _crossing(met: DataFrame, labels: DataFrame, threshold: float, radius: int) -> DataFrame:
    """a, b: all pairs of a key that aren't in one component yet and may be similar."""
    named = met.join(labels, "node", "left").select("key", "node", "n", "fp", F.coalesce("root", "node").alias("root")).distinct()
    apart = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")

    def compare(table):
        key, node, n, fp, root = _columns(table, "key", "node", "n", "fp", "root")
        for i, j, _ in close_pairs(_runs(key), fp.view(np.uint64), n, threshold, radius):
            far = root[i] != root[j]
            i, j = i[far], j[far]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

    return _in_groups(named.join(apart, "key", "left_semi"), ["key"], compare, "a bigint, b bigint").distinct()


def _verified(pairs: DataFrame, src: DataFrame, lead: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Those pairs whose sets' Jaccard similarity is at least the threshold. lead: node, id of a row that has it."""
    pairs = settled(pairs)
    if not (n := pairs.count()):
        return pairs
    named = pairs.join(lead.select(F.col("node").alias("a"), F.col("id").alias("ia")), "a").join(lead.select(F.col("node").alias("b"), F.col("id").alias("ib")), "b")
    named = settled(named)
    left = src.join(sized(named.select("ia").distinct().withColumnRenamed("ia", "id"), n), "id").select(F.col("id").alias("ia"), F.col("text").alias("x"))
    right = src.join(sized(named.withColumnRenamed("ib", "id"), n), "id").select("a", "b", "ia", F.col("text").alias("y"))

    def check(batches):
        memo: dict = {}
        for batch in batches:
            ok = []
            x, y = (_sets(batch.column(c), shingle, memo) for c in "xy")
            for p, q in zip(x, y):
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both + 1e-9 >= threshold * (len(p) + len(q) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return settled(right.join(left, "ia").select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint"))


def _sets(values, shingle: int, memo: dict):
    for _, own, sizes in shingle_sets(values, shingle, memo):
        yield from np.split(own, np.cumsum(sizes)[:-1])


def similar_groups(docs: DataFrame, id_col: str, text_col: str = "text", *, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """id_col (different for each row) and group: rows linked, over others too, by fingerprints within the radius and a
    Jaccard similarity of word shingles of at least `similarity`.

    Texts of fewer words are one shingle; null texts and those without a word are alike. The first round links each node
    to the nearest before it, so that a large group of copies is joined by fewer pairs than it has rows; what is still
    apart then is compared by all pairs that meet at a shingle.
    """
    spark = docs.sparkSession
    folder = scratch(spark, "similar")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    nodes = _nodes(src, shingle_counts(src, shingle), shingle, similarity, f"{folder}/nodes")
    lead = settled(nodes.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("fp").alias("fp")))
    met = _met(nodes, f"{folder}/met")
    met = settled(met.join(lead.select("node", "n", "fp"), "node"))
    near = settled(_nearest(met, similarity, radius))
    links = _verified(near, src, lead, shingle, similarity)
    labels = components(links)
    labels = settled(labels.union(labels.select(F.col("root").alias("node"), "root").distinct()))
    more = _verified(_crossing(met, labels, similarity, radius).join(near, ["a", "b"], "left_anti"), src, lead, shingle, similarity)
    if not more.isEmpty():
        labels = components(links.union(more))
    named = nodes.select("id", "node").join(labels, "node", "left")
    return named.select(F.col("id").alias(id_col), F.coalesce("root", "node").alias("group"))
