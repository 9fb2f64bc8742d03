"""Suffix-array dedup: external induced sorting of suffixes with their common prefixes, over shards of shared anchors.

Documents are cut into pieces around anchors (the least hash of an 8-byte gram in each window of `length` bytes), so that
equal windows fall to pieces with one key. Pieces whose key is met again go to shards by key; there the suffixes are
sorted by recursive induction: substrings between local minima are sorted by inducing through queues by character and
named, the string of names is sorted, and all suffixes with their common-prefix values are induced from its order. The
queues hold a bounded number of tuples in memory and the rest in files.
"""

from __future__ import annotations

import contextlib
import hashlib
import math
import os
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, settled, shared_dir, text_bytes
from .ngram_lm import local_path

LENGTH = 400
GRAM = 8
#: Bytes of pieces in a shard, about.
SHARD = 2_500_000
#: Suffix tuples that a set of queues keeps in memory.
IN_MEMORY = 4_000_000
#: Bytes of text whose anchors are sought at once.
CHUNK = 1_500_000


class Queues:
    """A priority queue of (character, order of arrival): a queue by character, spilled to files beyond a bound."""

    def __init__(self, folder: str, bound: int):
        self.folder, self.bound, self.held, self.n, self.files = folder, bound, {}, 0, {}

    def push(self, c: int, position: np.ndarray, lcp: np.ndarray) -> None:
        self.held.setdefault(c, []).append((position, lcp))
        self.n += len(position)
        if self.n > self.bound:
            self._spill()

    def _spill(self) -> None:
        os.makedirs(self.folder, exist_ok=True)
        for c, parts in self.held.items():
            path, sizes = self.files.setdefault(c, (f"{self.folder}/{uuid.uuid4().hex}", []))
            with open(path, "ab") as f:
                for position, lcp in parts:
                    f.write(position.tobytes() + lcp.tobytes())
                    sizes.append(len(position))
        self.held, self.n = {}, 0

    def pop(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a character, in order of arrival."""
        parts = []
        if c in self.files:
            path, sizes = self.files.pop(c)
            with open(path, "rb") as f:
                for k in sizes:
                    parts.append((np.frombuffer(f.read(8 * k), np.int64), np.frombuffer(f.read(2 * k), np.int16)))
            os.remove(path)
        own = self.held.pop(c, [])
        self.n -= sum(len(p) for p, _ in own)
        parts += own
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int16)
        return np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])

    def close(self) -> None:
        for path, _ in self.files.values():
            with contextlib.suppress(FileNotFoundError):
                os.remove(path)
        with contextlib.suppress(OSError):
            os.rmdir(self.folder)


def is_small(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the next one; the end is below every symbol."""
    n = len(t)
    change = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    at = change[np.searchsorted(change, np.arange(n))]
    return np.append(t, -1)[at + 1] > t[at]


class Inducer:
    """Sorts all suffixes of t from the order of those at its local minima."""

    def __init__(self, t: np.ndarray, cap: int, folder: str, bound: int = IN_MEMORY):
        self.t, self.cap, self.folder, self.bound = t, cap, folder, bound
        self.chars = np.flatnonzero(np.bincount(t))

    def _scatter(self, q: Queues, rest: dict[int, int], position, lcp, c: int, up: bool, equal: bool):
        """Pushes the predecessors of some suffixes of bucket c; gives those of the bucket itself.

        A predecessor's common prefix with the one before it in its queue is one more than the least value between
        their sources; rest has that least since each character's last source, and 0 for sources of other buckets.
        """
        t, cap = self.t, self.cap
        source = np.flatnonzero(position > 0)
        before = position[source] - 1
        sym = t[before]
        take = (sym > c) if up else (sym < c)
        if equal:
            take |= sym == c
        source, before, sym = source[take], before[take], sym[take]
        order = np.argsort(sym.astype(np.uint16), kind="stable")
        source, before, sym = source[order], before[order], sym[order]
        cuts = np.append(np.flatnonzero(np.diff(sym, prepend=-1)), len(sym))
        least = int(lcp.min(initial=cap))
        met, same = {}, (before[:0], lcp[:0])
        for a, z in zip(cuts, cuts[1:]):
            d, own = int(sym[a]), source[a:z]
            low = np.minimum.reduceat(lcp, np.append(0, own + 1) if own[-1] + 1 < len(lcp) else np.append(0, own[:-1] + 1))
            met[d] = int(low[-1]) if own[-1] + 1 < len(lcp) else cap
            low = low[: z - a]
            low[0] = min(int(low[0]), rest.get(d, 0))
            new = np.minimum(low + 1, cap).astype(np.int16)
            if d == c:
                same = (before[a:z], new)
            else:
                q.push(d, before[a:z], new)
        for d in rest:
            rest[d] = min(rest[d], least)
        rest.update(met)
        return same

    def runs(self, position: np.ndarray) -> int:
        """How often the first symbol of the suffix is repeated, to the cap."""
        p = int(position[0])
        part = self.t[p : p + self.cap]
        other = np.flatnonzero(part != part[0])
        return int(other[0]) if len(other) else len(part)

    def sort(self, minima: np.ndarray, lcp: np.ndarray):
        """(positions, common prefixes with the one before) of each bucket, in order; minima sorted, with their own."""
        t, cap = self.t, self.cap
        starts = np.searchsorted(t[minima], np.append(self.chars, self.chars[-1] + 1))
        low, q = {}, Queues(f"{self.folder}-l", self.bound)
        q.push(int(t[-1]), np.array([len(t) - 1]), np.zeros(1, np.int16))
        for k, c in enumerate(map(int, self.chars)):
            position, own = q.pop(c)
            rest: dict[int, int] = {}
            parts = []
            while len(position):
                own = own.copy()
                if not parts:
                    own[0] = 0
                parts.append((position, own))
                position, own = self._scatter(q, rest, position, own, c, True, True)
            if parts:
                low[c] = tuple(np.concatenate(x) for x in zip(*parts))
            s = minima[starts[k] : starts[k + 1]]
            if len(s):
                own = lcp[starts[k] : starts[k + 1]].copy()
                own[0] = min(self.runs(low[c][0][-1:]), self.runs(s[:1])) if c in low else 0
                self._scatter(q, rest, s, own, c, True, False)
        q.close()
        high, q = {}, Queues(f"{self.folder}-s", self.bound)
        for c in map(int, self.chars[::-1]):
            position, own = q.pop(c)
            rest, parts = {}, []
            while len(position):
                own = own.copy()
                if not parts:
                    own[0] = 0
                parts.append((position, own))
                position, own = self._scatter(q, rest, position, own, c, False, True)
            if parts:
                high[c] = tuple(np.concatenate(x) for x in zip(*parts))
            if c in low:
                position, own = low[c]
                first = min(self.runs(position[-1:]), self.runs(high[c][0][-1:])) if c in high else 0
                self._scatter(q, rest, position[::-1], np.append(np.int16(first), own[:0:-1]), c, False, False)
        q.close()
        for c in map(int, self.chars):
            if c in low:
                yield low[c]
            if c in high:
                position, own = high[c]
                first = min(self.runs(low[c][0][-1:]), self.runs(position[-1:])) if c in low else 0
                yield position[::-1], np.append(np.int16(first), own[:0:-1])


def named(t: np.ndarray, minima: np.ndarray, in_order: np.ndarray) -> np.ndarray:
    """Names of the substrings from each minimum to the next, by text position; in_order: the minima by substring."""
    rng = np.random.default_rng(7)
    code = rng.integers(1, 2**63, int(t.max()) + 1, dtype=np.uint64) | np.uint64(1)
    base = np.uint64(0x9E3779B97F4A7C15)
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(t), base, np.uint64))))
    run = np.concatenate(([np.uint64(0)], np.cumsum(code[t] * power[:-1])))
    end = np.append(minima[1:] + 1, len(t))
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    back = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(t), inverse, np.uint64))))
    digest = (run[end] - run[minima]) * back[minima]
    rank = np.empty(len(t), np.int64)
    rank[minima] = np.arange(len(minima))
    at = rank[in_order]
    size = end - minima
    new = np.ones(len(at), bool)
    new[1:] = (digest[at[1:]] != digest[at[:-1]]) | (size[at[1:]] != size[at[:-1]])
    names = np.empty(len(at), np.int64)
    names[at] = np.cumsum(new)
    return names


def order_of_names(names: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of the name string's suffixes by their first 1, 2, 4, ... names, until all differ or depth is reached."""
    levels, h = [names], 1
    while h < depth:
        rank = levels[-1]
        if int(rank.max()) == len(rank):
            break
        after = np.append(rank[h:], np.zeros(min(h, len(rank)), np.int64))
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key)  # equal keys get one rank, however they come to lie
        key = key[order]
        new = np.ones(len(key), np.int64)
        new[1:] = key[1:] != key[:-1]
        rank = np.empty_like(key)
        rank[order] = np.cumsum(new)
        levels.append(rank)
        h *= 2
    return levels


def prefixes_of_minima(t: np.ndarray, minima: np.ndarray, levels: list[np.ndarray], order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of neighbours among the sorted minima, to the cap."""
    n, m = len(t), len(minima)
    i, j = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((i < m) & (j < m))
        same = inside[levels[k][i[inside]] == levels[k][j[inside]]]
        i[same] += 1 << k
        j[same] += 1 << k
    place = np.append(minima, np.full(1, n))
    a, b = place[np.minimum(i, m)], place[np.minimum(j, m)]
    lcp = a - place[order[:-1]]
    live = np.flatnonzero((lcp < cap) & (a < n) & (b < n))
    a, b = a.copy(), b.copy()
    while len(live):
        live = live[t[a[live]] == t[b[live]]]
        lcp[live] += 1
        a[live] += 1
        b[live] += 1
        live = live[(lcp[live] < cap) & (a[live] < n) & (b[live] < n)]
    return np.append(0, np.minimum(lcp, cap)).astype(np.int16)


def suffix_order(t: np.ndarray, cap: int, folder: str, bound: int = IN_MEMORY):
    """Runs of (positions, common prefixes to the cap with the one before, the first with the last of the run before)."""
    t = t.astype(np.int64)
    small = is_small(t)
    minima = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    inducer = Inducer(t, cap, folder, bound)
    if not len(minima):
        yield from inducer.sort(minima, np.zeros(0, np.int16))
        return
    rough = minima[np.argsort(t[minima].astype(np.uint16), kind="stable")]
    lowest = np.zeros(len(t), bool)
    lowest[minima] = True
    by_substring = np.concatenate([p[lowest[p]] for p, _ in inducer.sort(rough, np.zeros(len(rough), np.int16))])
    levels = order_of_names(named(t, minima, by_substring), cap)
    order = np.argsort(levels[-1], kind="stable")
    lcp = prefixes_of_minima(t, minima, levels, order, cap)
    yield from inducer.sort(minima[order], lcp)


def repeated(pieces: list[bytes], windows: list[int], length: int, folder: str, bound: int = IN_MEMORY) -> list[np.ndarray]:
    """For each piece, which of its first `windows` starts begin a string of `length` bytes that begins elsewhere too."""
    sizes = np.array([len(p) + 1 for p in pieces])
    starts = np.cumsum(sizes) - sizes
    t = np.zeros(int(sizes.sum()), np.uint16)
    owned = np.zeros(len(t), bool)
    for p, s, w in zip(pieces, starts, windows):
        t[s : s + len(p)] = np.frombuffer(p, np.uint8)
        t[s : s + len(p)] += 1
        owned[s : s + w] = True
    hit = np.zeros(len(t), bool)
    open_run: list[int] = []  # owned positions of the run of equal strings that the last bucket ended in
    for position, lcp in suffix_order(t, length, folder, bound):
        new = lcp < length
        group = np.cumsum(new)
        own = np.flatnonzero(owned[position])
        if not len(own):
            if new.any():
                open_run = []
            continue
        g = group[own]
        many = np.bincount(g, minlength=int(group[-1]) + 1) > 1
        hit[position[own[many[g]]]] = True
        if g[0] == 0 and open_run:
            hit[position[own[g == 0]]] = True
            hit[open_run] = True
        last = position[own[g == group[-1]]].tolist()
        open_run = last if new.any() else open_run + last
    return [hit[s : s + w] for s, w in zip(starts, windows)]


def anchored(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(text, first start, last start, key, digest) of every piece of the texts: windows alike fall to pieces alike in key."""
    keep = [i for i, x in enumerate(texts) if len(x) >= length]
    if not keep:
        return
    joined = b"".join(texts[i] for i in keep)
    sizes = np.array([len(texts[i]) for i in keep])
    raw = np.frombuffer(joined + b"\0" * gram, np.uint8)
    n = len(joined)
    grams = np.lib.stride_tricks.sliding_window_view(raw, gram)[:n].copy().view("<u8").ravel()
    h = (grams ^ (grams >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    packed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    # The least of each stretch of `span` values: of the tail of one block and the head of the next.
    span = length - gram + 1
    blocks = -(-(n + span) // span)
    padded = np.full(blocks * span, ~np.uint64(0))
    padded[:n] = packed
    padded = padded.reshape(blocks, span)
    head = np.minimum.accumulate(padded, axis=1).ravel()
    tail = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(tail[: n - span + 1], head[span - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(keep)), sizes)[: len(at)]
    start = np.arange(len(at))
    valid = start + length <= ends[doc]
    half = (length - gram) // 2
    left = at - start >= half
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (left[1:] != left[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    good = valid[first]
    first, last = first[good], last[good]
    # What every window of the piece holds: from `half` before the anchor to its gram's end, or as much after it.
    lo = np.where(left[first], at[first] - half, at[first])
    hi = np.where(left[first], at[first] + gram, at[first] + length - half + 1)
    digest = xxhash.xxh3_64_intdigest
    begin = ends - sizes
    view = memoryview(joined)
    for d, a, z, x, y, s in zip(doc[first].tolist(), first.tolist(), last.tolist(), lo.tolist(), hi.tolist(), left[first].tolist()):
        yield keep[d], a - int(begin[d]), z - int(begin[d]), digest(view[x:y], int(s)), digest(view[a : z + length])


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """id, t, spans: runs of bytes covered by repeated strings, merged. docs: id, t (a hash of the text), text.

    Pieces whose key occurs once hold no repeated string. Where all pieces of a key are alike, each string in them is
    repeated. The others, one of each kind, are sorted in shards; a kind met twice is repeated throughout.
    """
    spark = docs.sparkSession
    shared = local_path(shared_dir(spark))
    folder = scratch(spark, "suffixes")
    kind = docs.schema["id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            texts, first, size = [], 0, 0
            for i, value in enumerate(batch.column("text")):
                texts.append(text_bytes(value.as_py()))
                size += len(texts[-1])
                if size > CHUNK or i == batch.num_rows - 1:
                    cols = list(zip(*anchored(texts, length))) or [(), (), (), (), ()]
                    at = pa.array([first + x for x in cols[0]], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("t").take(at), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), _signed(cols[3]), _signed(cols[4])], ["id", "t", "a", "z", "key", "digest"])
                    texts, first, size = [], i + 1, 0

    docs.mapInArrow(cut, f"id {kind}, t bigint, a int, z int, key bigint, digest bigint").write.parquet(f"{folder}/pieces")
    pieces = spark.read.parquet(f"{folder}/pieces")
    keys = pieces.groupBy("key").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("n > 1")
    # Written first: where both sides of the join are plain exchanges, the rows of a common key are split.
    keys = settled(keys.select("key", (F.col("lo") != F.col("hi")).alias("mixed")))
    pieces.join(keys, "key").write.parquet(f"{folder}/met")
    met = spark.read.parquet(f"{folder}/met")
    own = met.where("mixed").groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("id", "t", "a", "z")).alias("at"))
    own = settled(own)
    total = own.agg(F.sum(F.col("at.z") - F.col("at.a") + length + 1)).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD))
    wanted = own.groupBy("at.id", "at.t").agg(F.collect_list(F.struct("key", "digest", "n", F.col("at.a").alias("a"), F.col("at.z").alias("z"))).alias("want"))
    held = docs.join(wanted.select(F.col("id").alias("w_id"), F.col("t").alias("w_t"), "want"), F.col("id").eqNullSafe(F.col("w_id")) & (F.col("t") == F.col("w_t")))
    held = held.select(F.encode("text", "UTF-8").alias("raw"), F.explode("want").alias("w"))
    held = held.select(F.pmod("w.key", F.lit(shards)).alias("shard"), "w.key", "w.digest", "w.n", (F.col("w.z") - F.col("w.a") + 1).alias("windows"), F.substring("raw", F.col("w.a") + 1, F.col("w.z") - F.col("w.a") + length).alias("piece"))

    def sort_shard(table: pa.Table) -> pa.Table:
        seen, rows = set(), []
        for r in range(table.num_rows):
            k = (table.column("key")[r].as_py(), table.column("digest")[r].as_py())
            if k not in seen:  # rows alike in id and text bring a piece twice
                seen.add(k)
                rows.append(r)
        table = table.take(pa.array(rows, pa.int64()))
        found = repeated(table.column("piece").to_pylist(), table.column("windows").to_pylist(), length, f"{shared}/queues-{uuid.uuid4().hex}")
        runs = []
        for hit, n in zip(found, table.column("n").to_pylist()):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (hit | (n > 1)).astype(np.int8), [0]))))
            runs.append([{"a": int(x), "z": int(y) - 1} for x, y in zip(edge[::2], edge[1::2])])
        return pa.table({"key": table.column("key"), "digest": table.column("digest"), "runs": pa.array(runs, pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))})

    runs = held.groupBy("shard").applyInArrow(sort_shard, "key bigint, digest bigint, runs array<struct<a:int,z:int>>")
    runs = runs.where(F.size("runs") > 0)
    # Whether a run ends or the piece's windows do: byte past the last is the last start and the string's length.
    plain = met.where("not mixed").select("id", "t", "a", (F.col("z") + length).alias("z"))
    sorted_out = met.where("mixed").join(runs, ["key", "digest"]).select("id", "t", F.col("a").alias("first"), F.explode("runs").alias("r"))
    sorted_out = sorted_out.select("id", "t", (F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.z") + length).alias("z"))
    return plain.union(sorted_out).groupBy("id", "t").agg(F.sort_array(F.collect_set(F.struct("a", "z"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (the bytes left), kept_sha256, spans for each row.

    A byte goes if a string of `length` bytes that begins anywhere else too covers it. A null text is empty. Rows alike
    in id and text are two occurrences of all their strings. Texts shorter than `length` stay whole.
    """
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = repeats(src, length).select(F.col("id").alias("s_id"), F.col("t").alias("s_t"), "spans")
    rows = src.join(found, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("t") == F.col("s_t")), "left").select("id", "text", "spans")
    kind = src.schema["id"].dataType.simpleString()
    pair = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for value, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                raw = text_bytes(value.as_py())
                gone = merged([(s["a"], s["z"]) for s in spans or ()])
                edges = [0, *(x for s in gone for x in s), len(raw)]
                kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))
                for c, x in zip(out, (len(raw), len(raw) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest(), [{"a": a, "z": z} for a, z in gone])):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pair]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(out, kinds))], ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "spans"])

    done = rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string, spans array<struct<a:int,z:int>>")
    return done.withColumnRenamed("id", id_col)
