"""LM scoring by a trie of n-grams in Elias-Fano levels: monotone pointers, quantised probabilities, memory-mapped.

Words are ranks in a vocabulary of sorted 64-bit hashes. A shard of the trie holds the trigrams whose first word hashes
to it; those of a frequent word are dealt out by their first two words, so that it doesn't draw all to one shard. Each
level points to the range of its successors in the next, in which a word is searched. Shard files lie in the shared
folder, which executors must be able to map (a mounted path or file: URI).
"""

from __future__ import annotations

import json
import math
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

#: Tokens of training text for each shard, so that a shard's size doesn't grow with the corpus.
SHARD_TOKENS = 2_000_000
#: Tokens that a task counts before it passes sums on, and those it holds as words at a time.
FLUSH, CHUNK = 1_500_000, 800_000
#: Bytes that a word and its blank are reckoned at.
BYTES = 6
#: A word with more than a shard's tokens over this is frequent.
FREQUENT = 8
#: Shards that a task keeps open at a time.
MOST_OPEN = 4096
#: What is taken off a successor's count of one, of two, and of more, for the shorter context's estimate.
DISCOUNTS = (0.9, 1.3, 1.5)
#: Steps of the probabilities' logarithm: 16 bits over 12 decades.
STEPS, DECADES = 65535, 12.0
END = xxhash.xxh64_intdigest(b"")


_BYTES = np.uint64(0x0101010101010101)
#: Position of the r-th one in a byte.
_PLACE = np.array([[([k for k in range(8) if b >> k & 1] + [0] * 8)[r] for r in range(8)] for b in range(256)], np.uint8).ravel()


def select_in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th (from 0) one in each word, by sums of bytes side by side."""
    r = r.astype(np.uint64)
    s = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
    s = ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
    up = ((r * _BYTES | (_BYTES << np.uint64(7))) - s) & (_BYTES << np.uint64(7))
    byte = np.minimum(np.bitwise_count(up).astype(np.uint64), np.uint64(7)) << np.uint64(3)
    r = r - (((s << np.uint64(8)) >> byte) & np.uint64(255))
    return (byte + _PLACE[(((x >> byte) & np.uint64(255)) << np.uint64(3)) + r]).astype(np.int64)


def packed_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """Values side by side in words, with a spare word."""
    n = len(values)
    low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
    if bits and n:
        bit = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        np.bitwise_or.at(low, word, values << shift)
        spill = shift + np.uint64(bits) > 64
        np.bitwise_or.at(low, word[spill] + 1, values[spill] >> (np.uint64(64) - shift[spill]))
    return low


def unpacked(low: np.ndarray, bits: int, i: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(i), np.uint64)
    bit = i.astype(np.uint64) * np.uint64(bits)
    word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
    # The next word's part, shifted twice as a shift by 64 is undefined.
    x = (low[word] >> shift) | ((low[word + 1] << (np.uint64(63) - shift)) << np.uint64(1))
    return x & np.uint64((1 << bits) - 1)


class Words:
    """Successors of all contexts of a level side by side, each context's in ascending order, in as many bits as ids need."""

    def __init__(self, bits: int, low: np.ndarray):
        self.bits, self.low = bits, low

    @staticmethod
    def build(values: np.ndarray) -> dict:
        bits = int(values.max()).bit_length() if len(values) else 0
        return {"bits": bits, "low": packed_bits(values.astype(np.uint64), bits)}

    def find(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Where each x stands in its own range, or -1.

        Ids are ranks of hashes, so that a context's successors lie evenly and a guess by proportion is close; every
        third step halves the range, for those that don't.
        """
        lo, hi, x = lo.copy(), hi.copy(), x.astype(np.uint64)
        some = lo < hi
        live = np.flatnonzero(hi - lo > 1)
        under, over = np.zeros(len(live)), np.full(len(live), float(1 << self.bits))
        step = 0
        while len(live):
            a, z, want = lo[live], hi[live], x[live]
            if step % 3 == 2:
                mid = (a + z) >> 1
            else:
                guess = (z - a) * ((want.astype(np.float64) - under) / np.maximum(over - under, 1.0))
                mid = np.clip(a + guess.astype(np.int64), a + 1, z - 1)
            v = unpacked(self.low, self.bits, mid)
            le = v <= want
            lo[live] = a = np.where(le, mid, a)
            hi[live] = z = np.where(v == want, mid + 1, np.where(le, z, mid))
            on = z - a > 1
            under, over = np.where(le, v, under)[on], np.where(le, over, v)[on]
            live = live[on]
            step += 1
        out = np.full(len(x), -1, np.int64)
        c = np.flatnonzero(some)
        c = c[unpacked(self.low, self.bits, lo[c]) == x[c]]
        out[c] = lo[c]
        return out


class EliasFano:
    """A non-decreasing sequence of n integers below u: low bits packed, high bits in unary, a directory by word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        self.n, self.l, self.low, self.high, self.zeros, self.ones = n, low_bits, low, high, zeros, ones

    @staticmethod
    def build(values: np.ndarray, low_bits: int | None = None) -> dict:
        values = values.astype(np.uint64)
        n = len(values)
        u = int(values[-1]) + 1 if n else 1
        if low_bits is None:
            low_bits = max(0, (u // max(n, 1)).bit_length() - 1)
        low = packed_bits(values & np.uint64((1 << low_bits) - 1), low_bits)
        top = (values >> np.uint64(low_bits)).astype(np.int64)
        size = n + (int(top[-1]) if n else 0) + 2
        bits = np.zeros((size + 63) // 64 * 64, np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate(([0], np.cumsum(count)))[:-1]
        return {"n": n, "l": low_bits, "low": low, "high": high, "ones": ones.astype(np.uint64), "zeros": (np.arange(len(high)) * 64 - ones).astype(np.uint64)}

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th (from 0) one or zero."""
        base = self.ones if ones else self.zeros
        w = np.searchsorted(base, k.astype(np.uint64), "right") - 1
        r = k - base[w].astype(np.int64)
        return w * 64 + select_in_word(self.high[w] if ones else ~self.high[w], r)

    def span(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and i + 1, of pointers without low bits."""
        at = self._select(i, True)
        x = (self.high[at >> 6] >> (at & 63).astype(np.uint64)) >> np.uint64(1)
        lo = at - i
        hi = lo + np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1))
        on = np.flatnonzero(x == 0)  # the next one stands in a later word
        hi[on] = self._select(i[on] + 1, True) - (i[on] + 1)
        return lo, hi

    def _ones_from(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand in a row from each position on."""
        w, shift = at >> 6, (at & 63).astype(np.uint64)
        x = ~(self.high[w] >> shift)  # zeros shifted in at the top end the row, unless it goes on in the next word
        out = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64)
        room = 64 - (at & 63)
        out = np.minimum(out, room)
        on = np.flatnonzero((out == room) & (w + 1 < len(self.high)))
        if len(on):
            out[on] += self._ones_from((w[on] + 1) << 6)
        return out

    def _lows(self, i: np.ndarray) -> np.ndarray:
        return unpacked(self.low, self.l, i)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at i."""
        top = (self._select(i, True) - i).astype(np.uint64)
        return (top << np.uint64(self.l)) | self._lows(i)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Where each x stands, or -1: its successor is searched among the values that share its high bits."""
        if not self.n:
            return np.full(len(x), -1, np.int64)
        x = x.astype(np.uint64)
        top = (x >> np.uint64(self.l)).astype(np.int64)
        most = len(self.high) * 64 - self.n - 1  # zeros beyond the first
        inside = top <= most
        top = np.minimum(top, most)
        # The values with these high bits are the ones after the zero before: their number is that of the ones in a row.
        at = np.where(top > 0, self._select(np.maximum(top - 1, 0), False) + 1, 0)
        lo = np.minimum(at - top, self.n)
        hi = np.minimum(lo + self._ones_from(at), self.n)
        end, want = hi.copy(), x & np.uint64((1 << self.l) - 1)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self._lows(mid) < want[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        ok = inside & (lo < end)
        hit = np.full(len(x), -1, np.int64)
        c = np.flatnonzero(ok)
        c = c[self._lows(lo[c]) == want[c]]
        hit[c] = lo[c]
        return hit


def quantised(p: np.ndarray) -> np.ndarray:
    """log10 p in steps, rounded down so that no distribution gains mass; 0 for what is below the range."""
    with np.errstate(divide="ignore"):
        q = np.floor((np.log10(p) / DECADES + 1) * STEPS)
    return np.clip(q, 0, STEPS).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, 10.0 ** ((q / STEPS - 1) * DECADES), 0.0)


def discounts(counts: np.ndarray, steps: tuple[float, ...]) -> np.ndarray:
    return np.array(steps)[np.minimum(counts, len(steps)) - 1]


def save(path: str, parts: dict) -> None:
    """Arrays in one file behind a header, in place at once, so that a repeated task leaves the same whole file."""
    head, at, blobs = {}, 0, []
    for name, x in parts.items():
        if isinstance(x, np.ndarray):
            raw = x.tobytes()
            head[name] = [str(x.dtype), len(x), at]
            blobs.append(raw + b"\0" * (-len(raw) % 8))
            at += len(blobs[-1])
        else:
            head[name] = x
    first = json.dumps(head).encode()
    first += b" " * (-(len(first) + 8) % 8)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(own := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        f.write(len(first).to_bytes(8, "little") + first)
        f.writelines(blobs)
    os.replace(own, path)


def load(path: str) -> dict:
    with open(path, "rb") as f:
        n = int.from_bytes(f.read(8), "little")
        head = json.loads(f.read(n))
    raw = np.asarray(np.memmap(path, np.uint8, "r"))
    return {k: raw[n + 8 + v[2] : n + 8 + v[2] + v[1] * np.dtype(v[0]).itemsize].view(v[0]) if isinstance(v, list) else v for k, v in head.items()}


def _level(name: str, values: np.ndarray, low_bits: int | None = None) -> dict:
    return {f"{name}.{k}": v for k, v in EliasFano.build(values, low_bits).items()}


def _words(name: str, values: np.ndarray) -> dict:
    return {f"{name}.{k}": v for k, v in Words.build(values).items()}


def groups(x: np.ndarray):
    """Each value of x with the places at which it stands."""
    order = by_shard(x)
    at = np.append(runs([x[order]]), len(order))
    for a, b in zip(at, at[1:]):
        yield int(x[order[a]]), order[a:b]


def by_shard(x: np.ndarray) -> np.ndarray:
    """Places in order of x, equal ones as they stand; few shards are sorted by counting."""
    return np.argsort(x.astype(np.uint16) if len(x) and 0 <= x.min() and x.max() < 1 << 16 else x, kind="stable")


def _mapped(parts: dict, name: str) -> EliasFano:
    return EliasFano(*(parts[f"{name}.{k}"] for k in ("n", "l", "low", "high", "zeros", "ones")))


class Vocabulary:
    """Hashes of the known words by shard of the hash's high bits; a word's id is its rank."""

    def __init__(self, folder: str, sizes: list[int]):
        self.folder, self.first, self.open = folder, np.cumsum([0, *sizes]), {}
        self.size = int(self.first[-1])

    def shard(self, s: int) -> tuple[EliasFano, EliasFano]:
        if s not in self.open:
            parts = load(f"{self.folder}/vocabulary-{s}")
            self.open[s] = _mapped(parts, "hash"), _mapped(parts, "sums")
        return self.open[s]

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        n = len(self.first) - 1
        if not self.size:
            return ids, counts
        ascending = np.argsort(hashes)
        for s, own in groups(vocabulary_shard(hashes[ascending], n)):
            own = ascending[own]
            if self.first[s] == self.first[s + 1]:
                continue
            at = self.shard(int(s))[0].find(hashes[own])
            own, at = own[at >= 0], at[at >= 0]
            ids[own], counts[own] = at + self.first[s], self._counts(int(s), at)
        return ids, counts

    def _counts(self, s: int, at: np.ndarray) -> np.ndarray:
        sums = self.shard(s)[1]
        return (sums.get(at + 1) - sums.get(at)).astype(np.int64)

    def backoff(self, ids: np.ndarray) -> np.ndarray:
        """Weight of the unigram after each word, `size` standing for a text's begin; 1 where nothing followed it."""
        out = np.ones(len(ids))
        where = np.searchsorted(self.first, ids, "right") - 1
        for s, own in groups(where):
            if s < 0:  # unknown words
                continue
            if (key := f"back{s}") not in self.open:
                path = f"{self.folder}/backoff-{s}"
                self.open[key] = load(path)["q"] if os.path.exists(path) else None
            if self.open[key] is not None:
                out[own] = restored(self.open[key][ids[own] - self.first[s]])
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        where = np.searchsorted(self.first, ids, "right") - 1
        for s, own in groups(where):
            out[own] = self._counts(s, ids[own] - self.first[s])
        return out


def vocabulary_shard(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def context_shard(a: np.ndarray, b: np.ndarray, frequent: np.ndarray, n: int) -> np.ndarray:
    """By the first word, or by both where that is frequent."""
    second = np.where(frequent, b.astype(np.uint64) + np.uint64(1), np.uint64(0))
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (second * np.uint64(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(40)) * np.uint64(n) >> np.uint64(24)).astype(np.int64)


def runs(sorted_columns: list[np.ndarray]) -> np.ndarray:
    """Where a new combination begins."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def distinct(x: np.ndarray, y: np.ndarray, most: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The distinct pairs of x and y (below most), ascending, and which of them stands in each place."""
    key = x * most + y
    order = np.argsort(key)
    key = key[order]
    at = runs([key])
    of = np.empty(len(key), np.int64)
    of[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(key))))
    return (key[at] // most, key[at] % most), of


def summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows, in order of the first column, then the next, with their sums."""
    if len(columns) == 3 and len(counts) and (int(columns[0].max()) + 1) * (int(columns[1].max()) + 1) < 2**62 and len(counts) * (int(columns[2].max()) + 1) < 2**62:
        # Pairs by one number, then their ranks with the third by another.
        pair = columns[0] * (int(columns[1].max()) + 1) + columns[1]
        order = np.argsort(pair)
        pair = pair[order]
        rank = np.cumsum(np.append(False, pair[1:] != pair[:-1])) * (int(columns[2].max()) + 1)
        order = order[np.argsort(rank + columns[2][order])]
    else:
        order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    at = runs(columns)
    return [c[at] for c in columns], np.add.reduceat(counts[order], at) if len(at) else counts


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which Spark's shuffle compression can use."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplaned(raw: bytes, kind) -> np.ndarray:
    w = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(w, -1).T).view(kind).ravel()


def chunks(batches, column: str = "text", size: int = CHUNK):
    """(batch, its first text, hashes of the distinct words and END, number of each token, tokens of each text) of some
    texts at a time, by their bytes."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // (size * BYTES)
        at = np.append(runs([part]), len(part))
        for first, past in zip(at, at[1:]):
            yield batch, int(first), *_tokens(texts.slice(first, past - first))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are cut at the six ASCII blanks and A-Z lower-cased; a text without any is split into one empty word."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    coded = lists.flatten().dictionary_encode()
    distinct, number = coded.dictionary.cast(pa.binary() if pa.types.is_string(coded.dictionary.type) else pa.large_binary()).to_pylist(), coded.indices.to_numpy()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, [*distinct, b""]), np.uint64, len(distinct) + 1)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if b"" in distinct:
        # Blank texts are their end alone; the empty word and the end are one.
        end = distinct.index(b"")
        hashes = hashes[:-1]
        first = np.cumsum(counts) - counts
        empty = (counts == 1) & (number[np.minimum(first, len(number) - 1)] == end)
    else:
        end = len(distinct)
    # An end after each text's last word.
    number = np.insert(number.astype(np.int64), np.cumsum(counts)[~empty], end)
    return hashes, number, counts + ~empty


def _packed(shards: np.ndarray, columns: list[np.ndarray], counts: np.ndarray, kind=np.uint32):
    """A record batch with a row for each shard: its sorted columns."""
    order = by_shard(shards)
    at = np.append(runs([shards[order]]), len(order))
    rows = [order[a:b] for a, b in zip(at, at[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array([int(shards[r[0]]) for r in rows], pa.int32()), *(pa.array([planes(c[r]) for r in rows], pa.binary()) for c in columns), pa.array([planes(counts[r].astype(kind)) for r in rows], pa.binary())],
        ["shard", *(f"c{i}" for i in range(len(columns))), "n"],
    )


def train(docs: DataFrame, text_col: str = "text", *, shard_tokens: int = SHARD_TOKENS, steps: tuple[float, ...] = DISCOUNTS) -> dict:
    """Counts of all texts of docs, as a trie in the shared folder; what `score` needs to find it."""
    spark = docs.sparkSession
    src = docs.select(F.col(text_col).alias("text"))
    row = src.agg(F.count("*").alias("docs"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes")).first()
    n = max(1, math.ceil((row["bytes"] or 0) / BYTES / shard_tokens))
    folder = local_path(scratch(spark, "trie"))

    def count_words(batches):
        held, size = [], 0

        def flush():
            (h,), c = summed([np.concatenate([x[0] for x in held])], np.concatenate([x[1] for x in held]))
            return _packed(vocabulary_shard(h, n), [h], c)

        for _, _, hashes, number, _ in chunks(batches):
            held.append((hashes, np.bincount(number, minlength=len(hashes))))
            size += len(hashes)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def write_words(table: pa.Table) -> pa.Table:
        s = table.column("shard")[0].as_py()
        (h,), c = summed([np.concatenate([unplaned(x.as_py(), np.uint64) for x in table.column("c0")])], np.concatenate([unplaned(x.as_py(), np.uint32) for x in table.column("n")]).astype(np.int64))
        save(f"{folder}/vocabulary-{s}", _level("hash", h) | _level("sums", np.concatenate(([0], np.cumsum(c)))))
        return pa.table({"shard": pa.array([s], pa.int32()), "size": pa.array([len(h)], pa.int64()), "total": pa.array([int(c.sum())], pa.int64())})

    made = src.mapInArrow(count_words, "shard int, c0 binary, n binary").groupBy("shard").applyInArrow(write_words, "shard int, size bigint, total bigint").collect()
    sizes = [0] * n
    for r in made:
        sizes[r["shard"]] = r["size"]
    model = {"folder": folder, "sizes": sizes, "shards": n, "tokens": sum(r["total"] for r in made), "types": sum(sizes), "docs": row["docs"], "steps": steps, "frequent": shard_tokens // FREQUENT}
    wide = np.uint32 if model["types"] + 1 < 2**32 else np.uint64

    def count_trigrams(batches):
        words = Vocabulary(folder, sizes)
        for _, _, hashes, number, counts in chunks(batches):
            # A chunk's words by rank, in order of their ids: three ranks fit in 63 bits and sort as the ids do.
            ids, seen = words.lookup(hashes)
            order = np.argsort(ids)
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            own, begin = rank[number], len(order)
            w0, w1 = contexts(own, counts, begin)
            # An end is followed by the next begin, so that pairs that end a text count too.
            last = np.cumsum(counts) - 1
            w0, w1, own = np.append(w0, w1[last]), np.append(w1, own[last]), np.append(own, np.full(len(last), begin))
            name = np.append(ids[order], words.size)
            frequent = np.append(seen[order] > model["frequent"], True)
            if begin < 2_000_000:
                key = np.sort((w0 * (begin + 1) + w1) * (begin + 1) + own)
                at = runs([key])
                times, key = np.diff(np.append(at, len(key))), key[at]
                a, b, c = key // (begin + 1) ** 2, key // (begin + 1) % (begin + 1), key % (begin + 1)
            else:  # one text has more distinct words than that
                (a, b, c), times = summed([w0, w1, own], np.ones(len(own), np.int64))
            often, (a, b, c) = frequent[a], (name[a], name[b], name[c])
            yield _packed(context_shard(a, b, often, n), [x.astype(wide) for x in (a, b, c)], times)

    def write_trie(table: pa.Table) -> pa.Table:
        s, words = table.column("shard")[0].as_py(), Vocabulary(folder, sizes)
        cols = [np.concatenate([unplaned(x.as_py(), wide) for x in table.column(f"c{i}")]).astype(np.int64) for i in range(3)]
        (a, b, c), k = summed(cols, np.concatenate([unplaned(x.as_py(), np.uint32) for x in table.column("n")]).astype(np.int64))
        # Level 1: first words; 2: second words, in the range that their first word points to; 3: third words, in their pair's.
        pair, first = runs([a, b]), runs([a])
        pair_count = np.add.reduceat(k, pair)
        pair_of = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(a))))
        off, total = discounts(k, steps), np.add.reduceat(k, pair)
        one = np.full(len(pair), model["docs"], np.int64)
        known = a[pair] < words.size
        one[known] = words.counts(a[pair][known])
        off_pair = discounts(pair_count, steps)
        parts = _level("a", a[first]) | _level("a.next", np.append(np.searchsorted(pair, first), len(pair)), 0) | _words("b", b[pair])
        parts |= _level("b.next", np.append(pair, len(a)), 0) | _words("c", c)
        parts |= {"b.q": quantised((pair_count - off_pair) / one), "b.back": quantised(np.add.reduceat(off, pair) / total), "c.q": quantised((k - off) / total[pair_of])}
        save(f"{folder}/trie-{s}", parts)
        # What this shard's pairs leave to the unigram, by first word: sent to the word's shard of the vocabulary.
        follows = b[pair] < words.size  # a text's begin follows nothing
        (heads,), left = summed([a[pair][follows]], off_pair[follows])
        return pa.Table.from_batches([_packed(np.searchsorted(words.first, heads, "right") - 1, [heads], left, np.float64)])

    def write_backoff(table: pa.Table) -> pa.Table:
        s, words = table.column("shard")[0].as_py(), Vocabulary(folder, sizes)
        (ids,), left = summed([np.concatenate([unplaned(x.as_py(), np.int64) for x in table.column("c0")])], np.concatenate([unplaned(x.as_py(), np.float64) for x in table.column("n")]))
        begin = ids == words.size
        total = np.full(len(ids), model["docs"], np.int64)
        total[~begin] = words.counts(ids[~begin])
        q = np.full(sizes[s] if s < n else 1, STEPS, np.uint16)
        q[ids - words.first[s]] = quantised(left / total)
        save(f"{folder}/backoff-{s}", {"q": q})
        return pa.table({"shard": pa.array([s], pa.int32())})

    grams = src.mapInArrow(count_trigrams, "shard int, c0 binary, c1 binary, c2 binary, n binary").groupBy("shard").applyInArrow(write_trie, "shard int, c0 binary, n binary")
    grams.groupBy("shard").applyInArrow(write_backoff, "shard int").count()
    return model


def local_path(uri: str) -> str:
    path = uri.removeprefix("file://").removeprefix("file:")
    if not path.startswith("/"):
        raise ValueError(f"the trie's levels are memory-mapped: spark.checkpoint.dir must be a mounted path, not {uri}")
    return path


def contexts(ids: np.ndarray, counts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The words before each token, `begin` before a text's first."""
    starts = np.cumsum(counts) - counts
    w1, w0 = np.empty_like(ids), np.empty_like(ids)
    w1[1:], w0[2:] = ids[:-1], ids[:-2]
    w1[starts] = begin
    w0[starts] = begin
    second = starts[counts > 1] + 1
    w0[second] = begin
    return w0, w1


class Trie:
    def __init__(self, model: dict):
        self.m, self.open, self.words = model, {}, Vocabulary(model["folder"], model["sizes"])

    def shard(self, s: int) -> dict | None:
        """None if no pair fell into the shard."""
        if s not in self.open:
            if len(self.open) >= MOST_OPEN:
                self.open.clear()
            if not os.path.exists(path := f"{self.m['folder']}/trie-{s}"):
                self.open[s] = None
            else:
                parts = load(path)
                self.open[s] = {k: _mapped(parts, k) for k in ("a", "a.next", "b.next")} | {k: parts[k] for k in ("b.q", "b.back", "c.q")}
                self.open[s] |= {k: Words(parts[f"{k}.bits"], parts[f"{k}.low"]) for k in "bc"}
        return self.open[s]

    def probabilities(self, hashes, number, counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its count in training, the unigram and the trie's log10 probability."""
        n, v, begin = self.m["tokens"], self.m["types"], len(hashes)
        ids, seen = self.words.lookup(hashes)
        # The chunk's words are numbered as their ids ascend: what is searched then lies in the order of the levels.
        order = np.argsort(ids)
        rank = np.empty_like(order)
        rank[order] = np.arange(begin)
        ids, seen, number = np.append(ids[order], self.words.size), seen[order], rank[number]  # the last is a text's begin
        after = self.words.backoff(ids)
        p1 = ((seen + 0.5) / (n + 0.5 * (v + 1)))[number]
        frequent = np.append(seen > self.m["frequent"], True)
        unknown = int((ids < 0).sum())
        known = number >= unknown
        starts = np.cumsum(counts) - counts
        w1 = np.empty_like(number)
        w1[1:], w1[starts] = number[:-1], begin
        # Each distinct pair is searched once; the last, of two begins, is the context of all first tokens.
        live = np.flatnonzero(known & (w1 >= unknown))
        (a, b), pair_of = distinct(np.append(w1[live], begin), np.append(number[live], begin), begin + 1)
        context = np.full(len(number) + 1, -1)
        context[live + 1] = pair_of[:-1]
        context[starts] = pair_of[-1]
        context = context[:-1]
        # And so is each word after one.
        after_pair = np.flatnonzero((context >= 0) & known)
        (before, c), triple_of = distinct(context[after_pair], number[after_pair], begin + 1)
        where = context_shard(ids[a], ids[b], frequent[a], self.m["shards"])
        third = dict(groups(where[before]))
        q2, back, met, lo, hi = np.zeros(len(a)), np.ones(len(a)), np.zeros(len(a), bool), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        q3 = np.zeros(len(c))
        for s, own in groups(where):
            t = self.shard(s)
            if t is None:
                continue
            new = runs([a[own]])
            size = np.diff(np.append(new, len(own)))
            place = t["a"].find(ids[a[own[new]]])
            first, past = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
            first[place >= 0], past[place >= 0] = t["a.next"].span(place[place >= 0])
            at = t["b"].find(np.repeat(first, size), np.repeat(past, size), ids[b[own]])
            own, at = own[at >= 0], at[at >= 0]
            q2[own], back[own], met[own] = restored(t["b.q"][at]), restored(t["b.back"][at]), True
            lo[own], hi[own] = t["b.next"].span(at)
            own = third.get(s, np.zeros(0, np.int64))
            own = own[met[before[own]]]
            at = t["c"].find(lo[before[own]], hi[before[own]], ids[c[own]])
            q3[own[at >= 0]] = restored(t["c.q"][at[at >= 0]])
        p2, p3 = np.zeros(len(number)), np.zeros(len(number))
        p2[live] = q2[pair_of[:-1]]
        p3[after_pair] = q3[triple_of]
        two = p2 + after[w1] * p1
        longer = (context >= 0) & met[context]
        return seen[number], np.log10(p1), np.log10(np.where(longer, p3 + back[context] * two, two))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, base_score, score: log10 probabilities of each whole text, its end included.

    Null and empty texts are an end alone. Rows are scored one by one, repeated or not; untrained, all is uniform.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        trie = Trie(model)
        for batch, first, hashes, number, counts in chunks(batches):
            seen, base, own = trie.probabilities(hashes, number, counts)
            starts = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(first, len(counts)), pa.array(counts), pa.array(np.add.reduceat((seen > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(own, starts))],
                ["id", "n_tokens", "n_known", "base_score", "score"],
            )

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 1. A null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def fit_and_score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """score of all docs under a model of those not held out, with held_out and train_tokens."""
    model = train(docs.where(~held_out(id_col)), text_col)
    return score(docs, model, id_col, text_col).withColumns({"held_out": held_out(id_col), "train_tokens": F.lit(model["tokens"]).cast("long")})
