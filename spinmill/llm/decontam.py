"""Benchmark decontamination over a positional inverted index that lives in segments of documents."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, scratch

WINDOW = 10
#: Words that a proximity match may hold beside a window's, in tenths of the window's length: 3 for ten words.
SLOP = 3
#: Words between documents in a segment's numbering; no match may reach as far.
GAP = 64
#: Candidates of proximity matches that are judged at once.
AT_ONCE = 50_000
#: Documents in a segment of the index.
SEGMENT = 512
#: Benchmark items in a block: what one broadcast holds at most, with their words.
BLOCK = 20_000
#: Distinct benchmark words up to which postings of other words are left out of the index.
MOST_TERMS = 1_000_000


def term_id(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


class Windows:
    """The windows of a block of items: distinct sequences of terms, and the items that each belongs to."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW, slop: int | None = SLOP):
        seen: dict[tuple[int, ...], set[int]] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        for name, words in items:
            ids = [term_id(w) for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                seen.setdefault(tuple(ids[i : i + window]), set()).add(number[name])
        self.lengths = np.array([len(x) for x in seen], np.int64)
        self.terms = np.full((len(seen), window), -1, np.int64)
        for i, x in enumerate(seen):
            self.terms[i, : len(x)] = x
        #: Words that a proximity match spans at most; null: phrases alone.
        self.reach = None if slop is None else self.lengths + self.lengths * slop // 10
        #: How many equal terms stand before each, and how many there are.
        self.nth, self.often = np.zeros(self.terms.shape, np.int8), np.zeros(self.terms.shape, np.int8)
        for j in range(window):
            same = self.terms == self.terms[:, j : j + 1]
            self.nth[:, j], self.often[:, j] = same[:, :j].sum(axis=1), same.sum(axis=1)
        self.ptr = np.cumsum([0, *map(len, seen.values())])
        self.items = np.array([j for x in seen.values() for j in sorted(x)], np.int64)


class Segment:
    """Postings of some documents: for each term its positions, counted on through the documents with gaps between."""

    def __init__(self, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray):
        self.terms, self.starts, self.positions = terms, starts, positions.astype(np.int64)
        self.keys = np.repeat(np.arange(len(terms), dtype=np.int64), np.diff(starts)) << 34 | self.positions

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """Where the terms stand in this segment's list; -1 for those that it lacks."""
        if not len(self.terms):
            return np.full(terms.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def has(self, number: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = number << 34 | position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[at] == key

    def following(self, number: np.ndarray, position: np.ndarray, skip: np.ndarray | int = 0) -> np.ndarray:
        """Where a term stands at or after a position, `skip` times passed over; far away if nowhere."""
        at = np.searchsorted(self.keys, (number << 34) + np.maximum(position, 0)) + skip
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (key >> 34 == number), key & (1 << 34) - 1, 1 << 40)

    def matches(self, w: Windows) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Phrases: (window, position of its first word) of every place where a window's terms stand in a row.
        Proximity: (window, first, past) of every shortest stretch within the window's reach that holds all its terms,
        each as often as the window, in any order.

        The rarest term's list gives the candidates of both; from the next rarest on, those stay that have each other
        term within reach. Phrases are what the lists shifted by their offsets intersect in.
        """
        none = np.zeros(0, np.int64)
        number = self.numbers(w.terms)
        count = np.diff(self.starts)
        used = w.terms >= 0
        sizes = np.where(used, np.where(number >= 0, count[number] if len(count) else 0, 0), np.iinfo(np.int64).max)
        alive = np.flatnonzero(sizes.min(axis=1, initial=np.iinfo(np.int64).max) > 0)
        if not len(alive):
            return (none, none), (none, none, none)
        order = np.argsort(sizes[alive], axis=1, kind="stable")
        lists = number[alive, order[:, 0]]
        n = count[lists]
        window = np.repeat(np.arange(len(alive)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = self.positions[np.repeat(self.starts[lists], n) + within]
        for j in range(1, w.terms.shape[1] if w.reach is not None else 0):
            offset, reach = order[window, j], w.reach[alive[window]]
            check = offset < w.lengths[alive[window]]
            ok = ~check | (self.following(np.where(check, number[alive[window], offset], 0), at - reach + 1) < at + reach)
            window, at = window[ok], at[ok]
        near = [self.stretches(w, number, alive[window[i : i + AT_ONCE]], at[i : i + AT_ONCE]) for i in range(0, len(at) if w.reach is not None else 0, AT_ONCE)]
        near = np.unique(np.concatenate(near), axis=0) if near else np.zeros((0, 3), np.int64)
        first = at - order[window, 0]
        for j in range(1, w.terms.shape[1]):
            offset = order[window, j]
            check = offset < w.lengths[alive[window]]
            ok = ~check | self.has(np.where(check, number[alive[window], offset], 0), first + offset)
            window, first = window[ok], first[ok]
        return (alive[window], first), (near[:, 0], near[:, 1], near[:, 2])

    def stretches(self, w: Windows, number: np.ndarray, window: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(window, first, past) of the shortest stretches in reach that hold the window's terms and the position."""
        reach = w.reach[window]
        back = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        pair = np.unique(np.stack([np.repeat(window, reach), np.repeat(at, reach) - back], axis=1), axis=0)
        window, first = pair[pair[:, 1] >= 0].T
        least, last = np.full(len(first), 1 << 40), np.zeros(len(first), np.int64)
        for j in range(w.terms.shape[1]):
            here = w.terms[window, j] >= 0
            own = self.following(np.where(here, number[window, j], 0), first, w.nth[window, j])
            least, last = np.where(here, np.minimum(least, own), least), np.where(here, np.maximum(last, own), last)
        ok = (least == first) & (last < first + w.reach[window])
        window, first, last = window[ok], first[ok], last[ok]
        shortest = np.ones(len(first), bool)
        for j in range(w.terms.shape[1]):
            # The first word can go if its term stands once more in the stretch than the window asks for.
            mine = (w.terms[window, j] >= 0) & (w.nth[window, j] == 0)
            term = np.where(mine, number[window, j], 0)
            shortest &= ~(mine & (self.following(term, first) == first) & (self.following(term, first, w.often[window, j]) <= last))
        return np.stack([window, first, last + 1], axis=1)[shortest]


def covered(first: np.ndarray, past: np.ndarray, firsts: np.ndarray, size: int) -> list[list[dict]]:
    """For each document the runs of words that the stretches cover."""
    cover = np.zeros(size, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, past, -1)
    edge = np.diff(np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8), [0])))
    spans: list[list[dict]] = [[] for _ in firsts]
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for d, a, z in zip(np.searchsorted(firsts, begin, "right") - 1, begin, end):
        spans[d].append({"first": int(a - firsts[d]), "past": int(z - firsts[d])})
    return spans


def add_names(names: list[set[str]], w: Windows, window: np.ndarray, first: np.ndarray, firsts: np.ndarray) -> None:
    """To each document's names, those of the items whose windows it holds."""
    doc = np.searchsorted(firsts, first, "right") - 1
    for x in np.unique(doc * len(w.lengths) + window) if len(doc) else ():
        d, k = divmod(int(x), len(w.lengths))
        names[d].update(w.names[j] for j in w.items[w.ptr[k] : w.ptr[k + 1]])


def index(docs: DataFrame, vocabulary: frozenset[bytes] | None, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row a segment: ids, n_words and first positions of its documents; its terms, starts and positions as arrays.

    vocabulary: words whose postings are stored (null: all). Written to the shared folder and read from there.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = spark.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = {w: i for i, w in enumerate(words.value)} if words.value is not None else {}
        ids = np.fromiter(map(term_id, known), np.int64, len(known))
        for batch in batches:
            for at in range(0, batch.num_rows, segment):
                part = batch.slice(at, segment)
                if words.value is None:
                    known = {}
                terms, counts = [], []
                for value in part.column("text"):
                    own = alnum_words(value.as_py())
                    if words.value is None:
                        terms += [known.setdefault(w, len(known)) for w in own]
                    else:
                        terms += [known.get(w, -1) for w in own]
                    counts.append(len(own))
                if words.value is None:
                    ids = np.fromiter(map(term_id, known), np.int64, len(known))
                terms, counts = np.array(terms, np.int32), np.array(counts, np.int64)
                # A gap longer than any window keeps phrases inside documents.
                firsts = np.cumsum(counts + GAP) - counts - GAP
                places = np.arange(len(terms), dtype=np.int64) + np.repeat(np.arange(len(counts)) * GAP, counts)
                keep = np.flatnonzero(terms >= 0)
                present, inverse = np.unique(ids[terms[keep]], return_inverse=True)
                order = np.argsort(inverse, kind="stable")
                starts = np.searchsorted(inverse[order], np.arange(len(present) + 1)) if len(keep) else np.zeros(1, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id")), *(pa.array([x.tobytes()], pa.binary()) for x in (counts, firsts, present, starts.astype(np.int64), places[keep][order].astype(np.uint32)))],
                    ["ids", "counts", "firsts", "terms", "starts", "positions"],
                )

    kind = src.schema["id"].dataType.simpleString()
    made = src.mapInArrow(run, f"ids array<{kind}>, counts binary, firsts binary, terms binary, starts binary, positions binary")
    path = scratch(spark, "index")
    made.write.parquet(path)
    return spark.read.parquet(path)


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str, block: int):
    """The items in blocks, by one pass through the driver that holds a block at a time."""
    held = []
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = alnum_words(row["t"])
        if row["i"] is not None and words:
            held.append((row["i"], words))
            if len(held) >= block:
                yield held
                held = []
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, window: int = WINDOW, slop: int | None = SLOP, block: int = BLOCK) -> DataFrame:
    """id_col, n_words; exact phrases: n_hit, n_items, items_sha256, items (ids of the items found, sorted), spans (runs
    of hit words); proximity: near_items, near_spans.

    A proximity match of a window is a shortest stretch of words that holds all the window's, each as often, in any
    order, with at most `slop` tenths of the window's length of other words among them; exact phrases are such matches,
    too. A word that was replaced by another isn't made up for. With a null slop, phrases alone are sought.
    One row for each row of docs. Null texts have no words; items with a null id or no words are skipped; items that
    share an id are one. An empty benchmark finds nothing.
    """
    if window + window * (slop or 0) // 10 > GAP:
        raise ValueError(f"a window of {window} and {slop} tenths reaches over {GAP} words")
    spark = docs.sparkSession
    vocabulary: set[bytes] | None = set()
    searched = []
    for held in blocks_of(benchmark, item_col, item_text_col, block):
        if vocabulary is not None:
            vocabulary.update(w for _, words in held for w in words)
            vocabulary = vocabulary if len(vocabulary) <= MOST_TERMS else None
        searched.append(spark.sparkContext.broadcast(Windows(held, window, slop)))
    segments = index(docs, None if vocabulary is None else frozenset(vocabulary), id_col, text_col)
    runs = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[row].as_py(), kind)  # noqa: E731, B023
                counts, firsts = get("counts", np.int64), get("firsts", np.int64)
                seg = Segment(get("terms", np.int64), get("starts", np.int64), get("positions", np.uint32))
                exact: list[set[str]] = [set() for _ in counts]
                close: list[set[str]] = [set() for _ in counts]
                first, past, near_first, near_past = ([np.zeros(0, np.int64)] for _ in range(4))
                for b in searched:
                    w = b.value
                    (x, a), (y, c, z) = seg.matches(w)
                    add_names(exact, w, x, a, firsts)
                    add_names(close, w, y, c, firsts)
                    for held, new in ((first, a), (past, a + w.lengths[x]), (near_first, c), (near_past, z)):
                        held.append(new)
                size = int(counts.sum()) + GAP * len(counts) + 1
                spans = covered(np.concatenate(first), np.concatenate(past), firsts, size)
                near = covered(np.concatenate(near_first), np.concatenate(near_past), firsts, size)
                items = [sorted(x) for x in exact]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("ids")[row].values, pa.array(counts), pa.array([sum(s["past"] - s["first"] for s in x) for x in spans], pa.int64()),
                        pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                        pa.array(items, pa.list_(pa.string())), pa.array(spans, runs), pa.array([sorted(x) for x in close], pa.list_(pa.string())), pa.array(near, runs),
                    ],
                    ["id", "n_words", "n_hit", "n_items", "items_sha256", "items", "spans", "near_items", "near_spans"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    pieces = "array<struct<first:bigint,past:bigint>>"
    found = segments.mapInArrow(run, f"id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, items array<string>, spans {pieces}, near_items array<string>, near_spans {pieces}")
    return found.withColumnRenamed("id", id_col)
