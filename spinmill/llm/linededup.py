"""Line dedup: deletion neighbourhoods of lines as hashed keys, joined, verified, the earliest kept."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, pinned, scratch, settled, sized, text_bytes

#: A line of fewer words is only held against equal lines: one word in five may differ.
MIN_WORDS = 5
#: Lines of candidates, or lines to remove, up to which they are broadcast to the documents; beyond, both are shuffled.
MOST_BROADCAST = 1_000_000
#: Odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Positions whose powers of BASE are made at once; longer runs extend them.
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    h, get = xxhash.xxh64_intdigest, memo.get
    if len(memo) > 100_000:
        memo.clear()
    out = []
    for w in words:
        x = get(w)
        if x is None:
            x = memo[w] = h(w)
        out.append(x)
    return np.array(out, np.uint64)


def variants(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, position, line) of lines with so many hashes each: every whole line at -1, then each without each word.

    Equal sequences have equal keys: sums of hashes by powers of BASE, all from one running sum, brought back to each
    line's own first power.
    """
    n, ends = len(h), np.cumsum(counts)
    starts = ends - counts
    up, down = powers(BASE, n + 1), powers(INVERSE, n + 1)
    run = np.concatenate(([np.uint64(0)], np.cumsum(h * up[:n])))
    line = np.repeat(np.arange(len(counts)), counts)
    a, b, i = starts[line], ends[line], np.arange(n)
    whole = (run[ends] - run[starts]) * down[starts]
    less = (run[i] - run[a] + (run[b] - run[i + 1]) * np.uint64(INVERSE)) * down[a]
    size = counts.astype(np.uint64)
    keys = mixed(np.concatenate((whole + size, less + size[line] - np.uint64(1))))
    return keys.view(np.int64), np.concatenate((np.full(len(counts), -1), i - a)), np.concatenate((np.arange(len(counts)), line))


def halves(words: list[bytes]) -> list[int]:
    """Hashes of the first and last words, of which two lines a word apart share one at least.

    As many words as half the power of two below the line's length, and below its length less one, so that both lines
    have a length in common.
    """
    n, out = len(words), []
    for half in dict.fromkeys(1 << (m.bit_length() - 2) for m in (n, n - 1)):
        out += [xxhash.xxh64_intdigest(b" ".join(words[:half]), half), xxhash.xxh64_intdigest(b" ".join(words[n - half :]), half + 1)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def one_word_apart(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit distance in words is 1 at most."""
    if abs(len(a) - len(b)) > 1:
        return False
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    if len(a) == len(b):
        return a[same + 1 :] == b[same + 1 :]
    return a[same:] == b[same + 1 :] if len(a) < len(b) else a[same + 1 :] == b[same:]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))


def _lines(docs: DataFrame) -> DataFrame:
    """id, t, no, k1, k2 (hash of the line's words), halves (from MIN_WORDS words on); a row for each line with a word."""

    def run(batches):
        for batch in batches:
            take, no, k1, k2, hv = [], [], [], [], []
            for i, value in enumerate(batch.column("text")):
                for j, line in enumerate(text_bytes(value.as_py()).split(b"\n")):
                    words = line.split()
                    if not words:
                        continue
                    d = xxhash.xxh3_128_intdigest(b" ".join(words))
                    take.append(i)
                    no.append(j)
                    k1.append((d >> 64) - (1 << 63))
                    k2.append((d & ((1 << 64) - 1)) - (1 << 63))
                    hv.append(halves(words) if len(words) >= MIN_WORDS else None)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("t").take(at), pa.array(no, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(hv, pa.list_(pa.int64()))], ["id", "t", "no", "k1", "k2", "halves"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, t bigint, no int, k1 bigint, k2 bigint, halves array<bigint>")


def near_lines(lines: DataFrame, folder: str) -> DataFrame:
    """a, b: for each line with an earlier one an edit away, such an earlier line. lines: ord (earlier is smaller), line.

    Variants of all lines are grouped by their key. Two lines that agree without the word at the same place are a
    substitution apart; a whole line and another's variant an insertion. So a group needs two minima by place, not its
    pairs, and gives at most two pairs a row. What the hashes say is verified on the words.
    """

    def emit(batches):
        memo: dict = {}
        for batch in batches:
            words, counts, first = [], [], 0
            ords = batch.column("ord").to_numpy()
            for i, value in enumerate(batch.column("line")):
                own = text_bytes(value.as_py()).split()
                words += own
                counts.append(len(own))
                if len(words) > 200_000 or i == batch.num_rows - 1:
                    key, place, line = variants(word_hashes(words, memo), np.array(counts, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), pa.array(ords[first + line])], ["key", "place", "ord"])
                    words, counts, first = [], [], i + 1

    lines.mapInArrow(emit, "key bigint, place bigint, ord bigint").write.parquet(f"{folder}/variants")
    keyed = lines.sparkSession.read.parquet(f"{folder}/variants")
    # The aggregate is combined before its exchange, and the join's keys may repeat: a key of very many lines is split.
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("place") < 0, F.col("ord"))).alias("full"), F.min(F.when(F.col("place") >= 0, F.col("ord"))).alias("short")).where("n > 1")
    met = settled(keyed.join(settled(shared), "key"))
    at_place = met.where("place >= 0").groupBy("key", "place").agg(F.min("ord").alias("alike"))
    pairs = met.join(at_place, ["key", "place"], "left").select("ord", F.explode(F.array("alike", F.when(F.col("place") < 0, F.col("short")).otherwise(F.col("full")))).alias("b"))
    pairs = pairs.where("b < ord").select(F.col("ord").alias("a"), "b").distinct()
    texts = lines.select("ord", "line")
    both = pairs.join(texts.select(F.col("ord").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("ord").alias("b"), F.col("line").alias("lb")), "b").select("a", "b", "la", "lb")

    def verify(batches):
        for batch in batches:
            ok = [one_word_apart(text_bytes(x.as_py()).split(), text_bytes(y.as_py()).split()) for x, y in zip(batch.column("la"), batch.column("lb"))]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return both.mapInArrow(verify, "a bigint, b bigint")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col less its repeated lines, n_lines and n_removed.

    A line goes if an earlier one (by id, then place) has the same words, or, from MIN_WORDS words on, is one word's
    insertion, deletion or substitution away. Lines without a word stay. Null ids come first; rows alike in id and text
    are one document and keep the same lines; a null text stays null with 0 lines. Columns n_lines and n_removed of docs
    are replaced.
    """
    spark = docs.sparkSession
    src = _rows(docs, id_col, text_col)
    folder = scratch(spark, "lines")
    _lines(src).write.parquet(f"{folder}/all")
    every = spark.read.parquet(f"{folder}/all")
    place = F.struct("id", "t", "no")
    lines = every.groupBy("k1", "k2").agg(F.min(place).alias("own"), F.count("*").alias("n"), F.max("halves").alias("halves"))
    lines.write.parquet(f"{folder}/distinct")
    lines = spark.read.parquet(f"{folder}/distinct")

    # Only lines that share half with another can be a word apart from one.
    half = lines.select(F.explode("halves").alias("half"), "k1", "k2")
    met = half.join(half.groupBy("half").count().where("count > 1"), "half", "left_semi").select("k1", "k2").distinct()
    wanted = lines.select("k1", "k2", "own").join(met, ["k1", "k2"], "left_semi")
    wanted.repartitionByRange("own").sortWithinPartitions("own").withColumn("ord", F.monotonically_increasing_id()).write.parquet(f"{folder}/wanted")
    wanted = spark.read.parquet(f"{folder}/wanted")
    by_doc = wanted.groupBy("own.id", "own.t").agg(F.collect_list(F.struct(F.col("own.no").alias("no"), "ord")).alias("want"))
    by_doc = sized(by_doc, wanted.count(), MOST_BROADCAST)
    # Rows alike in id and text give a line twice, with one ord: it has no earlier neighbour in itself.
    held = src.join(by_doc, src["id"].eqNullSafe(by_doc["id"]) & (src["t"] == by_doc["t"])).select("text", F.explode("want").alias("w"))
    held = held.select("w.ord", F.get(F.split("text", "\n", -1), F.col("w.no")).alias("line"))
    held.write.parquet(f"{folder}/candidates")
    near = near_lines(spark.read.parquet(f"{folder}/candidates"), folder).select(F.col("a").alias("ord")).distinct()
    near = wanted.join(near, "ord", "left_semi").select("k1", "k2", F.lit(True).alias("near"))

    fates = lines.join(near, ["k1", "k2"], "left").where("n > 1 or near").select("k1", "k2", "own", "near")
    fates = settled(fates)  # so that the join's both sides are plain exchanges, of which a common line's part is split
    gone = every.drop("halves").join(fates, ["k1", "k2"]).where(F.col("near").isNotNull() | ~place.eqNullSafe(F.col("own")))
    last = scratch(spark, "gone-lines")
    gone.groupBy("id", "t").agg(F.collect_set("no").alias("gone")).write.parquet(last)
    dropped(spark, folder)
    gone = spark.read.parquet(last)
    gone = sized(gone, gone.agg(F.sum(F.size("gone"))).first()[0] or 0, MOST_BROADCAST)

    had = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # The caller's columns travel in one struct, so that none can clash with those made here.
    rows = docs.select(F.struct(*had).alias("row"), F.xxhash64(F.col(text_col)).alias("r_t"), F.col(id_col).alias("r_id"))
    out = rows.join(gone, F.col("r_id").eqNullSafe(gone["id"]) & (F.col("r_t") == gone["t"]), "left").select("row", "gone")
    value = F.col("row").getField(text_col)
    out = out.withColumn("parts", pinned(F.split(value, "\n", -1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), value).otherwise(F.array_join(F.transform(kept, lambda i: F.get("parts", i)), "\n"))
    n_lines = F.when(value.isNull(), 0).otherwise(F.size(F.filter("parts", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))))
    return out.select(*[(text if c == text_col else F.col("row").getField(c)).alias(c) for c in had], n_lines.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"))
