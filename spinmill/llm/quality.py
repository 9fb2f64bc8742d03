"""Quality rules: repetition and length rules, then a hashed n-gram log-likelihood ratio. DataFrame functions only."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from .common import WS_WORD, pinned, whole

#: Hash buckets of each multinomial: its table has this many doubles, whatever the input.
BUCKETS = 1 << 14
#: A document below this log_ratio (nats a feature, trusted against raw) is rejected.
MIN_RATIO = -0.08
#: How far below the lowest trusted document, scored without its own counts, a document may lie, as a multiple.
SLACK = 1.5
#: Ids of trusted documents up to which they are broadcast; beyond, documents and ids are shuffled together.
MOST_BROADCAST = 1_000_000
#: Added to each bucket's count.
ALPHA = 1.0


#: Bits that a place takes beside a window's hash while they are sorted together; longer documents sort them apart.
PLACE_BITS = 20


def _hashed(df: DataFrame) -> DataFrame:
    """df with __words, __hw (a hash of each word), __pw (of each pair of neighbours) and __n."""
    df = df.withColumn("__words", F.regexp_extract_all(whole("__text"), F.lit(WS_WORD), F.lit(0)))
    df = df.withColumn("__hw", pinned(F.transform("__words", lambda w: F.xxhash64(w))))
    # zip_with instead of places: an array that a lambda looks into is opened again for each element.
    return df.withColumn("__pw", pinned(F.zip_with(_but(1), _after("__hw", 1), lambda a, b: F.xxhash64(a, b)))).withColumn("__n", F.size("__hw").cast("long"))


def _but(k: int, array: str = "__hw") -> Column:
    return F.slice(array, F.lit(1), F.greatest(F.size(array) - k, F.lit(0)))


def _after(array: str, k: int) -> Column:
    return F.slice(array, F.lit(k + 1), F.greatest(F.size(array) - k, F.lit(0)))


def _bucket(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(F.lit(buckets - 1)).cast("int")


def _features(buckets: int) -> Column:
    """Buckets of a document's words and pairs."""
    return F.transform(F.concat("__hw", "__pw"), lambda x: _bucket(x, buckets))


def _literal(values: list, kind: str) -> Column:
    """An array of bigint or double as a constant of the plan, its values packed in one block.

    Unlike a folded array of boxed values it doesn't print them: Spark describes a plan anew, several times over, whenever
    a stage of it ends, and some MB of text in each description fill the driver's memory.
    """
    spark = SparkSession.active()
    jvm, long = spark._jvm, kind == "bigint"
    array = spark.sparkContext._gateway.new_array(jvm.long if long else jvm.double, len(values))
    raw = jvm.java.nio.ByteBuffer.wrap(bytearray(struct.pack(f">{len(values)}{'q' if long else 'd'}", *values)))
    (raw.asLongBuffer() if long else raw.asDoubleBuffer()).get(array)
    catalyst = jvm.org.apache.spark.sql.catalyst.expressions
    value = catalyst.Literal(catalyst.UnsafeArrayData.fromPrimitiveArray(array), jvm.org.apache.spark.sql.types.DataType.fromDDL(f"array<{kind}>"))
    return ClassicColumn(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(value))


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with `__ratio`, an array of log(p_trusted / p_raw) by bucket; the counts as `__raw`, `__trusted`, `__nr`, `__ng`.

    docs has __id and __text; trusted has __id, distinct. The counts come from every document; a row for each bucket
    is the most that meets in one task.
    """
    good = trusted.select("__id", F.lit(1).alias("__good"))
    marked = docs.join(F.broadcast(good) if trusted.count() <= MOST_BROADCAST else good.hint("merge"), "__id", "left")
    # Rows of a word and its pair, whose buckets are then found in compiled code.
    pairs = _hashed(marked).select(F.explode(F.arrays_zip("__hw", "__pw")).alias("x"), F.coalesce("__good", F.lit(0)).alias("g"))
    counted = pairs.select(F.explode(F.array(_bucket(F.col("x.__hw"), buckets), _bucket(F.col("x.__pw"), buckets))).alias("b"), "g")
    counted = counted.where("b is not null").groupBy("b").agg(F.count("*").alias("raw"), F.sum("g").alias("good"))
    full = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counted, "b", "left").na.fill(0, ["raw", "good"])
    one = full.agg(F.sum("raw").alias("nr"), F.sum("good").alias("ng"), F.array_sort(F.collect_list(F.struct("b", "raw", "good"))).alias("t"))
    p = lambda c, n: (c + F.lit(ALPHA)) / (n + F.lit(ALPHA * buckets))
    ratio = F.transform("t", lambda x: F.log(p(x["good"], F.col("ng")) / p(x["raw"], F.col("nr"))))
    return one.select(
        F.when(F.col("ng") > 0, ratio).otherwise(F.array_repeat(F.lit(0.0), buckets)).alias("__ratio"),
        F.transform("t", lambda x: x["raw"]).alias("__raw"), F.transform("t", lambda x: x["good"]).alias("__trusted"),
        F.col("nr").alias("__nr"), F.col("ng").alias("__ng"),
    )


def _repeats(df: DataFrame) -> DataFrame:
    """df of _hashed with n_repeat_words: words inside a three-word window that occurs twice.

    Hashes of windows are sorted with their places in the low bits. Hashes that differ in those bits alone could come to
    stand between equal ones: then, and for very long documents, hashes and places are sorted as pairs.
    """
    low, n = (1 << PLACE_BITS) - 1, F.col("__n")
    df = df.withColumn("__win", pinned(F.zip_with(_but(1, "__pw"), _after("__hw", 2), lambda p, c: F.xxhash64(p, c))))
    df = df.withColumn("__more", pinned(F.size("__win") - F.size(F.array_distinct("__win"))))
    packed = F.sort_array(F.transform("__win", lambda h, i: h.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))
    df = df.withColumn("__packed", pinned(F.when((F.col("__more") > 0) & (n <= low), packed)))
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    alike = F.zip_with(_but(1, "__packed"), _after("__packed", 1), lambda x, y: F.when(F.shiftright(x, PLACE_BITS) == F.shiftright(y, PLACE_BITS), F.array(place(x), place(y))))
    df = df.withColumn("__alike", pinned(F.filter(alike, lambda x: x.isNotNull() & (F.get("__win", x[0]) == F.get("__win", x[1])))))
    pairs = F.array_sort(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__pairs", pinned(F.when((F.col("__more") > 0) & (F.col("__alike").isNull() | (F.size("__alike") != F.col("__more"))), pairs)))
    of_pairs = F.zip_with(_but(1, "__pairs"), _after("__pairs", 1), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
    found = F.when(F.col("__pairs").isNull(), F.col("__alike")).otherwise(F.filter(of_pairs, lambda x: x.isNotNull()))
    df = df.withColumn("__at", pinned(F.when(F.col("__more") > 0, F.sort_array(F.array_distinct(F.flatten(found))))))
    gaps = F.zip_with(_but(1, "__at"), _after("__at", 1), lambda x, y: F.least(F.lit(3), y - x))
    total = F.aggregate(gaps, F.lit(0), lambda a, x: a + x) + 3
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.size("__at") > 0, total), F.lit(0)).cast("long"))


def _fails(n: Column) -> Column:
    return (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)


def lowest_left_out(docs: DataFrame, trusted: DataFrame, ratio: Row, buckets: int = BUCKETS) -> float | None:
    """The lowest mean log ratio of a trusted document that passes the base rules, with its own counts taken out of the
    trusted ones: as it would be scored if it were not among them. None if there is no such document.

    docs and trusted as for log_ratios; ratio: its row.
    """
    own = docs.join(F.broadcast(trusted) if trusted.count() <= MOST_BROADCAST else trusted.hint("merge"), "__id")
    own = _hashed(own).where(F.col("__n") >= 50)
    own = _repeats(own).where(~_fails(F.col("__n"))).withColumn("__f", pinned(F.transform(F.sort_array(_features(buckets)), lambda x, i: F.shiftleft(x.cast("long"), 32) + i)))
    m = F.size("__f")
    # The last place of each run of a bucket in the sorted features; the run before it ends where this one begins.
    last = F.zip_with(_but(1, "__f"), _after("__f", 1), lambda x, y: F.when(F.shiftright(x, 32) != F.shiftright(y, 32), x))
    own = own.withColumn("__ends", pinned(F.array_append(F.filter(last, lambda x: x.isNotNull()), F.element_at("__f", -1))))
    place = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1))
    good, raw = _literal(ratio["__trusted"], "bigint"), _literal(ratio["__raw"], "bigint")
    once = _literal([math.log((max(t - 1, 0) + ALPHA) / (r + ALPHA)) for t, r in zip(ratio["__trusted"], ratio["__raw"])], "double")

    def part(end: Column, before: Column) -> Column:
        b, c = F.shiftright(end, 32).cast("int"), place(end) - F.coalesce(place(before), F.lit(-1))
        return F.when(c == 1, F.get(once, b)).otherwise(c * F.log((F.get(good, b) - c + F.lit(ALPHA)) / (F.get(raw, b) + F.lit(ALPHA))))

    ends = F.col("__ends")
    total = F.aggregate(F.zip_with(ends, F.array_prepend(_but(1, "__ends"), F.lit(None).cast("long")), part), F.lit(0.0), lambda a, x: a + x)
    mean = total / m - F.log((F.lit(ratio["__ng"]) - m + F.lit(ALPHA * buckets)) / F.lit(ratio["__nr"] + ALPHA * buckets))
    return own.agg(F.min(mean)).first()[0]


def quality_rules(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_ratio: float = MIN_RATIO, buckets: int = BUCKETS
) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ratio and kept.

    trusted: a table with `id_col`, the documents of the target distribution. Null and empty texts have no words, fail
    the base rules and have a log_ratio of 0. A row with a null id is never trusted; each repeated row is judged by
    itself, alike. Columns of docs with the names above are replaced. With no trusted document, ratios are 0.

    log_ratio is the mean log ratio of the features with p_trusted drawn towards p_raw (p_trusted^w * p_raw^(1-w), so w
    times the ratio). Words that trusted documents happen to lack score below zero whatever their quality, the more the
    fewer trusted documents use them; w is such that SLACK times the lowest trusted document's score without its own
    counts is not below min_ratio, and 1 where it isn't anyway, or where min_ratio isn't negative.
    """
    ids = trusted.select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    ratio = log_ratios(texts, ids, buckets).first()  # numbers for each bucket
    low = lowest_left_out(texts, ids, ratio, buckets) if min_ratio < 0 else None
    weight = 1.0 if low is None or SLACK * low >= min_ratio else min_ratio / (SLACK * low)
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept"]
    had = [c for c in docs.columns if c not in out]
    # The caller's columns travel in one struct, so that none can clash with those made here.
    df = _hashed(docs.select(F.struct(*had).alias("__row"), F.col(text_col).alias("__text")))
    n, text, table = F.col("__n"), whole("__text"), _literal(ratio["__ratio"], "double")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WS_WORD))
    df = df.select(
        "__row", "__hw", "__pw", "__n", n.alias("n_words"), pinned(lines).alias("__lines"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    scores = F.zip_with("__hw", "__pw", lambda a, p: F.get(table, _bucket(a, buckets)) + F.coalesce(F.get(table, _bucket(p, buckets)), F.lit(0.0)))
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x)
    df = _repeats(df.withColumns({
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "log_ratio": F.when(n > 0, F.lit(weight) * total / (2 * n - 1)).otherwise(0.0),
    }).drop("__lines"))
    df = df.withColumn("base_failed", _fails(n))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= F.lit(min_ratio))).select(*[F.col("__row").getField(c).alias(c) for c in had], *out)
