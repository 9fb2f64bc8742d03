import re

import pytest

from spinmill.llm import quality
from spinmill.llm.queries import op5_quality_rules, trusted_ids


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeat = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat), n < 50 or 100 * len(repeat) > 50 * n


@pytest.mark.parametrize("kind", ["odd", "table"])
def test_base_rules(spark, frame, rows, odd_rows, kind):
    data = (odd_rows + [{**odd_rows[5], "doc_id": 900, "text": "a b a b a b a b c d e a b x\n\n y\ny\n y " * 9}]) if kind == "odd" else rows
    trusted = spark.createDataFrame([(5,), (5,), (9,), (None,)], "doc_id bigint")
    got = quality.quality_rules(frame(data, extra=("n_words", "ratio", "h", "kept", "__ratio", "__n", "__hw", "__row", "__text", "b", "g", "x") if kind == "odd" else ()), trusted).collect()
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(((r["doc_id"], *(r[c] for c in cols)) for r in got), key=str) == sorted(((r["doc_id"], *base(r["text"])) for r in data), key=str)
    assert all(r["kept"] == (not r["base_failed"] and r["log_ratio"] >= quality.MIN_RATIO) for r in got)


@pytest.mark.parametrize("bits", [2, 5])
def test_long_documents_and_meeting_hashes(spark, frame, odd_rows, monkeypatch, bits):
    """With few bits for places, most documents count as very long."""
    monkeypatch.setattr(quality, "PLACE_BITS", bits)
    data = odd_rows + [{**odd_rows[5], "doc_id": 900, "text": "a b a b a b a b c d e a b x\n\n y\ny\n y " * 9}, {**odd_rows[5], "doc_id": 901, "text": "p q r s p q r t"}]
    got = quality.quality_rules(frame(data), spark.createDataFrame([], "doc_id bigint")).collect()
    assert sorted(((r["doc_id"], r["n_repeat_words"]) for r in got), key=str) == sorted(((r["doc_id"], base(r["text"])[4]) for r in data), key=str)


def test_hashes_that_differ_in_the_low_bits(spark):
    """Windows whose hashes agree but for the bits of their places are still told apart."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(i, [rng.choice([8, 9, 10, 11, 64]) for _ in range(rng.randint(0, 12))]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, w array<bigint>")
    # Hashes of windows are stood in for by the numbers themselves: 8 to 11 agree above the lowest bits.
    real = F.xxhash64
    try:
        F.xxhash64 = lambda a, b: b
        quality_n = quality._repeats(df.select("id", F.col("w").alias("__hw"), quality._after("w", 1).alias("__pw"), F.size("w").cast("long").alias("__n")))
        got = {r["id"]: r["n_repeat_words"] for r in quality_n.select("id", "n_repeat_words").collect()}
    finally:
        F.xxhash64 = real
    for i, w in rows:
        win = w[2:]
        assert got[i] == len({k + j for k, x in enumerate(win) if win.count(x) > 1 for j in range(3)}), w


def test_ratios_tell_junk_from_prose(spark, sf):
    got = op5_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in got if r["quality"] == 1]
    assert good and all(good)
    bad = [r["log_ratio"] for r in got if r["quality"] == 0]
    assert not bad or sum(bad) / len(bad) < min(r["log_ratio"] for r in got if r["quality"] == 1)


def test_both_joins_agree(spark, sf, frame, rows, monkeypatch):
    one = sorted(map(str, quality.quality_rules(frame(rows), trusted_ids(spark, sf)).collect()))
    monkeypatch.setattr(quality, "MOST_BROADCAST", 0)
    assert sorted(map(str, quality.quality_rules(frame(rows), trusted_ids(spark, sf)).collect())) == one


def test_ratios_by_hand(spark):
    """log(p_trusted / p_raw) with a count added to every bucket."""
    import math

    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, None)], "__id int, __text string")
    good = spark.createDataFrame([(1,)], "__id int")
    ratio = quality.log_ratios(docs, good, buckets=4096).first()["__ratio"]
    h = {r["w"]: r["h"] for r in spark.sql("SELECT w, xxhash64(w) & 4095 AS h FROM VALUES ('a'), ('b') AS t(w)").collect()}
    # Raw: a twice, b and the pair once; trusted: each once. 4 and 3 features.
    assert ratio[h["a"]] == pytest.approx(math.log((2 / 4099) / (3 / 4100)))
    assert ratio[h["b"]] == pytest.approx(math.log((2 / 4099) / (2 / 4100)))
    assert len(ratio) == 4096 and sorted(set(round(x, 12) for x in ratio))[-1] == round(math.log((2 / 4099) / (2 / 4100)), 12)


def test_empty_tables(spark, frame, odd_rows):
    none = spark.createDataFrame([], "doc_id bigint")
    assert quality.quality_rules(frame([]), none).count() == 0
    assert all(r["log_ratio"] == 0 for r in quality.quality_rules(frame(odd_rows), none).collect())


def test_constants_of_the_plan_are_exact_and_not_printed(spark, sf):
    """Spark describes the plan whenever a stage of it ends; tables of 16,384 numbers in it filled the driver's memory."""
    import corpus_pipeline as cp
    from pyspark.sql import functions as F
    from spinmill.llm.common import table

    for kind, values in (("double", [0.1, -0.0, 1e-300, -7.25]), ("bigint", [0, -1, 2**62, -(2**63)])):
        got = spark.range(4).select("id", F.get(quality._literal(values, kind), F.col("id").cast("int")).alias("x"))
        assert [repr(r["x"]) for r in got.orderBy("id").collect()] == [repr(v) for v in values]
    docs, ids = table(spark, sf, "documents"), cp.trusted_ids(spark, sf)
    assert len(quality.quality_rules(docs, ids)._jdf.queryExecution().toString()) < 200_000
