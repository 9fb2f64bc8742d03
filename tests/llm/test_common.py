import re

import os

from spinmill.llm import common


def test_scratch_folders_go(spark):
    common.clear(spark)
    path = common.scratch(spark, "x")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file:")
    assert os.path.isdir(local)
    common.clear(spark)
    assert not os.path.exists(local) and not common._scratch


def test_words_of_bytes():
    assert common.ws_words("A B\x0bc\x1cD É") == ["a b".encode(), b"c\x1cd", "É".encode()]
    assert common.alnum_words("A-b_Ç9\x7f日本") == [b"a", b"b", "Ç9".encode(), "日本".encode()]
    assert common.ws_words(None) == common.alnum_words(None) == []


def test_words_are_the_contracts(spark):
    """Every ASCII character, and some of each length in UTF-8, by the contract's class."""
    from pyspark.sql import functions as F

    from spinmill.llm.common import ANY_CASE_WORD

    text = "".join(f"a{chr(c)}b{chr(c)}" for c in [*range(1, 0x180), 0x7FF, 0x800, 0x2028, 0xFFFD, 0x10000, 0x1F642, 0x10FFFF])
    row = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract_all("t", F.lit(ANY_CASE_WORD), F.lit(0)).alias("w"), F.regexp_count("t", F.lit(ANY_CASE_WORD)).alias("n")).first()
    assert row["w"] == re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text) and row["n"] == len(row["w"])
