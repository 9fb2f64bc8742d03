"""Patterns and small helpers that several operators share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the query contracts.
WS_WORD = r"[^\x20\x09-\x0D]+"
#: The alphanumeric words of a text, before A-Z is lower-cased: what the contract's class leaves, said by what it holds,
#: which Java matches many times as fast as the complement of four ranges.
ANY_CASE_WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: For bytes.translate: A-Z lower-cased; every byte that ends an alphanumeric word becomes a space.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b
    for b in range(256)
)


def text_bytes(value) -> bytes:
    """UTF-8 of a text; null is empty."""
    return value.encode("utf-8", "surrogatepass") if value else b""


def alnum_words(value) -> list[bytes]:
    return text_bytes(value).translate(ALNUM_BYTES).split()


def ws_words(value) -> list[bytes]:
    """Lower-cased words. bytes.split() cuts at the six ASCII blanks, as the contracts do."""
    return text_bytes(value).translate(LOWER_BYTES).split()


def whole(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Set here only where the session has none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(found)
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spinmill-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def pinned(c: Column) -> Column:
    """c, computed where it stands. A filter above would else be pushed below it with a copy of c for each use, and a
    copy inside a lambda is computed for each element."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one. Results are read from it lazily, so it stays until clear()."""
    _scratch.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _scratch:
        _scratch.remove(path)


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Scratch folders made inside are removed at the end: for what is written elsewhere by then."""
    before = len(_scratch)
    yield
    for path in _scratch[before:]:
        dropped(spark, path)


#: Rows of numbers up to which a side is broadcast.
MOST_BROADCAST = 1_000_000


def sized(df: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """df, to be broadcast if it holds n rows of numbers and n is at most `most`."""
    return F.broadcast(df) if n <= (MOST_BROADCAST if most is None else most) else df


def clear(spark: SparkSession) -> None:
    """Removes all scratch folders that this process has made; for when its results have been written."""
    while _scratch:
        dropped(spark, _scratch[-1])


def settled(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared folder, where a lost executor can't take it along."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
