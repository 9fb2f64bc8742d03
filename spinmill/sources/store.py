"""Bases, spectra and results on storage: Parquet first; text formats for exchange."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import State, names


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; one of our own only where it is unset, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="spinmill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there to its end."""
    fs, where = _file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(where)


def listing(spark: SparkSession, path: str, prefix: str = "basis") -> DataFrame:
    """name and rows of each Parquet table under path whose name starts with the prefix; rows come from the files' ends."""
    fs, where = _file_system(spark, path)
    found = sorted(f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory() and f.getPath().getName().startswith(prefix))
    sizes = [(n, spark.read.parquet(f"{path}/{n}").count()) for n in found if written(spark, f"{path}/{n}")]
    return spark.createDataFrame(sizes, "name string, rows bigint")


def basis_path(lattice: str, n_pairs: int = 0, partitioned: bool = False, kind: str = "parquet") -> str:
    """`<lattice>.<pairs>.basis[.partitioned].<kind>` beside the lattice's file."""
    return f"{re.sub(r'[.]json$', '', lattice)}.{n_pairs}.basis{'.partitioned' if partitioned else ''}.{kind}"


def lattice_of(path: str) -> tuple[str, int]:
    """The lattice file and number of pairs that a basis path names."""
    m = re.fullmatch(r"(.*)\.(\d+)\.basis(?:\.partitioned)?\.\w+", path)
    if not m:
        raise ValueError(f"{path} names no basis")
    return f"{m[1]}.json", int(m[2])


def key_values(name: str) -> dict[str, str]:
    """Pairs of a file name such as `g=1%x=2%.out`."""
    return dict(part.split("=", 1) for part in name.split("%") if "=" in part)


def write_csv(states: DataFrame, path: str, n_sites: int) -> None:
    """0x and 32 digits a line, ascending; a range-partitioned sort, not one task."""
    ordered = states.orderBy(*State.of(n_sites).order())
    ordered.select(State.of(n_sites).to_hex().alias("value")).write.mode("overwrite").text(path)


def read_csv(spark: SparkSession, path: str, n_sites: int) -> DataFrame:
    """States of hexadecimal lines; a line that is none fails the read."""
    text = F.trim("value")
    ok = F.when(text.rlike("^0[xX][0-9a-fA-F]{1,32}$"), text).otherwise(F.raise_error(F.concat(F.lit("no state: "), F.col("value"))))
    return spark.read.text(path).where(F.length(text) > 0).select(*State.from_hex(ok, n_sites).named())


def write_basis(states: DataFrame, path: str, n_sites: int, *, sectors: list[int] | None = None) -> None:
    """Sorted Parquet; by sector folders if sublattice masks are given, so that reading one prunes the others."""
    order = State.of(n_sites).order()
    if sectors:
        from ..operators.sectors import with_sector

        marked = with_sector(states, sectors, n_sites)
        keys = [c for c in marked.columns if re.fullmatch(r"s\d+", c)]
        # Ranges of sector and state: a task writes few sectors, and a large one is written by several tasks.
        marked.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).write.mode("overwrite").partitionBy(*keys).parquet(path)
    else:
        states.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def read_basis(spark: SparkSession, path: str, n_sites: int, sector: list[int] | None = None) -> DataFrame:
    """By the path's ending: Parquet or csv. sector: numbers up by sublattice, of a basis written by sector."""
    if path.endswith(".csv"):
        return read_csv(spark, path, n_sites)
    if not path.endswith(".parquet"):
        raise ValueError(f"{path}: neither .parquet nor .csv")
    df = spark.read.parquet(path)
    for k, n in enumerate(sector or []):
        df = df.where(F.col(f"s{k}") == n)
    return df.select(*names(n_sites))


def write_values(spark: SparkSession, path: str, **values) -> None:
    """Named numbers and texts as one row; a complex number is a struct of re and im."""
    kinds = {int: "bigint", float: "double", str: "string", complex: "struct<re:double,im:double>"}
    row = tuple((v.real, v.imag) if isinstance(v, complex) else v for v in values.values())
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)


def manifest(states: DataFrame, by: list[str]) -> DataFrame:
    """Rows and files of each sector, from the files read."""
    return states.withColumn("file", F.input_file_name()).groupBy(*by).agg(F.count("*").alias("size"), F.sort_array(F.collect_set("file")).alias("shards"))


def write_matrix_market(triplets: DataFrame, size: int, path: str) -> None:
    """row, col (from 1) and val in a coordinate text. The header is a file that sorts first."""
    n = triplets.count()
    head = triplets.sparkSession.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{size} {size} {n}",)], "value string").coalesce(1)
    body = triplets.select(F.concat_ws(" ", "row", "col", F.format_string("%.17g", "val")).alias("value"))
    head.write.mode("overwrite").text(f"{path}/0-head")
    body.write.mode("overwrite").text(f"{path}/1-body")


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.trim("value"), r"\s+")
    body = spark.read.text(f"{path}/1-body").where(F.length(F.trim("value")) > 0)
    return body.select(parts[0].cast("bigint").alias("row"), parts[1].cast("bigint").alias("col"), parts[2].cast("double").alias("val"))


def path_parameters(df: DataFrame, path_col: str = "path") -> DataFrame:
    """df with Jpm, Bx, By, Bz and sector as a result's path states them, null where it doesn't."""
    number = r"([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"
    cols = {}
    for name in ("Jpm", "Bx", "By", "Bz"):
        found = F.regexp_extract(path_col, f"{name}={number}", 1)
        cols[name] = F.when(found != "", found.cast("double"))
    sector = F.regexp_extract(path_col, r"_s(\d+(?:\.\d+)*)", 1)
    cols["sector"] = F.when(sector != "", sector)
    return df.withColumns(cols)


def without_output(inputs: DataFrame, outputs: DataFrame, key: str = "path") -> DataFrame:
    """Inputs that no output names yet."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")
