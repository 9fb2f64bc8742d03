"""Shards of states as a stream: sector counts kept up to date while searches still write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.bits import names
from ..operators.sectors import histogram


def read_shards(spark: SparkSession, path: str, n_sites: int, *, files_at_once: int = 100) -> DataFrame:
    """States of Parquet shards as they appear; a shard is whole once its writer has committed it."""
    schema = ", ".join(f"{c} bigint" for c in names(n_sites))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def sector_counts(shards: DataFrame, masks: list[int], n_sites: int) -> DataFrame:
    """Rows by sector so far; its state is a count for each sector, not the states."""
    return histogram(shards, masks, n_sites)
