"""The corpus pipeline: five stages over documents, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinmill.llm import decontam, linededup, mixing, quality, similar
from spinmill.llm.common import passing, scratch, settled, sized, table
from spinmill.llm.queries import trusted_ids


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged = quality.quality_rules(docs, trusted_ids(spark, sf_dir))
    return judged.where("kept").select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated lines; those left without a word go."""
    text = linededup.line_dedup(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return text.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def without(docs: DataFrame, ids: DataFrame, by: str = "doc_id") -> DataFrame:
    """docs whose `by` isn't among ids; a null is an id like another. Few ids are broadcast, so that docs stay in place."""
    ids = ids.select(F.col(by).alias("gone")).distinct()
    return docs.join(sized(ids, ids.count()), docs[by].eqNullSafe(ids["gone"]), "left_anti")


def numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column more, and its name: what tells each row from any other, the same whenever it is read.

    For a table of files, a file's hash and the place in it; anything else is written with numbers first.
    """
    name = "row"
    while name in docs.columns:
        name += "_"
    if "_metadata" not in docs.columns and docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias(name)), name
    path = scratch(spark, "rows")
    docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("r"))).write.parquet(path)
    return spark.read.parquet(path), name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near-duplicates: five-word shingles, Jaccard similarity 0.8 or more.

    First by doc_id, nulls last; of equal ids, the first as written.
    """
    rows, row = numbered(spark, docs)
    path = scratch(spark, "copies")
    with passing(spark):
        groups = rows.select(F.col(row).alias("row"), "doc_id").join(similar.similar_groups(rows.select(F.col(row).alias("row"), "text"), "row"), "row")
        groups = settled(groups)
        first = groups.groupBy("group").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("x")).select("x.row")
        groups.join(first, "row", "left_anti").select("row").write.parquet(path)
    return without(rows, spark.read.parquet(path).withColumnRenamed("row", row), row).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark, each judged by itself, whatever its doc_id."""
    rows, row = numbered(spark, docs)
    path = scratch(spark, "hits")
    with passing(spark):
        found = decontam.contamination(rows.select(F.col(row).alias("row"), "text"), table(spark, sf_dir, "benchmark"), "row", slop=None)
        found.where("n_hit > 0").select("row").write.parquet(path)
    return without(rows, spark.read.parquet(path).withColumnRenamed("row", row), row).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often."""
    return mixing.mix(docs).where("repeats > 0").select("doc_id", "source", "size", "target", "repeats", "taken")


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", dedup_lines),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mix", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that its predecessor kept, from documents on."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs


#: The stages are hash-based searches over whole tables; they are held against brute force in tests/llm instead.
ORACLE_SQL = None
