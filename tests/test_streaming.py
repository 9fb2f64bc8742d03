from pyspark.sql import functions as F

from spinmill.operators.sectors import histogram
from spinmill.streaming.shards import read_shards, sector_counts


def test_counts_follow_shards(spark, tmp_path):
    path, masks = str(tmp_path / "shards"), [0x0F, 0xF0]
    for k in range(3):
        spark.range(50 * k, 50 * k + 50).select(F.col("id").alias("lo")).write.mode("append").parquet(path)
    q = sector_counts(read_shards(spark, path, 8, files_at_once=2), masks, 8).writeStream.outputMode("complete").format("memory").queryName("sector_counts").start()
    q.processAllAvailable()
    q.stop()
    want = histogram(spark.range(150).select(F.col("id").alias("lo")), masks, 8)
    assert sorted(map(tuple, spark.table("sector_counts").collect())) == sorted(map(tuple, want.collect()))
