"""Places of two-word states: in ranges rather than in one task, and as the SQL has them where keys are null."""

import pytest
from pyspark.sql import functions as F

from spinmill.operators import sectors
from spinmill.plans import catalog, more  # noqa: F401

COLUMNS = ["hi", "lo", "place", "below", "low40"]


def test_no_task_numbers_all_states(spark, sf):
    got = catalog.QUERIES["wide_order"](spark, sf)
    assert "row_number" not in got._jdf.queryExecution().optimizedPlan().toString()
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < sum(sizes) / 2


@pytest.mark.parametrize("rows", [[], [(1, 2, 3), (None, 2, 3), (7, None, 1), (None, None, None), (7, 7, 1), (7, 7, 1), (5, 5, None)]])
def test_nulls_and_no_rows(spark, tmp_path, rows):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES["wide_order"])
    got = catalog.QUERIES["wide_order"](spark, str(tmp_path)).select(*want.columns).collect()
    assert want.columns == COLUMNS and sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_unsigned_places(spark):
    words = [(lo, hi) for hi in (0, 1, -1, -(1 << 63)) for lo in (0, 5, -1, -(1 << 63))]
    got = sectors.numbered(spark.createDataFrame(words, "lo bigint, hi bigint"), 128).orderBy("place").collect()
    order = sorted(words, key=lambda w: (w[1] % (1 << 64), w[0] % (1 << 64)))
    assert [(r["lo"], r["hi"], r["place"]) for r in got] == [(*w, k) for k, w in enumerate(order, 1)]
