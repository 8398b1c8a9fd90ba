from pyspark.sql import functions as F
from stopgrid.llm import common as C


def test_maybe_in_loses_none(spark):
    rows = spark.range(20000).select(F.xxhash64("id").alias("h"), "id")
    for n in (0, 1, 700):
        keys = rows.where(F.col("id") < n).select("h")
        got = {r["id"] for r in C.maybe_in(rows, F.col("h"), keys, n).collect()}
        assert set(range(n)) <= got and len(got) < n + 20000 // 10


def test_spare_names():
    assert C.spare(["a", "_D", "_d_"], "_d", "_r", "_r") == ["_d__", "_r", "_r_"]


def test_trimmed_passes_every_batch_on(spark):
    from stopgrid.llm.common import trimmed

    rows = spark.range(1000, numPartitions=3)
    assert rows.mapInArrow(trimmed(lambda batches: batches), "id long").count() == 1000
    assert rows.where("id < 0").mapInArrow(trimmed(lambda batches: batches), "id long").count() == 0
