from pyspark.sql import functions as F

from tickloom import queries as Q

DIR = "/root/testdata/sf0.001"


def test_tasks_that_group_by_run_stay_small(spark, monkeypatch):
    """However many line items there are, a task groups about TASK_LINES of them, and a run lies in one task."""
    lines = spark.read.parquet(f"{DIR}/lineitem.parquet")
    n = lines.count()
    monkeypatch.setattr(Q, "TASK_LINES", n // 20)
    values = Q._tracking(spark, DIR).metrics.withColumn("task", F.spark_partition_id())
    assert values.groupBy("run_id").agg(F.count_distinct("task").alias("tasks")).where("tasks > 1").count() == 0
    assert max(r["count"] for r in values.groupBy("task").count().collect()) < 3 * (n // 20)
