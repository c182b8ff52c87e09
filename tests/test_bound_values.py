"""A rule of many steps stays in proportion to its steps."""

from pyspark.sql import functions as F

def test_a_bound_value_is_worked_out_once(spark):
    from helixframe.functions import rules

    plan = spark.range(1).select(rules.surname(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") < 10


def test_regions_are_never_sent_whole(spark, tmp_path):
    from helixframe.operators import regions

    spark.range(50).select(F.lit(1).alias("contig"), F.col("id").alias("region"), (F.col("id") * 1000).alias("lo"), (F.col("id") * 1000 + 500).alias("hi")).write.parquet(f"{tmp_path}/regions")
    rows = spark.range(80).select(F.lit(1).alias("contig"), F.col("id"), (F.col("id") * 700).alias("s"), (F.col("id") * 700 + 10).alias("e"))
    got = regions.rows_in_regions(rows, spark.read.parquet(f"{tmp_path}/regions"), "contig", "s", "e")
    assert sorted((r.id, r.region) for r in got.collect()) == [(i, k) for i in range(80) for k in range(50) if i * 700 <= k * 1000 + 500 and i * 700 + 10 >= k * 1000]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
