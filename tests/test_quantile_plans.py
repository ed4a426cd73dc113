"""Values that compress well lie in small files; that must not make the driver hold them."""

from pyspark.sql import functions as F

from paceline.functions.quantiles import exact_quantiles


def test_values_are_never_broadcast(spark):
    rows = spark.range(40_000).select((F.col("id") % 2).cast("double").alias("x"), F.lit(1.0).alias("y"))
    found = exact_quantiles(rows, [], ["x", "y"], [0.5])
    assert sorted((r["variable"], r["n"], r["q"]) for r in found.collect()) == [("x", 40_000, [0.5]), ("y", 40_000, [1.0])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins and all("rightHint=(strategy=broadcast)" in line for line in joins)
