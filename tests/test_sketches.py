"""Day tables of sketches: merging, plans, rank errors."""

import datetime as dt
import random

import numpy as np

from paceline.operators import sketches
from paceline.session import cut

START = dt.datetime(2024, 1, 1)
SCHEMA = "dataset string, system string, entity_id string, ts timestamp_ntz, eat double, rest double, anomaly_label string"


def table(spark, n, seed=0):
    rng = random.Random(seed)
    rows = [
        (rng.choice(["x", "y"]), "s", f"e{rng.randrange(3)}", START + dt.timedelta(hours=rng.randrange(24 * 60)), rng.lognormvariate(0, 2), None if rng.random() < 0.2 else float(rng.randrange(4)), None)
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_months_come_from_the_day_table(spark):
    days = cut(sketches.day_sketches(table(spark, 300), by=["dataset", "system"]))
    months = sketches.features_from_days(days, "monthly", by=["dataset", "system"])
    assert months._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(months.inputFiles()) == sorted(days.inputFiles())


def test_rank_error_of_large_groups(spark):
    rows = table(spark, 60_000)
    days = cut(sketches.day_sketches(rows, by=["dataset"], entities=False))
    merged = cut(sketches.merge_days(days, "monthly"))
    for c in ("eat", "rest"):
        errors = [r["error"] for r in sketches.rank_errors(rows, merged, "monthly", ["dataset"], c).collect()]
        assert len(errors) == 2 * 2 * 5 and max(errors) <= 0.01
    frame = rows.toPandas()
    for r in merged.collect():
        mine = frame[(frame["dataset"] == r["dataset"]) & (frame["ts"].dt.month == r["window_start"].month)]["eat"]
        assert r["eat_n"] == len(mine) and r["eat_min"] == mine.min() and r["eat_max"] == mine.max()
        assert np.isclose(r["eat_sum"], mine.sum()) and np.isclose(r["eat_m2"], mine.var(ddof=0) * len(mine))


def test_the_measured_error_sees_a_wrong_quantile(spark):
    rows = table(spark, 5_000)
    days = cut(sketches.day_sketches(rows.withColumn("eat", rows["eat"] * 2), by=["dataset"], entities=False))
    errors = [r["error"] for r in sketches.rank_errors(rows, sketches.merge_days(days, "monthly"), "monthly", ["dataset"], "eat").collect()]
    assert max(errors) > 0.05


def test_new_days_are_appended(spark):
    rows = table(spark, 400)
    cutoff = START + dt.timedelta(days=25)
    whole = sketches.day_sketches(rows, by=["dataset"])
    parts = sketches.day_sketches(rows.where(rows["ts"] < cutoff), by=["dataset"]).unionByName(sketches.day_sketches(rows.where(rows["ts"] >= cutoff), by=["dataset"]))
    a, b = ([[round(v, 9) if isinstance(v, float) else v for v in r] for r in sketches.features_from_days(d, "monthly", by=["dataset"]).orderBy("dataset", "entity_id", "window_start").collect()] for d in (whole, parts))
    assert a == b and len(a) == 12


def test_groups_without_values(spark):
    rows = spark.createDataFrame([("x", "s", None, START, None, None, None), ("x", "s", "e", None, 1.0, 1.0, None)], SCHEMA)
    (r,) = sketches.features_from_days(sketches.day_sketches(rows, by=["dataset"]), "weekly", by=["dataset"]).collect()
    assert r["n_records"] == 1 and r["eat_median"] is None and r["eat_mean"] is None and r["ratio_eat"] is None
