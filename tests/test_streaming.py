"""Streams of activity files: restarts, late rows, and equality with the batch operators."""

import datetime as dt
import random

from compare import difference
from paceline.operators.features import extract_features
from paceline.operators.rollup import rollup_daily
from paceline.streaming import activity as stream

SCHEMA = "entity_id string, ts timestamp_ntz, eat double, rest double, steps double, anomaly_label string"
START = dt.datetime(2024, 1, 1)


def records(seed, n=400, days=20):
    rng = random.Random(seed)
    some = lambda x: None if rng.random() < 0.1 else x
    return [
        (rng.choice(["a", "b", None]), START + dt.timedelta(hours=rng.randrange(24 * days)), some(rng.random()), some(rng.randrange(5) / 4), some(float(rng.randrange(9))),
         rng.choice([None, " Heat ", "No anomaly", "Other"]))
        for _ in range(n)
    ]


def deliver(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def closing(days):
    return [("~", START + dt.timedelta(days=days), None, None, None, None)]


def run(result, base):
    q = stream.write_stream(result, f"{base}/out", f"{base}/progress")
    q.awaitTermination()
    return q


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    rows, path = records(1), str(tmp_path / "in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in range(3):  # each start takes over state, timers and the list of files of the one before
        deliver(spark, rows[part::3] + (closing(200) if part == 2 else []), path)
        live = stream.read_activity_stream(spark, path, SCHEMA, files_per_batch=1)
        run(stream.stream_features(live, "weekly", delay="30 days"), tmp_path / "weeks")
        run(stream.stream_daily(live, delay="30 days"), tmp_path / "days")
    batch = spark.createDataFrame(rows, SCHEMA)
    for name, want in (("weeks", extract_features(batch, "weekly")), ("days", rollup_daily(batch))):
        got = spark.read.schema(want.schema).parquet(str(tmp_path / name / "out"))
        assert difference(got.select(want.columns).toPandas(), want.toPandas()) is None
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    path = str(tmp_path / "in")
    day = lambda k, n=1: [("a", START + dt.timedelta(days=k, hours=h), 1.0, 0.0, 2.0, None) for h in range(n)]
    dropped = 0
    for rows in (day(0, 3), day(1) + day(10), day(9), day(2) + day(0), closing(60)):
        deliver(spark, rows, path)
        live = stream.read_activity_stream(spark, path, SCHEMA, files_per_batch=1)
        dropped += stream.dropped_rows(run(stream.stream_daily(live, delay="2 days"), tmp_path))
    got = {r["ts"].day - 1: r["n_source_rows"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # day 2 and the fourth row of day 0 came when the watermark stood at day 8; day 9 was late, but not too late
    assert got == {0: 3, 1: 1, 9: 1, 10: 1} and dropped == 2


def test_a_window_without_values(spark, tmp_path):
    deliver(spark, [("a", START, None, None, None, None), *closing(60)], str(tmp_path / "in"))
    live = stream.read_activity_stream(spark, str(tmp_path / "in"), SCHEMA)
    run(stream.stream_features(live, "daily"), tmp_path)
    want = extract_features(spark.createDataFrame([("a", START, None, None, None, None)], SCHEMA), "daily")
    assert difference(spark.read.schema(want.schema).parquet(str(tmp_path / "out")).toPandas(), want.toPandas()) is None


def test_windows_of_every_length_equal_the_batch(spark, tmp_path):
    """Days and weeks are aggregated by the engine, without a call of Python per entity-window; months keep their rows in a processor."""
    rows, path = records(4, n=120, days=45), str(tmp_path / "in")
    deliver(spark, rows + closing(200), path)
    live = stream.read_activity_stream(spark, path, SCHEMA)
    for window in ("daily", "weekly", "monthly"):
        result = stream.stream_features(live, window, delay="30 days")
        assert ("TransformWithState" in result._jdf.queryExecution().analyzed().toString()) == (window == "monthly")
        run(result, tmp_path / window)
        want = extract_features(spark.createDataFrame(rows, SCHEMA), window)
        got = spark.read.schema(want.schema).parquet(str(tmp_path / window / "out"))
        assert difference(got.select(want.columns).toPandas(), want.toPandas()) is None
