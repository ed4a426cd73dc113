"""Edge cases on tiny frames with answers worked out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paceline.functions.quantiles import exact_quantiles
from paceline.model import SourceSpec
from paceline.operators import cleaning, cluster, eda, events, features, interpret, master, matrix, profile, rollup
from paceline.plans import slices
from paceline.sources import sinks, tables

SCHEMA = "entity_id string, ts timestamp_ntz, eat double, rest double, anomaly_label string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def t(day, hour=0, month=1):
    return datetime(2024, month, day, hour)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_one_row_has_no_spread(spark):
    r = one(features.extract_features(frame(spark, [("a", t(1), 5.0, 0.0, "unlabelled")]), "weekly"))
    assert r.eat_std is None and r.eat_iqr == 0 and r.eat_cv is None and r.n_records == 1


@pytest.mark.parametrize("hot", [None, 2, 1_000])
def test_quantiles_and_hot_groups(spark, hot):
    rows = [("a", t(1, h), v, None, "unlabelled") for h, v in enumerate([1.0, 2.0, 4.0, 9.0])] + [(None, t(1), 3.0, 1.0, "Other")]
    out = {r.entity_id: r for r in features.extract_features(frame(spark, rows), "weekly", hot_group_rows=hot).collect()}
    a = out["a"]
    assert (a.eat_p10, a.eat_iqr, a.eat_median) == (pytest.approx(1.3), pytest.approx(3.5), 3.0)
    assert a.rest_mean is None and a.n_missing == 4 and a.ratio_eat == 1.0
    assert out[None].n_records == 1 and out[None].n_missing == 1 and out[None].anomaly_rate == 1.0


def test_zero_mean_and_no_activity(spark):
    rows = [("a", t(1), -1.0, None, "x"), ("a", t(2), 1.0, None, "x")]
    r = one(features.extract_features(frame(spark, rows), "weekly"))
    assert r.eat_cv is None and r.ratio_eat is None and r.ratio_rest is None


def test_window_edges(spark):
    df = frame(spark, [("a", t(7, 23), 1.0, 1.0, ""), ("a", t(8), 1.0, 1.0, "")])
    weeks = {r.window_start for r in features.extract_features(df, "weekly").collect()}
    assert weeks == {t(1), t(8)}
    df = frame(spark, [("a", t(31), 1.0, 1.0, ""), ("a", t(1, month=2), 1.0, 1.0, "")])
    assert features.extract_features(df, "monthly").count() == 2
    with pytest.raises(ValueError):
        features.extract_features(df, "yearly")
    with pytest.raises(ValueError):
        features.extract_features(df.drop("ts"), "weekly")


def test_label_ties_and_dropped_entities(spark):
    labels = ["A", "B", "B", "A", "No anomaly", None]
    rows = [("a", t(1, h), 1.0, None, x) for h, x in enumerate(labels)] + [(None, t(1), 1.0, 1.0, "A")]
    r = one(rollup.rollup_daily(frame(spark, rows)))
    assert (r.anomaly_label, r.anomaly_hours, r.n_source_rows, r.eat, r.rest) == ("A", 4, 6, 6.0, 0.0)


def test_lenient_cleaning(spark):
    rows = [("a", "2024-01-01T01:00:00+01:00", "x", "1.5x", None), ("a", "not a date", "y", "NaN", " L "), ("a", "not a date", "y", "NaN", " L "),
            ("a", "2024-01-02 03:04:05", "z", "1.5d", "L")]
    raw = frame(spark, rows, "Cow_id string, Date string, Time string, ` Eat\n` string, Anomaly_Label string")
    out = cleaning.clean(raw).orderBy("Time").collect()
    assert [r.ts for r in out] == [t(1), None, datetime(2024, 1, 2, 3, 4, 5)]
    assert [r.eat for r in out] == [None, None, None]
    assert [r.anomaly_label for r in out] == ["unlabelled", "L", "L"]
    assert cleaning.drop_without_time(cleaning.clean(raw)).count() == 2


def test_select_rows_null_is_no_match(spark):
    df = frame(spark, [("Horario_1",), ("diario",), (None,)], "dataset string")
    assert cleaning.select_rows(df, "dataset", contains="horario").count() == 1
    assert cleaning.select_rows(df, "dataset", ["diario"]).count() == 1


@pytest.mark.parametrize("per_day,level,want", [
    (24, 59.0, "hourly"), (1, 1415.0, "daily"), (1, 59.5, "daily on hourly scale"), (1, 500.0, "undetermined"),
    (1, 800.0, "daily"), (1, 1440.0, "daily"), (1, 1440.0001, "undetermined"), (1, 20.0, "daily on hourly scale"), (1, 60.0, "daily on hourly scale"),
])
def test_resolution_classes(spark, per_day, level, want):
    rows = [("a", t(d, h), level, 0.0, "") for d in (1, 2, 3) for h in range(per_day)]
    audited = rollup.audit_rollup(frame(spark, rows).withColumn("dataset", F.lit("s")), by=["dataset"])
    assert one(rollup.classify_resolution(audited)).classification == want


def test_reconciliation(spark):
    hourly = frame(spark, [("a", t(d, h), 0.5, 1.0, "") for d in (1, 2) for h in range(24)])
    daily = frame(spark, [("a", t(d), 12.0, 24.0, "") for d in (1, 2, 3)])
    a, b = rollup.audit_rollup(daily), rollup.audit_rollup(hourly)
    diffs = rollup.reconcile_rollups(a, b)
    assert {(r.variable, r.max_diff, r.n_pairs) for r in diffs.collect()} == {("eat", 0.0, 2), ("rest", 0.0, 2)}
    assert tuple(one(rollup.reconcile_coverage(a, b))) == (2, 1, 0)
    assert one(rollup.reconcile_verdict(diffs)).verdict == "coherent"
    assert one(rollup.reconcile_verdict(diffs.where("false"))).verdict == "not comparable"


def test_event_labels(spark):
    act = frame(spark, [("a", t(d), 1.0, 1.0, None) for d in (1, 2, 3)])
    log = frame(spark, [("a", t(1), "HEAT"), ("a", t(1), "ANOMALY"), ("a", t(2), "BIRTH"), ("a", t(20), "HEAT")],
                "entity_id string, event_date timestamp_ntz, event_type string")
    got = [r.anomaly_label for r in events.label_from_events(act, log).orderBy("ts").collect()]
    assert got == ["ANOMALY", "unlabelled", "unlabelled"]
    late = log.where("event_date > '2024-01-10'")
    assert {r.anomaly_label for r in events.label_from_events(act, late).collect()} == {None}
    assert one(events.temporal_overlap(act, late)).temporal_overlap is False
    assert one(events.temporal_overlap(act.where("false"), log)).temporal_overlap is False


def test_master_first_table_wins(spark):
    keys = "dataset string, system string, entity_id string, window_start timestamp_ntz"
    a = frame(spark, [("d", "s", "e", t(1), 1.0)], keys + ", x double")
    b = frame(spark, [("d", "s", "e", t(1), 2.0), ("d", "s", "f", t(1), 3.0)], keys + ", y double")
    out = {r.entity_id: (r.x, r.y) for r in master.master_table([a, b]).collect()}
    assert out == {"e": (1.0, None), "f": (None, 3.0)}
    with pytest.raises(ValueError, match="entity_id"):
        master.master_table([a.drop("entity_id")])


def test_eta_squared(spark):
    def eta(rows):
        got = matrix.eta_squared(frame(spark, rows, "g string, v double"), "v", "g")
        return one(got).eta_squared

    assert eta([("a", 1.0), ("a", 1.0), ("b", 3.0), ("b", 3.0)]) == pytest.approx(1.0)
    assert eta([("a", 1.0), ("a", 3.0)]) == pytest.approx(0.0)
    assert eta([("a", 2.0), ("b", 2.0)]) is None


def test_bracketed_quantiles_beyond_small_groups(spark):
    df = spark.range(60_001).select(F.lit("s").alias("k"), F.pow(F.col("id") % 60_001, F.lit(1.5)).alias("x"))
    q = one(exact_quantiles(df, ["k"], ["x"], [0.0, 0.1, 0.5, 0.77777, 1.0])).q
    want = df.agg(F.percentile("x", [0.0, 0.1, 0.5, 0.77777, 1.0])).first()[0]
    assert q == pytest.approx(want, rel=1e-12)


def test_skewed_values_keep_exact_quantiles(spark):
    df = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.rand(1) * 10).alias("x"))
    df = df.cache()
    q = one(exact_quantiles(df, [], ["x"], [0.25, 0.5, 0.7])).q
    assert q == pytest.approx(df.agg(F.percentile("x", [0.25, 0.5, 0.7])).first()[0], abs=1e-9)


def test_scaling_drops_empty_columns(spark):
    df = frame(spark, [(1, 1.0, None, 5.0), (2, None, None, 5.0), (3, 4.0, None, 5.0)], "id int, a double, b double, c double")
    model = matrix.fit_scale(df, ["a", "b", "c"])
    assert model.dropped == ("b",)
    rows = model.standardize(df).orderBy("id").collect()
    assert sum(r.a for r in rows) == pytest.approx(0) and sum(r.a**2 for r in rows) == pytest.approx(3)
    assert {r.c for r in rows} == {0.0} and "b" not in rows[0]


def test_feature_sets(spark):
    cols = [f"{m}_{s}" for m in ("ruminate", "eat", "graze", "rest", "walk", "steps") for s in ("mean", "std", "min", "max", "median", "p10", "p90", "iqr", "cv")]
    cols += [f"ratio_{a}" for a in ("ruminate", "eat", "graze", "rest", "walk")]
    df = spark.range(1).select(F.lit("d").alias("dataset"), F.lit(1).alias("n_records"), *[F.lit(0.0).alias(c) for c in cols])
    assert [len(matrix.feature_columns(df, s)) for s in ("absolute", "ratios", "absolute_no_count")] == [54, 5, 45]
    with pytest.raises(ValueError):
        matrix.feature_columns(df, "all")


def test_frequency_and_histogram_of_constants(spark):
    df = frame(spark, [("a", t(1), 2.0, 1.0, "")])
    assert one(profile.infer_frequency(df)).frequency == "unknown"
    df = frame(spark, [("a", t(1, h), 2.0, 1.0, "") for h in range(4)])
    assert one(profile.infer_frequency(df)).frequency == "hourly"
    bins = eda.histogram(df, ["eat"]).collect()
    assert len(bins) == 30 and sum(r.n for r in bins) == 4


# published tables: verdict rules are pure functions of them


def test_published_relation(spark):
    rows = [(0, "extensive", 65), (0, "intensive", 3398), (1, "extensive", 245), (1, "intensive", 6)]
    r = one(interpret.relation_strength(frame(spark, rows, "cluster int, category string, n long")))
    assert r.relation == "moderate" and r.min_share == pytest.approx(0.790, abs=5e-4)
    r = one(interpret.relation_strength(frame(spark, rows[:1], "cluster int, category string, n long")))
    assert r.relation == "not evaluable" and r.min_share is None


def test_published_degenerate_and_eta(spark):
    rows = [("dbscan", 197, 1209), ("dbscan", 3, 246), ("kmeans", 20, 0)]
    flags = interpret.degenerate_flag(frame(spark, rows, "algorithm string, n_clusters int, n_noise int"), 3714).collect()
    assert [r.degenerate for r in flags] == [True, False, False]
    rows = [(2, 0.549, 0.563), (1, 0.0, 0.007), (2, 0.2, 0.5), (2, 0.5, 0.2)]
    verdicts = interpret.eta_verdict(frame(spark, rows, "n_systems int, eta_system double, eta_dataset double")).collect()
    assert [r.verdict for r in verdicts] == ["confounded", "not comparable, low", "dataset-driven", "system-driven"]


def test_best_config_ignores_unscored(spark):
    rows = [("a", "k=2", 0.5), ("b", "k=2", 0.5), ("c", "k=2", None)]
    df = frame(spark, rows, "algorithm string, params string, silhouette double")
    assert one(cluster.best_config(df)).algorithm == "a"
    assert cluster.best_config(df.where("silhouette IS NULL")).count() == 0


def test_base_variables(spark):
    df = frame(spark, [("eat_mean", 0.5), ("eat_p90", -0.6), ("ratio_graze", 0.4)], "variable string, loading double")
    r = one(interpret.loading_summary(df))
    assert (r.base_variables, r.top_variable, r.sign) == (["eat", "graze"], "eat_p90", "negative")


def test_sources_and_slice_sink(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    spark.createDataFrame([("e", "2024-01-01 00:00:00", "3.5"), ("e", "2024-01-01 00:00:00", "3.5")], "Cow_id string, Date string, Eat string") \
        .coalesce(1).write.option("header", True).csv(path)
    spec = SourceSpec(path, "d", "s", "hourly", "native")
    got = tables.read_activities(spark, [spec, SourceSpec(str(tmp_path / "none.csv"), "x", "y")], skip_missing=True)
    assert one(got).eat == 3.5 and one(got).dataset == "d"
    feats = slices.branch_features(spark, [spec], uncovered=["d"])
    assert one(feats).resolution == "hourly"
    with pytest.raises(ValueError, match="unsupported format"):
        tables.read_table(spark, "x.xlsx")
    out = str(tmp_path / "slices")
    assert slices.consolidate(spark, out) is None
    df = frame(spark, [("A", "ratios", 1.0), ("B", "ratios", 2.0)], "branch string, feature_set string, v double")
    sinks.write_slice(df, out)
    sinks.write_slice(df.where("branch = 'A'").withColumn("v", F.lit(9.0)), out)
    assert {(r.branch, r.v) for r in slices.consolidate(spark, out).collect()} == {("A", 9.0), ("B", 2.0)}
    sinks.write_summary(master.master_report(feats), str(tmp_path / "report"))
    assert one(spark.read.json(str(tmp_path / "report"))).rows == 1


def test_purity_leaves_rows_without_entity_out(spark):
    rows = [("a", 0), ("a", 0), ("a", 1), (None, 2), (None, 1)]
    got = interpret.entity_purity(frame(spark, rows, "entity_id string, cluster int")).collect()
    assert [(r.entity_id, r.dominant_cluster, r.n_windows) for r in got] == [("a", 0, 3)]


def test_row_keys_do_not_meet(spark):
    names = [(None, "s"), ("", "s"), ("a|b", "s"), ("a", "b|s"), ("\\", "s"), ("a\\", "|s"), ("a\\|", "s")]
    rows = [(d, x, "e", t(1)) for d, x in names]
    keys = slices.keyed(frame(spark, rows, "dataset string, system string, entity_id string, window_start timestamp_ntz"))
    assert keys.select("id").distinct().count() == len(names)


def test_zoned_times_become_utc_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        raw = spark.sql("SELECT 'a' AS entity_id, timestamp'2024-01-01 23:30:00 UTC' AS ts, 1.0D AS eat")
        assert cleaning.clean(raw).select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("t")).first()["t"] == "2024-01-01 23:30"
        log = raw.select("entity_id", F.col("ts").alias("event_date"), F.lit("heat").alias("event_type"))
        assert cleaning.normalise_events(log).first()["event_date"] == datetime(2024, 1, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_names_with_blanks(spark):
    df = frame(spark, [(1.0, 2.0), (2.0, 4.0), (3.0, 7.0)], "`a b` double, `c-d` double")
    assert eda.histogram(df, ["a b"], bins=2).agg(F.sum("n")).first()[0] == 3
    assert eda.correlation_matrix(df, ["a b", "c-d"]).count() == 4
    assert matrix.standardize(df, ["a b"]).columns == ["a b", "c-d"]


def test_scratch_leaves_only_what_is_kept(spark):
    import os

    from paceline.session import cut, keep, scratch, shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = len(os.listdir(folder))
    points = frame(spark, [(i, [float(i % 7), float(i % 3)]) for i in range(40)], "id long, features array<double>")
    with scratch(spark):
        cut(points)
        kept = keep(points)
    assert kept.count() == 40 and len(os.listdir(folder)) == before + 1
    cluster.evaluate_grid(points, algorithms=("kmeans", "agglomerative"), ks=(2, 50), restarts=1)
    assert len(os.listdir(folder)) == before + 3  # metrics and labels


def test_settings_with_more_clusters_than_rows_stay_unscored(spark):
    points = frame(spark, [(i, [float(i), float(i % 2)]) for i in range(6)], "id long, features array<double>")
    got = {(r.algorithm, r.params): r.silhouette for r in cluster.evaluate_grid(points, algorithms=("kmeans", "agglomerative", "gmm"), ks=(2, 9), restarts=1).metrics.collect()}
    assert {k for k, v in got.items() if v is None} == {("kmeans", "k=9"), ("agglomerative", "k=9, micro=512"), ("gmm", "k=9")}
    assert len(got) == 6


def test_one_group_is_ordered_by_many_tasks(spark):
    """The values of one group, all distinct, lie in several range partitions of the running count."""
    from paceline.functions.quantiles import _running_count

    counted = spark.range(0, 50_000, 1, 8).select(F.lit("g").alias("k"), F.lit(0).alias("i"), (F.col("id") * 7919 % 50_000).cast("double").alias("v"), F.lit(1).cast("long").alias("c"))
    out = _running_count(counted, ["k", "i"])
    assert out.where("upto <> v + 1").count() == 0
    assert exact_quantiles(counted, ["k"], ["v"], [0.5]).first()["q"][0] == 24_999.5


def test_collinear_columns_do_not_break_the_mixture(spark):
    from paceline.operators.centres import kmeans_fits, mixture_fits

    rows = [(i, [float(i % 10), 2.0 * (i % 10), 5.0 * (i // 50)]) for i in range(100)]
    points = frame(spark, rows, "id long, features array<double>")
    fit = mixture_fits(points, kmeans_fits(points, [2], 2, 1))[2]
    assert all(b >= a - 1e-6 for a, b in zip(fit.history, fit.history[1:])) and len(fit.history) > 1


def test_gaps_of_one_crowded_hour_are_dealt_to_many_partitions(spark):
    """All times of a source in one hour: neighbours across partitions are stitched."""
    import datetime as dt

    from paceline.operators.profile import time_gaps

    start = dt.datetime(2024, 5, 1)
    rows = [("a", start + dt.timedelta(milliseconds=7 * i * i % 3_599_000)) for i in range(1500)] + [("b", start + dt.timedelta(hours=5 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "source string, ts timestamp_ntz")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((r["source"], round(r["gap_hours"] * 3_600_000)) for r in time_gaps(df, ["source"]).collect())
        parts = df.distinct().repartitionByRange("source", "ts").selectExpr("spark_partition_id() AS p").distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = []
    for s in "ab":
        times = sorted({t for x, t in rows if x == s})
        want += [(s, round((b - a).total_seconds() * 1000)) for a, b in zip(times, times[1:])]
    assert got == sorted(want) and parts > 2
