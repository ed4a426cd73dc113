"""Daily roll-up, resolution audit and reconciliation of two sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.columns import (
    activity_columns, day_floor, is_anomaly, measure_columns, row_sum, sum_or_zero,
)
from paceline.functions.quantiles import exact_medians, exact_quantiles
from paceline.model import MEASURES, UNLABELLED, ResolutionBands

HOURLY, DAILY, DAILY_ON_HOURLY_SCALE, UNDETERMINED = "hourly", "daily", "daily on hourly scale", "undetermined"


def _dated(df: DataFrame) -> DataFrame:
    return df.where(F.col("ts").isNotNull() & F.col("entity_id").isNotNull())


def modal_label(label: str = "anomaly_label"):
    """Aggregate: most frequent anomaly label, tie to the alphabetically first, else "unlabelled"."""
    return F.coalesce(F.mode(F.when(is_anomaly(label), F.col(label)), True), F.lit(UNLABELLED))


def daily_aggregates(df: DataFrame) -> list[Column]:
    """Sums, modal label and anomaly hours of an entity-day."""
    aggs = [F.count("*").alias("n_source_rows")] + [sum_or_zero(c).alias(c) for c in measure_columns(df)]
    if "anomaly_label" in df.columns:
        aggs += [modal_label().alias("anomaly_label"), F.count_if(is_anomaly("anomaly_label")).alias("anomaly_hours")]
    return aggs


def rollup_daily(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums per entity and calendar day with modal label and anomaly hours: one aggregation."""
    work = _dated(df).withColumn("ts", day_floor("ts"))
    grouped = work.withColumnRenamed("ts", "day").groupBy(*by, "entity_id", "day")
    return grouped.agg(*daily_aggregates(df)).withColumnRenamed("day", "ts")


def audit_rollup(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Records and sums per entity-day plus the sum of the five behaviours."""
    acts = activity_columns(df)
    sums = [sum_or_zero(c).alias(f"sum_{c}") for c in measure_columns(df)]
    out = (
        _dated(df).withColumn("day", day_floor("ts")).groupBy(*by, "entity_id", "day")
        .agg(F.count("*").alias("n_records"), *sums)
    )
    return out.withColumn("sum_activity", row_sum([f"sum_{c}" for c in acts]))


def classify_resolution(audited: DataFrame, by: Sequence[str] = ("dataset",), bands: ResolutionBands = ResolutionBands()) -> DataFrame:
    """Which time resolution each source really has, from its audit roll-up.

    Sources are few, days are many: medians come from the bracketed quantiles.
    """
    by = list(by)
    long = exact_quantiles(audited, by, ["n_records", "sum_activity"], [0.5])
    is_sum = F.col("variable") == "sum_activity"
    wide = long.groupBy(*by).agg(
        F.max(F.when(~is_sum, F.col("q")[0])).alias("median_records"),
        F.max(F.when(is_sum, F.col("mean"))).alias("mean_sum_activity"),
        F.max(F.when(is_sum, F.col("q")[0])).alias("median_sum_activity"),
    )
    total = F.col("median_sum_activity")
    return wide.withColumn(
        "classification",
        F.when(F.col("median_records") >= bands.min_hourly_records, HOURLY)
        .when(total.between(*bands.daily), DAILY)
        .when(total.between(*bands.hourly_scale), DAILY_ON_HOURLY_SCALE)
        .otherwise(UNDETERMINED),
    )


def _joined(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    shared = [c for c in MEASURES if f"sum_{c}" in a.columns and f"sum_{c}" in b.columns]
    left = a.select(*keys, *[F.col(f"sum_{c}").alias(f"a_{c}") for c in shared])
    right = b.select(*keys, *[F.col(f"sum_{c}").alias(f"b_{c}") for c in shared])
    return left.join(right, list(keys), "inner"), shared


def reconcile_rollups(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("entity_id", "day")) -> DataFrame:
    """Absolute differences of two audit roll-ups per variable over their common entity-days."""
    pairs, shared = _joined(a, b, keys)
    diffs = pairs.select(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(c) for c in shared])
    return exact_quantiles(diffs, [], shared, [0.5]).select(
        "variable", F.col("mean").alias("mean_diff"), F.col("max").alias("max_diff"),
        F.col("q")[0].alias("median_diff"), F.col("n").alias("n_pairs"),
    )


def reconcile_coverage(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("entity_id", "day")) -> DataFrame:
    """Entity-days in both roll-ups and on one side only: one tagged union, one aggregation, no join."""
    tagged = a.select(*keys, F.lit(1).alias("s")).unionByName(b.select(*keys, F.lit(2).alias("s")))
    sides = tagged.groupBy(*keys).agg(F.max(F.col("s") == 1).alias("in_a"), F.max(F.col("s") == 2).alias("in_b"))
    return sides.agg(
        F.count_if(F.col("in_a") & F.col("in_b")).alias("n_common"),
        F.count_if(F.col("in_a") & ~F.col("in_b")).alias("n_only_a"),
        F.count_if(~F.col("in_a") & F.col("in_b")).alias("n_only_b"),
    )


def reconcile_verdict(differences: DataFrame, max_limit: float = 5.0, mean_limit: float = 1.0) -> DataFrame:
    worst = differences.agg(
        F.max("max_diff").alias("worst_max_diff"), F.max("mean_diff").alias("worst_mean_diff"),
        F.count("*").alias("n_variables"),
    )
    return worst.withColumn(
        "verdict",
        F.when(F.col("worst_max_diff").isNull(), "not comparable")
        .when((F.col("worst_max_diff") <= max_limit) & (F.col("worst_mean_diff") <= mean_limit), "coherent")
        .otherwise("different"),
    )


def rollup_report(daily: DataFrame, by: Sequence[str] = (), **provenance: str) -> DataFrame:
    """Size and level of a roll-up: rows, entities, medians, plus literal provenance columns."""
    by = list(by)
    work = daily.withColumn("sum_activity", row_sum(activity_columns(daily)))
    base = work.groupBy(*by).agg(
        F.count("*").alias("rows"), F.countDistinct("entity_id").alias("entities"),
        F.avg("sum_activity").alias("mean_sum_activity"),
    )
    cols = [c for c in ("n_source_rows", "sum_activity") if c in work.columns]
    medians = exact_medians(work, by, cols)
    if by:
        cond = F.lit(True)
        for k in by:
            cond = cond & base[k].eqNullSafe(medians[k])
        out = base.join(medians, cond, "left").select(
            *[base[c] for c in base.columns], *[medians[f"median_{c}"] for c in cols]
        )
    else:
        picked = medians.select(F.struct(*medians.columns).alias("m")).scalar()
        out = base.withColumn("__m", picked).select(*base.columns, *[F.col(f"__m.median_{c}") for c in cols])
    return out.withColumns({k: F.lit(v) for k, v in provenance.items()}) if provenance else out
