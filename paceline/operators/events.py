"""Event logs: labels for activity rows, per-entity summaries, overlap of two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.columns import activity_columns, day_floor, missing_cells, row_sum
from paceline.functions.quantiles import exact_medians
from paceline.model import UNLABELLED, MEASURES
from paceline.operators.cleaning import rescale


def _day_range(activity: DataFrame) -> Column:
    day = day_floor("ts")
    return activity.agg(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi")).alias("r")).scalar()


def events_in_activity_range(activity: DataFrame, events: DataFrame) -> DataFrame:
    """Events dated within the first and last activity day, ends included.

    The range is a scalar subquery: no join, and it reaches the scan as a filter.
    """
    kept = events.withColumn("__r", _day_range(activity))
    return kept.where(F.col("event_date").between(F.col("__r.lo"), F.col("__r.hi"))).drop("__r")


def label_from_events(activity: DataFrame, events: DataFrame) -> DataFrame:
    """Daily activity labelled from the log: ANOMALY before HEAT, other kinds ignored.

    Without any event in the activity range nothing is known, so every label is NULL.
    """
    in_range = events_in_activity_range(activity, events)
    priority = F.when(F.col("event_type") == "ANOMALY", 2).when(F.col("event_type") == "HEAT", 1).otherwise(0)
    per_day = in_range.groupBy(F.col("entity_id"), F.col("event_date").alias("__day")).agg(F.max(priority).alias("__p"))
    covered = in_range.agg(F.count("*").alias("n")).scalar()
    work = activity.drop("anomaly_label").withColumn("__day", day_floor("ts"))
    label = F.when(F.col("__p") == 2, "ANOMALY").when(F.col("__p") == 1, "HEAT").otherwise(UNLABELLED)
    return (
        work.join(per_day, ["entity_id", "__day"], "left")
        .withColumn("anomaly_label", F.when(covered > 0, label))
        .select(*work.drop("__day").columns, "anomaly_label")
    )


def daily_equivalent(raw: DataFrame, events: DataFrame, factor: float = 24.0) -> DataFrame:
    """A daily table of hourly means as daily totals, labelled from the event log."""
    work = raw.where(F.col("ts").isNotNull()).withColumn("ts", day_floor("ts"))
    return label_from_events(rescale(work, factor=factor), events)


def rescale_report(scaled: DataFrame, events: DataFrame, factor: float = 24.0, dataset: str = "daily_equivalent") -> DataFrame:
    """What was scaled and how far the event log covers it: one row."""
    columns = [c for c in MEASURES if c in scaled.columns]
    work = scaled.withColumn("sum_activity", row_sum(activity_columns(scaled)))
    in_range = events_in_activity_range(scaled, events).agg(F.count("*").alias("n")).scalar()
    ev = events.agg(
        F.struct(F.count("*").alias("n"), F.min("event_date").alias("lo"), F.max("event_date").alias("hi")).alias("s")
    ).scalar()
    median = exact_medians(work, [], ["sum_activity"]).scalar()
    out = work.agg(
        F.count("*").alias("rows"), F.countDistinct("entity_id").alias("entities"),
        F.avg("sum_activity").alias("mean_sum_activity"),
        F.min(day_floor("ts")).alias("activity_start"), F.max(day_floor("ts")).alias("activity_end"),
    )
    out = out.withColumns({
        "dataset": F.lit(dataset), "factor": F.lit(float(factor)), "scaled_columns": F.lit(",".join(columns)),
        "median_sum_activity": median, "__ev": ev, "events_in_range": in_range,
    })
    return out.select(
        "dataset", "rows", "entities", "factor", "scaled_columns", "mean_sum_activity", "median_sum_activity",
        F.col("__ev.n").alias("events_total"), "events_in_range",
        F.col("__ev.lo").alias("events_start"), F.col("__ev.hi").alias("events_end"), "activity_start", "activity_end",
        F.when(F.col("events_in_range") == 0, "no event within the activity period: labels unknown")
        .otherwise("labels derived from events within the activity period").alias("note"),
    )


def event_counts(events: DataFrame) -> DataFrame:
    """Events per kind; a missing kind is counted as its own row."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def entity_event_summary(activity: DataFrame, events: DataFrame, kinds: Sequence[str] = ("ANOMALY", "HEAT", "BIRTH")) -> DataFrame:
    """Per entity: event totals by kind, first and last date, whether activity exists."""
    kind = F.col("event_type")
    summary = events.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(
        F.count("event_type").alias("event_total"),
        *[F.count_if(kind == k).alias(f"{k.lower()}_events") for k in kinds],
        F.min("event_date").alias("first_event_date"), F.max("event_date").alias("last_event_date"),
    )
    known = activity.select("entity_id").where(F.col("entity_id").isNotNull()).distinct().withColumn("__a", F.lit(True))
    return (
        summary.join(known, "entity_id", "left")
        .withColumn("has_activity", F.coalesce(F.col("__a"), F.lit(False)))
        .drop("__a")
        .orderBy(F.col("event_total").desc(), F.col("entity_id").asc())
    )


def common_entities(a: DataFrame, b: DataFrame, sample: int | None = None) -> DataFrame:
    """Entities of both tables; ``sample`` keeps the first few in order."""
    both = a.select("entity_id").intersect(b.select("entity_id"))
    return both.orderBy("entity_id").limit(sample) if sample else both


def temporal_overlap(activity: DataFrame, events: DataFrame) -> DataFrame:
    """Both time ranges and whether they meet; an empty side never overlaps."""
    ev = events.agg(F.struct(F.min("event_date").alias("lo"), F.max("event_date").alias("hi")).alias("s")).scalar()
    out = activity.agg(F.min("ts").alias("activity_start"), F.max("ts").alias("activity_end")).withColumn("__e", ev)
    out = out.select("activity_start", "activity_end", F.col("__e.lo").alias("events_start"), F.col("__e.hi").alias("events_end"))
    known = F.lit(True)
    for c in out.columns:
        known = known & F.col(c).isNotNull()
    meets = F.greatest("activity_start", "events_start") <= F.least("activity_end", "events_end")
    return out.withColumn("temporal_overlap", known & F.coalesce(meets, F.lit(False)))


def integration_report(activity: DataFrame, events: DataFrame, sample: int = 10) -> DataFrame:
    """One nested row describing both tables and their overlap, ready for the JSON sink."""
    a = activity.agg(F.struct(
        F.count("*").alias("rows"), F.lit(len(activity.columns)).alias("columns"),
        F.countDistinct("entity_id").alias("entities"), F.min("ts").alias("start"), F.max("ts").alias("end"),
        F.coalesce(F.sum(missing_cells(activity.columns)), F.lit(0)).cast("long").alias("missing"),
    ).alias("activity"))
    counts = event_counts(events).agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("c")).scalar()
    e = events.agg(F.struct(
        F.count("*").alias("rows"), F.lit(len(events.columns)).alias("columns"),
        F.countDistinct("entity_id").alias("entities"),
        F.min("event_date").alias("start"), F.max("event_date").alias("end"),
    ).alias("e")).scalar()
    n_common = common_entities(activity, events).agg(F.count("*").alias("n")).scalar()
    first = common_entities(activity, events, sample).agg(F.sort_array(F.collect_list("entity_id")).alias("s")).scalar()
    overlap = temporal_overlap(activity, events).select("temporal_overlap").scalar()
    return a.withColumns({
        "events": e, "event_counts": counts,
        "overlap": F.struct(
            n_common.alias("common_entities"), first.alias("sample_common_entities"), overlap.alias("temporal_overlap")
        ),
    })
