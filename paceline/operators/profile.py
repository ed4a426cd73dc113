"""Profiles of raw and cleaned tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.columns import label_or_default, measure_columns, missing_cells
from paceline.functions.quantiles import exact_medians
from paceline.session import cut

DAILY_GAP_HOURS = 12.0


def null_safe(keys: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds per-source columns of ``right``; both have one row per source."""
    if not keys:
        packed = right.select(F.struct(*columns).alias("s")).scalar()
        return left.withColumn("__s", packed).select(*left.columns, *[F.col(f"__s.{c}") for c in columns])
    joined = left.join(right, null_safe(keys, left, right), "left")
    return joined.select(*[left[c] for c in left.columns], *[right[c] for c in columns])


def time_gaps(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Gaps in hours between consecutive distinct times of each source.

    Distinct times are dealt to range partitions, so that neighbours in time lie together however crowded an hour or a source is. ``lag`` runs inside a
    partition; the gaps between partitions come from a table of their ends, a row per source and partition.
    """
    by = list(by)
    times = df.where(F.col("ts").isNotNull()).select(*by, "ts").distinct()
    ranged = cut(times.repartitionByRange(*[F.col(f"`{k}`") for k in by], "ts").withColumn("__part", F.spark_partition_id()))

    def hours(late: Column, early: Column) -> Column:
        return (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / F.lit(3.6e9)

    within = ranged.withColumn("__prev", F.lag("ts").over(Window.partitionBy("__part", *by).orderBy("ts")))
    inner = within.where(F.col("__prev").isNotNull()).select(*by, hours(F.col("ts"), F.col("__prev")).alias("gap_hours"))
    ends = ranged.groupBy(*by, "__part").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    across = ends.withColumn("__prev", F.lag("last").over(Window.partitionBy(*by).orderBy("__part")))  # at most one row per partition
    outer = across.where(F.col("__prev").isNotNull()).select(*by, hours(F.col("first"), F.col("__prev")).alias("gap_hours"))
    return inner.unionByName(outer)


def infer_frequency(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """"daily" when the median gap is at least twelve hours, else "hourly"; one time only: "unknown"."""
    by = list(by)
    gaps = time_gaps(df, by)
    medians = exact_medians(gaps, by, ["gap_hours"], ["median_gap_hours"])
    sources = df.select(*by).distinct() if by else df.agg(F.count("*").alias("rows"))
    out = attach(sources, medians, by, ["median_gap_hours"])
    gap = F.col("median_gap_hours")
    out = out.withColumn(
        "frequency", F.when(gap.isNull(), "unknown").when(gap >= DAILY_GAP_HOURS, "daily").otherwise("hourly")
    )
    return out.select(*by, "median_gap_hours", "frequency")


def label_counts(df: DataFrame, column: str = "anomaly_label", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label_or_default(column).alias("label")).agg(F.count("*").alias("n"))


def top_labels(df: DataFrame, k: int = 5, column: str = "anomaly_label") -> DataFrame:
    """The k most frequent labels, ties alphabetical."""
    return label_counts(df, column).orderBy(F.col("n").desc(), F.col("label").asc()).limit(k)


def top_labels_by(df: DataFrame, by: Sequence[str], k: int = 5, column: str = "anomaly_label") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col("label").asc())
    ranked = label_counts(df, column, by).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k)


def profile(df: DataFrame, by: Sequence[str] = (), data_columns: Sequence[str] | None = None, top: int = 5) -> DataFrame:
    """One row per source: size, entities, missing cells, time range, frequency, top labels."""
    by = list(by)
    counted = list(data_columns or [c for c in df.columns if c not in by])
    aggs = [F.count("*").alias("rows")]
    if "entity_id" in df.columns:
        aggs.append(F.countDistinct("entity_id").alias("entities"))
    aggs.append(F.coalesce(F.sum(missing_cells(counted)), F.lit(0)).cast("long").alias("missing"))
    if "ts" in df.columns:
        aggs += [F.min("ts").alias("start"), F.max("ts").alias("end")]
    out = df.groupBy(*by).agg(*aggs).withColumn("columns", F.lit(len(counted)))
    if "ts" in df.columns:
        out = attach(out, infer_frequency(df, by), by, ["median_gap_hours", "frequency"])
    else:
        out = out.withColumn("frequency", F.lit("unknown"))
    if "anomaly_label" in df.columns:
        ranked = top_labels_by(df, by, top)
        packed = ranked.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "label", "n"))).alias("top_labels"))
        out = attach(out, packed, by, ["top_labels"])
    return out


def compare_profiles(df: DataFrame, by: Sequence[str] = ("dataset", "system"), data_columns: Sequence[str] | None = None) -> DataFrame:
    """One row per source of a union: size, range, top label, labelled rows, mean of each measure."""
    by = list(by)
    counted = list(data_columns or [c for c in df.columns if c not in by])
    aggs = [
        F.count("*").alias("rows"), F.countDistinct("entity_id").alias("entities"),
        F.coalesce(F.sum(missing_cells(counted)), F.lit(0)).cast("long").alias("missing"),
    ]
    if "ts" in df.columns:
        aggs += [F.min("ts").alias("start"), F.max("ts").alias("end")]
    if "anomaly_label" in df.columns:
        aggs.append(F.count("anomaly_label").alias("labelled_rows"))
    aggs += [F.avg(c).alias(f"mean_{c}") for c in measure_columns(df)]
    out = df.groupBy(*by).agg(*aggs).withColumn("columns", F.lit(len(counted)))
    if "anomaly_label" in df.columns:
        best = top_labels_by(df, by, 1).select(*by, F.col("label").alias("top_label"), F.col("n").alias("top_label_count"))
        out = attach(out, best, by, ["top_label", "top_label_count"])
    return out


def system_means(profiles: DataFrame) -> DataFrame:
    """Unweighted mean of the dataset means of each system."""
    means = [c for c in profiles.columns if c.startswith("mean_")]
    return profiles.groupBy("system").agg(*[F.avg(c).alias(c) for c in means])


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with missing cells, most affected first."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = counts.unpivot([], list(df.columns), "variable", "missing")
    return long.where(F.col("missing") > 0).orderBy(F.col("missing").desc(), "variable")


def group_counts(df: DataFrame, columns: Sequence[str], sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """Row counts per group, for several grouping sets in one pass when given."""
    if sets is None:
        return df.groupBy(*columns).agg(F.count("*").alias("n"))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return grouped.agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def branch_summary(df: DataFrame) -> DataFrame:
    """Rows and systems of a feature table, naming the system when there is only one."""
    out = df.agg(
        F.count("*").alias("n_rows"), F.countDistinct("system").alias("n_systems"), F.min("system").alias("__s")
    )
    return out.withColumn("only_system", F.when(F.col("n_systems") == 1, F.col("__s"))).drop("__s")
