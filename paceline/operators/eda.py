"""The numbers behind histograms, box plots, correlation maps and group means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.columns import melt
from paceline.functions.quantiles import exact_quantiles

# fixed values: the features the exploratory figures look at
KEY_FEATURES = (
    "ruminate_mean", "eat_mean", "graze_mean", "rest_mean", "walk_mean", "steps_mean",
    "ratio_ruminate", "ratio_eat", "ratio_graze", "ratio_rest", "ratio_walk",
)
BOX_FEATURES = KEY_FEATURES[:6]


def system_feature_means(df: DataFrame, columns: Sequence[str] = KEY_FEATURES, group: str = "system", groups: Sequence[str] | None = None) -> DataFrame:
    """Mean of each feature per group, features as rows and groups as columns ``mean_<group>``."""
    columns = [c for c in columns if c in df.columns]
    if groups is None:
        groups = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).collect()]
    pivoted = melt(df, columns, [group]).groupBy("variable").pivot(group, list(groups)).agg(F.avg("x"))
    return pivoted.select("variable", *[F.col(f"`{g}`").alias(f"mean_{g}") for g in groups])


def histogram(df: DataFrame, columns: Sequence[str] = KEY_FEATURES, bins: int = 30) -> DataFrame:
    """Counts of equal-width bins from minimum to maximum, the last bin closed; empty bins included."""
    columns = [c for c in columns if c in df.columns]
    extremes = df.agg(*[F.expr(f"struct(cast(min(`{c}`) AS DOUBLE) AS lo, cast(max(`{c}`) AS DOUBLE) AS hi) AS `{c}`") for c in columns])
    # a constant variable gets a unit range around its value
    ranges = ", ".join(
        f"struct('{c}' AS variable, if(`{c}`.lo = `{c}`.hi, `{c}`.lo - 0.5D, `{c}`.lo) AS lo, if(`{c}`.lo = `{c}`.hi, `{c}`.hi + 0.5D, `{c}`.hi) AS hi)"
        for c in columns
    )
    box = extremes.selectExpr(f"array({ranges}) AS b")
    edges = box.select(F.explode("b").alias("e")).select("e.*").where(F.col("lo").isNotNull())
    values = melt(df, columns).join(F.broadcast(edges), "variable")
    place = F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1
    counts = values.groupBy("variable", F.least(place, F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    frame = edges.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    width = (F.col("hi") - F.col("lo")) / bins
    return frame.join(counts, ["variable", "bin"], "left").select(
        "variable", "bin", (F.col("lo") + width * (F.col("bin") - 1)).alias("lower"),
        (F.col("lo") + width * F.col("bin")).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"),
    )


def boxplot_stats(df: DataFrame, columns: Sequence[str] = BOX_FEATURES, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the last value within ``reach`` IQR, and the number of outliers."""
    columns = [c for c in columns if c in df.columns]
    q = exact_quantiles(df, [], columns, [0.25, 0.5, 0.75]).select(
        "variable", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    x, low, high = F.col("x"), F.col("q1") - reach * (F.col("q3") - F.col("q1")), F.col("q3") + reach * (F.col("q3") - F.col("q1"))
    joined = melt(df, columns).join(F.broadcast(q), "variable")
    out = joined.groupBy("variable", "q1", "median", "q3").agg(
        F.min(F.when(x >= low, x)).alias("lo"), F.max(F.when(x <= high, x)).alias("hi"),
        F.count_if((x < low) | (x > high)).alias("n_outliers"),
    )
    return out.select(
        "variable", "q1", "median", "q3",
        F.least("lo", "q1").alias("whisker_low"), F.greatest("hi", "q3").alias("whisker_high"), "n_outliers",
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, pairwise complete, long form; all pairs in one aggregation."""
    columns = [c for c in columns if c in df.columns]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    one = df.selectExpr(*[f"corr(cast(`{a}` AS DOUBLE), cast(`{b}` AS DOUBLE)) AS c{i}" for i, (a, b) in enumerate(pairs)])
    cells = [
        f"'{x}', '{y}', if(isnan(c{i}), NULL, c{i})"
        for i, (a, b) in enumerate(pairs) for x, y in sorted({(a, b), (b, a)})
    ]
    return one.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) AS (a, b, corr)")


def group_centroids(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Mean position of each group, ordered along the first column."""
    return df.groupBy(group).agg(*[F.avg(c).alias(c) for c in columns]).orderBy(columns[0])


def cumulative_variance(explained: DataFrame) -> DataFrame:
    """Running sum of explained variance over the (few) components."""
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return explained.withColumn("cumulative", F.sum("explained").over(w))
