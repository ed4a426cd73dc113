"""Window features from mergeable day tables: the raw rows are read once, weeks and months come from the days.

A day row of an entity (or of whole sources, without the entity) holds counts, sums, squares about the day's mean, extremes and a KLL
quantile sketch per measure. Days merge into any longer window, and new days are appended without touching old ones. Counts,
sums, means, deviations and extremes are exact up to rounding. A quantile is a value of the group whose rank is off by at most one hundredth
of the group (k = 1024; measured by ``rank_errors``); groups of no more than k values are held whole, so theirs are exact order
statistics (no interpolation).

Both steps aggregate on the map side, so a hot source costs one sketch a task, not its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.columns import measure_columns, window_floor
from paceline.model import ACTIVITY
from paceline.operators.features import QUANTILES, finished, windowed

K = 1024


def day_sketches(df: DataFrame, by: Sequence[str] = (), entities: bool = True, k: int = K) -> DataFrame:
    """One row per (``by``, entity, day); without ``entities`` one per (``by``, day)."""
    keys = [*by, *(["entity_id"] if entities else []), "day"]
    work = windowed(df, "daily", by).withColumnRenamed("window_start", "day")
    aggs = [F.count("*").alias("n_records"), F.sum("__missing").cast("long").alias("n_missing")]
    if "__anomaly" in work.columns:
        aggs.append(F.count_if("__anomaly").alias("anomaly_count"))
    for c in measure_columns(df):
        x = F.col(f"`{c}`").cast("double")
        aggs += [
            F.count(x).alias(f"{c}_n"), F.sum(x).alias(f"{c}_sum"), (F.var_pop(x) * F.count(x)).alias(f"{c}_m2"),
            F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.kll_sketch_agg_double(x, k).alias(f"{c}_kll"),
        ]
    return work.groupBy(*keys).agg(*aggs)


def merge_days(days: DataFrame, window: str = "monthly") -> DataFrame:
    """Day rows merged into windows; the columns stay the same, with ``window_start`` for ``day``."""
    names = days.columns
    cols = [c.removesuffix("_kll") for c in names if c.endswith("_kll")]
    facts = ("n_records", "n_missing", "anomaly_count")
    own = {*facts, "day", *[f"{c}_{s}" for c in cols for s in ("n", "sum", "m2", "min", "max", "kll")]}
    keys = [F.col(f"`{c}`") for c in names if c not in own]
    aggs = [F.sum(c).alias(c) for c in facts if c in names]
    for c in cols:
        n, total = F.sum(f"{c}_n"), F.sum(f"{c}_sum")
        # squares about the common mean, from those about each day's
        between = F.sum(F.col(f"{c}_sum") * F.col(f"{c}_sum") / F.nullif(F.col(f"{c}_n"), F.lit(0))) - total * total / F.nullif(n, F.lit(0))
        aggs += [
            n.alias(f"{c}_n"), total.alias(f"{c}_sum"), (F.sum(f"{c}_m2") + F.greatest(between, F.lit(0.0))).alias(f"{c}_m2"),
            F.min(f"{c}_min").alias(f"{c}_min"), F.max(f"{c}_max").alias(f"{c}_max"), F.kll_merge_agg_double(f"{c}_kll").alias(f"{c}_kll"),
        ]
    return days.groupBy(*keys, window_floor("day", window).alias("window_start")).agg(*aggs)


def quantiles(merged: DataFrame, column: str, probs: Sequence[float] = QUANTILES) -> F.Column:
    """Array of the sketch's values at the given ranks; NULL where the group has none."""
    asked = F.array(*[F.lit(float(p)) for p in probs])
    return F.when(F.col(f"{column}_n") > 0, F.kll_sketch_get_quantile_double(f"{column}_kll", asked))


def rank_errors(df: DataFrame, merged: DataFrame, window: str, by: Sequence[str], column: str, probs: Sequence[float] = QUANTILES) -> DataFrame:
    """``(by, window_start, p, value, n, error)``: how far the rank of each sketched quantile lies from ``p`` in the rows themselves, in parts of
    the group. A value stands for all ranks that its equal rows take."""
    asked = F.arrays_zip(F.array(*[F.lit(float(p)) for p in probs]).alias("p"), quantiles(merged, column, probs).alias("value"))
    told = merged.where(F.col(f"{column}_n") > 0).select(*[F.col(f"`{c}`").alias(f"__{c}") for c in (*by, "window_start")], asked.alias("asked"))
    rows = df.where(F.col("ts").isNotNull() & F.col(f"`{column}`").isNotNull()).select(*by, window_floor("ts", window).alias("window_start"), F.col(f"`{column}`").cast("double").alias("x"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, "window_start")]
    # one row a group on the right; its quantiles are counted against in one pass, before anything is shuffled twice
    counts = [F.count("*").alias("n")]
    for i in range(len(probs)):
        value = F.col("asked")[i]["value"]
        counts += [F.count_if(F.col("x") < value).alias(f"below{i}"), F.count_if(F.col("x") <= value).alias(f"upto{i}")]
    counted = rows.join(told, same).groupBy(*by, "window_start", "asked").agg(*counts)
    each = F.array(*[F.struct(F.col("asked")[i]["p"].alias("p"), F.col("asked")[i]["value"].alias("value"), F.col(f"below{i}").alias("below"), F.col(f"upto{i}").alias("upto")) for i in range(len(probs))])
    out = counted.select(*by, "window_start", "n", F.inline(each))
    off = F.greatest(F.col("below") / F.col("n") - F.col("p"), F.col("p") - F.col("upto") / F.col("n"), F.lit(0.0))
    return out.select(*by, "window_start", "p", "value", "n", off.alias("error"))


def features_from_days(days: DataFrame, window: str = "monthly", by: Sequence[str] = (), **metadata: str) -> DataFrame:
    """The columns of ``extract_features`` from day rows."""
    merged = merge_days(days, window)
    cols = [c.removesuffix("_kll") for c in merged.columns if c.endswith("_kll")]
    made = [F.col("n_records"), F.col("n_missing"), *([F.col("anomaly_count")] if "anomaly_count" in merged.columns else [])]
    for c in cols:
        n = F.col(f"{c}_n")
        made += [
            F.when(n > 0, F.col(f"{c}_sum") / n).alias(f"{c}_mean"), F.when(n > 1, F.sqrt(F.col(f"{c}_m2") / (n - 1))).alias(f"{c}_std"),
            F.col(f"{c}_min"), F.col(f"{c}_max"), F.coalesce(f"{c}_sum", F.lit(0.0)).alias(f"__sum_{c}"), quantiles(merged, c).alias(f"__q_{c}"),
        ]
    grouped = merged.select(*by, "entity_id", "window_start", *made)
    return finished(grouped, by, cols, [c for c in cols if c in ACTIVITY], "anomaly_count" in merged.columns, metadata)
