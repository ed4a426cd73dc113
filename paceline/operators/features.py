"""Per-entity window features: moments, exact quantiles, ratios, anomaly rates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.columns import (
    activity_columns, is_anomaly, measure_columns, missing_cells, require, sum_or_zero, window_floor,
)
from paceline.functions.quantiles import exact_quantiles
from paceline.model import FEATURE_METADATA
from paceline.session import cut

QUANTILES = (0.10, 0.25, 0.50, 0.75, 0.90)
# above this many rows a single (entity, window) no longer fits one aggregation buffer
HOT_GROUP_ROWS = 500_000
# groups are first counted together in so many buckets: a group is only looked at where its whole bucket is that large
BUCKETS = 65_536


def _same_keys(keys: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def hot_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys of the groups larger than ``limit`` (at most rows/limit of them), None if there are none."""
    placed = df.withColumn("__b", F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(BUCKETS)))
    crowded = cut(placed.groupBy("__b").agg(F.count("*").alias("__n")).where(F.col("__n") > limit).select("__b"))  # at most rows/limit
    if not crowded.limit(1).count():
        return None
    hot = cut(placed.join(F.broadcast(crowded), "__b").groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > limit).select(*keys))
    return hot if hot.limit(1).count() else None


def _mergeable(cols: Sequence[str], acts: Sequence[str], labelled: bool) -> list[Column]:
    aggs = [F.count("*").alias("n_records"), F.sum("__missing").cast("long").alias("n_missing")]
    for c in cols:
        aggs += [
            F.expr(f"avg(`{c}`) AS `{c}_mean`"), F.expr(f"stddev_samp(`{c}`) AS `{c}_std`"),
            F.expr(f"min(`{c}`) AS `{c}_min`"), F.expr(f"max(`{c}`) AS `{c}_max`"),
        ]
    aggs += [F.expr(f"coalesce(sum(`{c}`), 0.0D) AS `__sum_{c}`") for c in acts]
    if labelled:
        aggs.append(F.count_if("__anomaly").alias("anomaly_count"))
    return aggs


def _percentiles(cols: Sequence[str], approximate: bool = False) -> list[Column]:
    probs = ", ".join(f"{q}D" for q in QUANTILES)
    percentile = f"percentile_approx(`{{0}}`, array({probs}), 10000)" if approximate else f"percentile(`{{0}}`, array({probs}))"
    return [F.expr(percentile.format(c) + f" AS `__q_{c}`") for c in cols]


def _in_one_aggregate(cols: Sequence[str], acts: Sequence[str], labelled: bool) -> tuple[Callable[[str], str], Callable[[str, int], str]]:
    """What ``_columns`` needs, spelled as aggregates of the records. A window's quantiles come from the ordered list of its present values, interpolated as
    ``percentile`` does: windows are many and mostly small, and a list is far less to set up than a ``percentile`` a column."""
    named = {"n_records": "count(1)", "n_missing": "cast(sum(__missing) AS BIGINT)"}
    for c in cols:
        named |= {f"{c}_mean": f"avg(`{c}`)", f"{c}_std": f"stddev_samp(`{c}`)", f"{c}_min": f"min(`{c}`)", f"{c}_max": f"max(`{c}`)"}
    named |= {f"__sum_{c}": f"coalesce(sum(`{c}`), 0.0D)" for c in acts}
    if labelled:
        named["anomaly_count"] = "count_if(__anomaly)"

    def quantile(c: str, i: int) -> str:
        value = f"cast(`{c}` AS DOUBLE)"
        place = f"({QUANTILES[i]}D * (count({value}) - 1))"
        a, b = (f"get(sort_array(collect_list({value})), cast({end}({place}) AS INT))" for end in ("floor", "ceil"))
        return f"if({a} = {b}, {a}, (ceil({place}) - {place}) * {a} + ({place} - floor({place})) * {b})"

    return named.__getitem__, quantile


def window_aggregates(cols: Sequence[str], acts: Sequence[str], labelled: bool) -> list[Column]:
    """What ``finished`` needs of a window's records, given as ``windowed`` gives them."""
    return _mergeable(cols, acts, labelled) + _percentiles(cols)


def _hot_features(df: DataFrame, keys: Sequence[str], cols: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    base = df.groupBy(*keys).agg(*aggs)
    q = exact_quantiles(df, keys, cols, QUANTILES)
    wide = q.groupBy(*keys).agg(*[F.expr(f"max(if(variable = '{c}', q, NULL)) AS `__q_{c}`") for c in cols])
    cond = _same_keys(keys, base, wide)
    return base.join(wide, cond, "left").select(*[base[c] for c in base.columns], *[wide[f"__q_{c}"] for c in cols])


def record_flags(df: DataFrame, by: Sequence[str]) -> list[Column]:
    """Missing cells of a record and, where labels are given, whether it is an anomaly."""
    counted = [c for c in df.columns if c not in by and c not in ("dataset", "system")]
    return [missing_cells(counted)] + ([is_anomaly("anomaly_label")] if "anomaly_label" in df.columns else [])


def windowed(df: DataFrame, window: str, by: Sequence[str]) -> DataFrame:
    """``(by, entity_id, window_start, measures, __missing, __anomaly)`` per record with a time: all that features need of it."""
    require(df, ("entity_id", "ts"), "activity table")
    missing, *anomaly = record_flags(df, by)
    flags = [missing.alias("__missing"), *[a.alias("__anomaly") for a in anomaly]]
    return df.where(F.col("ts").isNotNull()).select(
        *[F.col(f"`{k}`") for k in by], "entity_id", window_floor("ts", window).alias("window_start"), *[F.col(f"`{c}`") for c in measure_columns(df)], *flags
    )


def _columns(
    by: Sequence[str], cols: Sequence[str], acts: Sequence[str], labelled: bool, metadata: dict[str, str],
    of: Callable[[str], str] = "`{}`".format, quantile: Callable[[str, int], str] = "`__q_{}`[{}]".format,
) -> list[tuple[str, str]]:
    """The feature columns in their order, each with the SQL that makes it of the aggregates, which ``of`` and ``quantile`` spell."""
    keys = [*by, "entity_id", "window_start"]
    literal = {k: f"'{v}'" for k, v in metadata.items()}
    out = [(k, f"`{k}`") for k in by if k not in FEATURE_METADATA]
    for c in FEATURE_METADATA[:8]:
        if c in literal and c not in by:
            out.append((c, literal[c]))
        elif c in keys:
            out.append((c, f"`{c}`"))
        elif c in ("n_records", "n_missing"):
            out.append((c, of(c)))
    for c in cols:
        mean, std = of(f"{c}_mean"), of(f"{c}_std")
        out += [
            (f"{c}_mean", mean), (f"{c}_std", std), (f"{c}_min", of(f"{c}_min")), (f"{c}_max", of(f"{c}_max")),
            (f"{c}_median", quantile(c, 2)), (f"{c}_p10", quantile(c, 0)), (f"{c}_p90", quantile(c, 4)),
            (f"{c}_iqr", f"{quantile(c, 3)} - {quantile(c, 1)}"), (f"{c}_cv", f"if({mean} <> 0, {std} / {mean}, NULL)"),
        ]
    total = " + ".join(of(f"__sum_{c}") for c in acts)
    out += [(f"ratio_{c}", f"if({total} > 0, {of(f'__sum_{c}')} / ({total}), NULL)") for c in acts]
    if labelled:
        out += [("anomaly_count", of("anomaly_count")), ("anomaly_rate", f"{of('anomaly_count')} / {of('n_records')}")]
    return out


def finished(grouped: DataFrame, by: Sequence[str], cols: Sequence[str], acts: Sequence[str], labelled: bool, metadata: dict[str, str]) -> DataFrame:
    """The feature columns, in their order, from the aggregates of each group."""
    return grouped.selectExpr(*[f"{made} AS `{name}`" for name, made in _columns(by, cols, acts, labelled, metadata)])


def extract_features(
    df: DataFrame,
    window: str = "weekly",
    by: Sequence[str] = (),
    hot_group_rows: int | None = HOT_GROUP_ROWS,
    approximate: bool = False,
    **metadata: str,
) -> DataFrame:
    """One row per (``by``, entity, window) with nine statistics per measure.

    ``by`` names metadata columns already in ``df`` (several sources in one job);
    ``metadata`` stamps literal ones. A missing entity is a group of its own.
    ``approximate`` trades exact quantiles for sketches.

    The source is read once: its keys, measures and two flags are written as a narrow table, groups
    are counted from that, and only if one is too large for an aggregation buffer is it treated apart.
    """
    by = list(by)
    cols, acts = measure_columns(df), activity_columns(df)
    labelled = "anomaly_label" in df.columns
    keys = by + ["entity_id", "window_start"]
    work = windowed(df, window, by)
    aggs = _mergeable(cols, acts, labelled)

    of, quantile = _in_one_aggregate(cols, acts, labelled)
    columns = _columns(by, cols, acts, labelled, metadata, of, quantile)

    def gathered(rows: DataFrame) -> DataFrame:
        if approximate:
            return finished(rows.groupBy(*keys).agg(*aggs, *_percentiles(cols, True)), by, cols, acts, labelled, metadata)
        # records travel once and plain: lists do not get smaller before a shuffle
        together = rows.repartition(*[F.col(f"`{k}`") for k in keys]).groupBy(*keys)
        made = together.agg(*[F.expr(f"{sql} AS `{name}`") for name, sql in columns if name not in keys])
        return made.select(*[F.col(f"`{name}`") for name, _ in columns])

    hot = None
    if hot_group_rows is not None and not approximate and cols:
        work = cut(work)
        hot = hot_groups(work, keys, hot_group_rows)
    if hot is None:
        return gathered(work)
    cond = _same_keys(keys, work, hot)
    ordinary, crowded = work.join(hot, cond, "left_anti"), cut(work.join(hot, cond, "left_semi"))
    return gathered(ordinary).unionByName(finished(_hot_features(crowded, keys, cols, aggs), by, cols, acts, labelled, metadata))


def activity_ratios(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each behaviour in the summed activity of a group; NULL where nothing was recorded."""
    acts = activity_columns(df)
    sums = df.groupBy(*keys).agg(*[sum_or_zero(c).alias(f"__{c}") for c in acts])
    total = F.lit(0.0)
    for c in acts:
        total = total + F.col(f"__{c}")
    return sums.select(*keys, *[F.when(total > 0, F.col(f"__{c}") / total).alias(f"ratio_{c}") for c in acts])


def anomaly_rate(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_records"), F.count_if(is_anomaly("anomaly_label")).alias("anomaly_count")
    ).withColumn("anomaly_rate", F.col("anomaly_count") / F.col("n_records"))
