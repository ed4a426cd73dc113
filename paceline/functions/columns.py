"""Column expressions shared by the operators. All JVM-side, no UDF."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.model import ACTIVITY, MEASURES, NORMAL_LABELS, UNLABELLED

WINDOWS = ("daily", "weekly", "monthly")


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def present(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def require(df: DataFrame, wanted: Iterable[str], what: str = "table") -> None:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")


def day_floor(ts: str | Column) -> Column:
    """Midnight of the calendar day, free of any session time zone."""
    return F.to_date(as_col(ts)).cast(T.TimestampNTZType())


def hour_floor(ts: str | Column) -> Column:
    return day_floor(ts) + F.make_dt_interval(F.lit(0), F.hour(as_col(ts)))


def window_floor(ts: str | Column, window: str) -> Column:
    """Start of the daily, weekly (Monday) or monthly window."""
    day = F.to_date(as_col(ts))
    if window == "daily":
        start = day
    elif window == "weekly":
        start = F.trunc(day, "week")
    elif window == "monthly":
        start = F.trunc(day, "month")
    else:
        raise ValueError(f"unsupported window {window!r}; choose one of {WINDOWS}")
    return start.cast(T.TimestampNTZType())


def lenient_double(c: str | Column) -> Column:
    """Number or NULL; NaN counts as missing. Java's ``1.5d`` spelling is no number here."""
    text = as_col(c).cast("string")
    java_suffix = text.rlike(r"[0-9.]\s*[dDfF]\s*$")
    value = F.when(~java_suffix, text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def clean_double(df: DataFrame, name: str) -> Column:
    """``lenient_double`` that skips the text round trip for numeric columns."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = F.col(name).cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    return lenient_double(name)


def lenient_timestamp(c: str | Column, formats: Iterable[str] = ()) -> Column:
    """Text to a zone-free UTC timestamp; text that cannot be read becomes NULL.

    A trailing zone is honoured, zone-free text is taken as UTC whatever the
    session time zone is. ``formats`` are tried after the ISO forms.
    """
    text = F.trim(as_col(c).cast("string"))
    tries = [F.try_to_timestamp(text)] + [F.try_to_timestamp(text, F.lit(f)) for f in formats]
    local = F.coalesce(*tries).cast(T.TimestampNTZType())
    has_zone = text.rlike(r"(?i)[0-9]\s*(z|utc|gmt|[+-][0-9]{2}(:?[0-9]{2})?)$") & text.contains(":")
    return F.when(has_zone, F.convert_timezone(F.current_timezone(), F.lit("UTC"), local)).otherwise(local)


def utc_wall_time(c: str | Column) -> Column:
    """A timestamp with a zone as zone-free UTC, whatever the session time zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), as_col(c).cast(T.TimestampNTZType()))


def label_or_default(c: str | Column, default: str = UNLABELLED) -> Column:
    return F.trim(F.coalesce(as_col(c).cast("string"), F.lit(default)))


def is_anomaly(c: str | Column, normal: Iterable[str] = NORMAL_LABELS) -> Column:
    return ~label_or_default(c).isin(*normal)


def row_sum(columns: Iterable[str]) -> Column:
    """Row-wise sum in which a missing value counts as zero."""
    return F.expr(" + ".join(["0.0D"] + [f"coalesce(`{c}`, 0.0D)" for c in columns]))


def sum_or_zero(c: str | Column) -> Column:
    return F.coalesce(F.sum(as_col(c)), F.lit(0.0))


def activity_columns(df: DataFrame) -> list[str]:
    return present(df, ACTIVITY)


def measure_columns(df: DataFrame) -> list[str]:
    return present(df, MEASURES)


def missing_cells(columns: Iterable[str]) -> Column:
    """Number of missing cells of one row."""
    return F.expr(" + ".join(["0"] + [f"cast(`{c}` IS NULL AS INT)" for c in columns]))


def melt(df: DataFrame, columns: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """``(*keep, variable, x)`` with one row per present value of ``columns``."""
    columns = list(columns)
    pairs = ", ".join(f"'{c}', cast(`{c}` AS DOUBLE)" for c in columns)
    kept = [f"`{k}`" for k in keep]
    return df.selectExpr(*kept, f"stack({len(columns)}, {pairs}) AS (variable, x)").where("x IS NOT NULL")
