"""Cleaning of raw tables: headers, types, labels, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.functions.columns import (
    clean_double, day_floor, is_anomaly, label_or_default, lenient_timestamp, measure_columns, require, utc_wall_time,
)
from paceline.model import HEADER_NAMES, NORMAL_LABELS, TIME_HEADERS


def trim_headers(df: DataFrame) -> DataFrame:
    """Header cells without outer blanks and with line breaks as blanks."""
    return df.toDF(*[c.strip().replace("\n", " ") for c in df.columns])


def canonical_names(df: DataFrame, names: Mapping[str, str] = HEADER_NAMES) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns and new not in df.columns})


def alias_time(df: DataFrame, headers: Sequence[str] = TIME_HEADERS, name: str = "ts") -> DataFrame:
    """The first time header that is present becomes ``ts``; without one the frame is unchanged."""
    if name in df.columns:
        return df
    for header in headers:
        if header in df.columns:
            return df.withColumnRenamed(header, name)
    return df


def deduplicate(df: DataFrame) -> DataFrame:
    """Whole-row de-duplication: one hash aggregate, copies collapse before the shuffle."""
    return df.dropDuplicates()


def drop_without_time(df: DataFrame) -> DataFrame:
    return df.where(F.col("ts").isNotNull())


def clean(df: DataFrame, deduplicate: bool = True, time_formats: Sequence[str] = ()) -> DataFrame:
    """Raw activity table to the canonical model.

    Only what is present is touched. Times become zone-free UTC, measures become
    doubles with NaN mapped to NULL, a missing label becomes "unlabelled".
    """
    df = alias_time(canonical_names(trim_headers(df)))
    typed = {c: clean_double(df, c) for c in measure_columns(df)}
    if "entity_id" in df.columns:
        typed["entity_id"] = F.col("entity_id").cast("string")
    if "ts" in df.columns and isinstance(df.schema["ts"].dataType, T.TimestampType):
        typed["ts"] = utc_wall_time("ts")
    elif "ts" in df.columns and not isinstance(df.schema["ts"].dataType, T.TimestampNTZType):
        typed["ts"] = lenient_timestamp("ts", time_formats)
    if "anomaly_label" in df.columns:
        typed["anomaly_label"] = label_or_default("anomaly_label")
    if "description" in df.columns:
        typed["description"] = label_or_default("description", "")
    df = df.withColumns(typed) if typed else df
    return df.dropDuplicates() if deduplicate else df


def normalise_events(df: DataFrame) -> DataFrame:
    """Event types trimmed and upper-cased, dates floored to days, undated rows dropped."""
    require(df, ("entity_id", "event_date", "event_type"), "event log")
    when = F.col("event_date")
    if isinstance(df.schema["event_date"].dataType, T.StringType):
        when = lenient_timestamp(when)
    elif isinstance(df.schema["event_date"].dataType, T.TimestampType):
        when = utc_wall_time(when)
    return df.withColumns({
        "entity_id": F.col("entity_id").cast("string"),
        "event_date": day_floor(when),
        "event_type": F.upper(F.trim(F.col("event_type").cast("string"))),
    }).where(F.col("event_date").isNotNull())


def anomaly_rows(df: DataFrame, normal: Sequence[str] = NORMAL_LABELS) -> DataFrame:
    return df.where(is_anomaly("anomaly_label", normal))


def stamp(df: DataFrame, **metadata: str) -> DataFrame:
    """Literal metadata columns."""
    return df.withColumns({k: F.lit(v) for k, v in metadata.items()})


def rescale(df: DataFrame, columns: Sequence[str] | None = None, factor: float = 24.0) -> DataFrame:
    """Multiplies the measures, e.g. mean minutes per hour to minutes per day."""
    columns = list(columns or measure_columns(df))
    return df.withColumns({c: F.col(c) * F.lit(factor) for c in columns})


def null_where(df: DataFrame, condition, columns: Sequence[str]) -> DataFrame:
    """Unknown is not zero: blanks the columns of the rows that meet the condition."""
    return df.withColumns({c: F.when(~F.coalesce(condition, F.lit(False)), F.col(c)) for c in columns})


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def select_rows(df: DataFrame, column: str, values: Sequence[str] = (), contains: str | None = None) -> DataFrame:
    """Membership or case-insensitive substring filter; NULL never matches."""
    keep = F.lit(False)
    if values:
        keep = keep | F.col(column).isin(*values)
    if contains is not None:
        keep = keep | F.lower(F.col(column)).contains(contains.lower())
    return df.where(F.coalesce(keep, F.lit(False)))
