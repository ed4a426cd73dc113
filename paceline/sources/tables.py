"""Readers: activity tables, event logs, feature tables."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.functions.columns import require
from paceline.model import EVENT_HEADER_NAMES, FEATURE_KEYS, SourceSpec
from paceline.operators.cleaning import canonical_names, clean, normalise_events, trim_headers

log = logging.getLogger(__name__)

FORMATS = ("csv", "parquet", "orc", "json")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the Hadoop file system, so it works for any storage the cluster reads."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop_path))


def _format_of(path: str) -> str:
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported format {suffix!r} of {path}; expected one of {FORMATS}")
    return suffix


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    """Any supported file with trimmed headers. CSV without a schema stays text.

    Text columns are typed by the lenient casts of the cleaning step, so no
    inference pass reads the file twice.
    """
    fmt = fmt or _format_of(path)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true").option("multiLine", "false")
    if schema is not None:
        reader = reader.schema(schema)
    return trim_headers(reader.load(path))


def read_activity(
    spark: SparkSession,
    spec: SourceSpec,
    schema: T.StructType | None = None,
    fmt: str | None = None,
    deduplicate: bool = True,
) -> DataFrame:
    """One cleaned activity table with its dataset and system stamped on."""
    df = clean(read_table(spark, spec.path, schema, fmt), deduplicate=deduplicate)
    return df.withColumns({"dataset": F.lit(spec.dataset), "system": F.lit(spec.system)})


def read_activities(
    spark: SparkSession, specs: Sequence[SourceSpec], skip_missing: bool = False, **options
) -> DataFrame | None:
    """Union of several sources; absent ones are skipped on request. None if nothing is left."""
    frames = []
    for spec in specs:
        if skip_missing and not path_exists(spark, spec.path):
            log.warning("source %s is missing, skipped", spec.path)
            continue
        frames.append(read_activity(spark, spec, **options))
    if not frames:
        return None
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_events(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    """Event log ``(entity_id, event_date, event_type)``; rows without a readable date are dropped."""
    df = canonical_names(read_table(spark, path, schema, fmt), EVENT_HEADER_NAMES)
    return normalise_events(df)


def read_feature_tables(spark: SparkSession, paths: Iterable[str], fmt: str | None = None) -> list[tuple[str, DataFrame]]:
    """Named feature tables in the given order (the order decides which duplicate wins)."""
    tables = []
    for path in paths:
        df = canonical_names(read_table(spark, path, fmt=fmt))
        require(df, FEATURE_KEYS, path)
        tables.append((path, type_features(df)))
    return tables


def type_features(df: DataFrame) -> DataFrame:
    """Types a feature table read as text: keys stay text, times are parsed, the rest is numeric."""
    from paceline.functions.columns import clean_double, lenient_timestamp

    text = {"dataset", "system", "entity_id", "resolution", "scale_type"}
    typed = {}
    for f in df.schema.fields:
        if f.name == "window_start":
            if not isinstance(f.dataType, T.TimestampNTZType):
                typed[f.name] = lenient_timestamp(f.name)
        elif f.name not in text and isinstance(f.dataType, T.StringType):
            typed[f.name] = clean_double(df, f.name)
    return df.withColumns(typed) if typed else df
