"""Writers: tables, one-row summaries as JSON, restartable slice results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), order_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """A table in any file format; ``partition_by`` lets later reads prune whole folders.

    ``order_by`` writes it in global order, one range of keys per file.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A (one-row, nested) summary as JSON; NULL fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_slice(df: DataFrame, path: str, keys: Sequence[str] = ("branch", "feature_set")) -> None:
    """Replaces the partitions of the slices in ``df`` and leaves the others, so single slices can be rerun."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    )
