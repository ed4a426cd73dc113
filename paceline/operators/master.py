"""Feature tables of several branches merged into one master table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.columns import missing_cells, require
from paceline.model import FEATURE_KEYS


def union_features(tables: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns a table lacks are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def master_table(tables: Sequence[DataFrame], keys: Sequence[str] = FEATURE_KEYS) -> DataFrame:
    """Union that is unique on the keys; the earliest table in the list wins.

    The winner is an arg-min aggregate, so copies of one key collapse before the
    shuffle however many there are. Within a table the tie goes to the lowest row hash, then to the least row.
    """
    for i, t in enumerate(tables):
        require(t, keys, f"feature table {i}")
    return first_of_each(union_features([t.withColumn("__rank", F.lit(i)) for i, t in enumerate(tables)]), keys)


def first_of_each(ranked: DataFrame, keys: Sequence[str], keep_rank: bool = False) -> DataFrame:
    """One row per key of a table with ``__rank``: the one of the lowest rank, of these the one with the lowest hash, then the least row."""
    rest = [c for c in ranked.columns if c not in keys and c != "__rank"]
    kept = [*rest, "__rank"] if keep_rank else rest
    if not rest:
        return ranked.groupBy(*keys).agg(F.min("__rank").alias("__rank")) if keep_rank else ranked.select(*keys).distinct()
    order = F.struct(F.col("__rank"), F.xxhash64(*rest), F.struct(*rest))
    best = ranked.groupBy(*keys).agg(F.min_by(F.struct(*kept), order).alias("__b"))
    columns = [c for c in ranked.columns if c != "__rank" or keep_rank]
    return best.select(*[F.col(c) if c in keys else F.col(f"__b.{c}") for c in columns])


def master_report(master: DataFrame) -> DataFrame:
    """Totals of the master table: one row, zeros for an empty one."""
    return master.agg(
        F.count("*").alias("rows"), F.lit(len(master.columns)).alias("columns"),
        F.sort_array(F.collect_set("dataset")).alias("datasets"), F.sort_array(F.collect_set("system")).alias("systems"),
        F.countDistinct("entity_id").alias("entities"),
        F.min("window_start").alias("window_start_min"), F.max("window_start").alias("window_start_max"),
        F.coalesce(F.sum(missing_cells(master.columns)), F.lit(0)).cast("long").alias("missing"),
    )


def table_report(tables: Sequence[tuple[str, DataFrame]]) -> DataFrame | None:
    """Rows, columns, dataset and system of each table that goes into the master."""
    parts = [
        df.agg(
            F.lit(name).alias("table"), F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"),
            F.min("dataset").alias("dataset"), F.min("system").alias("system"),
        ).select("table", "rows", "columns", "dataset", "system")
        for name, df in tables
    ]
    return union_features(parts) if parts else None


def empty_master_report(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(0, 0, [], [])], "rows long, columns int, datasets array<string>, systems array<string>"
    )


def feature_counts(df: DataFrame, columns: Sequence[str] = ("dataset", "system", "resolution", "scale_type")) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))
