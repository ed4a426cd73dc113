"""The star-schema test tables seen as activity data.

``events`` pivoted per user and hour is the activity table, ``events`` per user and
day is the event log, ``customer`` tells dataset and system of a user, and
``embeddings`` is a ready feature matrix with labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.columns import day_floor, hour_floor

# fixed values: which event type feeds which measure or event kind
EVENT_MEASURES = {"click": "ruminate", "view": "eat", "purchase": "graze", "signup": "rest", "error": "walk"}
EVENT_KINDS = {"error": "ANOMALY", "signup": "HEAT", "purchase": "BIRTH"}
EXTENSIVE = ("BUILDING", "MACHINERY")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("double")


def _pivoted(events: DataFrame, keys: list) -> DataFrame:
    measures = [
        F.sum(F.when(F.col("event_type") == kind, F.col("value"))).alias(name) for kind, name in EVENT_MEASURES.items()
    ]
    top = F.max("k")
    label = F.when(top >= 90, "Heat/Estrus").when(top >= 80, "Other").when(top >= 70, "No anomaly")
    return (
        events.select(*keys, "event_type", "value", _k().alias("k"))
        .groupBy("entity_id", "ts")
        .agg(*measures, F.sum("k").alias("steps"), label.alias("anomaly_label"))
    )


def farms(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("entity_id"),
        segment.alias("dataset"),
        F.when(segment.isin(*EXTENSIVE), "extensive").otherwise("intensive").alias("system"),
    )


def raw_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly activity without metadata: ``(entity_id, ts, measures, anomaly_label)``."""
    events = table(spark, sf_dir, "events")
    keys = [F.col("user_id").cast("string").alias("entity_id"), hour_floor("ts").alias("ts")]
    return _pivoted(events, keys)


def raw_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same measures summed straight to days: an independent daily source."""
    events = table(spark, sf_dir, "events")
    keys = [F.col("user_id").cast("string").alias("entity_id"), day_floor("ts").alias("ts")]
    return _pivoted(events, keys)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_hourly(spark, sf_dir).join(farms(spark, sf_dir), "entity_id")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_daily(spark, sf_dir).join(farms(spark, sf_dir), "entity_id")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(entity_id, event_date, event_type)``, one row per source event of the three kinds."""
    kind = F.create_map(*[F.lit(x) for pair in EVENT_KINDS.items() for x in pair])[F.col("event_type")]
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin(*EVENT_KINDS))
        .select(F.col("user_id").cast("string").alias("entity_id"), day_floor("ts").alias("event_date"), kind.alias("event_type"))
    )


def order_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger table: order lines as activity of the ordering customer."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("entity_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("ruminate"),
        F.col("l_extendedprice").alias("eat"),
        F.col("l_discount").alias("graze"),
        F.col("l_tax").alias("rest"),
        F.col("l_returnflag").alias("anomaly_label"),
    )


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, features array<double>, label)``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label")
    )
