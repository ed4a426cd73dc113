"""Daily roll-up and window features of activity that arrives file by file, late rows included.

Both operators take a streaming activity table and return a streaming result in append mode: a day or window is given out
once, when the watermark (the latest time seen, less ``delay``) has passed its end. Rows may come in any order as long as none is
later than ``delay``; of later ones, days and weeks drop what belongs to a closed one, months drop every row behind the watermark. Spark counts
the dropped rows in the progress (``dropped_rows``).

The roll-up is an event-time window aggregation with the aggregates of ``rollup_daily``; its state is one buffer an entity-day.
Features of days and weeks are one with the aggregates of ``extract_features``; the state of an entity-window is keyed by both and holds its values, as the quantiles are exact.

Months differ in length, which event-time windows cannot express. There all values of an entity-window are kept by a stateful processor until it closes: per key a list state with the
rows seen and an event-time timer at the window's end. Expired keys give one row and their state is cleared, so the state is as large
as the open windows. An entity-window must fit in a task, as in any exact quantile of a group; ``extract_features`` brackets larger ones.

State and progress lie in the query's checkpoint folder, which executors share: a query that is stopped or loses executors goes on from there, and
the file sink lists each batch once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from paceline.functions.columns import activity_columns, as_col, measure_columns, utc_wall_time, window_floor
from paceline.operators.features import QUANTILES, finished, record_flags, window_aggregates
from paceline.operators.rollup import daily_aggregates

#: Keyed state with timers needs a store that keeps several columns a key.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Windows of a fixed length, and where they start after Thursday, the first of January 1970.
FIXED = {"daily": ("1 day", "0 days"), "weekly": ("7 days", "4 days")}
LENGTHS = {"daily": "interval 1 day", "weekly": "interval 7 days", "monthly": "interval 1 month"}


def event_time(ts: str | Column = "ts") -> Column:
    """The zone-free UTC time as an instant, whatever the session time zone is."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), as_col(ts)).cast("timestamp")


def read_activity_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """Activity files of a folder, as they come."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_daily(rows: DataFrame, by: Sequence[str] = (), delay: str = "2 days") -> DataFrame:
    """``rollup_daily`` of a stream."""
    timed = rows.withColumn("__at", event_time()).withWatermark("__at", delay).where(F.col("entity_id").isNotNull() & F.col("ts").isNotNull())
    days = timed.groupBy(*by, "entity_id", F.window("__at", "1 day").alias("__day")).agg(*daily_aggregates(rows))
    return days.select(*by, "entity_id", utc_wall_time("__day.start").alias("ts"), *[c for c in days.columns if c not in (*by, "entity_id", "__day")])


class WindowFeatures(StatefulProcessor):
    """Keeps the rows of a key until its window has ended, then gives out their aggregates."""

    def __init__(self, keys: Sequence[str], cols: Sequence[str], acts: Sequence[str], labelled: bool) -> None:
        self.keys, self.cols, self.acts, self.labelled = list(keys), list(cols), list(acts), labelled
        self.kept = [*self.cols, "missing", *(["anomaly"] if labelled else [])]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", ", ".join(f"`{c}` double" for c in self.kept))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = not self.seen.exists()
        for pdf in rows:
            if new:
                self.handle.registerTimer(int(pdf["end_ms"].iloc[0]))
                new = False
            values = pdf[self.kept].astype(float).astype(object)
            self.seen.appendList([tuple(None if v != v else v for v in row) for row in values.itertuples(index=False, name=None)])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        table = np.array([[np.nan if v is None else v for v in row] for row in self.seen.get()], dtype=float)
        self.seen.clear()
        yield pd.DataFrame([self.aggregates(key, table)])

    def aggregates(self, key: tuple, table: np.ndarray) -> dict:
        """The same aggregates as ``extract_features`` takes of a group."""
        out = dict(zip(self.keys, key))
        at = {c: i for i, c in enumerate(self.kept)}
        out |= {"n_records": len(table), "n_missing": int(table[:, at["missing"]].sum())}
        for c in self.cols:
            x = table[:, at[c]]
            x = x[~np.isnan(x)]
            some = len(x) > 0
            out |= {f"{c}_mean": x.mean() if some else None, f"{c}_std": x.std(ddof=1) if len(x) > 1 else None}
            out |= {f"{c}_min": x.min() if some else None, f"{c}_max": x.max() if some else None}
            if c in self.acts:
                out[f"__sum_{c}"] = float(x.sum())
            out[f"__q_{c}"] = np.quantile(x, QUANTILES).tolist() if some else None
        if self.labelled:
            out["anomaly_count"] = int(table[:, at["anomaly"]].sum())
        return out

    def schema(self, kinds: dict[str, str]) -> str:
        fields = [f"`{k}` {kinds[k]}" for k in self.keys] + ["n_records long", "n_missing long"]
        for c in self.cols:
            fields += [f"`{c}_{s}` double" for s in ("mean", "std", "min", "max")]
            fields += [f"`__sum_{c}` double"] if c in self.acts else []
            fields.append(f"`__q_{c}` array<double>")
        return ", ".join(fields + (["anomaly_count long"] if self.labelled else []))


def stream_features(rows: DataFrame, window: str = "weekly", by: Sequence[str] = (), delay: str = "2 days", **metadata: str) -> DataFrame:
    """``extract_features`` of a stream."""
    by, cols, acts, labelled = list(by), measure_columns(rows), activity_columns(rows), "anomaly_label" in rows.columns
    keys = [*by, "entity_id", "window_start"]
    at = rows.where(F.col("ts").isNotNull()).withColumn("__at", event_time()).withWatermark("__at", delay)
    missing, *anomaly = record_flags(rows, by)
    if window in FIXED:
        length, offset = FIXED[window]
        flags = [missing.alias("__missing"), *[a.alias("__anomaly") for a in anomaly]]
        records = at.select(*[F.col(f"`{c}`") for c in [*by, "entity_id", *cols]], "__at", *flags)
        days = records.groupBy(*by, "entity_id", F.window("__at", length, length, offset).alias("__window")).agg(*window_aggregates(cols, acts, labelled))
        return finished(days.withColumn("window_start", utc_wall_time("__window.start")).drop("__window"), by, cols, acts, labelled, metadata)
    processor = WindowFeatures(keys, cols, acts, labelled)
    start = window_floor("ts", window)
    ends = F.unix_millis(event_time(start + F.expr(LENGTHS[window])))
    flags = [missing.alias("missing"), *[a.cast("int").alias("anomaly") for a in anomaly]]
    records = at.select(*[F.col(f"`{c}`") for c in [*by, "entity_id", *cols]], start.alias("window_start"), ends.alias("end_ms"), "__at", *flags)
    kinds = {k: records.schema[k].dataType.simpleString() for k in keys}
    grouped = records.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.schema(kinds), outputMode="Append", timeMode="EventTime"
    )
    return finished(grouped, by, cols, acts, labelled, metadata)


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """The setting a query takes over when it starts; the session gets its own back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_stream(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that reads all files there are, writes what has closed to ``path``, and ends. Started again with the same ``checkpoint``
    it goes on with the files that came since."""
    with _state_store(result.sparkSession):
        writer = result.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that came too late, of all batches since the start."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
