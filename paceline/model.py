"""Vocabulary of the data model: column roles, fixed labels, source specs."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: they name columns and labels of the input files ------------
# minutes spent per behaviour, and one count
ACTIVITY = ("ruminate", "eat", "graze", "rest", "walk")
COUNT_COLUMN = "steps"
MEASURES = ACTIVITY + (COUNT_COLUMN,)

UNLABELLED = "unlabelled"
# labels that do not mark an anomaly
NORMAL_LABELS = (UNLABELLED, "Sin etiqueta", "No anomaly", "No Anomaly", "None", "")

# input header -> canonical column
HEADER_NAMES = {
    "Cow_id": "entity_id",
    "cow_id": "entity_id",
    "Ruminate": "ruminate",
    "Eat": "eat",
    "Graze": "graze",
    "Rest": "rest",
    "Walk": "walk",
    "Steps": "steps",
    "Anomaly_Label": "anomaly_label",
    "Description": "description",
}
EVENT_HEADER_NAMES = {"official_tag": "entity_id", "date": "event_date", "event": "event_type"}
TIME_HEADERS = ("Date", "Time")  # in order of preference

STATISTICS = ("mean", "std", "min", "max", "median", "p10", "p90", "iqr", "cv")
FEATURE_KEYS = ("dataset", "system", "entity_id", "window_start")
# never inputs of PCA or clustering
FEATURE_METADATA = (
    "dataset", "system", "entity_id", "window_start", "resolution", "scale_type",
    "n_records", "n_missing", "anomaly_count", "anomaly_rate",
)
# which features go into PCA and clustering together
FEATURE_SET_COLUMNS = {
    "absolute": tuple(f"{m}_{s}" for m in MEASURES for s in STATISTICS),
    "ratios": tuple(f"ratio_{a}" for a in ACTIVITY),
    "absolute_no_count": tuple(f"{a}_{s}" for a in ACTIVITY for s in STATISTICS),
}
FEATURE_SETS = tuple(FEATURE_SET_COLUMNS)
# ------------------------------------------------------------------------------


@dataclass(frozen=True)
class SourceSpec:
    """Where one activity table lies and which metadata its rows carry."""

    path: str
    dataset: str
    system: str
    resolution: str = "unknown"
    scale_type: str = "unknown"


@dataclass(frozen=True)
class ResolutionBands:
    """Closed bands (minutes) that tell daily totals from hourly means."""

    min_hourly_records: float = 12.0
    daily: tuple[float, float] = (800.0, 1440.0)
    hourly_scale: tuple[float, float] = (20.0, 60.0)
