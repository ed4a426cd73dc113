"""paceline: activity-series analytics as Spark DataFrame operators."""

from paceline.model import SourceSpec
from paceline.session import get_spark

__all__ = ["SourceSpec", "get_spark"]
