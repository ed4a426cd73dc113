"""Column expressions on texts that several operators share. All JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df: DataFrame, *fields: Column) -> DataFrame:
    """``df`` with the fields appended. They are generated, so no later filter or
    projection makes the optimiser evaluate them again."""
    return df.select("*", F.inline(F.array(F.struct(*fields))))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lines(text: Column) -> Column:
    return F.split(or_empty(text), "\n")


def words(text: Column) -> Column:
    r"""Maximal runs of characters other than ``[\x20\x09-\x0D]``; none for a null text."""
    return F.array_remove(F.split(or_empty(text), SPACES), "")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(or_empty(text), SPACES, "")).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
