"""Feature selection, imputation, scaling, PCA and explained group variance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.columns import present
from paceline.functions.quantiles import exact_quantiles
from paceline.model import FEATURE_KEYS, FEATURE_SET_COLUMNS, FEATURE_SETS
from paceline.operators.tsqr import centred_factor, principal


def feature_columns(df: DataFrame, feature_set: str) -> list[str]:
    """The declared columns of a set, as far as the table has them."""
    require_set(feature_set)
    return present(df, FEATURE_SET_COLUMNS[feature_set])


def require_set(feature_set: str) -> None:
    if feature_set not in FEATURE_SET_COLUMNS:
        raise ValueError(f"unknown feature set {feature_set!r}; choose one of {FEATURE_SETS}")


@dataclass(frozen=True)
class ScaleModel:
    """Per-column median, mean and population deviation: a handful of numbers per column."""

    columns: tuple[str, ...]
    dropped: tuple[str, ...]
    median: tuple[float, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]

    def _filled(self) -> dict[str, str]:
        return {c: f"coalesce(cast(`{c}` AS DOUBLE), {m!r}D)" for c, m in zip(self.columns, self.median)}

    def _scaled(self) -> dict[str, str]:
        filled = self._filled()
        return {c: f"({filled[c]} - {mu!r}D) / {sd!r}D" for c, mu, sd in zip(self.columns, self.mean, self.std)}

    def _replace(self, df: DataFrame, exprs: dict[str, str]) -> DataFrame:
        kept = [c for c in df.columns if c not in self.dropped]
        return df.selectExpr(*[f"{exprs[c]} AS `{c}`" if c in exprs else f"`{c}`" for c in kept])

    def impute(self, df: DataFrame) -> DataFrame:
        return self._replace(df, self._filled())

    def standardize(self, df: DataFrame) -> DataFrame:
        return self._replace(df, self._scaled())

    def features(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``(*keep, features array<double>)`` in scaled space."""
        return df.selectExpr(*[f"`{k}`" for k in keep], f"array({', '.join(self._scaled().values())}) AS features")


def fit_scale(df: DataFrame, columns: Sequence[str]) -> ScaleModel:
    """Exact medians, then the moments of the imputed columns, without a second imputed pass.

    Filling m gaps with the median shifts mean and spread in a known way, so both
    follow from the moments of the present values. Columns without any value are dropped.
    """
    columns = list(columns)
    moments = df.agg(
        F.count("*").alias("__rows"),
        *[
            F.expr(f"struct(count(`{c}`) AS n, avg(cast(`{c}` AS DOUBLE)) AS mu, var_pop(cast(`{c}` AS DOUBLE)) AS var) AS `{c}`")
            for c in columns
        ],
    ).first()
    medians = {r["variable"]: r["q"][0] for r in exact_quantiles(df, [], columns, [0.5]).collect()}
    rows = moments["__rows"]
    kept, med, mean, std = [], [], [], []
    for c in columns:
        if c not in medians:
            continue
        n, mu, var = moments[c]["n"], moments[c]["mu"], moments[c]["var"]
        gaps, m = rows - n, medians[c]
        centre = (n * mu + gaps * m) / rows
        spread = (n * var + n * (mu - centre) ** 2 + gaps * (m - centre) ** 2) / rows
        kept.append(c)
        med.append(float(m))
        mean.append(float(centre))
        # rounding noise of a constant column must not become a divisor
        std.append(float(np.sqrt(spread)) if spread > 1e-20 * max(1.0, centre * centre) else 1.0)
    return ScaleModel(tuple(kept), tuple(c for c in columns if c not in kept), tuple(med), tuple(mean), tuple(std))


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fit_scale(df, columns).impute(df)


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median imputation, then zero mean and unit population deviation."""
    return fit_scale(df, columns).standardize(df)


@dataclass(frozen=True)
class PcaResult:
    projection: DataFrame  # keep columns + pc1..pck
    loadings: DataFrame  # variable, pc1, pc2, abs_pc1, abs_pc2
    explained: tuple[float, ...]
    components: np.ndarray  # (variables, k)


def pca(df: DataFrame, names: Sequence[str], k: int = 2, features: str = "features") -> PcaResult:
    """Principal components of a ``features`` column, from its QR factor; signs are fixed: the largest loading is positive."""
    return pca_sets(df, names, {"": names}, k, features)[""]


def pca_sets(df: DataFrame, names: Sequence[str], sets: Mapping[str, Sequence[str]], k: int = 2, features: str = "features") -> dict[str, PcaResult]:
    """Principal components of several subsets of the columns ``names`` from one pass: a subset's factor is that of its columns of the whole triangle.

    The projection is a dot product with the (variables x k) loadings.
    """
    factor = centred_factor(df, features)
    return {name: _components(df, columns, [list(names).index(c) for c in columns], factor, k, features) for name, columns in sets.items()}


def _components(df: DataFrame, names: Sequence[str], at: Sequence[int], factor: np.ndarray, k: int, features: str) -> PcaResult:
    pc, explained = principal(factor[:, list(at)], k)
    keep = [c for c in df.columns if c != features]
    # plain products stay inside whole-stage codegen
    coords = [
        " + ".join(f"`{features}`[{i}] * {float(w)!r}D" for i, w in zip(at, pc[:, j])) + f" AS pc{j + 1}"
        for j in range(pc.shape[1])
    ]
    projection = df.selectExpr(*[f"`{c}`" for c in keep], *coords)
    rows = [
        (name, *[float(pc[i, j]) for j in range(k)], *[abs(float(pc[i, j])) for j in range(k)])
        for i, name in enumerate(names)
    ]
    schema = ", ".join(
        ["variable string"] + [f"pc{j + 1} double" for j in range(k)] + [f"abs_pc{j + 1} double" for j in range(k)]
    )
    return PcaResult(projection, df.sparkSession.createDataFrame(rows, schema), explained, pc)


def with_features(projection: DataFrame, features: DataFrame) -> DataFrame:
    """The projection with the feature columns of the same entity-window; keys may be missing."""
    right = features.select(F.struct(*features.columns).alias("__f"))
    same = F.lit(True)
    for k in FEATURE_KEYS:
        same = same & projection[k].eqNullSafe(F.col(f"__f.{k}"))
    rest = [F.col(f"__f.{c}") for c in features.columns if c not in projection.columns]
    return projection.join(right, same, "left").select(*projection.columns, *rest)


def top_loadings(loadings: DataFrame, component: int = 1, k: int = 5) -> DataFrame:
    """The k variables with the largest absolute loading on one component."""
    name = f"pc{component}"
    return loadings.orderBy(F.col(f"abs_{name}").desc(), "variable").limit(k).select("variable", F.col(name).alias("loading"))


def eta_squared(df: DataFrame, values: str | Sequence[str], group: str) -> DataFrame:
    """Share of the variance of each value between the groups ``(value, grouping, eta_squared)``.

    One grouped pass for all values; only the per-group moments are merged afterwards.
    A NULL group counts in the total only; no variance at all gives NULL.
    """
    values = [values] if isinstance(values, str) else list(values)
    moments = [F.expr(f"struct(count(`{v}`) AS n, avg(`{v}`) AS mu, var_pop(`{v}`) AS var) AS `{v}`") for v in values]
    pairs = ", ".join(f"'{v}', `{v}`" for v in values)
    parts = df.groupBy(F.col(group).alias("__g")).agg(*moments).selectExpr(
        "__g", f"stack({len(values)}, {pairs}) AS (value, s)"
    ).where("s.n > 0")
    w = Window.partitionBy("value")
    grand = F.sum(F.expr("s.n * s.mu")).over(w) / F.sum("s.n").over(w)
    merged = parts.withColumn("between", F.col("s.n") * F.pow(F.col("s.mu") - grand, F.lit(2)))
    sums = merged.groupBy("value").agg(
        F.expr("sum(s.n * s.var + between) AS total"), F.expr("coalesce(sum(if(__g IS NOT NULL, between, NULL)), 0.0D) AS between")
    )
    return sums.select(
        "value", F.lit(group).alias("grouping"),
        F.when(F.col("total") > 0, F.col("between") / F.col("total")).alias("eta_squared"),
    )


def to_array(df: DataFrame, vector: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, vector_to_array(vector))
