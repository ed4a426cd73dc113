"""Whole analyses: feature branches, source audit, PCA and clustering per slice, global summary."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.model import FEATURE_KEYS, FEATURE_SETS, SourceSpec
from paceline.operators import cluster, interpret, profile, rollup
from paceline.operators.cleaning import null_where
from paceline.operators.features import extract_features
from paceline.operators.master import union_features
from paceline.operators.matrix import PcaResult, eta_squared, feature_columns, fit_scale, pca, require_set, top_loadings
from paceline.session import cut, side_by_side
from paceline.sources.tables import path_exists, read_activity

log = logging.getLogger(__name__)

SPACES = ("scaled", "pca")


def branch_features(
    spark: SparkSession, specs: Sequence[SourceSpec], window: str = "weekly", uncovered: Sequence[str] = (), **options
) -> DataFrame:
    """Window features of all sources of a branch; ``uncovered`` datasets have no event coverage."""
    parts = []
    for spec in specs:
        df = read_activity(spark, spec, **options).drop("dataset", "system")
        parts.append(extract_features(
            df, window, dataset=spec.dataset, system=spec.system, resolution=spec.resolution, scale_type=spec.scale_type
        ))
    out = union_features(parts)
    anomaly = [c for c in ("anomaly_count", "anomaly_rate") if c in out.columns]
    return null_where(out, F.col("dataset").isin(*uncovered), anomaly) if uncovered and anomaly else out


def audit(activity: DataFrame) -> DataFrame:
    """Profile and resolution class of every source of a union with a ``dataset`` column."""
    shape = profile.profile(activity, by=["dataset"]).select("dataset", "rows", "entities", "frequency")
    classes = rollup.classify_resolution(rollup.audit_rollup(activity, by=["dataset"]), ["dataset"])
    return shape.join(classes, "dataset", "left")


def keyed(features: DataFrame) -> DataFrame:
    """Feature table with one sortable row key ``id`` made of its four key columns.

    A backslash marks a bar inside a key, and stands alone for a missing key, so different keys never meet.
    """
    parts = [F.coalesce(F.regexp_replace(F.col(k).cast("string"), r"([\\|])", r"\\$1"), F.lit("\\")) for k in FEATURE_KEYS]
    return features.withColumn("id", F.concat_ws("|", *parts))


def feature_matrix(features: DataFrame, feature_set: str) -> tuple[DataFrame, list[str]]:
    """``(id, keys, features)`` imputed and scaled, and the names of the matrix columns."""
    columns = feature_columns(features, feature_set)
    model = fit_scale(features, columns)
    keep = [c for c in ("id", *FEATURE_KEYS, "resolution", "scale_type") if c in features.columns]
    return model.features(features, keep), list(model.columns)


def eta_table(projection: DataFrame, components: Sequence[str] = ("pc1", "pc2"), groups: Sequence[str] = ("system", "dataset")) -> DataFrame:
    return union_features([eta_squared(projection, components, g) for g in groups])


def analyze_pca(features: DataFrame, feature_set: str) -> tuple[PcaResult, DataFrame]:
    """Projection, loadings and explained variance, plus a one-row summary with the eta verdict."""
    matrix, names = feature_matrix(keyed(features), feature_set)
    matrix = cut(matrix)
    result = pca(matrix, names)
    eta = {(r["value"], r["grouping"]): r["eta_squared"] for r in eta_table(result.projection).collect()}
    summary = profile.branch_summary(features).withColumns({
        "feature_set": F.lit(feature_set), "n_features": F.lit(len(names)),
        "explained_pc1": F.lit(result.explained[0]), "explained_pc2": F.lit(result.explained[1]),
        **{f"eta_{g}": F.lit(eta[("pc1", g)]).cast("double") for g in ("system", "dataset")},
        **{f"eta_{g}_pc2": F.lit(eta[("pc2", g)]).cast("double") for g in ("system", "dataset")},
    })
    return result, interpret.eta_verdict(summary)


def pca_by_resolution(features: DataFrame, feature_set: str, resolutions: Mapping[str, Sequence[str]]) -> dict[str, PcaResult]:
    """PCA of each named group of datasets; groups without rows are skipped."""
    out = {}
    for name, datasets in resolutions.items():
        part = features.where(F.col("dataset").isin(*datasets))
        if part.limit(1).count() == 0:
            log.warning("no rows for %s, skipped", name)
            continue
        out[name] = analyze_pca(part, feature_set)[0]
    return out


def cluster_space(points: DataFrame, meta: DataFrame, **grid) -> tuple[DataFrame, DataFrame | None]:
    """Metric table of a space and, if a configuration was scored, its best row with relations and purity.

    ``meta`` has ``id, dataset, system, entity_id``.
    """
    result = cluster.evaluate_grid(points, **grid)
    best = cluster.best_config(result.metrics)
    row = best.first()
    if row is None:
        return result.metrics, None
    labelled = cut(meta.join(cluster.labels_of(result, row["config"]), "id"))
    tables = {}
    for g in ("system", "dataset"):
        long = interpret.contingency(labelled, g)
        rel = interpret.relation_strength(long).select(F.struct("relation", "min_share").alias("r")).scalar()
        cells = long.agg(F.array_sort(F.collect_list(F.struct("cluster", "category", "n"))).alias("c")).scalar()
        tables[f"relation_{g}"], tables[f"contingency_{g}"] = rel, cells
    purity = interpret.mean_purity(interpret.entity_purity(labelled)).scalar()
    rows = points.agg(F.count("*").alias("n")).scalar()
    best = interpret.degenerate_flag(best.withColumn("n_rows", rows), F.col("n_rows"))
    # one row, written out so that its subqueries run once however often it is read
    return result.metrics, cut(best.withColumns({**tables, "mean_purity": purity}))


def analyze_slice(features: DataFrame, branch: str, feature_set: str, spaces: Sequence[str] = SPACES, **grid) -> tuple[DataFrame, DataFrame]:
    """All spaces of one (branch, feature set): metric rows and best rows, stamped with slice and space."""
    require_set(feature_set)
    matrix, names = feature_matrix(keyed(features), feature_set)
    matrix = cut(matrix)
    projected = pca(matrix, names)
    meta = matrix.select("id", "dataset", "system", "entity_id")
    frames = {
        "scaled": matrix.select("id", "features"),
        "pca": projected.projection.select("id", F.array("pc1", "pc2").alias("features")),
    }
    top = top_loadings(projected.loadings)
    loads = interpret.loading_summary(top).select(F.struct("base_variables", "top_variable", "top_loading", "sign").alias("l")).scalar()
    metrics, bests = [], []
    for space in spaces:
        stamp = {"branch": F.lit(branch), "feature_set": F.lit(feature_set), "space": F.lit(space)}
        m, best = cluster_space(frames[space], meta, **grid)
        metrics.append(m.withColumns(stamp))
        if best is not None:
            bests.append(best.withColumns({**stamp, "loadings": loads}))
        else:
            log.warning("%s/%s/%s: no configuration with two clusters", branch, feature_set, space)
    return union_features(metrics), (union_features(bests) if bests else None)


def analyze_slices(
    branches: Mapping[str, DataFrame], feature_sets: Sequence[str] = FEATURE_SETS, spaces: Sequence[str] = SPACES, parallel: int = 6, **grid
) -> DataFrame:
    """Best rows of every branch and feature set. Slices do not depend on each other, so several run side by side."""
    one = lambda branch, kind: analyze_slice(branches[branch], branch, kind, spaces=spaces, **grid)[1]
    found = side_by_side([partial(one, branch, kind) for branch in branches for kind in feature_sets], parallel)
    return union_features([best for best in found if best is not None])


def analyze_clusters(features: DataFrame, branch: str, feature_set: str, ks: Sequence[int] = cluster.K_RANGE, **grid):
    """The base analysis: scaled space only, no density clustering, unscored configurations left out."""
    metrics, best = analyze_slice(
        features, branch, feature_set, spaces=["scaled"], algorithms=("kmeans", "agglomerative", "gmm"), ks=ks, **grid
    )
    return metrics.where("n_clusters >= 2"), best


def global_summary(bests: DataFrame, space: str = "pca") -> DataFrame:
    """One row per (branch, feature set): best configuration of a space, rounded, with its relations."""
    chosen = bests.where(F.col("space") == space)
    rel, share = F.col("relation_system.relation"), F.col("relation_system.min_share")
    return chosen.select(
        "branch", "feature_set", "space", F.format_string("%s (%s)", "algorithm", "params").alias("configuration"), "n_clusters",
        F.round("silhouette", 3).alias("silhouette"), F.round("davies_bouldin", 3).alias("davies_bouldin"),
        F.round("calinski_harabasz", 1).alias("calinski_harabasz"), rel.alias("relation_system"),
        F.col("relation_dataset.relation").alias("relation_dataset"), interpret.interpretation(rel, share).alias("interpretation"),
    )


def consolidate(spark: SparkSession, path: str) -> DataFrame | None:
    """All slice results written so far; None (with a warning) if there are none yet."""
    if not path_exists(spark, path):
        log.warning("no slice results under %s", path)
        return None
    return spark.read.parquet(path)
