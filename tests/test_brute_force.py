"""Neighbours, density clusters, scores and Ward merges against all-pairs numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paceline.operators import cluster, matrix, neighbours, scores

rng = np.random.default_rng(7)
BLOBS = np.vstack([
    rng.normal(0, 0.1, (400, 2)), rng.normal(3, 0.3, (200, 2)), rng.uniform(-4, 6, (80, 2)), np.zeros((60, 2)),
])


def frame(spark, x, labels=None):
    data = {"id": np.arange(len(x)), "features": [list(map(float, row)) for row in x]}
    df = spark.createDataFrame(pd.DataFrame(data), "id long, features array<double>")
    if labels is None:
        return df
    lab = spark.createDataFrame([(i, [int(v) for v in row]) for i, row in enumerate(zip(*labels))], "id long, labels array<int>")
    return df.join(lab, "id")


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))


def density(x, eps, m):
    near = distances(x) <= eps
    core, lab, c = near.sum(1) >= m, np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and lab[i] < 0:
            todo, lab[i] = [i], c
            while todo:
                for v in np.flatnonzero(near[todo.pop()] & core):
                    if lab[v] < 0:
                        lab[v] = c
                        todo.append(v)
            c += 1
    for i in np.flatnonzero(~core):
        owners = np.flatnonzero(near[i] & core)
        if len(owners):
            lab[i] = lab[owners].min()
    return lab


@pytest.fixture(scope="module")
def blobs(spark):
    df = frame(spark, BLOBS)
    return df, neighbours.build_cells(neighbours.distinct_points(df), rows_per_cell=32)


def test_knn_line(spark):
    got = neighbours.knn_distance(frame(spark, np.array([[0.0], [1.0], [3.0], [7.0]])), 2).orderBy("id").collect()
    assert [r.distance for r in got] == [1.0, 1.0, 2.0, 4.0]


def test_knn_blobs(blobs):
    df, cells = blobs
    got = neighbours.knn_distance(df, 6, cells=cells).orderBy("id").toPandas()["distance"].to_numpy()
    assert np.allclose(got, np.sort(distances(BLOBS), 1)[:, 5], atol=1e-9)


@pytest.mark.parametrize("eps,m", [(0.05, 5), (0.3, 8)])
def test_dbscan_blobs(blobs, eps, m):
    df, cells = blobs
    got = neighbours.dbscan(df, eps, m, cells=cells).orderBy("id").toPandas()["cluster"].to_numpy()
    assert (got == density(BLOBS, eps, m)).all()


def test_fewer_pivots_give_the_same_labels(spark):
    df = frame(spark, BLOBS)
    found = [
        neighbours.dbscan(df, 0.3, 8, cells=neighbours.build_cells(neighbours.distinct_points(df), rows_per_cell=16, max_pivots=m)).orderBy("id").toPandas()["cluster"].tolist()
        for m in (2, 64)
    ]
    assert found[0] == found[1] == density(BLOBS, 0.3, 8).tolist()


def test_one_search_serves_several_k(blobs):
    df, cells = blobs
    got = neighbours.knn_distances(df, [2, 70], cells=cells).orderBy("id").toPandas()
    for k in (2, 70):
        assert np.allclose(got[got["k"] == k]["distance"], np.sort(distances(BLOBS), 1)[:, k - 1], atol=1e-9)


def test_border_joins_lowest_cluster(spark):
    x = np.array([[0.0], [0.5], [1.0], [1.9], [2.8], [3.3], [3.8]])
    got = neighbours.dbscan(frame(spark, x), 1.0, 3).orderBy("id").toPandas()["cluster"].tolist()
    assert got == density(x, 1.0, 3).tolist()


def test_scores(spark):
    x = np.vstack([rng.normal(0, 1, (60, 3)), rng.normal(2, 1, (50, 3))])
    a, b = rng.integers(0, 3, 110), rng.integers(-1, 2, 110)
    a[0] = 3  # singleton
    df = frame(spark, x, [a, b])
    d = distances(x)
    for tile in (32_768, 24):
        got = {r.config: r.silhouette for r in scores.silhouette(df, tile_rows=tile).collect()}
        for c, lab in enumerate((a, b)):
            keep, s = lab >= 0, []
            for i in np.flatnonzero(keep):
                own = (lab == lab[i]).sum()
                other = min(d[i, lab == o].mean() for o in set(lab[keep]) - {lab[i]})
                inner = d[i, lab == lab[i]].sum() / max(own - 1, 1)
                s.append(0.0 if own == 1 else (other - inner) / max(other, inner))
            assert got[c] == pytest.approx(np.mean(s), abs=1e-9)


def test_single_cluster_is_not_scored(spark):
    df = frame(spark, BLOBS[:20], [np.zeros(20, int)])
    assert scores.score_all(df).count() == 0


def test_ward_matches_naive_merging():
    y = rng.normal(0, 1, (30, 3))
    merges = cluster.ward_merges(y, np.ones(30))
    groups = [[i] for i in range(30)]

    def cost(p, q):
        return len(p) * len(q) / (len(p) + len(q)) * ((y[p].mean(0) - y[q].mean(0)) ** 2).sum()

    while len(groups) > 4:
        _, i, j = min((cost(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        groups[i] += groups.pop(j)
    labels = np.array(cluster._cut_tree(30, merges, 4))
    assert {frozenset(np.flatnonzero(labels == c)) for c in set(labels)} == {frozenset(g) for g in groups}


def test_two_blobs_agree(spark):
    x = np.vstack([rng.normal(0, 0.1, (50, 2)), rng.normal(5, 0.1, (50, 2))])
    df = frame(spark, x)
    truth = np.repeat([0, 1], 50)
    found = [cluster.kmeans(df, 2, restarts=2), cluster.gmm(df, 2), cluster.ward_grid(df, (2,))[2], cluster.ward_grid(df, (2,), micro=8)[2]]
    for labels in found:
        got = labels.orderBy("id").toPandas()["cluster"].to_numpy()
        assert (got == truth).all() or (got == 1 - truth).all()


def test_pca_matches_eigenvectors(spark):
    x = rng.normal(0, 1, (200, 4)) @ np.diag([3.0, 2.0, 1.0, 0.5])
    x -= x.mean(0)
    got = matrix.pca(frame(spark, x), list("abcd"))
    values, vectors = np.linalg.eigh(np.cov(x.T))
    top = vectors[:, ::-1][:, :2]
    top = top * np.sign(top[np.abs(top).argmax(0), [0, 1]])
    assert np.allclose(got.components, top, atol=1e-8)
    assert got.explained == pytest.approx(tuple(values[::-1][:2] / values.sum()))
    scores_ = got.projection.orderBy("id").toPandas()[["pc1", "pc2"]].to_numpy()
    assert np.allclose(scores_, x @ top, atol=1e-8)


def test_partitioning_does_not_change_ratios(spark, sf):
    from paceline import catalog

    h = catalog.hourly(spark, sf)
    from paceline.operators.features import extract_features

    r = extract_features(h.repartition(3), "weekly").where("ratio_eat IS NOT NULL")
    off = r.select(F.max(F.abs(F.expr("ratio_ruminate + ratio_eat + ratio_graze + ratio_rest + ratio_walk - 1")))).first()[0]
    assert off < 1e-9
