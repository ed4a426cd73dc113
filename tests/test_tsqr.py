"""Principal components by a tree of QR factorisations."""

import numpy as np
import pytest

from paceline.operators import matrix, tsqr
from test_brute_force import frame

rng = np.random.default_rng(8)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_factor_of_many_partitions(spark, fan_in, monkeypatch):
    monkeypatch.setattr(tsqr, "FAN_IN", fan_in)
    monkeypatch.setattr(tsqr, "BLOCK", 7)
    x = rng.normal(3, 2, (150, 4)) @ rng.normal(0, 1, (4, 4))
    r = tsqr.centred_factor(frame(spark, x).repartition(9))
    c = x - x.mean(0)
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-10) and np.allclose(r, np.triu(r))


def test_nearly_collinear_columns_keep_their_digits(spark):
    """Two columns that differ by a ten-millionth: products of the columns cannot tell, the factor can."""
    a, b = rng.normal(0, 1, 400), rng.normal(0, 1, 400)
    x = np.stack([a, a + 1e-9 * b], 1)
    got = matrix.pca(frame(spark, x), ["a", "b"])
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert got.explained[1] == pytest.approx(s[1] ** 2 / (s**2).sum(), rel=1e-3) and got.explained[1] < 1e-17
    by_products = np.linalg.eigvalsh(np.cov(x.T))[0] / np.cov(x.T).trace()
    assert abs(by_products / got.explained[1] - 1) > 0.5


def test_subsets_come_from_one_factor(spark):
    x = rng.normal(0, 1, (120, 5)) @ np.diag([4.0, 1, 2, 0.5, 3])
    names = list("abcde")
    found = matrix.pca_sets(frame(spark, x), names, {"all": names, "some": ["d", "a", "c"]})
    alone = matrix.pca(frame(spark, x[:, [3, 0, 2]]), ["d", "a", "c"])
    assert np.allclose(found["some"].components, alone.components) and found["some"].explained == pytest.approx(alone.explained)
    p, q = (r.projection.orderBy("id").toPandas()[["pc1", "pc2"]].to_numpy() for r in (found["some"], alone))
    assert np.allclose(p, q)


def test_fewer_rows_than_columns(spark):
    x = rng.normal(0, 1, (3, 5))
    got = matrix.pca(frame(spark, x), list("abcde"))
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert got.explained == pytest.approx(tuple(s[:2] ** 2 / (s**2).sum()))
