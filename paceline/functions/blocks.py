"""Distances between bounded blocks of rows, distributed by Spark.

``tile_apply`` lets every row meet every other row once: rows are hashed into tiles, a task gets two tiles and emits per-row sums only
(theta-join by tiling, Okcan & Riedewald 2011). For measures that are quadratic by definition; searches use ``tree``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_ROWS = 32_768
CHUNK_ROWS = 4_096
STRIP = 256  # rows of a distance matrix held at once


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def stack(values: pd.Series) -> np.ndarray:
    return np.vstack(values.to_numpy()).astype(np.float64, copy=False)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances by one matrix product."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0, out=d)


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Boolean distance <= eps; pairs too close to call by the product form are recomputed exactly."""
    d = squared(a, b)
    e2 = eps * eps
    out = d <= e2
    size = max(float((a * a).sum(1).max(initial=0.0)), float((b * b).sum(1).max(initial=0.0)), e2)
    i, j = np.nonzero(np.abs(d - e2) <= 1e-9 * size)
    if len(i):
        for s in range(0, len(i), 65_536):
            p, q = i[s : s + 65_536], j[s : s + 65_536]
            diff = a[p] - b[q]
            out[p, q] = np.sqrt((diff * diff).sum(1)) <= eps
    return out


def tile_apply(
    df: DataFrame,
    key: str,
    rows: int,
    fn: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame],
    schema: str,
    by: Sequence[str] = (),
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Calls ``fn(a, b, same)`` once for every unordered pair of tiles.

    ``rows`` sizes the tiles; the hash of the unique ``key`` spreads rows evenly, so
    a task never holds more than about two tiles. ``by`` restricts pairs to equal keys.
    """
    n = max(1, -(-rows // tile_rows))
    tiled = df.withColumn("__t", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))
    spread = tiled.withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumns(
        {"__lo": F.least("__t", "__o"), "__hi": F.greatest("__t", "__o")}
    )

    names = _names(schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["__lo"].iloc[0], pdf["__hi"].iloc[0]
        if lo == hi:
            return fn(pdf, pdf, True)
        a, b = pdf[pdf["__t"] == lo], pdf[pdf["__t"] == hi]
        if a.empty or b.empty:
            return pd.DataFrame(columns=names)
        return fn(a, b, False)

    return spread.drop("__o").groupBy(*by, "__lo", "__hi").applyInPandas(run, schema)
