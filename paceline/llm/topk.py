"""Exact top-k search by inner product: one ball tree per shard, branch and bound with shared k-th scores.

Vectors are quantized to integers, dealt by hash into shards of about SHARD_ROWS rows, queries into blocks of about
QUERY_BLOCK rows; each pair of a shard and a block is one task-sized group. The SEEDS candidates of the largest
norm give every query a first k-th score, which travels with the query to all shards. In a shard, a ball tree is
searched depth first, the child with the larger upper bound ``q.c + |q| r`` first; a branch is cut for every query
whose current k-th score lies above its bound. Bounds are rounded up, scores are exact integers.

Defined results: vectors that are null, or hold a null or non-finite component, take no part, nor do rows without an
id. Only vectors of equal length are compared. Rows with the query's id count as its own. Ties go to the smaller id;
repeated rows appear as often as they occur. With fewer than k candidates all are returned; an empty table gives an empty result.
Extra columns are ignored. Products are exact while length times the largest squared component stays below 2^63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.session import cut

SHARD_ROWS = 32_768
QUERY_BLOCK = 8_192
LEAF = 256
SEEDS = 1_024
SCORES = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part; ``v`` is ``floor(scale * x)`` of each component."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


def is_query(every: int) -> Column:
    return F.col("vec_id") % every == 0


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles where those are exact."""
    most = max(int(np.abs(q).max(initial=0)), 1) * max(int(np.abs(v).max(initial=0)), 1) * max(q.shape[1], 1)
    if most < 1 << 53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        raise ValueError("inner products exceed 64-bit integers")
    return q @ v.T


class Best:
    """The k best candidates so far of each query, and its k-th score."""

    def __init__(self, own: np.ndarray, kth: np.ndarray, k: int) -> None:
        self.own, self.kth, self.k = own, kth.copy(), k
        self.rows = np.zeros((0, 3), np.int64)  # query position, -score, id

    def add(self, active: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        i, j = np.nonzero((scores >= self.kth[active][:, None]) & (self.own[active][:, None] != ids[None, :]))
        if not len(i):
            return
        rows = np.concatenate([self.rows, np.stack([active[i], -scores[i, j], ids[j]], axis=1)])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
        place = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        self.rows = rows[place < self.k]
        full = rows[place == self.k - 1]
        self.kth[full[:, 0]] = np.maximum(self.kth[full[:, 0]], -full[:, 1])


class BallTree:
    """Median splits along the widest axis, down to LEAF vectors."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> None:
        self.ids, self.v, self.leaf = ids, v, leaf
        self.x = v.astype(np.float64)
        self.nodes: list[tuple[np.ndarray, np.ndarray, float, int, int]] = []
        self._grow(np.arange(len(ids)))

    def _grow(self, at: np.ndarray) -> int:
        here = len(self.nodes)
        x = self.x[at]
        centre = x.mean(axis=0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
        self.nodes.append((at, centre, radius, -1, -1))
        if len(at) > self.leaf:
            axis = int(np.ptp(x, axis=0).argmax())
            order = at[np.argsort(x[:, axis], kind="stable")]
            half = len(order) // 2
            left, right = self._grow(order[:half]), self._grow(order[half:])
            self.nodes[here] = (at[:0], centre, radius, left, right)
        return here

    def search(self, q: np.ndarray, best: Best) -> None:
        x = q.astype(np.float64)
        norms = np.sqrt((x * x).sum(axis=1))

        def bound(node: int, active: np.ndarray) -> np.ndarray:
            _, centre, radius, _, _ = self.nodes[node]
            ub = x[active] @ centre + norms[active] * radius
            return ub + 1e-9 * (np.abs(ub) + norms[active] * (radius + np.sqrt(centre @ centre)) + 1)

        stack = [(0, np.arange(len(q)), bound(0, np.arange(len(q))))]
        while stack:
            node, active, ub = stack.pop()
            active = active[ub >= best.kth[active]]  # the k-th scores may have risen meanwhile
            if not len(active):
                continue
            at, _, _, left, right = self.nodes[node]
            if left < 0:
                best.add(active, self.ids[at], products(q[active], self.v[at]))
            else:
                sides = [(n, active, bound(n, active)) for n in (left, right)]
                stack += sorted(sides, key=lambda s: s[2].sum())


def _lengths(v: pd.Series) -> np.ndarray:
    return np.array([len(x) for x in v], dtype=np.int64)


def search_group(cands: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of every query, from the candidates of one shard."""
    out = []
    if len(cands) and len(queries):
        have, want = _lengths(cands["v"]), _lengths(queries["v"])
        for d in np.unique(want):
            c, q = cands[have == d], queries[want == d]
            if not len(c):
                continue
            own = q["vec_id"].to_numpy()
            best = Best(own, q["kth"].to_numpy(), k)
            BallTree(c["vec_id"].to_numpy(), np.stack(c["v"].to_list()).astype(np.int64)).search(np.stack(q["v"].to_list()).astype(np.int64), best)
            out.append(pd.DataFrame({"query_id": own[best.rows[:, 0]], "vec_id": best.rows[:, 2], "score": -best.rows[:, 1]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, seeds: int = SEEDS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows for every row whose id is divisible by ``every``."""
    rows = cut(quantized(vectors))
    asked = rows.where(is_query(every))
    n, n_asked = rows.count(), asked.count()
    shards, blocks = -(-n // shard_rows) or 1, -(-n_asked // query_block) or 1
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x.cast("double"))
    first = rows.orderBy(norm.desc(), "vec_id").limit(seeds).toPandas()  # at most ``seeds`` rows
    lowest = np.iinfo(np.int64).min

    def seeded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kth = np.full(len(pdf), lowest)
            have, want = _lengths(first["v"]), _lengths(pdf["v"])
            for d in np.unique(want):
                c, at = first[have == d], np.nonzero(want == d)[0]
                if len(c) > k:
                    ids = c["vec_id"].to_numpy()
                    best = Best(pdf["vec_id"].to_numpy()[at], kth[at], k)
                    q, v = np.stack(pdf["v"].iloc[at].to_list()), np.stack(c["v"].to_list())
                    for s in range(0, len(at), 1024):
                        active = np.arange(s, min(s + 1024, len(at)))
                        best.add(active, ids, products(q[active], v))
                    kth[at] = best.kth
            yield pdf.assign(kth=kth)

    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every_one = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("vec_id", "v", deal(shards).alias("shard"), every_one(blocks).alias("block"))
    asked = asked.mapInPandas(seeded, "vec_id long, v array<long>, kth long")
    right = asked.select("vec_id", "v", "kth", deal(blocks).alias("block"), every_one(shards).alias("shard"))
    pairs = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    found = pairs.applyInPandas(lambda c, q: search_group(c, q, k), SCORES)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
