r"""SimHash near-duplicates by vantage-point trees over fingerprints.

Equal fingerprints collapse first. A tree then partitions the distinct ones by Hamming distance: each level measures
distance to its vantage fingerprint over its own block of bits. Blocks do not overlap, so the differences of two fingerprints' distances along a
path add up to at most their Hamming distance: the search radius is one budget for the whole path, and a branch is pruned once the
triangle bounds have used it up. Eight levels take eight bits each; below them single bits go on until any crowd is apart.

Tree nodes with more than SHARD_ROWS fingerprints are split, counting only (no fingerprints are gathered); the leaves are the shards. Every
fingerprint is a member of its own shard and visits the other shards its ball overlaps (only those behind its own in order, so that a pair
meets once). A task streams a shard: members are held (bounded), visitors pass by in batches. In the shard the same tree
goes on. Linked members join at once, and one link per visitor and joined group is returned, so a crowd of near copies costs links in proportion to its rows.

A fingerprint bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the shingles, repeats included.

Defined results: a null text or one without words has fingerprint zero, which links like any other. Fewer words than a shingle: the whole sequence.
Rows with equal ids are one document per fingerprint. A null id never names a component unless all its ids are null. An empty table gives an empty result. Extra columns pass through in ``keep_one``,
which decides row by row: of each component one row stays, whatever ids it shares with rows of other components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.text import free_name
from paceline.session import cut

SHINGLE = 3
RADIUS = 2
SEED = 42
SHARD_ROWS = 4_096
#: The tree has at most about this many shards: above SHARD_ROWS times as many fingerprints the shards grow instead.
MAX_SHARDS = 100_000
SAMPLE = 1_024
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b" " * 5)
_BIT_ROWS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().translate(_FOLD).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    hashes = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)]
    lanes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BIT_ROWS for k in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``fp``, which holds the 64 bits as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, shingle) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pdf[list(keep)].assign(fp=fps)

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInPandas(run, f"{kinds}, fp long")


class Levels:
    """The tree's levels: a bit mask and a vantage fingerprint each."""

    def __init__(self, sample: np.ndarray) -> None:
        eights = [np.uint64(0xFF) << np.uint64(8 * i) for i in range(8)]
        ones = [np.uint64(1) << np.uint64(i) for i in range(64)]
        self.masks = np.array([*eights, *ones], dtype=np.uint64)
        self.vantage = np.zeros(len(self.masks), dtype=np.uint64)
        tried = sample[:32] if len(sample) else np.zeros(1, np.uint64)
        for i in range(8):  # the vantage with the widest spread of distances
            spread = [np.bitwise_count((sample ^ v) & self.masks[i]).var() if len(sample) else 0.0 for v in tried]
            self.vantage[i] = tried[int(np.argmax(spread))]

    def __len__(self) -> int:
        return len(self.masks)

    def ring(self, level: int, fps: np.ndarray) -> np.ndarray:
        return np.bitwise_count((fps ^ self.vantage[level]) & self.masks[level]).astype(np.int64)

    @staticmethod
    def renewed(level: int) -> bool:
        """The budget starts anew where the single bits begin: they overlap the blocks above."""
        return level == 8


def child(codes: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Name of the child node in a ring. Names are hashes: if two nodes ever share one, they share a shard, and nothing is lost."""
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ring.astype(np.uint64) + np.uint64(1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def homes(fps: np.ndarray, levels: Levels, split: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Leaf code of each fingerprint and the depth of the leaf."""
    code, depth = np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)
    heavy = np.array(sorted(split), np.int64)
    live = np.arange(len(fps))
    for level in range(len(levels)):
        live = live[np.isin(code[live], heavy)]
        if not len(live):
            break
        code[live] = child(code[live], levels.ring(level, fps[live]))
        depth[live] = level + 1
    return code, depth


def visits(fps: np.ndarray, levels: Levels, split: set[int], exists: set[int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, leaf)`` of all shards that a ball around each fingerprint overlaps and that come behind its own."""
    heavy, known = np.array(sorted(split), np.int64), np.array(sorted(exists), np.int64)
    row, code = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    budget, ahead = np.full(len(fps), radius), np.zeros(len(fps), np.int8)  # ahead: 0 on the own path, 1 behind it
    rows, leaves = [], []
    for level in range(len(levels)):
        inner = np.isin(code, heavy)
        done = ~inner & (ahead == 1)
        rows.append(row[done])
        leaves.append(code[done])
        row, code, budget, ahead = row[inner], code[inner], budget[inner], ahead[inner]
        if not len(row):
            break
        if levels.renewed(level):
            budget = np.full(len(row), radius)
        own = levels.ring(level, fps[row])
        nexts = []
        for step in range(-radius, radius + 1):
            ok = (abs(step) <= budget) & (own + step >= 0) & ((ahead == 1) | (step >= 0))
            to = child(code[ok], own[ok] + step)
            there = np.isin(to, known)
            at = np.nonzero(ok)[0][there]
            nexts.append((row[at], to[there], budget[at] - abs(step), np.maximum(ahead[at], np.int8(step > 0))))
        row, code, budget, ahead = (np.concatenate(x) for x in zip(*nexts))
    else:
        done = ahead == 1
        rows.append(row[done])
        leaves.append(code[done])
    return np.concatenate(rows), np.concatenate(leaves)


def within(a: np.ndarray, b: np.ndarray, radius: int, levels: Levels, level: int = 0, budget: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within ``radius``: the tree goes on until a pair of branches is small, then all is compared."""
    stack = [(np.arange(len(a)), np.arange(len(b)), level, radius if budget is None else budget)]
    while stack:
        i, j, at, left = stack.pop()
        if not len(i) or not len(j):
            continue
        if len(i) <= SHARD_ROWS or at >= len(levels):
            step = max(1, (1 << 21) // len(i))
            for s in range(0, len(j), step):
                q, p = np.nonzero(np.bitwise_count(b[j[s : s + step]][:, None] ^ a[i][None, :]) <= radius)
                yield i[p], j[s + q]
            continue
        left = radius if levels.renewed(at) else left
        ra, rb = levels.ring(at, a[i]), levels.ring(at, b[j])
        for x in np.unique(ra):
            for y in np.unique(rb):
                if abs(int(x) - int(y)) <= left:
                    stack.append((i[ra == x], j[rb == y], at + 1, left - abs(int(x) - int(y))))


class Joined:
    """Groups of positions, joined by pairs."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            if np.array_equal(x, y):
                return
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(self.of, up := self.of[self.of]):
                self.of = up


def shard_links(batches: Iterator[pd.DataFrame], levels: Levels, radius: int) -> Iterator[pd.DataFrame]:
    """Links ``(a, b)`` of rows ``(leaf, visitor, fp)`` that come sorted by leaf, members first."""
    held, parts, groups, leaf = None, [], None, None

    def close() -> pd.DataFrame:
        nonlocal held, groups
        held = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        groups = Joined(len(held))
        for i, j in within(held, held, radius, levels):
            groups.add(i, j)
        linked = np.nonzero(groups.of != np.arange(len(held)))[0]
        return pd.DataFrame({"a": held[groups.of[linked]].view(np.int64), "b": held[linked].view(np.int64)})

    for pdf in batches:
        for (code, visitor), part in pdf.groupby(["leaf", "visitor"], sort=False):
            if code != leaf:
                if leaf is not None and held is None:
                    yield close()
                leaf, held, parts = code, None, []
            fps = part["fp"].to_numpy().view(np.uint64)
            if not visitor:
                parts.append(fps)
                continue
            if held is None:
                yield close()
            for i, j in within(held, fps, radius, levels):
                yield pd.DataFrame({"a": held[groups.of[i]].view(np.int64), "b": fps[j].view(np.int64)}).drop_duplicates()
    if leaf is not None and held is None:
        yield close()


def grow(fps: DataFrame, levels: Levels, most: int) -> tuple[set[int], set[int]]:
    """Codes of the nodes that are split and of all nodes: one counting pass a level, as long as a node holds over ``most`` rows."""
    split, exists = {0}, {0}
    for level in range(len(levels)):
        now = set(split)

        def count(batches: Iterator[pd.DataFrame], now: set[int] = now, depth: int = level + 1) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                code, at = homes(pdf["fp"].to_numpy().view(np.uint64), levels, now)
                found, n = np.unique(code[at == depth], return_counts=True)
                yield pd.DataFrame({"code": found, "n": n})

        counted = fps.mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        nodes = counted.collect()  # children of split nodes only: at most a few times MAX_SHARDS rows
        exists |= {r["code"] for r in nodes}
        more = {r["code"] for r in nodes if r["n"] > most}
        if not more:
            break
        split |= more
    return split, exists


def links(fps: DataFrame, radius: int = RADIUS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(a, b)`` pairs of distinct fingerprints that connect all pairs within ``radius``."""
    spark = fps.sparkSession
    total = fps.count()
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy().astype(np.int64).view(np.uint64)
    levels = Levels(sample)
    split, exists = grow(fps, levels, max(shard_rows, total // MAX_SHARDS))
    tree = spark.sparkContext.broadcast((split, exists))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            signed = pdf["fp"].to_numpy()
            for s in range(0, len(signed), 4096):
                part = signed[s : s + 4096]
                code, _ = homes(part.view(np.uint64), levels, tree.value[0])
                yield pd.DataFrame({"leaf": code, "visitor": False, "fp": part})
                row, leaf = visits(part.view(np.uint64), levels, *tree.value, radius)
                yield pd.DataFrame({"leaf": leaf, "visitor": True, "fp": part[row]})

    routed = fps.mapInPandas(route, "leaf long, visitor boolean, fp long")
    ordered = routed.repartition("leaf").sortWithinPartitions("leaf", "visitor")
    return ordered.mapInPandas(lambda batches: shard_links(batches, levels, radius), "a long, b long")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, root)``: the smallest node of each component, for every node that has an edge.

    Rounds of hooking and jumping: every node takes the least root among its neighbours' roots, then its
    root's root. Each node's neighbours are pre-aggregated before the shuffle, and each round is written.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    state = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    for _ in range(max_rounds):
        heard = both.join(state.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("heard"))
        # a node's old root hears what the node hears, so whole trees hook at once
        told = state.join(heard, "node").groupBy(F.col("root").alias("node")).agg(F.min("heard").alias("told"))
        hooked = state.join(heard, "node").join(told, "node", "left").select("node", F.col("root").alias("old"), F.least("root", "heard", F.coalesce("told", "root")).alias("root"))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = cut(hooked.join(up, "root").select("node", "old", F.least("root", "up").alias("root")))
        state = jumped.select("node", "root")
        if not jumped.where("old <> root").limit(1).count():
            return state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def rooted(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns per row with ``fp``, the component's ``root`` and ``component_id``: the smallest id among all that links reach."""
    marked = cut(fingerprints(docs, shingle, keep))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(cut(links(distinct.select("fp"), radius, shard_rows)))
    of_fp = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = of_fp.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = cut(of_fp.join(named, "root").select(F.col("fp").alias("__fp"), "root", "component_id"))
    return marked.join(by_fp, F.col("fp") == F.col("__fp")).select(*keep, "fp", "root", "component_id")


def groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row: the smallest id among all that links reach."""
    return rooted(docs, radius, shingle, shard_rows).select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def row_names(docs: DataFrame) -> tuple[str, str]:
    """Names for the two hashes of a row that no column of ``docs`` has."""
    return free_name(docs, "__h1"), free_name(docs, "__h2")


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with two 64-bit hashes of the whole row, nulls told apart from missing neighbours."""
    parts = []
    for f in docs.schema:
        c = F.col(f"`{f.name}`")
        hashable = not any(x in f.dataType.simpleString() for x in ("map<", "variant"))
        parts += [c if hashable else F.to_json(F.struct(c)), c.isNull()]
    h1, h2 = row_names(docs)
    return docs.withColumns({h1: F.xxhash64(*parts), h2: F.xxhash64(F.lit(1), *parts)})


def one_per_root(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their root in ``found`` ``(doc_id, row key, root)``: least id, null ids last, then least
    row key. Of rows that are equal in all columns one stays."""
    row = row_names(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *row)).alias("least")
    stay = found.groupBy("root").agg(first).select(*[F.col(f"least.{k}").alias(k) for k in row])
    return with_row_key(docs).join(stay, list(row), "left_semi").dropDuplicates(list(row)).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """One row of each near-duplicate group of ``docs``: the one with the smallest id."""
    return one_per_root(docs, rooted(with_row_key(docs), keep=("doc_id", *row_names(docs)), **options))
