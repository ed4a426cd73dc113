r"""Compressing vectors into codes of a few bytes: K-Means codebooks per part, with Drake and Hamerly's adaptive bounds.

Components become integers (``floor(scale * x)``), a vector is cut into equal parts, and each part position has a codebook. A round
assigns every part to its nearest entry and replaces the entries by the floored means of their parts. All decisions are made on exact integers.

Between rounds every vector keeps, per part, its entry and the next b closest ones with lower bounds of their distances in rising order,
an upper bound for its own entry, and one outer bound below which no other entry can lie. When the entries have moved,
bounds are widened by how far each moved (the outer one by the farthest move), rounded outwards. Where the own upper bound lies below the first lower bound nothing is
computed. Else the exact distance to the own entry, then only to the entries whose bounds it does not beat; where even the outer bound
may fail, to all. Uncertain cases end in integer distances, ties to the lower index. b follows the depth that the last round needed: it
is as small as leaves at most OUTER_SHARE of the rows beyond it, and doubles when more of them fell through the outer bound, within LEAST_B and MOST_B.

The state is a written table, one row a vector; a round is one pass over it and one over its codes, whose sums are added up per task
before the shuffle. The driver holds codebooks and depth counts only: entries x dimensions numbers, whatever the number of rows.

Defined results: rows whose vector is null or holds a null or non-finite component take no part. Vectors must be of one length, a multiple of
the parts; others raise. Components past 2^27 after scaling raise, since distances might leave 64 bits. Rows with a null id count, last in
the order of ids; equal ids go by their vectors. With fewer rows than entries the codebooks are that much smaller. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.session import cut, forget

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
FIRST_B, LEAST_B, MOST_B = 8, 2, 16
OUTER_SHARE = 0.05
LARGEST = 1 << 27
ALL = 255  # depth of rows that were compared with all entries
STRIP = 2_048  # rows whose distances to all entries are held at once
EXACT_FLOAT = float(1 << 52)


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, x)`` of the rows that take part; ``x`` holds the integer components."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(F.col("embedding").isNotNull() & fine)
    whole = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    within = F.forall("embedding", lambda c: F.abs(c.cast("double") * scale) < LARGEST)
    checked = F.when(within, F.transform(whole, lambda c: c.cast("int"))).otherwise(F.raise_error(F.lit(f"a component reaches {LARGEST} after scaling")).cast("array<int>"))
    return rows.select("vec_id", "label", checked.alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of integers as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries: by one product where doubles hold it exactly."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * x.shape[1] * top * top < EXACT_FLOAT:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for d in range(x.shape[1]):
        out += (x[:, d, None] - book[None, :, d]) ** 2
    return out


def to_entries(x: np.ndarray, book: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to the entries named in its row of ``ids``."""
    diff = x[:, None, :] - book[ids]
    return (diff * diff).sum(axis=2)


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


@dataclass
class Bounds:
    """For n rows of one part: ``ids`` (own entry, then b others), ``upper`` of the own one, ``lower`` of the others, rising, and ``outer``."""

    ids: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    outer: np.ndarray

    @classmethod
    def empty(cls, n: int, b: int) -> Bounds:
        return cls(np.zeros((n, b + 1), np.uint8), np.zeros(n, np.float32), np.zeros((n, b), np.float32), np.zeros(n, np.float32))

    def put(self, at: np.ndarray, other: Bounds) -> None:
        self.ids[at], self.upper[at], self.lower[at], self.outer[at] = other.ids, other.upper, other.lower, other.outer


def ranked(ids: np.ndarray, sq: np.ndarray, b: int, outer: np.ndarray) -> Bounds:
    """Bounds from exact squared distances ``sq`` to the entries ``ids``: the nearest is the own one, the next b are kept, the rest lowers ``outer``."""
    order = np.lexsort((ids, sq), axis=1)[:, : b + 2]
    ids, root = np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(sq, order, 1).astype(np.float64))
    if root.shape[1] > b + 1:
        outer = np.minimum(outer, down(root[:, b + 1]))
    return Bounds(ids[:, : b + 1].astype(np.uint8), up(root[:, 0]), down(root[:, 1 : b + 1]), outer)


def from_all(x: np.ndarray, book: np.ndarray, b: int) -> Bounds:
    """Bounds of rows that nothing is known of: the distances to all entries."""
    sq = distances(x, book)
    if b + 2 >= len(book):
        some = np.broadcast_to(np.arange(len(book)), sq.shape)
        return ranked(some, sq, b, np.full(len(x), np.inf, np.float32))
    # one number orders by distance, then index; doubles of it would not be exact
    key = sq * len(book) + np.arange(len(book)) if sq.max(initial=0) < (1 << 62) // len(book) else None
    picked = np.argpartition(key, b + 1, axis=1)[:, : b + 2] if key is not None else np.argsort(sq, axis=1, kind="stable")[:, : b + 2]
    return ranked(picked, np.take_along_axis(sq, picked, 1), b, np.full(len(x), np.inf, np.float32))


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry has moved, rounded up."""
    diff = (new - old).astype(np.float64)
    return up(np.sqrt((diff * diff).sum(1)))


def fitted(known: Bounds, b: int) -> Bounds:
    """The same bounds for another b: entries that go lower the outer bound; places that come hold the own entry, bounded like all unknown ones."""
    n, have = known.lower.shape
    if have <= b:
        ids = np.concatenate([known.ids, np.repeat(known.ids[:, :1], b - have, 1)], 1)
        return Bounds(ids, known.upper, np.concatenate([known.lower, np.repeat(known.outer[:, None], b - have, 1)], 1), known.outer)
    return Bounds(known.ids[:, : b + 1], known.upper, known.lower[:, :b], np.minimum(known.outer, known.lower[:, b]))


def reassign(x: np.ndarray, book: np.ndarray, drift: np.ndarray, known: Bounds, b: int) -> tuple[Bounds, np.ndarray]:
    """Bounds after the entries have moved, and per row how many entries beside its own were looked at (ALL for all)."""
    n, have = known.lower.shape
    ids = known.ids.astype(np.int64)
    outer = down(known.outer - drift.max(initial=0))
    lower = down(known.lower - drift[ids[:, 1:]])
    lower = np.minimum.accumulate(np.concatenate([lower, outer[:, None]], 1)[:, ::-1], axis=1)[:, ::-1][:, :have]  # rising again
    upper = up(known.upper + drift[ids[:, 0]])
    depth = np.zeros(n, np.int64)
    out = Bounds(known.ids, upper, lower, outer)
    first = lower[:, 0] if have else outer
    near = np.flatnonzero(~(upper < first))
    if not len(near):
        return fitted(out, b), depth
    own = to_entries(x[near], book, ids[near, :1])[:, 0]
    out.upper[near] = up(np.sqrt(own.astype(np.float64)))
    open_ = ~(out.upper[near] < first[near])
    near, own = near[open_], own[open_]
    beyond = ~(out.upper[near] < outer[near])
    asked = (~(out.upper[near, None] < lower[near])).sum(1)  # bounds rise, so these are the first ones
    for m in np.unique(asked[~beyond]):
        at = near[~beyond & (asked == m)]
        some = ids[at, : m + 1]
        part = ranked(some, to_entries(x[at], book, some), m, np.full(len(at), np.inf, np.float32))
        rest = np.concatenate([part.lower, lower[at, m:]], 1)
        order = np.argsort(rest, axis=1, kind="stable")
        others = np.concatenate([part.ids[:, 1:], known.ids[at, m + 1 :]], 1)
        out.put(at, Bounds(np.concatenate([part.ids[:, :1], np.take_along_axis(others, order, 1)], 1), part.upper, np.take_along_axis(rest, order, 1), outer[at]))
        depth[at] = m
    at = near[beyond]
    depth[at] = ALL
    out = fitted(out, b)
    wide = out.lower.shape[1]
    for s in range(0, len(at), STRIP):
        out.put(at[s : s + STRIP], from_all(x[at[s : s + STRIP]], book, wide))
    return out, depth


STATE = "vec_id {}, label {}, x array<int>, near binary, bounds binary, code binary, depth binary"


def unpack(near: pa.Array, bounds: pa.Array, bs: list[int]) -> list[Bounds]:
    """The bounds of each part, from the two packed columns."""
    n = len(near)
    ids = np.frombuffer(b"".join(near.to_pylist()), np.uint8).reshape(n, -1)
    numbers = np.frombuffer(b"".join(bounds.to_pylist()), np.float32).reshape(n, -1)
    out, i, j = [], 0, 0
    for b in bs:
        out.append(Bounds(ids[:, i : i + b + 1].copy(), numbers[:, j].copy(), numbers[:, j + 1 : j + 1 + b].copy(), numbers[:, j + 1 + b].copy()))
        i, j = i + b + 1, j + b + 2
    return out


def packed(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    raw, width = rows.tobytes(), rows.shape[1] * rows.itemsize
    return pa.array([raw[i * width : (i + 1) * width] for i in range(len(rows))], pa.binary())


def assign(state: DataFrame, kinds: tuple[str, str], old: np.ndarray | None, new: np.ndarray, bs: list[int], next_bs: list[int]) -> DataFrame:
    """The state after one assignment to the entries ``new`` (parts x entries x dimensions); ``old`` is None at the first."""
    parts, _, width = new.shape
    drifts = None if old is None else [moved(old[p], new[p]) for p in range(parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            known = None if old is None else unpack(batch.column("near"), batch.column("bounds"), bs)
            ids, numbers, depths = [], [], []
            for p in range(parts):
                mine = x[:, p * width : (p + 1) * width]
                if known is None:
                    found, depth = Bounds.empty(len(x), next_bs[p]), np.full(len(x), ALL)
                    for s in range(0, len(x), STRIP):
                        found.put(np.arange(s, min(s + STRIP, len(x))), from_all(mine[s : s + STRIP], new[p], next_bs[p]))
                else:
                    found, depth = reassign(mine, new[p], drifts[p], known[p], next_bs[p])
                ids.append(found.ids)
                numbers += [found.upper[:, None], found.lower, found.outer[:, None]]
                depths.append(depth.astype(np.uint8))
            code = np.stack([i[:, 0] for i in ids], 1)
            made = [packed(np.concatenate(ids, 1)), packed(np.concatenate(numbers, 1)), packed(code), packed(np.stack(depths, 1))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("x"), *made], names=["vec_id", "label", "x", "near", "bounds", "code", "depth"])

    return cut(state.mapInArrow(run, STATE.format(*kinds)))


def totals(state: DataFrame, parts: int, width: int, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts of the parts of every entry, and how often each depth was needed per part; added up per task first."""
    names = [f"s{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, depths = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), np.zeros((parts, 256), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            code, depth = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(x), parts) for c in ("code", "depth"))
            for p in range(parts):
                for i in range(width):  # exact in doubles: LARGEST times the rows of a batch stays far below 2^53
                    sums[p, :, i] += np.bincount(code[:, p], x[:, p * width + i], entries).astype(np.int64)
                counts[p] += np.bincount(code[:, p], minlength=entries)
                depths[p] += np.bincount(depth[:, p], minlength=256)
        p, e = np.nonzero(counts)
        q, d = np.nonzero(depths)
        cols = [np.concatenate([p, q]), np.concatenate([e, d]), np.repeat([True, False], [len(p), len(q)]), np.concatenate([counts[p, e], depths[q, d]])]
        cols += [np.concatenate([sums[p, e, i], np.zeros(len(q), np.int64)]) for i in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["part", "entry", "is_entry", "n", *names])

    schema = "part long, entry long, is_entry boolean, n long, " + ", ".join(f"{c} long" for c in names)
    added = state.select("x", "code", "depth").mapInArrow(run, schema).groupBy("part", "entry", "is_entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
    sums, counts, depths = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), np.zeros((parts, 256), np.int64)
    for r in added.collect():  # at most parts x (entries + 256) rows
        if r["is_entry"]:
            sums[r["part"], r["entry"]], counts[r["part"], r["entry"]] = r[4:], r["n"]
        else:
            depths[r["part"], r["entry"]] = r["n"]
    return sums, counts, depths


def adapted(depths: np.ndarray, b: int) -> int:
    """The smallest b for which at most OUTER_SHARE of the rows need an entry beyond it; twice the present one if the outer bound failed more often."""
    upto = np.cumsum(depths)
    if not upto[-1]:
        return b
    if depths[ALL] > OUTER_SHARE * upto[-1]:
        return min(MOST_B, 2 * b)
    return int(np.clip(np.searchsorted(upto, (1 - OUTER_SHARE) * upto[-1]), LEAST_B, MOST_B))


@dataclass
class Compressed:
    """Rows ``(vec_id, label, code, error)``, the final codebooks (parts x entries x dimensions), and per assignment the b of each part
    and how often each depth was needed (ALL: all entries)."""

    rows: DataFrame
    books: np.ndarray
    history: list[tuple[list[int], np.ndarray]]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, first_b: int = FIRST_B) -> Compressed:
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    kinds = tuple(vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    state = cut(quantized(vectors, scale))
    sizes = state.agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b")).first()
    out_schema = f"vec_id {kinds[0]}, label {kinds[1]}, code binary, error long"
    if sizes["a"] is None:
        return Compressed(vectors.sparkSession.createDataFrame([], out_schema), np.zeros((parts, 0, 0), np.int64), [])
    if sizes["a"] != sizes["b"] or sizes["a"] % parts or not sizes["a"]:
        raise ValueError(f"vectors of {sizes['a']} to {sizes['b']} components cannot be cut into {parts} equal parts")
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([r["x"] for r in first], dtype=np.int64)
    width = start.shape[1] // parts
    new = np.stack([start[:, p * width : (p + 1) * width] for p in range(parts)])
    old, entries = None, len(start)
    bs = next_bs = [min(first_b, entries - 1)] * parts
    history = []
    for r in range(rounds + 1):
        before, state = state, assign(state, kinds, old, new, bs, next_bs)
        forget(before)
        bs = next_bs
        sums, counts, depths = totals(state, parts, width, entries)
        history.append((bs, depths))
        if r == rounds:
            break
        old, new = new, np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], new)
        if r:
            next_bs = [min(entries - 1, adapted(d, b)) for d, b in zip(depths, bs)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), parts)
            error = np.zeros(len(x), np.int64)
            for p in range(parts):
                diff = x[:, p * width : (p + 1) * width] - new[p][code[:, p]]
                error += (diff * diff).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("vec_id", "label", "code")] + [pa.array(error)], names=["vec_id", "label", "code", "error"])

    return Compressed(state.select("vec_id", "label", "x", "code").mapInArrow(judge, out_schema), new, history)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components, in order, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label_error``: the error summed over all rows of the same label, nulls together."""
    sums = rows.groupBy(F.col("label").alias("__l")).agg(F.sum("error").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("__l"))).drop("__l")
