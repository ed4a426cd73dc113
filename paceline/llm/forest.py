r"""MinHash near-duplicates by an LSH forest: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Equal sets collapse first. A set has 96 minima (the least of its shingle hashes under fixed multipliers). Each of TREES trees
orders the sets by a signature of its own: first BASE minima, whose hash names a *region*, then DEEPER further ones. Two sets of similarity s share
a region in a tree with probability s^4, and in one of 24 trees with 1 - (1 - s^4)^24, which is 0.999997 at 0.8 and more above. Sets alone in a region drop out.

Neighbours: rows are range-sorted by (region, deeper minima), and each set meets the NEAR sets before it in its region, the ones with which it
shares the longest prefixes (in a crowded region the BEST nearest). So depth adapts: in a small region all pairs meet at the base, in a crowded one only sets that agree far down. A crowded region may span
many range partitions: the ends of each partition are passed on and sorted again, so that no neighbour is lost at a seam.

A region with more than NEAR + 1 sets has pairs that never were neighbours. They are found exactly. The best neighbours of each set are checked
first and joined into groups; where a region still holds several groups, all its sets outside its largest group meet the whole region, chunk by
chunk: a task gets the full sets of two chunks, counts the common shingles of all their pairs by products of incidence matrices, and returns
links between groups only, no pairs. Regions of the same sets are done once. That costs sets outside the largest group times sets, which is what an exact
answer in a crowd of texts a little below the similarity asks for; it is spread over tasks of bounded size.

Every link is confirmed on the full sets. Pairs and links stay tables; components follow from ``simhash.components``.

Words are maximal runs without ASCII white space, A-Z in lower case; hashes are XXH64 (seed 42), sets are compared as hashes.

Defined results: null texts and texts without words have size 0 and are linked with nothing. Fewer words than a shingle: the whole sequence is the only one.
Rows with equal ids are separate documents. A null id never names a component unless all its ids are null; a row is kept if its id names its component, null ids as if
equal. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.simhash import components
from paceline.session import cut

SHINGLE, PERCENT = 4, 80
TREES, BASE, DEEPER = 24, 4, 6
#: Sets before it that a set meets in a tree, and the best of all trees that are checked at once.
NEAR, BEST = 6, 2
#: Sets of a chunk of a crowded region, and shingles counted at once.
CHUNK, COLUMNS = 512, 4_096
SEED = 42
STRIP = 1_024
TEXT_KEY = ("t1", "t2")
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t\n\x0b\x0c\r", bytes(range(97, 123)) + b" " * 5)
# An odd multiplier and a mask for each minimum.
_RNG = np.random.default_rng(SEED)
_TIMES = _RNG.integers(0, 1 << 63, TREES * BASE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, TREES * BASE, dtype=np.uint64)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles, in order."""
    words = (text or b"").translate(_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))], dtype=np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(len(_TIMES), np.iinfo(np.uint64).max)
    for s in range(0, len(hashes), STRIP):
        np.minimum(least, ((hashes[s : s + STRIP, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    return least


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, t1, t2, set_id, n, regions, deeper)``: hashes of the text, hash and size of the set, its region in each tree, and all
    minima in 32 bits, the first ones again at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, regions, deeper = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, shingle)
                sizes.append(len(s))
                if not len(s):
                    ids.append(None)
                    regions.append([])
                    deeper.append(None)
                    continue
                least = minima(s)
                ids.append(xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63))
                regions.append([xxhash.xxh64_intdigest(least[t * BASE : (t + 1) * BASE].tobytes(), t) - (1 << 63) for t in range(TREES)])
                low = least.astype(np.uint32)
                deeper.append(np.concatenate([low, low[:DEEPER]]).tobytes())
            made = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(regions, pa.list_(pa.int64())), pa.array(deeper, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *TEXT_KEY)), *made], names=["doc_id", *TEXT_KEY, "set_id", "n", "regions", "deeper"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", *TEXT_KEY, F.col("text").cast("binary").alias("text"))
    return cut(rows.mapInArrow(run, f"doc_id {kind}, t1 long, t2 long, set_id long, n long, regions array<long>, deeper binary"))


def in_shared_regions(sets: DataFrame) -> DataFrame:
    """``(region, crowd, path, set_id, n)`` of all sets that are not alone in a region; ``crowd`` is its number of sets."""
    keyed = sets.select("set_id", "n", F.posexplode("regions").alias("tree", "region"))
    shared = keyed.groupBy("region").agg(F.count("*").alias("crowd")).where("crowd > 1")
    held = cut(keyed.join(shared, "region"))
    behind = F.substring("deeper", (F.col("tree") + 1) * 4 * BASE + 1, F.lit(4 * DEEPER))
    paths = sets.join(held.select("set_id").distinct(), "set_id", "left_semi").select("set_id", "deeper")
    return held.join(paths, "set_id").select("region", "crowd", behind.alias("path"), "set_id", "n")


NEIGHBOURS = "a long, na long, b long, nb long, prefix int, crowd long, edge boolean, region long, path binary"


def _neighbours(sorted_rows: DataFrame, seams: bool, percent: int) -> DataFrame:
    """Pairs of each row with the NEAR rows before it in its region, in the order given; with ``seams`` also the rows that lie at the ends of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: deque = deque(maxlen=NEAR)
        head = 0
        for batch in batches:
            out = []
            for region, crowd, path, set_id, n in zip(*(batch.column(c).to_pylist() for c in ("region", "crowd", "path", "set_id", "n"))):
                if seams and head < NEAR:
                    out.append((set_id, n, None, None, None, crowd, True, region, path))
                    head += 1
                    held_back = False
                else:
                    held_back = True
                for k, (other, _, other_path, other_id, other_n, _) in enumerate(reversed(before)):
                    if other != region or (k >= BEST and crowd > NEAR + 1):
                        break
                    small, large = sorted((n, other_n))
                    if 100 * small < percent * large:
                        continue
                    same = next((i for i in range(0, len(path), 4) if path[i : i + 4] != other_path[i : i + 4]), len(path)) // 4
                    x, y = sorted(((set_id, n), (other_id, other_n)))
                    out.append((*x, *y, same, crowd, False, None, None))
                before.append((region, crowd, path, set_id, n, held_back))
            yield _table(out)
        if seams:
            yield _table([(s, n, None, None, None, c, True, r, p) for r, c, p, s, n, held in before if held])

    return sorted_rows.mapInArrow(run, NEIGHBOURS)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in NEIGHBOURS.split(", ")])


def neighbours(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(a, na, b, nb, prefix, crowd)``: pairs with the longest common prefix of all trees and their least crowded region."""
    order = ["region", "path", "set_id"]
    ranged = members.repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut(_neighbours(ranged, True, percent))
    # rows at the ends of partitions, few a partition, meet across the seams
    ends = found.where("edge").select("region", "crowd", "path", F.col("a").alias("set_id"), F.col("na").alias("n"))
    across = _neighbours(ends.repartition("region").sortWithinPartitions(*order), False, percent)
    pairs = found.where("not edge").unionByName(across).where("a <> b")
    return pairs.groupBy("a", "na", "b", "nb").agg(F.max("prefix").alias("prefix"), F.min("crowd").alias("crowd"))


class Confirmed:
    """Checks pairs on the full sets, which are made again from the texts of the sets that are asked for."""

    def __init__(self, docs: DataFrame, marked: DataFrame, shingle: int, percent: int) -> None:
        self.texts = docs.select(*TEXT_KEY, F.col("text").cast("binary").alias("text"))
        # any text of a set will do
        self.places = marked.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min(F.struct("t1", "t2")).alias("t")).select("set_id", "t.t1", "t.t2")
        self.shingle, self.percent = shingle, percent

    def read(self, wanted: DataFrame) -> DataFrame:
        """``(set_id, hashes)`` of the ``wanted`` sets."""
        shingle = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [shingles(t, shingle).view(np.int64) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(made, pa.list_(pa.int64()))], names=["set_id", "hashes"])

        texts = self.texts.join(self.places.join(wanted, "set_id", "left_semi"), ["t1", "t2"]).dropDuplicates(["set_id"])
        return cut(texts.select("set_id", "text").mapInArrow(run, "set_id long, hashes array<long>"))

    def links(self, pairs: DataFrame, full: DataFrame) -> DataFrame:
        """``(a, b)`` of the ``pairs`` ``(a, na, b, nb)`` that are similar enough."""
        left, right = (full.select(F.col("set_id").alias(k), F.col("hashes").alias(f"h{k}")) for k in "ab")
        shared = F.size(F.array_intersect("ha", "hb"))
        met = pairs.select("a", "na", "b", "nb").join(left, "a").join(right, "b")
        return cut(met.where((100 + self.percent) * shared >= self.percent * (F.col("na") + F.col("nb"))).select("a", "b"))


def grouped(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``sets`` with the ``group`` that links join them to."""
    roots = components(links)
    return sets.join(roots, sets.set_id == roots.node, "left").select(*sets.columns, F.coalesce("root", "set_id").alias("group"))


def tiles(members: DataFrame, groups: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Rows ``(region, o, c, set_id, n, group)`` of all crowded regions that hold several groups: chunks ``o`` of the sets outside the region's
    largest group, dealt to all chunks ``c`` of the region, and the other way round."""
    crowded = cut(members.where(F.col("crowd") > NEAR + 1).select("region", "set_id", "n").join(groups.select("set_id", "group"), "set_id"))
    sizes = crowded.groupBy("region", "group").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y"))
    whole = sizes.groupBy("region").agg(
        F.max_by("group", F.struct("m", "group")).alias("largest"), F.max("m").alias("m"), F.sum("m").alias("r"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")
    )
    plan = whole.where("r > m").dropDuplicates(["r", "x", "y"]).select("region", "largest", F.ceil((F.col("r") - F.col("m")) / chunk).alias("os"), F.ceil(F.col("r") / chunk).alias("cs"))
    rows = cut(crowded.join(plan, "region"))
    own, other = F.pmod(F.xxhash64("set_id", F.lit(2)), F.col("os")), F.pmod(F.xxhash64("set_id", F.lit(3)), F.col("cs"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    outside = rows.where(F.col("group") != F.col("largest")).withColumn("o", own).withColumn("c", every("cs"))
    inside = rows.withColumn("c", other).withColumn("o", every("os"))
    names = ("region", "o", "c", "set_id", "n", "group")
    return outside.select(*names), inside.select(*names)


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all sets of ``b``."""
    out = np.zeros((len(a), len(b)), np.float32)
    rows, cols = (np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (a, b))
    left, right = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(left, right)
    if not len(shared):
        return out
    sides = []
    for values, place in ((left, rows), (right, cols)):
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[at] == values
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], place[hit][order]))
    for start in range(0, len(shared), COLUMNS):
        dense = []
        for (at, place), height in zip(sides, out.shape):
            lo, hi = np.searchsorted(at, [start, start + COLUMNS])
            m = np.zeros((height, min(COLUMNS, len(shared) - start)), np.float32)
            m[place[lo:hi], at[lo:hi] - start] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def spanning(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places of pairs ``(x, y)`` that connect what all of them connect."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = i = root[up]
        return i

    out = []
    for k, (i, j) in enumerate(zip(x.tolist(), y.tolist())):
        i, j = find(i), find(j)
        if i != j:
            root[i] = j
            out.append(k)
    return out


def across_groups(members: DataFrame, groups: DataFrame, full: DataFrame, percent: int, chunk: int = CHUNK) -> DataFrame:
    """``(a, b)`` links between sets of different groups that share a crowded region, enough of them to connect all that are similar."""
    outside, inside = (t.join(full, "set_id") for t in tiles(members, groups, chunk))
    inside = inside.select(*[F.col(c).alias(f"in_{c}") for c in inside.columns])
    keys = ("region", "o", "c")

    def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if p.empty or q.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        q = q.rename(columns=lambda c: c.removeprefix("in_"))
        n = p["n"].to_numpy()[:, None] + q["n"].to_numpy()[None, :]
        near = (100 + percent) * common(list(p["hashes"]), list(q["hashes"])).astype(np.int64) >= percent * n
        i, j = np.nonzero(near & (p["group"].to_numpy()[:, None] != q["group"].to_numpy()[None, :]))
        some = spanning(p["group"].to_numpy()[i], q["group"].to_numpy()[j])
        return pd.DataFrame({"a": p["set_id"].to_numpy()[i[some]], "b": q["set_id"].to_numpy()[j[some]]})

    return cut(outside.groupBy(*keys).cogroup(inside.groupBy(*[f"in_{k}" for k in keys])).applyInPandas(run, "a long, b long"))


def linked(docs: DataFrame, marked: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``(a, b)`` pairs of sets that connect all pairs that are similar enough."""
    sets = marked.where("set_id IS NOT NULL").groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("n", "regions", "deeper")])
    members = cut(in_shared_regions(cut(sets)))
    pairs = cut(neighbours(members, percent))
    best = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("prefix"), "a")) <= BEST
    tried = cut(pairs.withColumn("best", best).where(F.col("best") | (F.col("crowd") <= NEAR + 1)))
    confirmed = Confirmed(docs, marked, shingle, percent)
    full = confirmed.read(members.select("set_id").distinct())
    found = confirmed.links(tried.where("best"), full)
    groups = cut(grouped(members.select("set_id", "n").distinct(), found))
    # what the best neighbours have joined already need not be looked at again
    of = [groups.select(F.col("set_id").alias(k), F.col("group").alias(f"g{k}")) for k in "ab"]
    apart = cut(tried.where("not best").join(of[0], "a").join(of[1], "b").where("ga <> gb"))
    return found.unionByName(confirmed.links(apart, full)).unionByName(across_groups(members, groups, full, percent))


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row: the smallest id among all that links reach."""
    if percent < PERCENT:
        raise ValueError(f"the trees find pairs from {PERCENT} per cent on")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    marked = sketches(docs, shingle)
    firsts = cut(marked.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first")))
    rooted = cut(grouped(firsts, linked(docs, marked, shingle, percent)))
    named = rooted.groupBy("group").agg(F.min("first").alias("component_id"))
    of_set = cut(rooted.join(named, "group").select("set_id", "component_id"))
    some = marked.where("set_id IS NOT NULL").join(of_set, "set_id").select("doc_id", "n", "component_id")
    none = marked.where("set_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
