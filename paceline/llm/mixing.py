r"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents fall by hash into BLOCKS blocks per source, and a source's blocks are put in a hashed order.
A source's target buys whole copies of all its blocks and, for the rest, the first blocks of that order; the block at
the cut is bought document by document up to the nearest word count. That gives exact block quotas per source.
A binary tree then splits the quotas among output shards: at every node the left half's share of each source is one
multivariate-hypergeometric draw. Nodes are rows of a table and carry where their range of each source's permuted blocks begins; a task splits
one node down to at most FAN_OUT others, so the tree takes a round for every factor FAN_OUT of shards. Each shard takes its own disjoint range
and shuffles its rows locally by hash. Every draw follows from the seed and the node, so reruns agree.

Size is the number of words ``[^\x20\x09-\x0D]+``. Sources are ordered by code point, null last; weights repeat along
that order. A source's target stops at MAX_REPEAT times its size, the excess is shared anew by weight.

Defined results: null text has size 0; sources of size 0 get target 0; an empty table gives an empty mix. Rows with
one document id in a source are drawn together. A null id is a document like any other. Extra columns pass through.

The driver holds one number row per source (name, size, quota), never per document, block or shard.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.text import free_name, words
from paceline.session import cut

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
BLOCKS = 4096
#: Words per output shard, some 50 MB, and the least number of shards; never more than there are blocks to deal.
SHARD_WORDS, LEAST_SHARDS = 8_000_000, 16
FAN_OUT = 256
SEED = "mix"
#: The block table is broadcast up to this many rows (under 10 MB); larger ones are joined by shuffle.
BROADCAST_BLOCKS = 100_000
PARAMS = "source string, rank int, source_size long, n_blocks long, target double, copies long, rest double"


def doc_hash(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def block_of(doc_md5: Column) -> Column:
    """0 .. BLOCKS - 1, from the first three hex digits."""
    return F.conv(F.substring(doc_md5, 1, 3), 16, 10).cast("int")


def targets(sizes: Sequence[int], weights: Sequence[int], max_repeat: int = MAX_REPEAT) -> list[float]:
    """Shares of the total by weight, none above ``max_repeat`` times its size."""
    total, full = sum(sizes), set()
    while True:
        rest = total - sum(max_repeat * sizes[i] for i in full)
        open_ = [i for i in range(len(sizes)) if i not in full]
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * rest > max_repeat * sizes[i] * weight]
        if not over or total == 0:
            break
        full.update(over)
    return [float(max_repeat * sizes[i]) if i in full or not weight else weights[i] * rest / weight for i in range(len(sizes))]


def split_node(first: int, shards: int, quotas: np.ndarray, starts: np.ndarray, seed: str, most: int = FAN_OUT) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first shard, shards, quotas, starts)`` of the nodes below one, until they are single shards or ``most`` in number. ``quotas`` are the items
    of each source, ``starts`` their places in the source's order; totals of nodes are in proportion to their shards, but for rounding."""
    out, deepest = [(first, shards, quotas, starts)], 1
    while deepest < most and any(n > 1 for _, n, _, _ in out):
        below = []
        for at, n, items, begin in out:
            if n == 1:
                below.append((at, n, items, begin))
                continue
            left = n // 2
            taken = int(items.sum()) * left // n
            rng = np.random.default_rng([*seed.encode(), at, n])
            half = rng.multivariate_hypergeometric(items, taken, method="marginals") if taken else np.zeros_like(items)
            below += [(at, left, half, begin), (at + left, n - left, items - half, begin + half)]
        out, deepest = below, 2 * deepest
    return out


def split_quotas(quotas: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """``(shard, rank, start, items)``: the range of each source's items that a shard takes, from ``(rank, items)``; empty ranges are left out."""

    def split(nodes: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("rank")
        made = split_node(int(nodes["shard"].iloc[0]), int(nodes["shards"].iloc[0]), nodes["items"].to_numpy(), nodes["start"].to_numpy(), seed)
        parts = [pd.DataFrame({"shard": a, "shards": n, "rank": nodes["rank"].to_numpy(), "start": s, "items": q}) for a, n, q, s in made]
        return pd.concat(parts)[lambda t: t["items"] > 0]

    schema = "shard long, shards long, rank int, start long, items long"
    nodes = quotas.select(F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("shards"), "rank", F.lit(0).cast("long").alias("start"), "items")
    left = shards
    while left > 1:
        nodes, left = cut(nodes.groupBy("shard", "shards").applyInPandas(split, schema)), -(-left // FAN_OUT)
    return nodes.drop("shards")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``(doc_id, source, size, doc_md5, block)`` per row, written once."""
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words(F.col("text"))).cast("long").alias("size"), doc_hash(seed=seed).alias("doc_md5"))
    return cut(rows.withColumn("block", block_of(F.col("doc_md5"))))


def plan(rows: DataFrame, weights: Sequence[int] = WEIGHTS, shards: int | None = None, seed: str = SEED) -> DataFrame:
    """One row per source and block: ``(source, block, copies, last_md5, shards, target, source_size)``.

    A document of the block is taken ``copies`` times and once more if its hash is at most
    ``last_md5``; copy i goes to the i-th of ``shards``.
    """
    spark = rows.sparkSession
    blocks = cut(rows.groupBy("source", "block").agg(F.sum("size").alias("block_size")))
    sources = blocks.groupBy("source").agg(F.sum("block_size").alias("s"), F.count("*").alias("b")).orderBy(F.col("source").asc_nulls_last()).collect()
    aims = targets([r["s"] for r in sources], [weights[i % len(weights)] for i in range(len(sources))])
    params = []
    for i, (r, t) in enumerate(zip(sources, aims)):
        copies = int(t / r["s"]) if r["s"] else 0
        params.append((r["source"], i, r["s"], r["b"], t, copies, t - copies * r["s"]))
    table = spark.createDataFrame(params, PARAMS)
    # places of the blocks in their source's permuted order: at most BLOCKS rows per source
    order = Window.partitionBy("rank").orderBy("block_md5", "block")
    name = F.concat_ws("|", F.lit(seed), F.coalesce("source", F.lit("")), F.col("block").cast("string"))
    placed = (
        blocks.withColumnRenamed("source", "__s")
        .join(table, F.col("__s").eqNullSafe(F.col("source")))
        .withColumn("block_md5", F.md5(name))
        .withColumn("place", F.row_number().over(order) - 1)
        .withColumn("upto", F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("before", F.col("upto") - F.col("block_size"))
        .drop("__s")
    )
    placed = cut(placed)
    cuts = placed.where((F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest"))).select(F.col("source").alias("__s"), F.col("block").alias("__b"), "rank", (F.col("rest") - F.col("before")).alias("left"))
    # the block at each source's cut, document by document
    at_cut = rows.join(cuts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b"))).groupBy("rank", "left", "doc_md5").agg(F.sum("size").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("rank").orderBy("doc_md5"))
    last = at_cut.withColumn("mid", upto - F.col("size") / 2).where(F.col("mid") < F.col("left")).groupBy("rank").agg(F.max("doc_md5").alias("cut_md5"))
    whole = (F.col("upto") <= F.col("rest")) & (F.col("rest") > 0)
    partial = (F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest"))
    joined = placed.join(last, "rank", "left").withColumn("last_md5", F.when(whole, F.lit("~")).when(partial, F.col("cut_md5")))
    joined = cut(joined)
    extra = {r["rank"]: r["n"] for r in joined.where("last_md5 IS NOT NULL").groupBy("rank").agg(F.count("*").alias("n")).collect()}
    quotas = [(p[1], p[5] * p[3] + extra.get(p[1], 0)) for p in params]
    items = sum(q for _, q in quotas)
    shards = min(shards or max(LEAST_SHARDS, -(-sum(r["s"] for r in sources) // SHARD_WORDS)), max(1, items))
    ranges = split_quotas(spark.createDataFrame(quotas, "rank int, items long").where("items > 0"), shards, seed)
    # a source's items: all blocks of the first copy in their order, then of the next; each falls to the shard whose range began last
    bought = F.col("copies") + F.when(F.col("last_md5").isNotNull(), 1).otherwise(0)
    dealt = joined.where(bought > 0).select("rank", "block", "n_blocks", "place", F.explode(F.sequence(F.lit(0).cast("long"), bought - 1)).alias("copy"))
    both = dealt.select("rank", (F.col("copy") * F.col("n_blocks") + F.col("place")).alias("item"), "block", "copy", F.lit(None).cast("long").alias("shard"))
    both = both.unionByName(ranges.select("rank", F.col("start").alias("item"), F.lit(None).cast("int").alias("block"), F.lit(None).cast("long").alias("copy"), "shard"))
    began = Window.partitionBy("rank").orderBy("item", F.col("shard").asc_nulls_last())  # at most twice the items of a source
    placed = both.withColumn("shard", F.last("shard", ignorenulls=True).over(began)).where("block IS NOT NULL")
    drawn = placed.groupBy("rank", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda c: c["shard"]).alias("shards"))
    return joined.join(drawn, ["rank", "block"], "left").select("source", "block", "copies", "last_md5", "shards", "target", "source_size")


def _with_plan(rows: DataFrame, blocks: DataFrame, source: str, block: str, plan: str) -> DataFrame:
    """``rows`` with the plan of their block as a struct; ``blocks`` is a written table."""
    small = blocks.count() <= BROADCAST_BLOCKS
    right = blocks.select(F.struct("*").alias(plan))
    same = F.col(source).eqNullSafe(F.col(f"{plan}.source")) & (F.col(block) == F.col(f"{plan}.block"))
    return rows.join(F.broadcast(right) if small else right, same)


def draws(doc_md5: Column, plan: Column) -> Column:
    """The shards that draw a document of the block, one entry a copy."""
    n = plan["copies"] + F.when(doc_md5 <= plan["last_md5"], 1).otherwise(0)
    return F.filter(F.slice(F.coalesce(plan["shards"], F.array().cast("array<long>")), F.lit(1), n.cast("int")), lambda s: s.isNotNull())


def taken(docs: DataFrame, seed: str = SEED, **options: object) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row: the words that all shards together draw of it."""
    rows = sized(docs, seed)
    marked = _with_plan(rows.withColumnsRenamed({"source": "of", "block": "at"}), cut(plan(rows, seed=seed, **options)), "of", "at", "plan")
    drawn = F.size(draws(F.col("doc_md5"), F.col("plan")))
    return marked.select("doc_id", "size", F.col("plan.source_size"), F.col("plan.target"), (F.col("size") * drawn).alias("taken"))


def mix(docs: DataFrame, shards: int | None = None, seed: str = SEED, **options: object) -> DataFrame:
    """One row per copy taken: the columns of ``docs``, then ``shard`` and ``copy``; each shard lies
    in one partition, in its locally shuffled order."""
    shard, copy, md5, source, block, aim, of = (free_name(docs, c) for c in ("shard", "copy", "__md5", "__source", "__block", "__plan", "__draws"))
    blocks = cut(plan(sized(docs, seed), shards=shards, seed=seed, **options))
    n_shards = blocks.agg(F.max(F.array_max("shards"))).first()[0]
    rows = docs.withColumn(md5, doc_hash(seed=seed)).withColumn(source, F.col("source").cast("string")).withColumn(block, block_of(F.col(md5)))
    drawn = _with_plan(rows, blocks, source, block, aim).withColumn(of, draws(F.col(md5), F.col(aim)))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    copies = drawn.select(*kept, md5, F.posexplode(of).alias(copy, shard)).withColumn(shard, F.col(shard).cast("int"))
    placed = copies.repartitionById((n_shards or 0) + 1, F.col(shard))
    shuffled = placed.sortWithinPartitions(shard, F.md5(F.concat_ws("|", md5, F.col(copy).cast("string"))), "doc_id")
    return shuffled.select(*kept, shard, copy)
