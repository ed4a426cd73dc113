r"""Chat formatting of reply trees, JVM-side only.

Messages point at the message they answer. Pointer-doubling self-joins give every message its root,
depth and the score of its path; each tree's leaves are ranked by that score, and the chosen leaves are
expanded to their root-to-leaf paths by the same jump tables, largest jump first, so a path of n messages takes 2 log n joins.
Each path becomes one conversation.

Template: every message is ``<|role|>``, line feed, text, ``<|end|>``, line feed. Inside texts and roles a ``\``
is put behind every ``<``, ``[`` and ``|``, so no control string of this or of the bracket style
(``<|end|>``, ``</s>``, ``[INST]``) survives; taking it out again gives the text back exactly.
The loss mask holds start and length (code points) of every assistant text in the formatted string.

Defined results: null text and null role are empty. A parent that is missing, null or the message itself makes a root. Messages on a cycle
have no root and raise an error. Equal scores go to the smaller leaf id. ``reply_chain`` orders rows with the same turn by role and text;
repeated rows all stay. An empty table gives no conversations. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.text import or_empty
from paceline.session import cut

END = "<|end|>\n"
CONTROL, MARK = r"([<\[|])", "\\"
MAX_ROUNDS = 40


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL + r"\\", "$1")


def reply_chain(rows: DataFrame) -> DataFrame:
    """A table of turns as reply trees of one branch: each row answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(order).cast("long")
    numbered = rows.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text")
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length(or_empty(F.col("text"))).cast("double").alias("score"))


def jump_tables(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Ancestors at distance 1, 2, 4, ... as ``(tree, node, up)``, and ``(tree, node, depth, total)``."""
    known = messages.select(F.col("tree").alias("__t"), F.col("node").alias("__n")).distinct()
    linked = messages.select("tree", "node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score"))
    linked = linked.join(known, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("parent") == F.col("__n")), "left")
    # up: the ancestor reached so far; depth and total: messages and scores from the node to below it
    state = cut(linked.select("tree", "node", F.col("__n").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")))
    settled, jumps = [], []
    for _ in range(MAX_ROUNDS):
        open_ = state.where("up IS NOT NULL")
        settled.append(state.where("up IS NULL"))  # at a root: carried along, joined no more
        every = reduce(DataFrame.unionByName, settled)
        if not open_.limit(1).count():
            return jumps, every.select("tree", "node", "depth", "total")
        jumps.append(open_.select("tree", "node", "up"))
        above = every.unionByName(open_).select(F.col("tree").alias("__t"), F.col("node").alias("__n"), F.col("up").alias("__up"), F.col("depth").alias("__d"), F.col("total").alias("__s"))
        joined = open_.join(above, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("up") == F.col("__n")))
        state = cut(joined.select("tree", "node", F.col("__up").alias("up"), (F.col("depth") + F.col("__d")).alias("depth"), (F.col("total") + F.col("__s")).alias("total")))
    raise ValueError("replies form a cycle")


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``(tree, leaf, rank, node, depth)``: all messages on the ``branches`` best root-to-leaf paths of each tree."""
    jumps, nodes = jump_tables(messages)
    answered = messages.where(F.col("parent").isNotNull() & (F.col("parent") != F.col("node"))).select(F.col("tree").alias("__t"), F.col("parent").alias("__p")).distinct()
    leaves = nodes.join(answered, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("node") == F.col("__p")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("total").desc(), "node")
    ranked = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    paths = ranked.select("tree", F.col("node").alias("leaf"), "rank", "node", "depth")
    for k in range(len(jumps) - 1, -1, -1):
        step = jumps[k].select(F.col("tree").alias("__t"), F.col("node").alias("__n"), F.col("up").alias("__up"))
        higher = paths.join(step, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("node") == F.col("__n")))
        paths = cut(paths.unionByName(higher.select("tree", "leaf", "rank", F.col("__up").alias("node"), (F.col("depth") - 2**k).alias("depth"))))
    return paths


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``(tree, rank, n_turns, formatted, loss_mask)`` per chosen path."""
    texts = messages.select(F.col("tree").alias("__t"), F.col("node").alias("__n"), or_empty(F.col("role")).alias("role"), or_empty(F.col("text")).alias("text"))
    on_path = best_paths(messages, branches).join(texts, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("node") == F.col("__n")))
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n"))
    parts = on_path.select("tree", "rank", "depth", "role", head.alias("head"), escape(F.col("text")).alias("body"))
    parts = parts.withColumn("turn", F.concat("head", "body", F.lit(END))).withColumn("chars", F.length("turn"))
    before = Window.partitionBy("tree", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum("chars").over(before) - F.col("chars") + F.length("head")
    placed = parts.select("tree", "rank", F.struct("depth", "turn", F.when(F.col("role") == "assistant", F.struct(start.cast("int").alias("start"), F.length("body").alias("length"))).alias("loss")).alias("p"))
    grouped = placed.groupBy("tree", "rank").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return grouped.select(
        "tree", "rank", F.size("ps").cast("long").alias("n_turns"),
        F.array_join(F.transform("ps", lambda p: p["turn"]), "").alias("formatted"),
        F.filter(F.transform("ps", lambda p: p["loss"]), lambda x: x.isNotNull()).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` back from a formatted string."""
    turns = F.slice(F.split(formatted, r"<\|end\|>\n"), 1, F.size(F.split(formatted, r"<\|end\|>\n")) - 1)

    def parse(turn: Column) -> Column:
        role = F.substring_index(turn, "|>\n", 1)
        return F.struct(unescape(F.substr(role, F.lit(3))).alias("role"), unescape(F.substr(turn, F.length(role) + 4)).alias("text"))

    return F.transform(turns, parse)


def read_loss(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(mask, lambda m: unescape(F.substr(formatted, m["start"] + 1, m["length"])))
