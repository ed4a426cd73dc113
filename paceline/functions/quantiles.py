"""Exact quantiles of groups of any size.

``percentile`` keeps every distinct value of a group in one buffer, which is fine
for an entity-week and hopeless for a whole source. Here a mergeable sketch first
brackets each wanted rank within a sliver of the group; one more pass counts what
lies below the sliver and counts the values inside it. Only the sliver (a few
thousandths of a group) is ever ordered, by range partitions whose totals give each of them its
first rank, so no task holds a whole sliver. The answer is exact: linear interpolation
between the two neighbouring ranks, as ``percentile`` does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.columns import melt
from paceline.session import cut

ACCURACY = 10_000
SLACK = 3.0 / ACCURACY
# below this many values the slack is worth less than a couple of ranks, and the
# group is small enough to be ordered whole
SMALL_GROUP = 10_000
# with at most so many groups their brackets are broadcast; the values never are, however small their files
BROADCAST_GROUPS = 10_000


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    accuracy: int = ACCURACY,
    slack: float = SLACK,
    staged: bool = False,
) -> DataFrame:
    """One row per group and column: ``(*keys, variable, n, mean, max, q)``.

    ``q`` is an array aligned with ``probs``; missing values are skipped and a
    group without values yields no row. NULL keys form a group of their own.
    The input is read twice, so its columns are written first unless the caller says it is ``staged``, a written table.
    """
    keys = list(keys)
    probs = list(probs)
    narrow = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keys, *columns])])
    long = melt(narrow if staged else cut(narrow), columns, keys)
    group = keys + ["variable"]

    edges = sorted({e for p in probs for e in (p - slack, p + slack) if 0 < e < 1}) or [0.5]

    def edge(e: float) -> str:
        # open (NULL) beyond the extremes and for small groups
        return f"if(n >= {SMALL_GROUP}, edge[{edges.index(e)}], NULL)" if e in edges else "cast(NULL AS DOUBLE)"

    sketch = cut(long.groupBy(*group).agg(
        F.expr("count(x) AS n"), F.expr("avg(x) AS mean"), F.expr("max(x) AS max"),
        F.percentile_approx("x", [float(e) for e in edges], accuracy).alias("edge"),
    ))
    side = "broadcast" if sketch.count() <= BROADCAST_GROUPS else "merge"
    slivers = ", ".join(
        f"struct({i} AS i, {edge(p - slack)} AS lo, {edge(p + slack)} AS hi)" for i, p in enumerate(probs)
    )
    right = sketch.selectExpr(
        *[f"`{k}` AS `__{k}`" for k in group], "struct(n, mean, max) AS st", f"array({slivers}) AS sl"
    )
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in group]
    placed = long.join(right.hint(side), same, "inner").select(*group, "st", "x", F.explode("sl").alias("s"))
    # all rows below a sliver collapse into one NULL-valued counter per task
    counted = (
        placed.where("coalesce(x <= s.hi, true)")
        .selectExpr(*[f"`{k}`" for k in group], "st", "s.i AS i", "if(coalesce(x < s.lo, false), NULL, x) AS v")
        .groupBy(*group, "st", "i", "v")
        .agg(F.count("*").alias("c"))
    )
    ranked = _running_count(counted, [*group, "i"], side)
    ranked = ranked.withColumn("pos", F.expr(f"array({', '.join(f'{float(q)}D' for q in probs)})[i] * (st.n - 1)"))
    # the value whose cumulative count first exceeds a 0-based rank
    at_rank = "max(CASE WHEN v IS NOT NULL AND upto > {0} AND upto - c <= {0} THEN v END)"
    picked = ranked.groupBy(*group, "st", "i", "pos").agg(
        F.expr(at_rank.format("floor(pos)") + " AS a"), F.expr(at_rank.format("ceil(pos)") + " AS b")
    )
    missed = "raise_error('a wanted rank fell outside its bracket; raise slack')"
    value = f"if(a IS NULL OR b IS NULL, cast({missed} AS DOUBLE), a + (pos - floor(pos)) * (b - a))"
    one = picked.groupBy(*group, "st").agg(
        F.expr(f"transform(array_sort(collect_list(struct(i, {value} AS v))), s -> s.v) AS q")
    )
    return one.selectExpr(*[f"`{k}`" for k in group], "st.n", "st.mean", "st.max", "q")


def _running_count(counted: DataFrame, keys: Sequence[str], side: str = "merge") -> DataFrame:
    """``counted`` with ``upto``, the running sum of ``c`` in order of ``v`` within ``keys``.

    Values are range-partitioned and written, partitions are summed, and their running totals, a row per key and one per partition at most, are added back.
    """
    by = [F.col(f"`{k}`") for k in keys]
    order = F.col("v").asc_nulls_first()
    placed = cut(counted.repartitionByRange(*by, order).withColumn("__p", F.spark_partition_id()))
    totals = placed.groupBy(*by, "__p").agg(F.sum("c").alias("__c"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    bases = totals.select(*[c.alias(f"__{k}") for c, k in zip(by, keys)], F.col("__p").alias("__q"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
    local = placed.withColumn("__local", F.sum("c").over(Window.partitionBy(*by, "__p").orderBy(order)))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in keys] + [F.col("__p") == F.col("__q")]
    return local.join(bases.hint(side), same).select(*[F.col(f"`{c}`") for c in counted.columns], (F.col("__base") + F.col("__local")).alias("upto"))


def exact_medians(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    names: Sequence[str] | None = None,
    staged: bool = False,
) -> DataFrame:
    """One row per group with one median column per input column."""
    names = list(names or [f"median_{c}" for c in columns])
    long = exact_quantiles(df, keys, columns, [0.5], staged=staged)
    picks = [F.expr(f"max(if(variable = '{c}', q[0], NULL)) AS `{n}`") for c, n in zip(columns, names)]
    return long.groupBy(*keys).agg(*picks)
