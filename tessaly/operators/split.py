"""A held-out split of exact size: a scarce class first, then quotas by group.

Groups in order of name give one scarce row each in turn until `least` are taken. Quotas, less what was taken, are filled
next. What is missing to `total` goes to the largest groups as far as they have rows; what is too much is cut from the
largest fills. Rows come in order of `order`; a split of any other size than `total` is an error.

Cases: a null group is a group, first by name; a null `scarce` is not scarce; groups without a quota have none, and a
quota beyond a group's rows is not passed on, so it is an error unless other groups overshoot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sizes(groups: dict[str | None, tuple[int, int]], quota: Callable[[str | None], int], total: int, least: int) -> dict[str | None, tuple[int, int]]:
    """How many scarce rows, then how many of the others, each group gives; from its rows and its scarce rows."""
    names = sorted(groups, key=lambda g: (g is not None, g))
    taken = dict.fromkeys(names, 0)
    while sum(taken.values()) < least and any(taken[g] < groups[g][1] for g in names):
        for g in names:
            if taken[g] < groups[g][1] and sum(taken.values()) < least:
                taken[g] += 1
    fill = {g: max(0, quota(g) - taken[g]) for g in names}
    short = total - sum(taken.values()) - sum(fill.values())
    for g in sorted(names, key=lambda g: -groups[g][0]):
        give = min(max(0, short), max(0, groups[g][0] - taken[g] - fill[g]))
        fill[g] += give
        short -= give
    for g in sorted(names, key=lambda g: -fill[g]):
        cut = min(max(0, -short), fill[g])
        fill[g] -= cut
        short += cut
    out = {g: (taken[g], min(fill[g], groups[g][0] - taken[g])) for g in names}
    if (n := sum(map(sum, out.values()))) != total:
        raise ValueError(f"the split has {n} rows, not {total}")
    return out


def held_out(rows: DataFrame, group: str, order: list[str], quota: Callable[[str | None], int], total: int = 40, scarce: Column | None = None, least: int = 8) -> DataFrame:
    """The split's rows, with their place `k` in their group."""
    spark = rows.sparkSession
    rows = rows.withColumn("_scarce", F.lit(False) if scarce is None else F.coalesce(scarce, F.lit(False)))
    counts = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if("_scarce").alias("s")).collect()
    parts = sizes({r[0]: (r.n, r.s) for r in counts}, quota, total, least)
    share = spark.createDataFrame([(g, *n) for g, n in parts.items()], "_group string, _taken int, _fill int")
    place = lambda *by: F.row_number().over(Window.partitionBy(group, *by).orderBy(*order))
    # No more than `total` rows of each kind can be wanted; the places after that are over few rows.
    few = rows.withColumn("_k", place("_scarce")).where(F.col("_k") <= total)
    few = few.join(F.broadcast(share), F.col(group).eqNullSafe(F.col("_group")))
    few = few.withColumn("_first", F.col("_scarce") & (F.col("_k") <= F.col("_taken"))).withColumn("_k", place("_first"))
    kept = few.where(F.col("_first") | (F.col("_k") <= F.col("_fill")))
    return kept.withColumn("k", place().cast("int")).drop("_scarce", "_k", "_first", "_group", "_taken", "_fill")
