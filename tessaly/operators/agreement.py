"""How far two results agree on the samples that both have: pairs of records by alike names, and means over them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lcs import rouge_l
from .fuse import alike, grams

PAIRS = "array<struct<i:int,j:int,sim:double>>"


def greedy_pairs(a: list[str | None], b: list[str | None]) -> list[dict]:
    """The most alike pair of names first, of equals the later one; until one side is used up."""
    own, other = [grams(x) for x in a], [grams(x) for x in b]
    every = sorted(((alike(x, y), i, j) for i, x in enumerate(own) for j, y in enumerate(other)), reverse=True)
    rows, cols, out = set(), set(), []
    for sim, i, j in every:
        if i not in rows and j not in cols:
            rows.add(i)
            cols.add(j)
            out.append({"i": i, "j": j, "sim": sim})
    return out


def pairs(both: DataFrame) -> DataFrame:
    """One row for each pair. both: sample_id, a and b, arrays of struct(name, stance, evidence, future)."""

    @F.pandas_udf(PAIRS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([greedy_pairs(list(p), list(q)) for p, q in zip(x, y, strict=True)])

    names = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(both.schema[c].dataType)), lambda r: r["name"])
    rows = both.select("sample_id", "a", "b", F.explode(run(names("a"), names("b"))).alias("p"))
    return rows.select("sample_id", F.col("p.sim").alias("sim"), F.get("a", F.col("p.i")).alias("x"), F.get("b", F.col("p.j")).alias("y"))


def report(both: DataFrame) -> DataFrame:
    """One row: n_samples, n_pairs, name_similarity, stance_agreement, shared_evidence, evidence lengths of both sides,
    future_similarity and count_delta (b less a). Missing futures are empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    size = lambda c: F.sum(F.aggregate(F.coalesce(F.col(c), F.array().cast("array<string>")), F.lit(0), lambda s, t: s + F.length(t))) / F.sum(F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)))
    p = pairs(both).withColumn("future", rouge_l(text("x.future"), text("y.future")))
    told = p.agg(F.count("*").alias("n_pairs"), F.avg("sim").alias("name_similarity"), share(F.col("x.stance").eqNullSafe(F.col("y.stance"))).alias("stance_agreement"), share(F.arrays_overlap("x.evidence", "y.evidence")).alias("shared_evidence"), size("x.evidence").alias("evidence_length_a"), size("y.evidence").alias("evidence_length_b"), F.avg("future").alias("future_similarity"))
    counts = both.agg(F.count("*").alias("n_samples"), F.avg(F.size("b") - F.size("a")).alias("count_delta"))
    return counts.crossJoin(told)  # one row each


