"""Extraction flows around an injected generator: a function from a column of prompts (and one of seeds) to a column of
replies, such as a pandas UDF around a model. Each phase is one pass over the samples that need it.

Cases: a reply is empty if it is null or has no ISSUE line; a sample whose replies all fail gets the fallback record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import rewrite
from .protocol import ISSUE

Generator = Callable[[Column, Column], Column]


def count_issues(reply: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(reply, F.lit("")), "\n"), lambda x: x.rlike(ISSUE))
    return F.size(lines)


def dry_run(samples: DataFrame, n: int = 3, order: str = "sample_id") -> DataFrame:
    """The prompts of the first n samples; nothing is generated."""
    return samples.orderBy(order).limit(n).select(order, "prompt", F.length("prompt").alias("chars"))


def replies(samples: DataFrame, generate: Generator, attempts: int = 2, least: int = 1, base_seed: int = 0) -> DataFrame:
    """Adds reply, n_issues, attempts (calls made) and failed to rows of sample_id and prompt. A reply with fewer than
    `least` issues is asked for again with another seed, and the new one is taken only if it has more."""
    ident = rewrite.seed(F.col("sample_id"), base_seed)
    out = samples.withColumn("reply", T.without_thinking(generate(F.col("prompt"), ident))).withColumn("n_issues", count_issues(F.col("reply"))).withColumn("attempts", F.lit(1))
    for k in range(1, attempts):
        need = F.col("n_issues") < least
        # A sample that needs nothing sends a null prompt, which the generator passes by.
        again = T.without_thinking(generate(F.when(need, F.col("prompt")), ident + 1000 * k))
        out = out.withColumn("again", again).withColumn("n_again", F.when(need, count_issues(F.col("again"))).otherwise(0))
        better = need & (F.col("n_again") > F.col("n_issues"))
        out = out.withColumns({"attempts": F.col("attempts") + need.cast("int"), "reply": F.when(better, F.col("again")).otherwise(F.col("reply")), "n_issues": F.greatest("n_issues", "n_again")}).drop("again", "n_again")
    return out.withColumn("failed", F.col("n_issues") == 0)


def failures(asked: DataFrame) -> DataFrame:
    """Rows for the failure log: what failed for good was given the fallback record."""
    return asked.where("failed").select("sample_id", F.col("attempts").alias("attempt"), F.lit("no issue in the reply").alias("error"), F.lit(True).alias("recovered"))


def futures(records: DataFrame, generate: Generator, prompt: Callable[[Column, Column], Column], base_seed: int = 0) -> DataFrame:
    """Rows of sample_id, issue_no, name, evidence and future with the future generated anew: what the reply's first FUTURE
    line says, else the old one, else the fallback. Nothing else changes."""
    raw = generate(prompt(F.col("name"), F.col("evidence")), rewrite.seed(F.col("sample_id"), base_seed))
    old = F.when(F.length(T.ustrip(F.coalesce("future", F.lit("")))) > 0, F.col("future")).otherwise(rewrite.fallback_future(F.get("evidence", 0)))
    return records.withColumn("raw", T.without_thinking(raw)).withColumn("future", T.future_pointing(F.col("name"), rewrite.future_line(F.col("raw"), old))).drop("raw")


def draws(samples: DataFrame, generate: Generator, n: int, base_seed: int = 0) -> DataFrame:
    """n replies of each sample, with seeds 1000 apart: sample_id, variant, reply; for merging or the best of n."""
    rows = samples.select("sample_id", "prompt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("variant"))
    return rows.select("sample_id", "variant", T.without_thinking(generate(F.col("prompt"), rewrite.seed(F.col("sample_id"), base_seed) + 1000 * F.col("variant"))).alias("reply"))
