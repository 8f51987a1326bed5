"""Training rows from reference records: extraction and future tasks as messages, boosted copies, a seeded order, and
token rows whose prompt is masked.

Cases: null names, stances and futures are empty texts; issues without sentences give no row; an empty table gives none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .protocol import token_sid, token_text

MESSAGES = "array<struct<role:string,content:string>>"
ENCODED = "struct<input_ids:array<int>,labels:array<int>>"
MASKED = -100  # fixed value: a label that no loss counts


def _messages(system: str, user: Column, answer: Column) -> Column:
    said = [("system", F.lit(system)), ("user", user), ("assistant", answer)]
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in said])


def _flat(c: str) -> Column:
    return F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\n"), F.lit(""))


def rows(issues: DataFrame, tokens: DataFrame, sentences: DataFrame, bodies: DataFrame, extract: tuple[str, str], future: tuple[str, str], taught: DataFrame | None = None, repeat: int = 1, boost: int = 1, boosted: str = "oppose", most: int = 3, seed: int = 0) -> DataFrame:
    """task, sample_id, issue_no, copy, messages, chars and order of a training set.

    issues: sample_id, issue_no, name, stance, future; tokens: sample_id, issue_no, tokens (clause_tokens); sentences:
    sample_id, sid, text; bodies: sample_id, body. extract and future: system text and instruction of either task. taught:
    sample_id, line_no, line, winning lines that extraction teaches in place of the reference's. Lines cite `most` tokens.
    A future row needs a line: the k-th issue of a name takes the k-th line of it. Extraction rows repeat, `boost` times
    more often where an issue has the boosted stance. order is a permutation that the seed gives."""
    lines = issues.join(tokens, ["sample_id", "issue_no"]).where(F.size("tokens") > 0).withColumn("tokens", F.slice("tokens", 1, most))
    own = lines.select("sample_id", F.col("issue_no").alias("line_no"), F.concat(F.lit("ISSUE "), _flat("name"), F.lit(" ||| "), F.coalesce("stance", F.lit("")), F.lit(" ||| "), F.array_join("tokens", ",")).alias("line"))
    if taught is not None:
        own = own.join(taught, "sample_id", "left_anti").unionByName(taught.select("sample_id", "line_no", "line"))
    answer = own.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    times = issues.groupBy("sample_id").agg(F.when(F.max((F.col("stance") == boosted).cast("int")) == 1, repeat * boost).otherwise(repeat).alias("times"))
    first = bodies.join(answer, "sample_id").join(times, "sample_id")
    said = _messages(extract[0], F.concat(F.lit(extract[1] + "\n"), "body"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"))
    one = first.select(F.lit("extract").alias("task"), "sample_id", F.lit(None).cast("long").alias("issue_no"), F.explode(F.sequence(F.lit(1), "times")).alias("copy"), said.alias("messages"))

    queue = lambda c: F.row_number().over(Window.partitionBy("sample_id", c).orderBy("issue_no"))
    wanted = issues.select("sample_id", F.col("issue_no").cast("long").alias("issue_no"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("stance", F.lit("")).alias("stance"), _flat("future").alias("future")).withColumn("k", queue("name"))
    queued = lines.withColumn("name", _flat("name")).withColumn("k", queue("name")).select("sample_id", "name", "k", F.posexplode("tokens").alias("place", "token"))
    cited = wanted.join(queued, ["sample_id", "name", "k"]).withColumn("sid", token_sid(F.col("token"))).join(sentences.select("sample_id", "sid", "text"), ["sample_id", "sid"])
    chain = cited.groupBy("sample_id", "issue_no", "name", "stance", "future").agg(F.sort_array(F.collect_list(F.struct("place", token_text(F.col("token"), F.col("text")).alias("text")))).alias("x"))
    user = F.concat(F.lit(future[1] + "\n议题："), "name", F.lit("\n立场："), "stance", F.lit("\n证据：\n"), F.array_join(F.transform("x", lambda r: F.concat(F.lit("- "), r["text"])), "\n"), F.lit("\n"))
    two = chain.select(F.lit("future").alias("task"), "sample_id", "issue_no", F.lit(1).alias("copy"), _messages(future[0], user, F.concat(F.lit("FUTURE "), "future")).alias("messages"))
    both = one.unionByName(two)
    chars = F.length(F.array_join(F.transform("messages", lambda m: m["content"]), "\n"))
    return both.withColumns({"chars": chars, "order": F.xxhash64(F.lit(seed), "task", "sample_id", "issue_no", "copy")})


def masked(prompt: Column, answer: Column, encoder: Callable[[], Callable[[str], list[int]]], end: str, longest: int) -> Column:
    """input_ids and labels of a prompt and its answer with an end mark; the prompt's labels are masked.

    Both are null for a blank answer and for more than `longest` ids: rows are left out, never cut. encoder makes the function from
    texts to ids, once in each worker. A prompt whose ids don't begin the whole's, or an answer whose ids don't follow
    them, is an error."""

    @F.pandas_udf(ENCODED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encode = encoder()

        def one(p: str | None, a: str | None) -> tuple[list[int] | None, list[int] | None]:
            if not (a or "").strip():
                return None, None
            head, said, whole = encode(p or ""), encode(a), encode(f"{p or ''}{a}{end}\n")
            n = len(head)
            if not n or whole[:n] != head or whole[n : n + len(said)] != said:
                raise ValueError("ids of prompt and answer don't begin the row's")
            return (whole, [MASKED] * n + whole[n:]) if len(whole) <= longest else (None, None)

        for p, a in batches:
            yield pd.DataFrame([one(x, y) for x, y in zip(p, a, strict=True)], columns=["input_ids", "labels"])

    return run(prompt, answer)


def padded(batches: DataFrame, pad: int, by: str = "batch") -> DataFrame:
    """Rows of a batch (input_ids, labels) padded on the right to the longest of it, and their attention_mask."""
    width = F.max(F.size("input_ids")).over(Window.partitionBy(by))
    wide = batches.withColumn("width", width)
    more = lambda x: F.array_repeat(F.lit(x), F.col("width") - F.size("input_ids"))
    ones = F.transform("input_ids", lambda x: F.lit(1))
    return wide.withColumns({"attention_mask": F.concat(ones, more(0)), "labels": F.concat("labels", more(MASKED)), "input_ids": F.concat("input_ids", more(pad))}).drop("width")
