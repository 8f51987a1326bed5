"""Sentence tokens and the line protocol of extraction replies, as Column expressions.

A token names a sentence, S12, perhaps with clauses in circled numbers, S12.②-④, in plain ones, S12.c2-c4, or with a
range of characters, S12:3-9. A range that doesn't fit its sentence names the whole sentence; what is no token at all, or
names no known sentence, is passed by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CIRCLED, clauses, ustrip

TOKEN = r"^\s*(S\d+)(?:\.([①-⑳])(?:-([①-⑳]))?|\.c(\d+)(?:-c?(\d+))?|:(\d+)-(\d+))?\s*$"
ISSUE = r"(?i)^\s*ISSUE\s+(.*?)\s*\|\|\|\s*(support|oppose|neutral)\s*\|\|\|\s*(.*?)\s*$"


def token_sid(token: Column) -> Column:
    return F.nullif(F.regexp_extract(token, TOKEN, 1), F.lit(""))


def token_text(token: Column, sentence: Column) -> Column:
    """The part of its sentence that a token names."""
    part = lambda k: F.nullif(F.regexp_extract(token, TOKEN, k), F.lit(""))
    base = ustrip(sentence)
    each = clauses(base)
    n = F.size(each)
    circled = F.position(part(2), F.lit(CIRCLED)), F.position(F.coalesce(part(3), part(2)), F.lit(CIRCLED))
    plain = part(4).cast("int"), F.coalesce(part(5), part(4)).cast("int")
    cut = lambda i, j: ustrip(F.regexp_replace(F.array_join(F.slice(each, i, j - i + 1), ""), "^[，；、 ]+|[，；、 ]+$", ""))
    fits = lambda i, j: (i >= 1) & (i <= j) & (j <= n)
    i, j = circled
    # A circled range past the end is cut to it; one that starts past it names the whole sentence.
    last = F.when((j < i) | (j > n), F.least(F.greatest(i, F.lit(1)), n)).otherwise(j)
    chosen = F.when(part(2).isNotNull() & fits(i, last), cut(i, last)).when(part(4).isNotNull() & fits(*plain), cut(*plain))
    a, b = part(6).cast("int"), part(7).cast("int")
    chosen = F.coalesce(chosen, F.when(part(6).isNotNull() & (a < b) & (b <= F.length(base)), F.substring(base, a + 1, b - a)))
    return F.when(F.length(chosen) > 0, chosen).otherwise(base)


def issues(replies: DataFrame) -> DataFrame:
    """sample_id, line, name, stance, token_no, token: one row for each token of each ISSUE line of column reply."""
    lines = replies.select("sample_id", F.posexplode(F.split("reply", "\n")).alias("line", "text")).where(F.col("text").rlike(ISSUE))
    get = lambda k: F.regexp_extract("text", ISSUE, k)
    rows = lines.select("sample_id", "line", get(1).alias("name"), F.lower(get(2)).alias("stance"), F.posexplode(F.split(get(3), r"\s*[,，]\s*")).alias("token_no", "token"))
    return rows.where("token <> ''")


def compile_replies(replies: DataFrame, sentences: DataFrame, most_issues: int = 6, most_evidence: int = 3) -> DataFrame:
    """sample_id, issue_no, name, stance, evidence and future for each sample's issues that cite a known sentence.

    Tokens that repeat count once, issues of one name, stance and set of sentences once; futures meet issues by place."""
    first = Window.partitionBy("sample_id", "line", "token").orderBy("token_no")
    tokens = issues(replies).withColumn("k", F.row_number().over(first)).where("k = 1").withColumn("sid", token_sid(F.col("token")))
    cited = tokens.join(sentences.select("sample_id", "sid", "text"), ["sample_id", "sid"])
    cited = cited.withColumn("e", F.struct("token_no", "sid", token_text(F.col("token"), F.col("text")).alias("text")))
    each = cited.groupBy("sample_id", "line", "name", "stance").agg(F.slice(F.sort_array(F.collect_list("e")), 1, most_evidence).alias("e"))
    same = Window.partitionBy("sample_id", "name", "stance", F.transform("e", lambda x: x["sid"])).orderBy("line")
    each = each.withColumn("k", F.row_number().over(same)).where("k = 1")
    each = each.withColumn("issue_no", F.row_number().over(Window.partitionBy("sample_id").orderBy("line")) - 1).where(F.col("issue_no") < most_issues)
    said = replies.select("sample_id", F.transform(F.filter(F.split("reply", "\n"), lambda x: F.startswith(x, F.lit("FUTURE"))), lambda x: ustrip(F.substring(x, F.lit(7), F.length(x)))).alias("said"))
    out = each.join(said, "sample_id")
    return out.select("sample_id", "issue_no", "name", "stance", F.transform("e", lambda x: x["text"]).alias("evidence"), F.coalesce(F.get("said", F.col("issue_no")), F.lit("")).alias("future"))
