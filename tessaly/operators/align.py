"""Evidence to the sentences that hold it: the smallest run of one, two or three neighbouring sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .segment import Profile, sentences_by_profile


def runs(sentences: DataFrame, docs: DataFrame, most: int = 3) -> DataFrame:
    """Runs of up to `most` sentences of one document: sample_id, width, first, sids, raw (a slice of the document) and
    joined (the sentences' texts end to end). sentences: sample_id, doc_index, sent_no, sid, start, end, text."""
    order = Window.partitionBy("sample_id", "doc_index").orderBy("sent_no")
    s = sentences
    for k in range(1, most):
        s = s.withColumn(f"next_{k}", F.lead(F.struct("sid", "text", "end"), k).over(order))
    kinds = []
    for width in range(1, most + 1):
        parts = [F.struct("sid", "text", "end"), *[F.col(f"next_{k}") for k in range(1, width)]]
        whole = F.struct(F.lit(width).alias("width"), F.array(*[p["sid"] for p in parts]).alias("sids"), F.concat(*[p["text"] for p in parts]).alias("joined"), parts[-1]["end"].alias("to"))
        kinds.append(F.when(parts[-1].isNotNull(), whole))
    rows = s.select("sample_id", "doc_index", F.col("sent_no").alias("first"), "start", F.explode(F.array_compact(F.array(*kinds))).alias("r"))
    both = rows.join(docs.select("sample_id", "doc_index", "full_text"), ["sample_id", "doc_index"])
    return both.select("sample_id", "doc_index", "first", "r.width", "r.sids", F.substring("full_text", F.col("start") + 1, F.col("r.to") - F.col("start")).alias("raw"), "r.joined")


def covers(sentences: DataFrame, docs: DataFrame, evidence: DataFrame, most: int = 3, hosted: bool = False) -> DataFrame:
    """sample_id, evidence_no, sids (null where no run holds it) for rows sample_id, evidence_no, evidence.

    The narrowest runs win; of those the shortest, then the first in order of sentence names (one sentence) or place.
    hosted: where documents hold the evidence, only the first of them counts."""
    some = evidence.where(F.length("evidence") > 0)
    found = runs(sentences, docs, most).join(some, "sample_id").where(F.contains("raw", F.col("evidence")) | F.contains("joined", F.col("evidence")))
    if hosted:
        host = docs.join(some, "sample_id").where(F.contains("full_text", F.col("evidence"))).groupBy("sample_id", "evidence_no").agg(F.min("doc_index").alias("host"))
        found = found.join(host, ["sample_id", "evidence_no"], "left").where("host is null or host = doc_index")
    size = F.when(F.col("width") == 1, F.length("joined")).otherwise(F.length("raw"))
    place = F.struct("width", size.alias("size"), F.when(F.col("width") == 1, F.col("sids")[0]).alias("name"), "first")
    best = found.groupBy("sample_id", "evidence_no").agg(F.min_by("sids", place).alias("sids"))
    return evidence.select("sample_id", "evidence_no").join(best, ["sample_id", "evidence_no"], "left")


def containment(covered: DataFrame) -> DataFrame:
    """How many pieces of evidence there are, and which shares lie in one sentence and in one or two."""
    n = F.coalesce(F.size("sids"), F.lit(0))
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6)
    return covered.agg(F.count("*").alias("n"), share(n == 1).alias("in_one"), share((n >= 1) & (n <= 2)).alias("in_one_or_two"))


def trimmed(covered: DataFrame, sentences: DataFrame, evidence: DataFrame, trim: Callable[[Column, Column], Column] = T.trim_evidence) -> DataFrame:
    """sample_id, evidence_no, gold and got: each piece of evidence and the trimmed texts, end to end, of the sentences
    that hold it; pieces that none holds are left out. evidence: sample_id, evidence_no, name, evidence."""
    each = covered.select("sample_id", "evidence_no", F.posexplode("sids").alias("p", "sid")).join(sentences.select("sample_id", "sid", "text"), ["sample_id", "sid"])
    cut = each.join(evidence.select("sample_id", "evidence_no", "name"), ["sample_id", "evidence_no"]).withColumn("cut", trim(F.col("name"), F.col("text")))
    got = cut.groupBy("sample_id", "evidence_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "cut"))), lambda x: x["cut"]), "").alias("got"))
    return got.join(evidence.select("sample_id", "evidence_no", F.col("evidence").alias("gold")), ["sample_id", "evidence_no"]).select("sample_id", "evidence_no", "gold", "got")


def recovered(sentences: DataFrame, texts: DataFrame) -> DataFrame:
    """sample_id, text_no, sid for rows sample_id, text_no, text: the first equal sentence, else the first that holds it."""
    s = sentences.select("sample_id", "sent_no", "sid", F.col("text").alias("sentence"))
    t = texts.select("sample_id", "text_no", "text")
    # Equal ones meet by their text; only the rest is looked for inside the sample's sentences.
    whole = s.select("sample_id", "sent_no", "sid", F.col("sentence").alias("text")).join(t, ["sample_id", "text"]).groupBy("sample_id", "text_no").agg(F.min_by("sid", "sent_no").alias("sid"))
    rest = t.join(whole, ["sample_id", "text_no"], "left_anti")
    part = s.join(rest, "sample_id").where(F.contains("sentence", F.col("text"))).groupBy("sample_id", "text_no").agg(F.min_by("sid", "sent_no").alias("sid"))
    return whole.unionByName(part)


def clause_token(sid: Column, sentence: Column, evidence: Column, least: int = 60, marks: str = T.CLAUSE_MARKS) -> Column:
    """The token of a sentence that holds the evidence: its bare name if it is short or the first clause has no circled
    number, else the clauses from the one where the evidence starts to the one where it ends."""
    ends = F.aggregate(T.clauses(sentence, marks), F.array().cast("array<int>"), lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + F.length(x))))
    start = F.position(evidence, sentence) - 1
    # Ends rise, so a clause's number is one more than how many end before the place.
    first = F.size(F.filter(ends, lambda e: e <= start)) + 1
    last = F.size(F.filter(ends, lambda e: e < start + F.length(evidence))) + 1
    mark = lambda k: F.substring(F.lit(T.CIRCLED), k, F.lit(1))
    one = F.concat(sid, F.lit("."), mark(first))
    token = F.when((last > first) & (last <= len(T.CIRCLED)), F.concat(one, F.lit("-"), mark(last))).otherwise(one)
    return F.when((F.length(sentence) < least) | (first > len(T.CIRCLED)), sid).otherwise(token)


def clause_tokens(sentences: DataFrame, docs: DataFrame, evidence: DataFrame, least: int = 60, marks: str = T.CLAUSE_MARKS) -> DataFrame:
    """sample_id, issue_no and tokens of rows sample_id, issue_no, evidence_no (one of its sample), evidence.

    Each piece takes the shortest sentence that holds it, of equal ones the first. Pieces that no single sentence holds
    take their smallest run in the first document with them, without sentences that a token before names. Issues without
    any token have no row."""
    s = sentences.select("sample_id", "sent_no", "sid", "text")
    place = F.struct(F.length("text").alias("n"), "sent_no")
    single = s.join(evidence.where(F.length("evidence") > 0), "sample_id").where(F.contains("text", F.col("evidence"))).groupBy("sample_id", "evidence_no").agg(F.min_by(F.struct("sid", "text", "evidence"), place).alias("b"))
    single = single.select("sample_id", "evidence_no", F.array(clause_token(F.col("b.sid"), F.col("b.text"), F.col("b.evidence"), least, marks)).alias("tokens"), F.lit(True).alias("single"))
    rest = evidence.join(single, ["sample_id", "evidence_no"], "left_anti")
    runs_ = covers(sentences, docs, rest, hosted=True).where("sids is not null").select("sample_id", "evidence_no", F.col("sids").alias("tokens"), F.lit(False).alias("single"))
    each = single.unionByName(runs_).join(evidence.select("sample_id", "issue_no", "evidence_no"), ["sample_id", "evidence_no"])
    listed = each.groupBy("sample_id", "issue_no").agg(F.sort_array(F.collect_list(F.struct("evidence_no", "tokens", "single"))).alias("x"))
    fresh = lambda have, x: F.filter(x["tokens"], lambda t: ~F.exists(have, lambda h: F.substring_index(h, ".", 1) == t))
    tokens = F.aggregate("x", F.array().cast("array<string>"), lambda have, x: F.concat(have, F.when(x["single"], x["tokens"]).otherwise(fresh(have, x))))
    return listed.select("sample_id", "issue_no", tokens.alias("tokens")).where(F.size("tokens") > 0)


def sweep(docs: DataFrame, evidence: DataFrame, profiles: dict[str, Profile]) -> DataFrame:
    """One row for each named profile: sentences, their mean length, the length at place int(n * 0.95) and the largest,
    pieces of evidence, and which shares of them lie in one sentence and in one or two."""
    s = sentences_by_profile(docs, profiles)
    names = F.explode(F.array(*map(F.lit, profiles))).alias("profile")
    by = lambda d, *rest: d.select("*", names).withColumn("sample_id", F.struct("profile", "sample_id")).select("sample_id", *rest)
    held = covers(s, by(docs, "doc_index", "full_text"), by(evidence, "evidence_no", "evidence"))
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6)
    n = F.coalesce(F.size("sids"), F.lit(0))
    shares = held.groupBy(F.col("sample_id.profile").alias("profile")).agg(F.count("*").alias("n"), share(n == 1).alias("in_one"), share((n >= 1) & (n <= 2)).alias("in_one_or_two"))
    sizes = s.groupBy(F.col("sample_id.profile").alias("profile"), F.length("text").alias("size")).agg(F.count("*").alias("k"))
    run = sizes.withColumns({"upto": F.sum("k").over(Window.partitionBy("profile").orderBy("size")), "total": F.sum("k").over(Window.partitionBy("profile"))})
    lengths = run.groupBy("profile").agg(F.max("total").alias("sentences"), F.round(F.sum(F.col("size") * F.col("k")) / F.max("total"), 6).alias("mean"), F.min(F.when(F.col("upto") > F.floor(F.col("total") * 0.95), F.col("size"))).alias("p95"), F.max("size").alias("most"))
    return lengths.join(shares, "profile", "left")
