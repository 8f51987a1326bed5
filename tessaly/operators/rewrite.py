"""Rewriting of extracted records: texts of records, trimming of evidence chains, fallbacks, normalisation, party
copies, protocol lines. Columns where Catalyst can say it; matching blocks of characters are an Arrow UDF.

Cases: a null chain is an empty one; null names and futures are empty texts."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lcs
from ..functions import text as T
from ..functions import vectors as V

# Wording of fallback records, document types that count as supportive.
LONG_FUTURE, SHORT_FUTURE = ("后续将延续「", "」所体现的现有安排。", 40), ("接下来双方将围绕「", "」进一步落实相关安排。", 24)
RULE_NAME, CORE_NAME = "文本主议题", "核心议题"
SUPPORTIVE = ("联合声明", "政策文件", "记者会")
NO_TEXTS = "array<string>"


def _texts(chain: Column) -> Column:
    return F.coalesce(chain, F.array().cast(NO_TEXTS))


def join_chain(chain: Column) -> Column:
    return F.array_join(_texts(chain), "\n")


def triple_text(name: Column, stance: Column, chain: Column) -> Column:
    """Name and stance in one line, then the chain; empty parts are left out."""
    part = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("\n", part(F.concat_ws(" ", part(name), part(stance))), part(join_chain(chain)))


def plain_text(name: Column, chain: Column) -> Column:
    """Name, a line end, the chain; the chain alone for a record without a name."""
    named = F.coalesce(name, F.lit(""))
    return F.when((named == "") & (F.size(_texts(chain)) > 0), join_chain(chain)).otherwise(F.concat(named, F.lit("\n"), join_chain(chain)))


def alpha(name: Column, chain: Column, other_name: Column, other_chain: Column) -> Column:
    """1 for equal texts, else the F1 of their longest common subsequence; stances don't count."""
    a, b = plain_text(name, chain), plain_text(other_name, other_chain)
    return F.when(a == b, 1.0).otherwise(lcs.rouge_l(a, b))


def argument_cosine(joined: Column, other_joined: Column, each: Column, other_each: Column, mode: str, dim: int) -> Column:
    """Cosine of two chains: of the vectors of their joined texts (newline), or of their texts' mean vectors (mean).

    Vectors are columns, encoded beforehand: an encoder inside a lambda would run again for each use."""
    if mode == "newline":
        return V.cosine(joined, other_joined)
    if mode == "mean":
        return V.dot(V.mean_unit(each, dim), V.mean_unit(other_each, dim))
    raise ValueError(mode)


def distinct_chain(chain: Column) -> Column:
    """Texts that aren't empty and aren't near duplicates of one kept before; the chain as it was if none is left."""
    keep = lambda s, x: F.when((F.length(x) == 0) | F.exists(s, lambda y: T.near_duplicate(x, y)) | F.array_contains(s, x), s).otherwise(F.concat(s, F.array(x)))
    return F.aggregate(_texts(chain), F.array().cast(NO_TEXTS), keep)


def trim_chain(name: Column, chain: Column) -> Column:
    out = distinct_chain(F.transform(_texts(chain), lambda x: T.trim_evidence(name, x)))
    return F.when(F.size(out) > 0, out).otherwise(_texts(chain))


def semantic_trim(name: Column, chain: Column, encode, longest: int = 64) -> Column:
    """Of a long text's runs of whole clauses, up to `longest` characters, the one whose vector has the largest inner
    product with the name's (the earliest of equal ones); near duplicates collapse."""
    whole = encode(name)
    edge = " ，。；、,;:："

    def best(t: Column) -> Column:
        text = T.ustrip(t)
        parts = F.filter(T.pieces(text, T.TRIM_MARKS), lambda x: F.length(T.ustrip(x)) > 0)
        runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda a: F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - a + 1, F.lit(longest))), lambda n: F.array_join(F.slice(parts, a, n), ""))))
        fit = F.filter(F.transform(F.filter(runs, lambda w: F.length(w) <= longest), lambda w: F.regexp_replace(w, f"^[{edge}]+|[{edge}]+$", "")), lambda w: F.length(w) > 0)
        rated = F.transform(fit, lambda w, i: F.struct(V.dot(whole, encode(w)).alias("s"), (-i).alias("i"), w.alias("x")))
        return F.when((F.length(text) <= longest) | (F.size(parts) <= 1) | (F.size(fit) == 0), text).otherwise(F.array_max(rated)["x"])

    out = distinct_chain(F.transform(_texts(chain), best))
    return F.when(F.size(out) > 0, out).otherwise(_texts(chain))


def fallback_future(evidence: Column, wording: tuple[str, str, int] = LONG_FUTURE) -> Column:
    before, after, most = wording
    text = T.ustrip(evidence) if wording is LONG_FUTURE else evidence
    return F.concat(F.lit(before), F.substring(F.coalesce(text, F.lit("")), 1, most), F.lit(after))


def future_line(reply: Column, otherwise: Column) -> Column:
    """What the first line that starts with FUTURE says, else the other text."""
    said = F.get(F.filter(F.transform(F.split(reply, "\n"), T.ustrip), lambda x: F.startswith(x, F.lit("FUTURE"))), 0)
    text = T.ustrip(F.substring(said, F.lit(7), F.length(said)))
    return F.when(F.length(text) > 0, text).otherwise(otherwise)


def seed(ident: Column, base: int = 0) -> Column:
    """The base plus the number that an id's digits make, if any."""
    return F.lit(base).cast("long") + F.coalesce(F.regexp_replace(ident.cast("string"), r"\D", "").try_cast("long"), F.lit(0).cast("long"))


def longest_text(gib: Column, asked: Column) -> Column:
    """Tokens of a training row that a device of so many GiB holds; what was asked for wins."""
    return F.when(asked > 0, asked).when(gib >= 43, 6144).when(gib >= 40, 4096).otherwise(3072)


def prior_stance(kind: Column) -> Column:
    return F.when(kind.isin(*SUPPORTIVE), "support").otherwise("neutral")


def longest_sentence(text: Column, most: int = 220, short: int = 60) -> Column:
    """The first of the longest sentences, cut; the start of the text if there is none."""
    each = T.sentences(F.coalesce(text, F.lit("")))
    best = F.array_max(F.transform(each, lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))["x"]
    return F.coalesce(F.substring(best, 1, most), F.substring(F.coalesce(text, F.lit("")), 1, short))


def _record(name: Column, stance: Column, evidence: Column, future: Column) -> Column:
    return F.struct(name.alias("name"), stance.alias("stance"), F.array(evidence).alias("evidence"), future.alias("future"))


def rule_record(sentence: Column, kind: Column) -> Column:
    """One record of the first sentence for a reply without any; null without a sentence."""
    return F.when(sentence.isNotNull(), _record(F.lit(RULE_NAME), prior_stance(kind), sentence, fallback_future(sentence)))


def core_record(text: Column, kind: Column) -> Column:
    """One record of the longest sentence."""
    evidence = longest_sentence(text)
    return _record(F.lit(CORE_NAME), prior_stance(kind), evidence, fallback_future(evidence, SHORT_FUTURE))


def longest_block(a: str, b: str) -> tuple[int, int]:
    """Start in b and length of the longest run of characters that both have."""
    m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b))
    return m.b, m.size


def forced(evidence: str | None, text: str | None, least: int = 6, most: int = 220, edge: str | None = None) -> str:
    """The evidence if the text has it, else the longest run they share if that is ten characters and half of it. edge:
    the characters that go at both ends, white space by default."""
    e, t = (evidence or "").strip(edge), text or ""
    if len(e) < least:
        return ""
    e = e[:most]
    if e in t:
        return e
    at, size = longest_block(e, t)
    return t[at : at + size] if size >= max(10, len(e) // 2) else ""


def force_substring(evidence: Column, text: Column, strip: Callable[[Column], Column] = T.ustrip) -> Column:
    """Like forced; strip takes away what doesn't count at the evidence's ends."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for e, t in batches:
            # Stripped before, and what the cut left at the end stays.
            yield pd.Series([forced(x, y, edge="") for x, y in zip(e, t, strict=True)])

    e = F.substring(strip(F.coalesce(evidence, F.lit(""))), 1, 220)
    # What the text has verbatim, or is too short, reaches no UDF.
    plain = (F.length(e) < 6) | F.contains(text, e)
    other = run(F.when(plain, "").otherwise(e), F.when(plain, "").otherwise(text))
    return F.when(F.length(e) < 6, "").when(F.contains(text, e), e).otherwise(other)


def kept_share(gold: Column, got: Column) -> Column:
    """Which share of a text's characters lie in blocks that another text has in the same order."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([sum(m.size for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) / len(x) if x else 0.0 for x, y in zip(a.fillna(""), b.fillna(""), strict=True)])

    return run(gold, got)


def coverage(rows: DataFrame) -> DataFrame:
    """Of rows gold and got: how many, the mean share kept, and the share of rows that keep nine tenths."""
    each = rows.where("got is not null").withColumn("kept", kept_share(F.col("gold"), F.col("got")))
    share = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return each.agg(F.count("*").alias("n"), share(F.col("kept")).alias("recall"), share((F.col("kept") >= 0.9).cast("double")).alias("fully_kept"))


def normalised(rows: DataFrame, most_issues: int = 6, most_evidence: int = 3, focus: int = 80) -> DataFrame:
    """sample_id and issues (name, stance, evidence, future) of rows sample_id, issues, futures, texts: limits come before
    validation; evidence is forced into one of the texts; records without name, stance or evidence go, and futures
    follow the places of those that stay."""
    each = rows.select("sample_id", "futures", "texts", F.posexplode(F.slice("issues", 1, most_issues)).alias("k", "r"))
    stance = F.coalesce(T.stance(F.col("r.stance")), F.lit(""))
    each = each.select("sample_id", "futures", "texts", "k", T.ustrip(F.coalesce("r.name", F.lit(""))).alias("name"), stance.alias("stance"), F.posexplode(F.slice(_texts(F.col("r.evidence")), 1, most_evidence)).alias("e", "evidence")).where("name <> '' and stance <> ''")
    tried = each.select("*", F.posexplode("texts").alias("t", "text")).withColumn("fixed", force_substring(F.col("evidence"), F.col("text"))).where("fixed <> ''")
    keys = ["sample_id", "k", "e"]
    won = tried.groupBy(*keys).agg(F.min_by(F.struct("futures", "name", "stance", "fixed"), "t").alias("w")).select(*keys, "w.*")
    cut = F.when(F.length("fixed") > focus, T.trim_focus(F.col("name"), F.col("fixed"))).otherwise(F.col("fixed"))
    chains = won.withColumn("cut", cut).groupBy("sample_id", "k", "name", "stance").agg(F.first("futures").alias("futures"), F.sort_array(F.collect_list(F.struct("e", "cut"))).alias("c"))
    chains = chains.withColumn("evidence", F.array_distinct(F.filter(F.transform("c", lambda x: x["cut"]), lambda x: F.length(x) > 0))).where(F.size("evidence") > 0)
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy("k")) - 1
    said = T.ustrip(F.coalesce(F.get("futures", F.col("place")), F.lit("")))
    future = F.when(F.length(said) > 0, said).otherwise(fallback_future(F.col("evidence")[0], SHORT_FUTURE))
    return chains.withColumn("place", place).withColumn("future", T.future_pointing(F.col("name"), future)).groupBy("sample_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name", "stance", "evidence", "future"))), lambda x: F.struct(x["name"].alias("name"), x["stance"].alias("stance"), x["evidence"].alias("evidence"), x["future"].alias("future"))).alias("issues"))


def parties(issues: DataFrame, sentences: DataFrame, most: int = 3) -> DataFrame:
    """The main issue once for each of the first `most` documents that speak, with its sentences there or the document's
    first one, then each other issue whose first sentence is known. issues: sample_id, issue_no, name, stance, sids,
    evidence, future; sentences: sample_id, doc_index, sent_no, sid, text. Adds speaker; place orders the copies."""
    s = sentences.select("sample_id", "doc_index", "sent_no", "sid", "text")
    speak = s.groupBy("sample_id", "doc_index").agg(F.min(F.struct("sent_no", "sid", "text")).alias("first"))
    speak = speak.withColumn("k", F.row_number().over(Window.partitionBy("sample_id").orderBy("doc_index"))).where(F.col("k") <= most)
    main = issues.where("issue_no = 0")
    cited = main.select("sample_id", F.posexplode("sids").alias("p", "sid")).join(s, ["sample_id", "sid"])
    own = cited.groupBy("sample_id", "doc_index").agg(F.sort_array(F.collect_list(F.struct("p", "sid", "text"))).alias("own"))
    copies = main.drop("sids", "evidence").join(speak, "sample_id").join(own, ["sample_id", "doc_index"], "left")
    take = lambda c: F.when(F.col("own").isNotNull(), F.transform("own", lambda x: x[c])).otherwise(F.array(F.col("first")[c]))
    copies = copies.select("sample_id", F.col("k").alias("place"), "name", "stance", take("sid").alias("sids"), take("text").alias("evidence"), "future", F.concat(F.lit("P"), F.col("doc_index") + 1).alias("speaker"))
    rest = issues.where((F.col("issue_no") > 0) & (F.size("evidence") > 0)).withColumn("sid", F.get("sids", 0)).join(s.select("sample_id", "sid", "doc_index"), ["sample_id", "sid"])
    future = F.when(F.length(T.ustrip(F.coalesce("future", F.lit("")))) > 0, F.col("future")).otherwise(fallback_future(F.col("evidence")[0]))
    rest = rest.select("sample_id", (F.col("issue_no") + most).alias("place"), "name", "stance", "sids", "evidence", future.alias("future"), F.concat(F.lit("P"), F.col("doc_index") + 1).alias("speaker"))
    return copies.unionByName(rest)


def aligned(covers: DataFrame) -> DataFrame:
    """sample_id, issue_no and sids: the sentences of an issue's evidence in order, each once. covers: with evidence_no
    and issue_no, sids null where nothing holds the evidence."""
    each = covers.where("sids is not null").groupBy("sample_id", "issue_no").agg(F.sort_array(F.collect_list(F.struct("evidence_no", "sids"))).alias("x"))
    return each.select("sample_id", "issue_no", F.array_distinct(F.flatten(F.transform("x", lambda r: r["sids"]))).alias("sids"))


def protocol_lines(issues: DataFrame) -> DataFrame:
    """sample_id and protocol: ISSUE lines, then FUTURE lines, of issues that cite a sentence. issues: sample_id, issue_no,
    name, stance, tokens, future."""
    flat = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\n"), F.lit(""))
    line = F.concat(F.lit("ISSUE "), flat("name"), F.lit(" ||| "), F.col("stance"), F.lit(" ||| "), F.array_join("tokens", ","))
    some = issues.where(F.size("tokens") > 0).select("sample_id", F.struct("issue_no", line.alias("line"), F.concat(F.lit("FUTURE "), flat("future")).alias("future")).alias("x"))
    each = some.groupBy("sample_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return each.select("sample_id", F.concat_ws("\n", F.transform("x", lambda r: r["line"]), F.transform("x", lambda r: r["future"])).alias("protocol"))


def public(issues: Column) -> Column:
    """Records with what a submission holds, without internal fields."""
    return F.transform(issues, lambda x: F.struct(x["name"].alias("issue_name"), x["stance"].alias("stance"), x["evidence"].alias("argument_chain")))


def scored_once(pairs: DataFrame, score, a: str = "a", b: str = "b") -> DataFrame:
    """pairs with a column score; each distinct pair is scored once."""
    known = pairs.select(a, b).distinct()
    known = known.withColumn("score", score(F.col(a), F.col(b)))
    l, r = pairs.alias("l"), known.alias("r")  # noqa: E741
    return l.join(r, F.expr(f"l.{a} <=> r.{a} and l.{b} <=> r.{b}")).select("l.*", "r.score")


def few_shot(samples: DataFrame, k: int, prefix: int = 500, budget: int = 60) -> DataFrame:
    """The k most diverse of the first `budget` samples that qualify: three to five records and as many futures, a text
    longer than the prefix that is cut after its last full stop, and three records whose evidence all lies before it.
    samples: sample_no, full_text, issues (name, stance, evidence), futures. The limits are the feature."""
    head = F.regexp_extract(F.substring("full_text", 1, prefix), r"(?s)^.*。", 0)
    n = F.size("issues")
    some = samples.where(n.between(3, 5) & (n == F.size("futures")) & (F.length("full_text") > prefix)).withColumn("head", head).where("head <> ''")
    kept = F.filter(F.arrays_zip("issues", "futures"), lambda z: (F.size(z["issues"]["evidence"]) > 0) & F.forall(z["issues"]["evidence"], lambda e: F.contains(F.col("head"), e)))
    some = some.withColumn("kept", kept).where(F.size("kept") >= 3).orderBy("sample_no").limit(budget)
    diverse = F.size(F.array_distinct(F.transform("kept", lambda z: z["issues"]["stance"])))
    return some.withColumn("diverse", diverse).orderBy(F.desc("diverse"), "sample_no").limit(k).select("sample_no", "head", "kept", "diverse")
