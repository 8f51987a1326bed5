"""Queries of segmentation, alignment, protocol and fusion over documents, passages and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lcs
from ..functions import text as T
from ..operators import agreement, align, fuse, protocol, repair, rewrite, segment, training, validate
from . import texts


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("sample_id"), F.lit(0).alias("doc_index"), F.col("text").alias("full_text"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.sentences(_samples(spark, sf_dir), segment.LATIN)


def segment_documents(spark, sf_dir):
    return _sentences(spark, sf_dir).select("sample_id", "sid", "sent_no", "start", "end", F.md5(F.col("text").cast("binary")).alias("digest"))


def length_stats(spark, sf_dir):
    """Count, mean, the value at place int(n * 0.95), and the largest of sentence lengths; by exact counts of lengths."""
    n = _sentences(spark, sf_dir).groupBy(F.length("text").alias("size")).agg(F.count("*").alias("n"))
    run = n.withColumns({"upto": F.sum("n").over(Window.orderBy("size")), "total": F.sum("n").over(Window.partitionBy())})
    return run.agg(F.max("total").alias("n"), F.round(F.sum(F.col("size") * F.col("n")) / F.max("total"), 6).alias("mean"), F.min(F.when(F.col("upto") > F.floor(F.col("total") * 0.95), F.col("size"))).alias("p95"), F.max("size").alias("most"))


def neighbourhood(spark, sf_dir):
    """Sentences within two of a document's first longest one."""
    s = _sentences(spark, sf_dir).select("sample_id", "sent_no", "sid", "text")
    cited = s.groupBy("sample_id").agg(F.max_by("sent_no", F.struct(F.length("text").alias("n"), (-F.col("sent_no")).alias("k"))).alias("sent_no"))
    return segment.neighbourhood(s, cited, 2).select("sample_id", "sid")


def prompt_body(spark, sf_dir):
    s = _sentences(spark, sf_dir)
    line = F.concat(F.lit("["), "sid", F.lit("] "), "text")
    body = s.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("sent_no", line.alias("line")))).alias("x"))
    return body.select("sample_id", F.size("x").alias("n"), F.md5(F.array_join(F.transform("x", lambda r: r["line"]), "\n").cast("binary")).alias("digest"))


def rouge_l(spark, sf_dir):
    """Passages against the passage of the next id."""
    p = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    both = p.join(p.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return both.select("item_id", F.round(lcs.rouge_l(F.col("text"), F.col("other")), 6).alias("f1"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages in the documents that hold them, and a piece of each."""
    p = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    held = texts.containment_pairs(spark, sf_dir).join(p, "item_id")
    each = F.array(F.struct((F.col("item_id") * 2).alias("evidence_no"), F.col("text").alias("evidence")), F.struct((F.col("item_id") * 2 + 1).alias("evidence_no"), F.substring("text", 30, 25).alias("evidence")))
    return held.select(F.col("doc_id").alias("sample_id"), F.explode(each).alias("e")).select("sample_id", "e.*")


def _covers(spark, sf_dir):
    evidence = _evidence(spark, sf_dir)
    # Only documents with evidence are cut into sentences.
    docs = _samples(spark, sf_dir).join(evidence.select("sample_id").distinct(), "sample_id", "left_semi")
    return align.covers(segment.sentences(docs, segment.LATIN), docs, evidence)


def minimal_cover(spark, sf_dir):
    return _covers(spark, sf_dir).select("sample_id", "evidence_no", F.array_join("sids", ",").alias("sids"))


def containment_stats(spark, sf_dir):
    return align.containment(_covers(spark, sf_dir))


def reference_protocol(spark, sf_dir):
    """Protocol lines of reference records: each held passage is an issue that cites the sentences of its evidence."""
    cited = rewrite.aligned(_covers(spark, sf_dir).withColumn("issue_no", F.expr("evidence_no div 2")))
    issues = cited.select("sample_id", "issue_no", F.concat(F.lit("n\n"), "issue_no").alias("name"), F.lit("support").alias("stance"), F.col("sids").alias("tokens"), F.lit("f").alias("future"))
    return rewrite.protocol_lines(issues)


def _cited(spark, sf_dir):
    """Sentences, documents and evidence by issue, of the documents that hold passages."""
    evidence = _evidence(spark, sf_dir).withColumn("issue_no", F.expr("evidence_no div 2"))
    docs = _samples(spark, sf_dir).join(evidence.select("sample_id").distinct(), "sample_id", "left_semi")
    return segment.sentences(docs, segment.LATIN), docs, evidence


def trimmed_coverage(spark, sf_dir):
    """How much of each piece of evidence is left when its sentences are cut to the clauses about a name."""
    s, docs, evidence = _cited(spark, sf_dir)
    cut = lambda name, text: T.trim_evidence(name, text, ",;. ")
    held = align.covers(s, docs, evidence, hosted=True)
    return rewrite.coverage(align.trimmed(held, s, evidence.withColumn("name", F.substring("evidence", 5, 10)), cut))


def clause_protocol(spark, sf_dir):
    """Protocol lines that cite clauses: each held passage is an issue of two pieces of evidence."""
    tokens = align.clause_tokens(*_cited(spark, sf_dir), marks=T.LATIN_MARKS)
    issues = tokens.select("sample_id", "issue_no", F.concat(F.lit("n\n"), "issue_no").alias("name"), F.lit("support").alias("stance"), "tokens", F.lit("f").alias("future"))
    return rewrite.protocol_lines(issues)


def segment_sweep(spark, sf_dir):
    """Sentences and containment of evidence under profiles of other lengths."""
    profiles = {"baseline": {}, "shortest_24": {"shortest": 24}, "shortest_48": {"shortest": 48}, "joined_200": {"joined": 200}, "long_140": {"long": 140}, "cap_256": {"cap": 256}}
    marks = {"primary": ".!?\n", "secondary": ";", "tertiary": ","}
    _, docs, evidence = _cited(spark, sf_dir)
    return align.sweep(docs, evidence, {name: segment.Profile(**marks, **more) for name, more in profiles.items()})


def training_rows(spark, sf_dir):
    """Extraction and future rows from held passages; issues with an even id oppose, and their documents are boosted."""
    s, docs, evidence = _cited(spark, sf_dir)
    tokens = align.clause_tokens(s, docs, evidence, marks=T.LATIN_MARKS)
    stance = F.when(F.col("issue_no") % 2 == 0, "oppose").otherwise("support")
    issues = evidence.select("sample_id", "issue_no").distinct().select("*", F.concat(F.lit("n"), F.col("issue_no") % 3).alias("name"), stance.alias("stance"), F.concat(F.lit("f"), "issue_no").alias("future"))
    line = F.concat(F.lit("["), "sid", F.lit("] "), T.mark_clauses(F.col("text"), 60, T.LATIN_MARKS))
    bodies = s.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("sent_no", line.alias("line")))).alias("x")).select("sample_id", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("body"))
    out = training.rows(issues, tokens, s, bodies, ("extract", "Name the issues."), ("future", "Say what follows."), repeat=2, boost=2)
    return out.select("task", "sample_id", "issue_no", "copy", "chars", F.md5(F.element_at("messages", -1)["content"].cast("binary")).alias("digest"))


def recover_ids(spark, sf_dir):
    """Every sentence, whole and by its part from the third character on, looked up again among its document's."""
    s = _sentences(spark, sf_dir)
    each = F.array(F.struct((F.col("sent_no") * 2).alias("text_no"), F.col("text").alias("text")), F.struct((F.col("sent_no") * 2 + 1).alias("text_no"), F.expr("substring(text, 3)").alias("text")))
    return align.recovered(s, s.select("sample_id", F.explode(each).alias("x")).select("sample_id", "x.*").where("text <> ''"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for each document that cites its sentences in turn, last ones too, and some that it lacks."""
    d = _sentences(spark, sf_dir).groupBy("sample_id").agg(F.max("sent_no").alias("most"))
    k = F.col("sample_id")
    cite = lambda n: F.concat(F.lit("ISSUE name"), ((k + n) % 3).cast("string"), F.lit(" ||| "), F.when((k + n) % 2 == 0, "support").otherwise("OPPOSE"), F.lit(" ||| S01, "), F.format_string("S%02d", (k * 7 + n) % (F.col("most") + 2) + 1), F.lit(", S02.c1"))
    return d.select("sample_id", F.concat_ws("\n", cite(0), F.lit("noise"), cite(1), cite(2), F.lit("FUTURE first"), F.lit("FUTURE second")).alias("reply"))


def compile_protocol(spark, sf_dir):
    s = _sentences(spark, sf_dir).select("sample_id", "sid", "text")
    out = protocol.compile_replies(_replies(spark, sf_dir), s)
    return out.select("sample_id", "issue_no", "name", "stance", F.size("evidence").alias("n_evidence"), F.md5(F.array_join("evidence", "|").cast("binary")).alias("digest"), "future")


def json_repair(spark, sf_dir):
    """Objects of passages, cut at places that the id gives, and what can be read of them."""
    p = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = F.to_json(F.struct(F.col("item_id").alias("id"), F.array("text", "text").alias("texts")))
    cut = F.substring(whole, F.lit(1), F.length(whole) - F.col("item_id").cast("int") % 60)
    return p.select("item_id", repair.extract_json(F.concat(F.lit("<think>{</think>"), cut)).alias("object"))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three variants of each conversation's turns as records: one keeps all, others drop turns and turn stances."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text", F.explode(F.array(*map(F.lit, range(3)))).alias("variant"))
    c = c.where("turn % (variant + 1) = 0")
    stance = F.when(F.col("variant") == 2, "neutral").when(F.col("turn") % 2 == 0, "support").otherwise("oppose")
    record = F.struct(F.regexp_extract("text", r"^\S+(?:\s+\S+){0,3}", 0).alias("name"), stance.alias("stance"), F.array("text").alias("evidence"), F.col("role").alias("future"))
    v = c.groupBy("conv_id", "variant").agg(F.sort_array(F.collect_list(F.struct("turn", record.alias("r")))).alias("x"))
    v = v.select("conv_id", F.struct("variant", F.transform("x", lambda x: x["r"]).alias("issues")).alias("v"))
    return v.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(F.col("v.variant").alias("k"), "v"))).alias("x")).select("conv_id", F.transform("x", lambda x: x["v"]).alias("v"))


def _fused(strategy: fuse.Strategy):
    def run(spark, sf_dir):
        rows = _variants(spark, sf_dir).select("conv_id", F.posexplode(fuse.fuse(F.col("v"), strategy)).alias("k", "r"))
        return rows.select("conv_id", "k", "r.name", "r.stance", F.size("r.evidence").alias("n_evidence"), "r.future")

    return run


def mbr_select(spark, sf_dir):
    return _variants(spark, sf_dir).select("conv_id", fuse.closest(F.col("v")).alias("variant"))


def agreement_report(spark, sf_dir):
    """The first variant of each conversation against the last one."""
    v = _variants(spark, sf_dir)
    side = lambda k: F.element_at(F.filter("v", lambda x: x["variant"] == k), 1)["issues"]
    both = v.where(F.size("v") == 3).select(F.col("conv_id").alias("sample_id"), side(0).alias("a"), side(2).alias("b"))
    r = agreement.report(both)
    return r.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_no and line of a record for each label, with faults that its id gives."""
    d = spark.read.parquet(f"{sf_dir}/labels.parquet")
    k = F.col("doc_id")
    line = F.concat(F.lit('{"sample_id":"'), (k - F.when(k % 17 == 0, 1).otherwise(0)).cast("string"), F.lit('","issue_list":[{"issue_name":"'), F.when(k % 5 == 0, " ").otherwise("n"), F.lit('","stance":"'), F.when(k % 7 == 0, "maybe").otherwise("support"), F.lit('","argument_chain":['), F.when(k % 11 == 0, "").otherwise('"e"'), F.lit("]}]"), F.when(k % 13 == 0, ',"more":1').otherwise(""), F.lit(',"future_argument":['), F.when(k % 3 == 0, "").otherwise('"f"'), F.lit("]"), F.when(k % 19 == 0, "").otherwise("}"))
    return d.select(k.alias("line_no"), line.alias("line"))


def validate_rows(spark, sf_dir):
    """Rules that raw lines of records break: bad JSON, keys, stances, blank names, evidence, lengths, repeated ids."""
    return violations(_lines(spark, sf_dir))


def validate_file(spark, sf_dir):
    """All rules of a file of result lines, against expected ids and source texts."""
    k = F.col("doc_id")
    d = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = d.select(k.cast("string").alias("sample_id"), F.when(k % 2 == 0, "text").otherwise("-").alias("text"))
    expected = d.where(k % 23 > 0).select(k.cast("string").alias("sample_id")).union(spark.range(1).select(F.lit("absent")))
    out = validate.violations(_lines(spark, sf_dir), expected, docs)
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("line_no", "sample_id", "place", "rule")])


def _named(line: Column) -> Column:
    """The id that a line names which can't be parsed: that of the first whole value of a top key sample_id; else null."""
    value = r'(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\s"{}\[\],]++(?=\s*[,}]))'
    parts = F.regexp_extract_all(line, F.lit(r'(?s)\G.*?"sample_id"\s*+:\s*+' + value), F.lit(0))
    ids = F.transform(parts, lambda _, k: F.from_json(F.concat(F.array_join(F.slice(parts, 1, k + 1), ""), F.lit("}")), "map<string,string>")["sample_id"])
    return F.get(F.filter(ids, lambda x: x.isNotNull()), 0)


def violations(lines: DataFrame) -> DataFrame:
    """line_no and rule for every rule that a line breaks. An id that a line of bad JSON names counts as used."""
    issue = "array<struct<issue_name:string,stance:string,argument_chain:array<string>>>"
    r = lines.withColumns({"m": F.from_json("line", "map<string,string>"), "r": F.from_json("line", f"struct<sample_id:string,issue_list:{issue},future_argument:array<string>>", {"mode": "PERMISSIVE"})})
    known = F.array(*map(F.lit, ("sample_id", "issue_list", "future_argument")))
    keys, each = F.map_keys("m"), F.col("r.issue_list")
    blank = lambda x: F.length(T.ustrip(F.coalesce(x, F.lit("")))) == 0
    broken = F.col("m").isNull() | ~F.endswith(T.ustrip(F.col("line")), F.lit("}"))
    r = r.withColumn("broken", broken).withColumn("id", F.when(F.col("broken"), _named(F.col("line"))).otherwise(F.col("r.sample_id")))
    # Lines without an id repeat none, and their numbers deal them out.
    first = F.row_number().over(Window.partitionBy("id", F.when(F.col("id").isNull(), F.col("line_no"))).orderBy("line_no"))
    rules = {
        "extra_keys": F.size(F.array_except(keys, known)) > 0,
        "missing_keys": F.size(F.array_except(known, keys)) > 0,
        "empty_list": F.coalesce(F.size(each), F.lit(0)) <= 0,
        "lengths_differ": F.size(each) != F.size("r.future_argument"),
        "bad_stance": F.exists(each, lambda x: ~F.coalesce(x["stance"].isin("support", "oppose", "neutral"), F.lit(False))),
        "blank_name": F.exists(each, lambda x: blank(x["issue_name"])),
        "empty_chain": F.exists(each, lambda x: F.coalesce(F.size(x["argument_chain"]), F.lit(0)) <= 0),
        "duplicate_id": F.col("id").isNotNull() & (F.col("first") > 1),
    }
    told = F.filter(F.array(*[F.when(~F.col("broken") & F.coalesce(c, F.lit(False)), n) for n, c in rules.items()], F.when(F.col("broken"), "bad_json")), lambda x: x.isNotNull())
    return r.withColumn("first", first).select("line_no", F.explode(told).alias("rule"))


QUERIES = {f.__name__: f for f in (segment_documents, length_stats, neighbourhood, prompt_body, rouge_l, minimal_cover, containment_stats, reference_protocol, trimmed_coverage, clause_protocol, segment_sweep, training_rows, recover_ids, compile_protocol, json_repair, mbr_select, agreement_report, validate_rows, validate_file)}
QUERIES |= {"fuse_anchored": _fused(fuse.ANCHORED), "consensus_filter": _fused(fuse.CONSENSUS), "merge_candidates": _fused(fuse.UNION)}
ORACLES = {
    "validate_file": """
WITH l AS (SELECT doc_id AS k, doc_id - CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS id FROM labels
), r AS (SELECT k, id, k % 19 = 0 AS bad FROM l
), seen AS (SELECT id::VARCHAR AS id, count(*) AS n FROM r WHERE NOT bad GROUP BY 1
), want AS (SELECT doc_id::VARCHAR AS id FROM labels WHERE doc_id % 23 > 0 UNION SELECT 'absent'
), t AS (
  SELECT k, id, '' AS place, 'invalid_json' AS rule FROM r WHERE bad
  UNION ALL SELECT k, id, '', 'extra_keys' FROM r WHERE k % 13 = 0
  UNION ALL SELECT k, id, '', 'lengths_differ' FROM r WHERE k % 3 = 0
  UNION ALL SELECT k, id, 'issue 0', 'bad_stance' FROM r WHERE k % 7 = 0
  UNION ALL SELECT k, id, 'issue 0', 'blank_name' FROM r WHERE k % 5 = 0
  UNION ALL SELECT k, id, 'issue 0', 'empty_chain' FROM r WHERE k % 11 = 0
  UNION ALL SELECT k, id, 'issue 0 evidence 0', 'not_in_source' FROM r WHERE k % 11 > 0 AND id % 2 > 0 AND id IN (SELECT doc_id FROM labels)
)
SELECT k::VARCHAR AS line_no, CASE WHEN rule = 'invalid_json' THEN '' ELSE id::VARCHAR END AS sample_id, place, rule FROM t
WHERE rule = 'invalid_json' OR k % 19 > 0
UNION ALL SELECT '', id, '', 'duplicate_id' FROM seen WHERE n > 1
UNION ALL SELECT '', id, '', 'unexpected_id' FROM seen WHERE id NOT IN (SELECT id FROM want)
UNION ALL SELECT '', id, '', 'missing_id' FROM want WHERE id NOT IN (SELECT id FROM seen)""",
    "validate_rows": """
WITH l AS (SELECT doc_id AS k, doc_id - CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS id FROM labels
), r AS (SELECT k, k % 19 = 0 AS bad, row_number() OVER (PARTITION BY id ORDER BY k) > 1 AS again FROM l)
SELECT k AS line_no, 'bad_json' AS rule FROM r WHERE bad
UNION ALL SELECT k, 'extra_keys' FROM r WHERE NOT bad AND k % 13 = 0
UNION ALL SELECT k, 'lengths_differ' FROM r WHERE NOT bad AND k % 3 = 0
UNION ALL SELECT k, 'bad_stance' FROM r WHERE NOT bad AND k % 7 = 0
UNION ALL SELECT k, 'blank_name' FROM r WHERE NOT bad AND k % 5 = 0
UNION ALL SELECT k, 'empty_chain' FROM r WHERE NOT bad AND k % 11 = 0
UNION ALL SELECT k, 'duplicate_id' FROM r WHERE NOT bad AND again""",
}
