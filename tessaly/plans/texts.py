"""Text queries over documents and benchmark passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import split

NAME = "substring(text, 1, 12)"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def _digest(parts: Column) -> Column:
    """A whole list of strings in one value that both engines can compare."""
    return F.md5(F.array_join(parts, "|").cast("binary"))


def bigram_set_cosine(spark, sf_dir):
    """Passages against the passage of the next id."""
    p = _passages(spark, sf_dir).select("item_id", "text")
    both = p.join(p.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return both.select("item_id", F.round(T.set_cosine(T.bigrams(F.col("text")), T.bigrams(F.col("other"))), 6).alias("cosine"), T.near_duplicate(F.col("text"), F.col("other")).alias("near"))


def mentions_name(spark, sf_dir):
    """Whether a document speaks of the one before it, by its first letters as a name."""
    d = _documents(spark, sf_dir).select("doc_id", "text", F.expr(NAME).alias("name"))
    both = d.select("doc_id", "text").join(d.select((F.col("doc_id") + 1).alias("doc_id"), "name"), "doc_id")
    return both.select("doc_id", T.mentions(F.col("name"), F.col("text")).alias("mentions"))


def hash_encode(spark, sf_dir):
    """Signed hashed counts of a passage's pairs of characters, every occurrence counted; told by length and extremes."""
    p = _passages(spark, sf_dir)
    t = F.col("text")
    grams = F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    v = p.where(F.length(t) > 1).select("item_id", V.hashing(t, grams).alias("v"))
    return v.select("item_id", F.round(V.norm(F.col("v")), 6).alias("length"), F.array_max("v").alias("top"), F.array_min("v").alias("low"), F.array_join(F.transform("v", lambda x: x.cast("int").cast("string")), ",").alias("vector"))


def clause_split(spark, sf_dir):
    c = T.clauses(F.col("text"), T.LATIN_MARKS)
    return _documents(spark, sf_dir).select("doc_id", F.size(c).alias("n"), _digest(c).alias("digest"))


def mark_clauses(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(T.mark_clauses(F.col("text"), 60, T.LATIN_MARKS).cast("binary")).alias("digest"))


def regex_sentences(spark, sf_dir):
    found = T.sentences(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.size(found).alias("n"), _digest(found).alias("digest"), F.coalesce(F.array_max(F.transform(found, F.length)), F.lit(0)).alias("longest"))


def trim_evidence(spark, sf_dir):
    """Passages cut to the clauses that speak most of a name."""
    p = _passages(spark, sf_dir).withColumn("name", F.substring("text", 20, 10))
    return p.select("item_id", T.trim_evidence(F.col("name"), F.col("text"), ",;. ").alias("kept"))


def trim_focus(spark, sf_dir):
    """Passages cut to a wider run of clauses about a name."""
    p = _passages(spark, sf_dir).withColumn("name", F.substring("text", 20, 10))
    return p.select("item_id", T.trim_focus(F.col("name"), F.col("text"), ",;. ").alias("kept"))


def future_pointing(spark, sf_dir):
    p = _passages(spark, sf_dir)
    return p.select("item_id", F.md5(T.future_pointing(F.concat(F.lit("x"), F.col("item_id").cast("string")), F.col("text")).cast("binary")).alias("digest"))


def stance_parse(spark, sf_dir):
    """A stance named in a reply, else the one before."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    reply = F.concat(F.lit("STANCE "), F.when(F.col("turn") % 4 == 0, "support").when(F.col("turn") % 4 == 1, "OPPOSE").when(F.col("turn") % 4 == 2, "中立").otherwise("unsure"), F.lit("\n"), F.col("text"))
    said = T.stance(F.nullif(F.regexp_extract(reply, r"STANCE\s+(\S+)", 1), F.lit("")))
    return c.select("conv_id", "turn", F.coalesce(said, F.lit("neutral")).alias("stance"))


def containment_pairs(spark, sf_dir):
    """Which documents hold which passages whole. A passage's words meet documents by its rarest-looking word, its
    longest, so no passage is held against every document; one without a word between white space meets them by its
    first characters, eight at most. An empty passage is none."""
    word = r"[^\x20\x09-\x0D]+"
    d = _documents(spark, sf_dir).select("doc_id", "text")
    words = d.select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(word), F.lit(0)))).alias("w"))
    inner = F.regexp_extract_all("text", F.lit(r"(?<=[\x20\x09-\x0D])[^\x20\x09-\x0D]+(?=[\x20\x09-\x0D])"), F.lit(0))
    longest = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    p = _passages(spark, sf_dir).select("item_id", F.col("text").alias("passage"), longest.alias("w"))
    hits = words.select("doc_id", "w").join(p.select("item_id", "w"), "w").select("doc_id", "item_id")
    size = F.least(F.lit(8), F.length("passage"))
    few = p.where("w is null and passage <> ''").select("item_id", size.alias("n"), F.expr("substring(passage, 1, 8)").alias("gram"))
    for r in few.select("n").distinct().collect():  # eight lengths at most
        each = F.expr(f"array_distinct(transform(sequence(1, length(text) - {r.n} + 1), i -> substring(text, i, {r.n})))")
        grams = d.where(F.length("text") >= r.n).select("doc_id", F.explode(each).alias("gram"))
        hits = hits.unionByName(grams.join(few.where(F.col("n") == r.n), "gram").select("doc_id", "item_id"))
    hits = hits.distinct()
    return hits.join(d, "doc_id").join(p.select("item_id", "passage"), "item_id").where(F.contains("text", F.col("passage"))).select("item_id", "doc_id")


def substring_ratio(spark, sf_dir):
    """Share of passages that some document holds."""
    held = containment_pairs(spark, sf_dir).select("item_id").distinct()
    n = _passages(spark, sf_dir).join(held.withColumn("hit", F.lit(1)), "item_id", "left")
    return n.agg(F.count("*").alias("n"), F.count("hit").alias("held"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), F.lit(1.0)).alias("ratio"))


def doc_order(spark, sf_dir):
    """Documents of a sample in order of date, missing ones first, then of place."""
    from pyspark.sql import Window

    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("date", F.when(F.col("turn") % 3 == 0, None).otherwise(F.format_string("%04d", 9999 - F.col("turn"))))
    order = Window.partitionBy("conv_id").orderBy(F.coalesce("date", F.lit("")), "turn")
    return c.select("conv_id", "turn", (F.row_number().over(order) - 1).alias("doc_index"))


def duplicate_ids(spark, sf_dir):
    d = _documents(spark, sf_dir).select(F.md5(F.col("text").cast("binary")).alias("id"))
    return d.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def missing_extra_ids(spark, sf_dir):
    """Ids that labels lack, and labels of no document."""
    d, lab = _documents(spark, sf_dir).select("doc_id"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    lab = lab.where("doc_id % 3 <> 0").union(lab.where("doc_id % 3 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id")))
    return d.join(lab, "doc_id", "left_anti").select("doc_id", F.lit("missing").alias("kind")).union(lab.join(d, "doc_id", "left_anti").select("doc_id", F.lit("unexpected").alias("kind")))


def stratified_split(spark, sf_dir):
    """40 held-out documents: two by source, an order of digests within each; the operator moves what is short or too
    much between sources. There is no scarce class here, as the SQL beside it has none."""
    d = _documents(spark, sf_dir).select("doc_id", "source", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")).alias("h"))
    return split.held_out(d, "source", ["h", "doc_id"], lambda source: 2).select("doc_id", "source", "k")


def oversample(spark, sf_dir):
    """Two copies of each labelled document, four of toxic ones."""
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return lab.select("doc_id", F.explode(F.sequence(F.lit(1), F.when(F.col("toxic") == 1, 4).otherwise(2))).alias("copy"))


def fifo_join(spark, sf_dir):
    """The k-th turn of a role in a conversation meets the k-th turn of that role in the next one."""
    from pyspark.sql import Window

    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    c = c.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")))
    other = c.select((F.col("conv_id") - 1).alias("conv_id"), "role", "k", F.col("turn").alias("next_turn"))
    return c.join(other, ["conv_id", "role", "k"]).select("conv_id", "role", "turn", "next_turn")


def percentile_low(spark, sf_dir):
    """The value at place int((n - 1) * q) of a sorted list, by source."""
    from pyspark.sql import Window

    d = _documents(spark, sf_dir).select("source", "n_chars", "doc_id")
    w = Window.partitionBy("source")
    ranked = d.withColumns({"k": F.row_number().over(w.orderBy("n_chars", "doc_id")) - 1, "n": F.count("*").over(w)})
    at = lambda q: F.max(F.when(F.col("k") == F.floor((F.col("n") - 1) * F.lit(q)), F.col("n_chars")))
    return ranked.groupBy("source").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("n_chars").alias("most"))


def token_buckets(spark, sf_dir):
    """How many texts fit which context length, by an estimate of tokens."""
    e = _documents(spark, sf_dir).select((F.col("n_chars") / F.lit(1.5) + 40).alias("t"))
    return e.agg(F.count("*").alias("n"), F.floor(F.sum("t")).alias("tokens"), *[F.count_if(F.col("t") <= b).alias(f"to_{b}") for b in (2048, 3072, 4096, 6144, 8192)], F.count_if(F.col("t") > 8192).alias("over"))


def shared_literals(spark, sf_dir):
    """Lines that both German and English documents have, six characters at least."""
    d = _documents(spark, sf_dir)
    lines = lambda lang: d.where(F.col("lang") == lang).select(F.explode(F.split("text", "\n")).alias("line")).select(T.ustrip(F.col("line")).alias("line")).where(F.length("line") >= 6)
    return lines("de").intersect(lines("en"))


def majority_vote(spark, sf_dir):
    """The most frequent role of a conversation, the earliest of equals."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = c.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min("turn").alias("first"))
    return n.groupBy("conv_id").agg(F.max_by("role", F.struct("n", (-F.col("first")).alias("f"))).alias("role"), F.count("*").alias("distinct_votes"))


def evidence_union(spark, sf_dir):
    """Distinct sources by language, most frequent first, three at most."""
    from pyspark.sql import Window

    d = _documents(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    return d.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "first"))).where("k <= 3").select("lang", "source", "k")


def best_of_n(spark, sf_dir):
    """A document's variant with the best score, the first of equals; scores of exactly 0 don't count."""
    d = _documents(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("variant"), "n_chars")
    s = d.withColumn("score", ((F.col("n_chars") * (F.col("variant") + 3)) % 5).cast("double") / 5).where("score <> 0")
    return s.groupBy("doc_id").agg(F.max_by("variant", F.struct("score", (-F.col("variant")).alias("v"))).alias("variant"), F.max("score").alias("score"))


def resume_anti(spark, sf_dir):
    """Documents still to do: those that the output so far, here the labels, doesn't have."""
    d = _documents(spark, sf_dir).select("doc_id", "lang")
    return d.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_anti")


QUERIES = {f.__name__: f for f in (bigram_set_cosine, mentions_name, hash_encode, clause_split, mark_clauses, regex_sentences, trim_evidence, trim_focus, future_pointing, stance_parse, containment_pairs, substring_ratio, doc_order, duplicate_ids, missing_extra_ids, stratified_split, oversample, fifo_join, percentile_low, token_buckets, shared_literals, majority_vote, evidence_union, best_of_n, resume_anti)}

_GRAMS = "CASE WHEN length({0}) >= 2 THEN list_distinct(list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))) WHEN length({0}) = 1 THEN [{0}] ELSE [] END"
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"



ORACLES = {
    "bigram_set_cosine": f"""
WITH p AS (SELECT a.item_id, a.text AS t, b.text AS o, regexp_replace(a.text, '{_SPACE}', '', 'g') AS ts, regexp_replace(b.text, '{_SPACE}', '', 'g') AS os FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1
), g AS (SELECT item_id, {_GRAMS.format('ts')} AS x, {_GRAMS.format('os')} AS y, {_GRAMS.format('t')} AS u, {_GRAMS.format('o')} AS v FROM p)
SELECT item_id, round(len(list_intersect(x, y)) / sqrt(len(x)::DOUBLE * len(y)), 6) AS cosine, len(list_intersect(u, v)) / sqrt(len(u)::DOUBLE * len(v)) >= 0.85::DOUBLE AS near FROM g""",
    "mentions_name": f"""
WITH d AS (SELECT a.doc_id, a.text, regexp_replace(substr(b.text, 1, 12), '{_SPACE}', '', 'g') AS n FROM documents a JOIN documents b ON b.doc_id + 1 = a.doc_id)
SELECT doc_id, len(list_filter({_GRAMS.format('n')}, lambda g: contains(text, g))) > 0 AS mentions FROM d""",
    "hash_encode": """
WITH g AS (SELECT item_id, unnest(list_transform(range(1, length(text)), lambda i: md5(substr(text, i, 2)))) AS h FROM benchmark
), s AS (SELECT item_id, ('0x' || substr(h, 1, 2))::INT AS b, sum(CASE WHEN ('0x' || substr(h, 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM g GROUP BY ALL
), f AS (SELECT i.item_id, k.b, coalesce(s.v, 0.0::DOUBLE) AS v FROM (SELECT DISTINCT item_id FROM g) i CROSS JOIN range(256) k(b) LEFT JOIN s ON s.item_id = i.item_id AND s.b = k.b)
SELECT item_id, round(sqrt(sum(v * v)), 6) AS length, max(v) AS top, min(v) AS low, string_agg(v::INT::VARCHAR, ',' ORDER BY b) AS vector FROM f GROUP BY item_id""",
    "clause_split": f"""
WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^,;:]*[,;:]|[^,;:]+$') AS x FROM documents
), e AS (SELECT doc_id, unnest(x) AS s, unnest(range(len(x))) AS k FROM p
), n AS (SELECT doc_id, s, k, count(*) FILTER (length({_strip('s')}) > 0 OR k = 0) OVER (PARTITION BY doc_id ORDER BY k) AS c FROM e
), j AS (SELECT doc_id, c, string_agg(s, '' ORDER BY k) AS s FROM n GROUP BY doc_id, c)
SELECT doc_id, count(*)::INT AS n, md5(string_agg(s, '|' ORDER BY c)) AS digest FROM j GROUP BY doc_id""",
    "mark_clauses": """
WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '[^,;:]*[,;:]|[^,;:]+$') AS x FROM documents
), m AS (SELECT doc_id, text, list_transform(x, lambda s, i: CASE WHEN regexp_matches(s, '[,;:]$') AND i + 1 <= 20 THEN s || substr('①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳', i + 1, 1) ELSE s END) AS y FROM p)
SELECT doc_id, md5(CASE WHEN length(text) >= 60 THEN array_to_string(y, '') ELSE text END) AS digest FROM m""",
    "regex_sentences": f"""
WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?]+[。！？!?]?'), lambda s: {_strip('s')}), lambda s: length(s) >= 12) AS x FROM documents)
SELECT doc_id, len(x)::INT AS n, md5(array_to_string(x, '|')) AS digest, coalesce(list_max(list_transform(x, lambda s: length(s))), 0)::INT AS longest FROM p""",
    "trim_evidence": f"""
WITH p AS (SELECT item_id, {_strip('text')} AS t, substr(text, 20, 10) AS name FROM benchmark
), c AS (SELECT *, regexp_replace(name, '{_SPACE}', '', 'g') AS n, list_filter(regexp_extract_all(t, '[^,;. ]*[,;. ]|[^,;. ]+$'), lambda s: length({_strip('s')}) > 0) AS x FROM p
), g AS (SELECT *, {_GRAMS.format('n')} AS g FROM c
), s AS (SELECT item_id, g, x, unnest(range(1, len(x) + 1)) AS a FROM g
), w AS (SELECT item_id, g, a, unnest(range(1, least(len(x) - a + 1, 64) + 1)) AS k, x FROM s
), v AS (SELECT item_id, g, a, k, array_to_string(x[a:a + k - 1], '') AS y FROM w
), r AS (SELECT item_id, y, row_number() OVER (PARTITION BY item_id ORDER BY len(list_filter(g, lambda z: contains(y, z))) DESC, abs(length(y) - 55), a, k) AS best FROM v WHERE length(y) <= 64
), b AS (SELECT item_id, regexp_replace(y, '^[ ,，;；、:：]+|[ ,，;；、:：]+$', '', 'g') AS y FROM r WHERE best = 1)
SELECT c.item_id, CASE WHEN length(t) <= 64 OR len(x) <= 1 OR coalesce(length(y), 0) = 0 THEN t ELSE y END AS kept FROM c LEFT JOIN b USING (item_id)""",
    "future_pointing": f"""
WITH p AS (SELECT item_id, text, 'x' || item_id AS n FROM benchmark), g AS (SELECT *, {_GRAMS.format('n')} AS g FROM p)
SELECT item_id, md5(CASE WHEN length(text) > 0 AND len(list_filter(g, lambda x: contains(text, x))) = 0 THEN '关于' || n || '，' || text ELSE text END) AS digest FROM g""",
    "stance_parse": "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'support' WHEN 1 THEN 'oppose' ELSE 'neutral' END AS stance FROM conversations",
    "containment_pairs": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "substring_ratio": "WITH h AS (SELECT b.item_id, bool_or(contains(d.text, b.text)) AS hit FROM benchmark b CROSS JOIN documents d GROUP BY b.item_id) SELECT count(*) AS n, count(*) FILTER (hit) AS held, avg(hit::INT::DOUBLE) AS ratio FROM h",
    "doc_order": "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 3 = 0 THEN '' ELSE lpad((9999 - turn)::VARCHAR, 4, '0') END, turn) - 1)::INT AS doc_index FROM conversations",
    "duplicate_ids": "SELECT md5(text) AS id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "missing_extra_ids": """
WITH l AS (SELECT DISTINCT CASE WHEN doc_id % 3 <> 0 THEN doc_id ELSE doc_id + 1000000 END AS doc_id FROM labels)
SELECT doc_id, 'missing' AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l)
UNION ALL SELECT doc_id, 'unexpected' FROM l WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "stratified_split": "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id), doc_id)::INT AS k FROM documents) SELECT * FROM r WHERE k <= 2",
    "oversample": "SELECT doc_id, unnest(range(1, CASE WHEN toxic = 1 THEN 5 ELSE 3 END))::INT AS copy FROM labels",
    "fifo_join": "WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations) SELECT a.conv_id, a.role, a.turn, b.turn AS next_turn FROM c a JOIN c b ON b.conv_id = a.conv_id + 1 AND a.role = b.role AND a.k = b.k",
    "percentile_low": """
WITH r AS (SELECT source, list(n_chars ORDER BY n_chars) AS x FROM documents GROUP BY source)
SELECT source, x[floor((len(x) - 1) * 0.5::DOUBLE)::INT + 1] AS p50, x[floor((len(x) - 1) * 0.95::DOUBLE)::INT + 1] AS p95, list_max(x) AS most FROM r""",
    "token_buckets": "WITH e AS (SELECT n_chars / 1.5::DOUBLE + 40 AS t FROM documents) SELECT count(*) AS n, floor(sum(t))::BIGINT AS tokens, count(*) FILTER (t <= 2048) AS to_2048, count(*) FILTER (t <= 3072) AS to_3072, count(*) FILTER (t <= 4096) AS to_4096, count(*) FILTER (t <= 6144) AS to_6144, count(*) FILTER (t <= 8192) AS to_8192, count(*) FILTER (t > 8192) AS over FROM e",
    "shared_literals": f"WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT lang, {_strip('line')} AS line FROM l) SELECT line FROM s WHERE lang = 'de' AND length(line) >= 6 INTERSECT SELECT line FROM s WHERE lang = 'en'",
    "majority_vote": "WITH n AS (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM conversations GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) AS k, count(*) OVER (PARTITION BY conv_id) AS distinct_votes FROM n) SELECT conv_id, role, distinct_votes FROM r WHERE k = 1",
    "evidence_union": "WITH n AS (SELECT lang, source, count(*) AS n, min(doc_id) AS f FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f)::INT AS k FROM n) SELECT lang, source, k FROM r WHERE k <= 3",
    "best_of_n": "WITH s AS (SELECT doc_id, v::INT AS variant, ((n_chars * (v + 3)) % 5)::DOUBLE / 5 AS score FROM documents, range(3) t(v)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, variant) AS k FROM s WHERE score <> 0) SELECT doc_id, variant, score FROM r WHERE k = 1",
    "resume_anti": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
}
ORACLES["trim_focus"] = ORACLES["trim_evidence"].replace("64", "80").replace("- 55", "- 53").replace("[ ,，;；、:：]", "[ ，。；、,;]")
