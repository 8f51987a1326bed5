"""Scoring queries over the embeddings table.

Ten vectors with neighbouring ids make a sample of five reference and five predicted records: the even ones plus a share
of the second one are references, and predictions are mixed from references and the odd ones, so that some are near,
some ambiguous and some lost. A vector's halves stand for a record's name and arguments; their cosines stand for the
agreement of texts and futures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import scoring as S

MIX = [(1.0, 1.0, 0.3), (0.8, 1.0, 0.0), (0.7, 1.0, 0.2), (1.0, 0.2, 0.5), (1.0, 0.0, 0.9)]


def _times(k: float):
    return lambda p: p * F.lit(k)


def measure(p, g):
    name, arg = V.cosine(p["name_v"], g["name_v"]), V.cosine(p["arg_v"], g["arg_v"])
    return F.struct(name.alias("alpha"), arg.alias("rouge"), name.alias("semantic"))


def halves(records):
    return F.transform(records, lambda x: F.struct(x["stance"].alias("stance"), x["v"].alias("v"), F.slice(x["v"], 1, 32).alias("name_v"), F.slice(x["v"], 33, 32).alias("arg_v")))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.expr("vec_id div 10").alias("sample_id"), F.struct((F.col("vec_id") % 10).alias("m"), F.col("embedding").cast("array<double>").alias("v"), "label").alias("x"))
    g = e.groupBy("sample_id").agg(F.sort_array(F.collect_list("x")).alias("x")).where("size(x) = 10")
    label = lambda j: F.col("x")[2 * j]["label"]
    add = lambda a, b, s: F.zip_with(a, b, lambda p, q: p + F.lit(s) * q)
    golds = [F.struct(F.when(label(j) < 6, "support").when(label(j) <= 8, "neutral").otherwise("oppose").alias("stance"), add(F.col("x")[2 * j]["v"], F.col("x")[1]["v"], 0.8).alias("v")) for j in range(5)]
    g = g.withColumn("golds", F.array(*golds))
    preds = []
    for j, (a, b, n) in enumerate(MIX):
        own, other, noise = F.col("golds")[j], F.col("golds")[(j + 1) % 5], F.col("x")[2 * j + 1]["v"]
        v = add(add(F.transform(own["v"], _times(a)), other["v"], b), noise, n)
        stance = own["stance"] if j < 4 else F.when(own["stance"] == "support", "neutral").otherwise("support")
        preds.append(F.struct(stance.alias("stance"), v.alias("v")))
    return g.select("sample_id", halves(F.array(*preds)).alias("preds"), halves(F.col("golds")).alias("golds"))


ROWS = """
WITH RECURSIVE e AS (
  SELECT vec_id // 10 AS g, vec_id % 10 AS m, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings
), x AS (
  SELECT g, list(v ORDER BY m) AS vs, list(label ORDER BY m) AS ls FROM e GROUP BY g HAVING count(*) = 10
), gold AS (
  SELECT g, j, list_transform(range(1, 65), lambda k: vs[2 * j + 1][k] + 0.8::DOUBLE * vs[2][k]) AS v, vs[2 * j + 2] AS z,
    CASE WHEN ls[2 * j + 1] < 6 THEN 'support' WHEN ls[2 * j + 1] <= 8 THEN 'neutral' ELSE 'oppose' END AS stance
  FROM x, range(5) t(j)
), mixing(j, a, b, n) AS (
  VALUES (0, 1.0::DOUBLE, 1.0::DOUBLE, 0.3::DOUBLE), (1, 0.8, 1.0, 0.0), (2, 0.7, 1.0, 0.2), (3, 1.0, 0.2, 0.5), (4, 1.0, 0.0, 0.9)
), pred AS (
  SELECT p.g, p.j AS i, list_transform(range(1, 65), lambda k: p.v[k] * c.a + c.b * o.v[k] + c.n * p.z[k]) AS v,
    CASE WHEN p.j < 4 THEN p.stance WHEN p.stance = 'support' THEN 'neutral' ELSE 'support' END AS stance
  FROM gold p JOIN gold o ON p.g = o.g AND o.j = (p.j + 1) % 5 JOIN mixing c ON c.j = p.j
), cosines AS (
  SELECT p.g AS sample_id, p.i, g.j, p.stance = g.stance AS same_stance,
    list_inner_product(p.v[1:32], g.v[1:32]) / (sqrt(list_inner_product(p.v[1:32], p.v[1:32])) * sqrt(list_inner_product(g.v[1:32], g.v[1:32]))) AS c,
    list_inner_product(p.v[33:64], g.v[33:64]) / (sqrt(list_inner_product(p.v[33:64], p.v[33:64])) * sqrt(list_inner_product(g.v[33:64], g.v[33:64]))) AS d
  FROM pred p JOIN gold g ON p.g = g.g
), pairs AS (
  SELECT sample_id, i, j, same_stance, 0.4::DOUBLE * c + 0.6::DOUBLE * d AS w, c, d FROM cosines
), options AS (
  SELECT sample_id, i, j, w, c, d FROM pairs WHERE same_stance AND w > 0.7::DOUBLE
  UNION ALL SELECT g, i, -1, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM x, range(5) t(i)
), walk AS (
  SELECT g AS sample_id, 0::BIGINT AS i, 0::BIGINT AS used, 0.0::DOUBLE AS total, 0::BIGINT AS n, []::BIGINT[] AS mine, []::BIGINT[] AS theirs, 0.0::DOUBLE AS c, 0.0::DOUBLE AS d FROM x
  UNION ALL
  SELECT s.sample_id, s.i + 1, CASE WHEN o.j < 0 THEN s.used ELSE s.used | (1::BIGINT << o.j::INT) END, s.total + o.w, s.n + (o.j >= 0)::INT,
    CASE WHEN o.j < 0 THEN s.mine ELSE list_append(s.mine, s.i) END, CASE WHEN o.j < 0 THEN s.theirs ELSE list_append(s.theirs, o.j) END, s.c + o.c, s.d + o.d
  FROM walk s JOIN options o ON s.sample_id = o.sample_id AND s.i = o.i WHERE s.i < 5 AND (o.j < 0 OR s.used & (1::BIGINT << greatest(o.j, 0)::INT) = 0)
), best AS (
  SELECT sample_id, arg_max(n, total)::INT AS n_matched, max(total) AS total, arg_max(mine, total) AS mine, arg_max(theirs, total) AS theirs, arg_max(c, total) AS c, arg_max(d, total) AS d, max(n)::INT AS most FROM walk WHERE i = 5 GROUP BY sample_id
), sc AS (
  SELECT *, n_matched / 5.0::DOUBLE AS p, CASE WHEN n_matched > 0 THEN c / n_matched ELSE 0.0::DOUBLE END AS alpha FROM best
), scored AS (
  SELECT *, p AS f1_ext, p * (0.7::DOUBLE + 0.3::DOUBLE * alpha) AS s_ext, 0.6::DOUBLE * d / 5 + 0.4::DOUBLE * c / 5 AS s_pred FROM sc
), lost AS (
  SELECT b.sample_id, t.i, CASE WHEN NOT bool_or(q.w > 0.7::DOUBLE) THEN 'low_sim' WHEN NOT bool_or(q.w > 0.7::DOUBLE AND q.same_stance) THEN 'stance_blocked' ELSE 'extra' END AS reason
  FROM best b, range(5) t(i) JOIN pairs q ON q.sample_id = b.sample_id AND q.i = t.i WHERE NOT list_contains(b.mine, t.i) GROUP BY b.sample_id, t.i
), attributed AS (
  SELECT s.*, coalesce(k.low, 0) AS low_sim, coalesce(k.blocked, 0) AS stance_blocked, coalesce(k.extra, 0) AS extra, 5 - n_matched AS gold_missed, 5 - n_matched AS pred_extra
  FROM scored s LEFT JOIN (SELECT sample_id, count(*) FILTER (reason = 'low_sim') AS low, count(*) FILTER (reason = 'stance_blocked') AS blocked, count(*) FILTER (reason = 'extra') AS extra FROM lost GROUP BY sample_id) k USING (sample_id)
)
"""


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def cosine_matrix(spark, sf_dir):
    return S.pairs_long(samples(spark, sf_dir)).select("sample_id", "i", "j", _r("w"))


def gated_edges(spark, sf_dir):
    return S.pairs_long(samples(spark, sf_dir)).where("edge is not null").select("sample_id", "i", "j", _r("edge"))


def match_weight_score(spark, sf_dir):
    return S.sample_scores(samples(spark, sf_dir), measure=measure).select("sample_id", "n_matched", _r("total"))


def match_cardinality(spark, sf_dir):
    s = S.sample_scores(samples(spark, sf_dir), by_count=True, measure=measure)
    return s.select("sample_id", F.when(F.col("total") >= 0, F.col("n_matched")).alias("most"))


def sample_score(spark, sf_dir):
    s = S.sample_scores(samples(spark, sf_dir), measure=measure)
    return s.select("sample_id", "n_matched", *[_r(c) for c in ("precision", "recall", "f1_ext", "alpha", "s_ext", "s_pred", "score")])


def dataset_score(spark, sf_dir):
    s = S.sample_scores(samples(spark, sf_dir), measure=measure)
    return s.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("score", "s_ext", "s_pred", "f1_ext", "alpha")], F.sum("n_matched").cast("long").alias("n_matched"), F.count("*").alias("n_samples"))


def classify_unmatched(spark, sf_dir):
    return S.reasons(S.sample_scores(samples(spark, sf_dir), measure=measure))


def attribution_totals(spark, sf_dir):
    a = S.attribution(S.sample_scores(samples(spark, sf_dir), measure=measure))
    return a.agg(*[F.sum(c).cast("long").alias(c) for c in ("low_sim", "stance_blocked", "extra", "pred_extra", "gold_missed")], F.count_if((F.col("pred_extra") > 0) & (F.col("n_pred") >= F.col("n_gold"))).alias("over_predicted"))


def attribution_detail(spark, sf_dir):
    d = S.detail(S.sample_scores(samples(spark, sf_dir), measure=measure))
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    return d.select("sample_id", text("matches", lambda m: F.concat(m["i"], F.lit("-"), m["j"])).alias("matches"), F.round(F.aggregate("matches", F.lit(0.0), lambda s, m: s + m["weight"]), 4).alias("weight"), text("unmatched_pred", lambda x: F.concat(x["i"], F.lit(":"), x["reason"])).alias("unmatched_pred"), F.array_join(F.transform("unmatched_gold", lambda j: j.cast("string")), ",").alias("unmatched_gold"))


def headroom(spark, sf_dir):
    return S.headroom(S.attribution(S.sample_scores(samples(spark, sf_dir), measure=measure))).select("kind", "gained", _r("gain"))


def worst_samples(spark, sf_dir):
    return S.sample_scores(samples(spark, sf_dir), measure=measure).select("sample_id", _r("score")).orderBy("score", "sample_id").limit(5)


def score_by_group(spark, sf_dir):
    s = S.sample_scores(samples(spark, sf_dir), measure=measure).withColumn("stance", F.col("golds")[0]["stance"])
    return s.groupBy("stance").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"))


def mean_vectors(spark, sf_dir):
    """Unit vector of the mean of a sample's references, as its cosine to the first one and its length."""
    s = samples(spark, sf_dir).withColumn("mean", V.mean_unit(F.transform("golds", lambda g: g["v"]), 64))
    return s.select("sample_id", F.round(V.cosine(F.col("mean"), F.col("golds")[0]["v"]), 6).alias("to_first"), F.round(V.norm(F.col("mean")), 6).alias("length"))


def _nearest(spark, sf_dir):
    """Each prediction's closest reference of its sample: first on ties."""
    p = S.pairs_long(samples(spark, sf_dir))
    return p.groupBy("sample_id", "i").agg(F.max_by("j", F.struct("w", (-F.col("j")).alias("first"))).alias("j"), F.max("w").alias("w"))


def nn_canonicalise(spark, sf_dir):
    """Names are replaced by the closest known one when close enough, but not all but equal."""
    n = _nearest(spark, sf_dir)
    return n.select("sample_id", "i", F.when(F.col("w").between(0.70, 0.985), F.concat(F.lit("L"), (F.col("sample_id") * 10 + 2 * F.col("j")).cast("string"))).otherwise(F.concat(F.lit("P"), F.col("i").cast("string"))).alias("name"))


def topk_rerank(spark, sf_dir):
    """Of each prediction, the three closest references in their own order."""
    s = S.similarities(samples(spark, sf_dir)).select("sample_id", F.posexplode("w").alias("i", "w"))
    ranked = F.slice(F.array_sort(F.transform("w", lambda x, j: F.struct((-x).alias("d"), j.alias("j")))), 1, 3)
    return s.select("sample_id", "i", F.array_join(F.array_sort(F.transform(ranked, lambda r: r["j"])), ",").alias("kept"))


def mmr_select(spark, sf_dir):
    """Of each sample's references, three for its first prediction: similarity less half the largest one to those picked."""
    s = S.similarities(samples(spark, sf_dir))
    among = F.transform("golds", lambda a: F.transform(F.col("golds"), lambda b: V.cosine(a["v"], b["v"])))
    s = s.select("sample_id", F.get("w", F.lit(0)).alias("sim"), among.alias("m"))

    def pick(state, _):
        near = lambda j: F.coalesce(F.array_max(F.transform(state, lambda p: F.get(F.get("m", p), j))), F.lit(0.0))
        left = F.filter(F.sequence(F.lit(0), F.size("sim") - 1), lambda j: ~F.array_contains(state, j))
        best = F.array_min(F.transform(left, lambda j: F.struct((-(F.get("sim", j) - 0.5 * near(j))).alias("d"), j.alias("j"))))["j"]
        return F.concat(state, F.array(best))

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.array().cast("array<int>"), pick)
    return s.select("sample_id", F.array_join(F.array_sort(chosen), ",").alias("kept"))


QUERIES = {f.__name__: f for f in (cosine_matrix, gated_edges, match_weight_score, match_cardinality, sample_score, dataset_score, classify_unmatched, attribution_totals, attribution_detail, headroom, worst_samples, score_by_group, mean_vectors, nn_canonicalise, topk_rerank, mmr_select)}
_TAILS = {
    "cosine_matrix": "SELECT sample_id, i::INT AS i, j::INT AS j, round(w, 6) AS w FROM pairs",
    "gated_edges": "SELECT sample_id, i::INT AS i, j::INT AS j, round(w, 6) AS edge FROM pairs WHERE same_stance AND w > 0.7::DOUBLE",
    "match_weight_score": "SELECT sample_id, n_matched, round(total, 6) AS total FROM best",
    "match_cardinality": "SELECT sample_id, most FROM best",
    "sample_score": "SELECT sample_id, n_matched, round(p, 6) AS precision, round(p, 6) AS recall, round(f1_ext, 6) AS f1_ext, round(alpha, 6) AS alpha, round(s_ext, 6) AS s_ext, round(s_pred, 6) AS s_pred, round(0.8::DOUBLE * s_ext + 0.2::DOUBLE * s_pred, 6) AS score FROM scored",
    "dataset_score": "SELECT round(avg(0.8::DOUBLE * s_ext + 0.2::DOUBLE * s_pred), 6) AS score, round(avg(s_ext), 6) AS s_ext, round(avg(s_pred), 6) AS s_pred, round(avg(f1_ext), 6) AS f1_ext, round(avg(alpha), 6) AS alpha, sum(n_matched)::BIGINT AS n_matched, count(*) AS n_samples FROM scored",
    "classify_unmatched": "SELECT sample_id, i::INT AS i, reason FROM lost",
    "attribution_totals": "SELECT sum(low_sim)::BIGINT AS low_sim, sum(stance_blocked)::BIGINT AS stance_blocked, sum(extra)::BIGINT AS extra, sum(pred_extra)::BIGINT AS pred_extra, sum(gold_missed)::BIGINT AS gold_missed, count(*) FILTER (pred_extra > 0) AS over_predicted FROM attributed",
    "attribution_detail": """, m AS (
  SELECT b.sample_id, string_agg(t.i || '-' || t.j, ',' ORDER BY t.i) AS matches, sum(round(q.w, 4)) AS weight FROM (SELECT sample_id, unnest(mine) AS i, unnest(theirs) AS j FROM best) t
  JOIN best b USING (sample_id) JOIN pairs q ON q.sample_id = t.sample_id AND q.i = t.i AND q.j = t.j GROUP BY b.sample_id
), l AS (SELECT sample_id, string_agg(i || ':' || reason, ',' ORDER BY i) AS lost FROM lost GROUP BY sample_id)
SELECT b.sample_id, coalesce(m.matches, '') AS matches, round(coalesce(m.weight, 0), 4) AS weight, coalesce(l.lost, '') AS unmatched_pred,
  array_to_string(list_filter(range(5), lambda j: NOT list_contains(theirs, j)), ',') AS unmatched_gold FROM best b LEFT JOIN m USING (sample_id) LEFT JOIN l USING (sample_id)""",
    "headroom": """, kinds AS (
  SELECT alpha, s_ext, n_matched, unnest(['low_sim', 'stance_blocked', 'gold_missed']) AS kind,
    unnest([least(low_sim, gold_missed), least(stance_blocked, gold_missed), greatest(0, gold_missed - low_sim - stance_blocked)]) AS gained FROM attributed
), g AS (
  SELECT *, (n_matched + gained) / (CASE WHEN kind = 'gold_missed' THEN 5 + gained ELSE 5 END)::DOUBLE AS pp, (n_matched + gained) / 5.0::DOUBLE AS rr FROM kinds
) SELECT kind, sum(gained)::BIGINT AS gained, round(avg(0.8::DOUBLE * (CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0 END) * (0.7::DOUBLE + 0.3::DOUBLE * alpha) - 0.8::DOUBLE * s_ext), 6) AS gain FROM g GROUP BY kind""",
    "worst_samples": "SELECT sample_id, round(0.8::DOUBLE * s_ext + 0.2::DOUBLE * s_pred, 6) AS score FROM scored ORDER BY 2, 1 LIMIT 5",
    "score_by_group": "SELECT g.stance, count(*) AS n, round(avg(0.8::DOUBLE * s_ext + 0.2::DOUBLE * s_pred), 6) AS score FROM scored s JOIN gold g ON g.g = s.sample_id AND g.j = 0 GROUP BY g.stance",
    "mean_vectors": """, u AS (
  SELECT g, j, list_transform(v, lambda y: y / sqrt(list_inner_product(v, v))) AS v FROM gold
), m AS (
  SELECT g, list_transform(range(1, 65), lambda k: list_sum(list_transform(vs, lambda v: v[k])) / 5) AS v FROM (SELECT g, list(v ORDER BY j) AS vs FROM u GROUP BY g)
) SELECT m.g AS sample_id, round(list_inner_product(m.v, o.v) / (sqrt(list_inner_product(m.v, m.v)) * sqrt(list_inner_product(o.v, o.v))), 6) AS to_first, 1.0::DOUBLE AS length FROM m JOIN gold o ON o.g = m.g AND o.j = 0""",
    "nn_canonicalise": ", n AS (SELECT sample_id, i, arg_max(j, w) AS j, max(w) AS w FROM pairs GROUP BY sample_id, i) SELECT sample_id, i::INT AS i, CASE WHEN w BETWEEN 0.70::DOUBLE AND 0.985::DOUBLE THEN 'L' || (sample_id * 10 + 2 * j) ELSE 'P' || i END AS name FROM n",
    "topk_rerank": ", n AS (SELECT *, row_number() OVER (PARTITION BY sample_id, i ORDER BY w DESC, j) AS k FROM pairs) SELECT sample_id, i::INT AS i, string_agg(j::VARCHAR, ',' ORDER BY j) AS kept FROM n WHERE k <= 3 GROUP BY sample_id, i",
    "mmr_select": """, s AS (SELECT sample_id, j, w FROM pairs WHERE i = 0
), q AS (
  SELECT a.g, a.j AS a, b.j AS b, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) AS c FROM gold a JOIN gold b ON a.g = b.g
), p1 AS (SELECT sample_id, arg_max(j, w) AS j1 FROM s GROUP BY sample_id
), p2 AS (
  SELECT p1.sample_id, j1, arg_max(s.j, s.w - 0.5::DOUBLE * greatest(q.c, -2)) AS j2 FROM p1 JOIN s ON s.sample_id = p1.sample_id AND s.j <> j1 JOIN q ON q.g = s.sample_id AND q.a = j1 AND q.b = s.j GROUP BY p1.sample_id, j1
), p3 AS (
  SELECT p2.sample_id, j1, j2, arg_max(s.j, s.w - 0.5::DOUBLE * greatest(q.c, r.c)) AS j3 FROM p2 JOIN s ON s.sample_id = p2.sample_id AND s.j NOT IN (j1, j2) JOIN q ON q.g = s.sample_id AND q.a = j1 AND q.b = s.j JOIN q r ON r.g = s.sample_id AND r.a = j2 AND r.b = s.j GROUP BY p2.sample_id, j1, j2
) SELECT sample_id, array_to_string(list_sort([j1, j2, j3]), ',') AS kept FROM p3""",
}
ORACLES = {name: ROWS + tail for name, tail in _TAILS.items()}
