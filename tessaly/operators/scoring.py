"""Predicted records against reference records: gated edges, one-to-one matching, scores, and what was missed and why.

Input rows hold one sample: sample_id, preds and golds, arrays of struct(stance, name_v, arg_v, ...) with vectors of names
and of arguments. With an injected measure of matched pairs everything up to a sample's scores happens inside its row,
without a shuffle; the default one compares texts (fields name, chain and future) and needs matched pairs as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lcs import rouge_l
from ..functions.vectors import cosine
from . import rewrite
from .matching import matched

#: Of a predicted and a reference record: struct(alpha, rouge, semantic).
Measure = Callable[[Column, Column], Column]

GATE = 0.7


def similarities(samples: DataFrame) -> DataFrame:
    """Adds w: the weight 0.4 * names + 0.6 * arguments of every pair."""
    w = F.transform("preds", lambda p: F.transform(F.col("golds"), lambda g: F.lit(0.4) * cosine(p["name_v"], g["name_v"]) + F.lit(0.6) * cosine(p["arg_v"], g["arg_v"])))
    return samples.withColumn("w", w)


def gated(samples: DataFrame, gate: float = GATE) -> DataFrame:
    """Adds edges: w where the stances are equal (or both null) and w is above the gate, else null."""
    row = lambda p, i: F.transform(F.col("golds"), lambda g, j: F.when(p["stance"].eqNullSafe(g["stance"]) & (F.get(F.get("w", i), j) > gate), F.get(F.get("w", i), j)))
    return similarities(samples).withColumn("edges", F.transform("preds", row))


def pairs_long(samples: DataFrame) -> DataFrame:
    """One row for each pair: sample_id, i, j, w, same_stance, edge."""
    rows = gated(samples).select("sample_id", "golds", F.posexplode(F.arrays_zip("preds", "w", "edges")).alias("i", "p"))
    rows = rows.select("sample_id", "i", F.col("p.preds.stance").alias("stance"), F.posexplode(F.arrays_zip("golds", F.col("p.w").alias("w"), F.col("p.edges").alias("edge"))).alias("j", "g"))
    return rows.select("sample_id", "i", "j", F.col("g.w").alias("w"), F.col("stance").eqNullSafe(F.col("g.golds.stance")).alias("same_stance"), F.col("g.edge").alias("edge"))


def _sum(of: Column) -> Column:
    return F.aggregate(of, F.lit(0.0), lambda s, x: s + x)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return _ratio(2.0 * p * r, p + r)


def _by_texts(s: DataFrame) -> DataFrame:
    """Adds parts: of each matched pair, agreement of name and chain, and that of the futures, twice."""
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = s.select("sample_id", "preds", "golds", F.posexplode("matches").alias("k", "m")).select("sample_id", "k", F.get("preds", F.col("m.i")).alias("p"), F.get("golds", F.col("m.j")).alias("g"))
    rows = rows.select("sample_id", "k", rewrite.alpha(F.col("p.name"), F.col("p.chain"), F.col("g.name"), F.col("g.chain")).alias("alpha"), rouge_l(text(F.col("p.future")), text(F.col("g.future"))).alias("rouge"))
    each = rows.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("k", "alpha", "rouge"))).alias("parts"))
    return s.join(each.select("sample_id", F.transform("parts", lambda x: F.struct(x["alpha"].alias("alpha"), x["rouge"].alias("rouge"), x["rouge"].alias("semantic"))).alias("parts")), "sample_id", "left")


def sample_scores(samples: DataFrame, by_count: bool = False, measure: Measure | None = None) -> DataFrame:
    """Adds matches, n_pred, n_gold, n_matched, total, precision, recall, f1_ext, alpha, s_ext, f1_pred, s_semantic, s_pred, score.

    alpha is the mean agreement of the matches; f1_pred and s_semantic are sums of two similarities of their future
    statements over the larger number of records. Sample ids are distinct."""
    # A generator of one row: the optimizer doesn't copy the assignment into what uses it.
    s = gated(samples).select("*", F.explode(F.array(matched(F.col("edges"), by_count))).alias("matches"))
    got = F.transform("matches", lambda m: F.get(F.get("edges", m["i"]), m["j"]))
    s = s.withColumns({"n_pred": F.size("preds"), "n_gold": F.size("golds"), "n_matched": F.size("matches"), "total": _sum(got)})
    s = s.withColumns({"precision": _ratio(F.col("n_matched"), F.col("n_pred")), "recall": _ratio(F.col("n_matched"), F.col("n_gold"))})
    if measure is None:
        s = _by_texts(s)
    else:
        s = s.withColumn("parts", F.transform("matches", lambda m: measure(F.get("preds", m["i"]), F.get("golds", m["j"]))))
    part = lambda c: F.coalesce(_sum(F.transform("parts", lambda x: x[c])), F.lit(0.0))
    over = F.greatest("n_pred", "n_gold")
    s = s.withColumns({"alpha": _ratio(part("alpha"), F.col("n_matched")), "f1_pred": _ratio(part("rouge"), over), "s_semantic": _ratio(part("semantic"), over), "f1_ext": f1(F.col("precision"), F.col("recall"))}).drop("parts")
    s = s.withColumns({"s_ext": F.col("f1_ext") * (0.7 + 0.3 * F.col("alpha")), "s_pred": 0.6 * F.col("f1_pred") + 0.4 * F.col("s_semantic")})
    return s.withColumn("score", 0.8 * F.col("s_ext") + 0.2 * F.col("s_pred"))


def reasons(scored: DataFrame, gate: float = GATE) -> DataFrame:
    """One row for each predicted record without a match: sample_id, i, reason (low_sim, stance_blocked or extra)."""
    left = F.filter(F.sequence(F.lit(0), F.col("n_pred") - 1), lambda i: ~F.exists("matches", lambda m: m["i"] == i))
    rows = scored.where("n_pred > 0").select("sample_id", "preds", "golds", "w", "edges", F.explode(left).alias("i"))
    clear = F.exists(F.get("w", F.col("i")), lambda x: x > gate)
    legal = F.exists(F.get("edges", F.col("i")), lambda x: x.isNotNull())
    return rows.select("sample_id", "i", F.when(~clear, "low_sim").when(~legal, "stance_blocked").otherwise("extra").alias("reason"))


def detail(scored: DataFrame, gate: float = GATE) -> DataFrame:
    """sample_id, matches (i, j and weight), unmatched_pred (i and reason) and unmatched_gold (j), each in order."""
    at = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    clear = lambda i: F.exists(F.get("w", i), lambda x: x > gate)
    legal = lambda i: F.exists(F.get("edges", i), lambda x: x.isNotNull())
    pairs = F.transform("matches", lambda m: F.struct(m["i"].alias("i"), m["j"].alias("j"), F.round(F.get(F.get("w", m["i"]), m["j"]), 4).alias("weight")))
    lone = F.filter(at("n_pred"), lambda i: ~F.exists("matches", lambda m: m["i"] == i))
    told = F.transform(lone, lambda i: F.struct(i.alias("i"), F.when(~clear(i), "low_sim").when(~legal(i), "stance_blocked").otherwise("extra").alias("reason")))
    missed = F.filter(at("n_gold"), lambda j: ~F.exists("matches", lambda m: m["j"] == j))
    return scored.select("sample_id", pairs.alias("matches"), told.alias("unmatched_pred"), missed.alias("unmatched_gold"))


def attribution(scored: DataFrame, gate: float = GATE) -> DataFrame:
    """Adds low_sim, stance_blocked, extra, pred_extra and gold_missed."""
    at = F.sequence(F.lit(0), F.col("n_pred") - 1)
    left = F.when(F.col("n_pred") > 0, F.filter(at, lambda i: ~F.exists("matches", lambda m: m["i"] == i))).otherwise(F.array().cast("array<int>"))
    clear = lambda i: F.exists(F.get("w", i), lambda x: x > gate)
    legal = lambda i: F.exists(F.get("edges", i), lambda x: x.isNotNull())
    out = scored.withColumn("left", left)
    out = out.withColumns({"low_sim": F.size(F.filter("left", lambda i: ~clear(i))), "stance_blocked": F.size(F.filter("left", lambda i: clear(i) & ~legal(i))), "extra": F.size(F.filter("left", lambda i: clear(i) & legal(i)))})
    return out.withColumns({"pred_extra": F.col("n_pred") - F.col("n_matched"), "gold_missed": F.col("n_gold") - F.col("n_matched")}).drop("left")


def headroom(attributed: DataFrame) -> DataFrame:
    """What each kind of miss costs: the mean gain in score if it were gone. One row for each kind."""
    n = {"low_sim": F.least("low_sim", "gold_missed"), "stance_blocked": F.least("stance_blocked", "gold_missed")}
    room = F.greatest(F.lit(0), F.col("gold_missed") - F.col("low_sim") - F.col("stance_blocked"))
    rows = []
    for kind, gained in {**n, "gold_missed": room}.items():
        preds = F.col("n_pred") + (gained if kind == "gold_missed" else F.lit(0))
        m = F.col("n_matched") + gained
        better = f1(_ratio(m, preds), _ratio(m, F.col("n_gold")))
        rows.append(F.struct(F.lit(kind).alias("kind"), gained.alias("gained"), (0.8 * better * (0.7 + 0.3 * F.col("alpha")) - 0.8 * F.col("s_ext")).alias("gain")))
    each = attributed.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return each.groupBy("kind").agg(F.sum("gained").cast("long").alias("gained"), F.avg("gain").alias("gain"))
