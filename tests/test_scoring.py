import itertools
import math
import random

import pytest

from tessaly.operators.matching import _by_prices, best_pairs
from tessaly.plans import scores


def brute(w, by_count):
    n, m = len(w), len(w[0])
    best = 0.0
    for cols in itertools.product(range(-1, m), repeat=n):
        used = [c for c in cols if c >= 0]
        if len(used) == len(set(used)) and all(c < 0 or w[i][c] is not None for i, c in enumerate(cols)):
            best = max(best, sum(1 if by_count else w[i][c] for i, c in enumerate(cols) if c >= 0))
    return best


@pytest.mark.parametrize("by_count", [False, True])
def test_matching_is_optimal(by_count):
    import numpy as np

    rng = random.Random(3)
    for _ in range(60):
        n, m = rng.randint(1, 4), rng.randint(1, 5)
        w = [[None if rng.random() < 0.4 else rng.random() for _ in range(m)] for _ in range(n)]
        got = best_pairs(w, by_count)
        assert len({j for _, j in got}) == len(got) == len({i for i, _ in got})
        assert math.isclose(sum(1 if by_count else w[i][j] for i, j in got), brute(w, by_count))
        gain = np.array([[-1.0 if x is None else 1.0 if by_count else x for x in r] for r in w])
        assert math.isclose(sum(gain[i, j] for i, j in _by_prices(gain)[0]), brute(w, by_count))


def test_known_matchings():
    assert best_pairs([[0.2, 0.9], [0.4, None]]) == [(0, 1), (1, 0)]
    assert best_pairs([[None, None], [None, None]]) == []
    w = [[0.71 if i == j else 0.95 if i == j + 1 else None for j in range(4)] for i in range(4)]
    assert len(best_pairs(w)) == 3 and len(best_pairs(w, True)) == 4
    with pytest.raises(ValueError):
        best_pairs([[1.0], [1.0, 2.0]])


def test_a_sample_against_itself_scores_one(spark):
    from pyspark.sql import functions as F

    from tessaly.operators import scoring

    s = scores.samples(spark, "/root/testdata/sf0.001").withColumn("preds", F.col("golds"))
    assert all(math.isclose(r.score, 1.0) and r.n_matched == 5 for r in scoring.sample_scores(s, measure=scores.measure).select("score", "n_matched").collect())
    turned = s.withColumn("preds", F.transform("preds", lambda p, i: F.struct(F.when(i == 0, "none").otherwise(p["stance"]).alias("stance"), p["name_v"].alias("name_v"), p["arg_v"].alias("arg_v"))))
    got = scoring.attribution(scoring.sample_scores(turned, measure=scores.measure)).select("n_matched", "stance_blocked", "pred_extra").collect()
    assert all((r.n_matched, r.stance_blocked, r.pred_extra) == (4, 1, 1) for r in got)


def test_ties_follow_one_rule_at_every_size():
    rng = random.Random(11)
    for k in range(120):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        w = [[None if rng.random() < 0.3 else rng.choice([0.0, 0.5, 0.75, 1.0]) for _ in range(m)] for _ in range(n)]
        wide = [[*r, *[None] * 13] for r in w]
        assert best_pairs(w, k % 2 == 0) == best_pairs(wide, k % 2 == 0)


def test_texts_of_matched_records(spark):
    """Names, chains and futures decide alpha and the share of futures; stances don't."""
    from tessaly.operators import scoring

    kind = "struct<stance:string,name_v:array<double>,arg_v:array<double>,name:string,chain:array<string>,future:string>"
    a, b = [1.0, 0.0], [0.0, 1.0]
    golds = [("support", a, a, "甲", ["证据"], "甲乙"), ("oppose", b, b, "乙", ["其他"], "丙丁")]
    preds = [("oppose", b, b, "乙", ["其他"], "丙戊"), ("support", a, a, "丁", ["证据"], "甲乙"), ("support", b, b, "x", ["y"], None)]
    rows = spark.createDataFrame([("A", preds, golds), ("B", [], golds), ("C", [], [])], f"sample_id string, preds array<{kind}>, golds array<{kind}>")
    got = {r.sample_id: r for r in scoring.sample_scores(rows).collect()}
    r = got["A"]
    assert [(m.i, m.j) for m in r.matches] == [(0, 1), (1, 0)] and r.n_matched == 2
    # The second pair's texts differ in one of four characters.
    assert math.isclose(r.alpha, (1 + 0.75) / 2) and math.isclose(r.f1_pred, (0.5 + 1) / 3) and math.isclose(r.s_semantic, r.f1_pred)
    f1 = 2 * (2 / 3) / (2 / 3 + 1)
    assert math.isclose(r.score, 0.8 * f1 * (0.7 + 0.3 * r.alpha) + 0.2 * r.f1_pred)
    assert got["B"].score == got["C"].score == 0
    d = {x.sample_id: x for x in scoring.detail(scoring.sample_scores(rows)).collect()}
    assert [(x.i, x.reason) for x in d["A"].unmatched_pred] == [(2, "stance_blocked")] and d["B"].unmatched_gold == [0, 1]
