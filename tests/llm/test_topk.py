import math

import numpy as np
from pyspark.sql import functions as F
from tessaly.llm import topk


def brute(rows, k, ask):
    live = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in live if ask(i)}):
        x = min(v for i, v in live if i == q)
        found = sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(x, v, strict=True)), i) for i, v in live if i != q and len(v) == len(x))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(size=4).round(1)]) for i in range(300)]
    rows += [(int(i), [0.5, 0.5, 0.5, 0.5]) for i in range(300, 420)]  # ties
    rows += [(0, [1.0, 1.0, 1.0, 1.0]), (7, [2.0, 0.0, 0.0, 0.0]), (None, [1.0] * 4), (500, None), (501, [1.0, None, 1.0, 1.0]), (502, [math.nan] * 4), (503, [math.inf] * 4), (550, [1.0, 2.0]), (600, [])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string").repartition(5)
    got = topk.search(table, F.col("vec_id") % 50 == 0, tile=4, shard=40, fan=3)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 5, lambda i: i % 50 == 0))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(empty, F.col("vec_id") % 50 == 0).collect() == []


def test_a_query_id_on_many_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=4).round(1)]) for i in range(1, 200) if i not in (50, 100)]
    rows += [(50, [9.0 + j, 9.0, 9.0, 9.0]) for j in range(8)] + [(100, [5.0, 5.0, 5.0, 5.0])] * 90  # all above every other row
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = topk.search(table, F.col("vec_id") % 50 == 0, shard=300)
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, 5, lambda i: i % 50 == 0))
    own = np.array([50] * 6 + list(range(1, 20)))
    ids, found, _ = topk.best(np.array([50]), np.ones((1, 2)), own, np.c_[np.r_[np.full(6, 99.0), np.arange(19)], np.ones(25)], 5)
    assert list(ids) == [50] * 5 and list(found) == [19, 18, 17, 16, 15]


def test_large_components_stay_exact():
    a = np.array([[1e12 + 0.5, -3.25]])
    want = math.floor(256 * a[0, 0]) ** 2 + math.floor(256 * a[0, 1]) ** 2
    assert topk.scores(a, a)[0, 0] == min(want, (1 << 63) - 1)
