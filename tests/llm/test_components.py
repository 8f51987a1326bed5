import random

from tessaly.llm.components import components


def test_against_brute_force(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)] + [(300, 300)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x: find(x) for x in root if find(x) != x}
    got = components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
