import random

import pytest
from tessaly.llm import jaccard

from .cases import SCHEMA, documents


def shingles(text, n=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, percent=85):
    kept = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(kept[i] & kept[j])
            if both and 100 * both >= percent * len(kept[i] | kept[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        out.append((doc, len(kept[i]), min(ids) if ids else None))
    return out


def corpus(seed):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(60)]
    rows, n = [], 1000
    for _ in range(14):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([2, 3, 5, 7, 9, 30, 80, 200]))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.choice([1, 2, 5, 40])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(w))
                w[k : k + rng.randint(0, 2)] = [f"x{rng.randint(0, 30)}"]
            rows.append((n, rng.choice([" ", "  ", "\n"]).join(w)))
            n += 1
    return rows


@pytest.mark.parametrize("rare", [24, 3])
def test_against_brute_force(spark, rare):
    docs = documents(spark).select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(corpus(rare), docs.schema)).repartition(4).cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = jaccard.linked(docs, rare=rare, rounds=rare % 5, block_tokens=2000).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_no_documents(spark):
    assert jaccard.linked(spark.createDataFrame([], SCHEMA)).collect() == []
