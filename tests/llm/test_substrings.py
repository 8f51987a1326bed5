import hashlib
import random

import numpy as np
from tessaly.llm import substrings

from .cases import SCHEMA, documents


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(6)
    for _ in range(40):
        seqs = [rng.integers(1, rng.integers(2, 6), rng.integers(0, 12)) for _ in range(rng.integers(1, 7))]
        text = np.concatenate([np.append(s, 0) for s in seqs])
        index = substrings.FMIndex(text)
        patterns = rng.integers(1, max(2, index.top), (30, 3))
        size, low, high = index.statistics(patterns)
        for p, n, a, b in zip(patterns, size, low, high, strict=True):
            places = [k for k in range(len(text)) if text[k : k + 3].tolist() == p.tolist()]
            if n == 3:
                assert sorted(index.suffixes[a:b].tolist()) == places
            else:
                tail = p[3 - n - 1 :].tolist()
                assert not places and not any(text[k : k + n + 1].tolist() == tail for k in range(len(text)))


def brute(rows, window):
    first = {}
    cut = [(r[0], (r[1] or "").encode().split()) for r in rows]
    big = 1 << 63
    for doc, w in cut:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, big), big if doc is None else doc)
    out = []
    for doc, w in cut:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (big if doc is None else doc):
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((doc, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    passages = [[f"p{k}_{j % 31}" for j in range(n)] for k, n in enumerate([12, 20, 24, 25, 60, 130])]
    rows = []
    for doc in range(100, 260):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else [f"w{rng.randint(0, 50)}" for _ in range(rng.randint(1, 50))]
        rows.append((doc, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(300 + k, " ".join(["spam"] * (10 * k))) for k in range(6)]
    docs = documents(spark).select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(rows, docs.schema)).repartition(5).cache()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], 20)
    got = substrings.remove(docs, window=20, step=5, block_words=900, shard_words=500).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r.n_removed for r in got) > 1000
    assert substrings.remove(spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_ids_and_the_largest_id(spark):
    words = " ".join(f"v{k}" for k in range(60))
    top = (1 << 63) - 1
    docs = spark.createDataFrame([(top, words), (None, words), (None, words + " end"), (3, "short")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substrings.remove(docs).collect()), key=str)
    # A null id counts as the largest one, so neither is smaller than the other.
    assert got == sorted([(top, 60, 0), (None, 60, 0), (None, 61, 0), (3, 1, 0)], key=str)
    docs = docs.union(spark.createDataFrame([(7, words)], docs.schema))
    got = sorted(((r.doc_id, r.n_removed) for r in substrings.remove(docs).collect()), key=str)
    assert got == sorted([(top, 60), (None, 60), (None, 60), (3, 0), (7, 0)], key=str)
