import math
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tessaly.llm import lattice

from .cases import SCHEMA, documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute_word(pieces, p, word):
    """Probability, and each piece's expected uses, by listing all segmentations."""
    text = b" " + word
    total, used = 0.0, Counter()

    def go(at, prob, path):
        nonlocal total
        if at == len(text):
            total += prob
            for x in path:
                used[x] += prob
            return
        for end in range(at + 1, min(len(text), at + pieces.longest) + 1):
            k = index.get(text[at:end])
            if k is not None:
                go(end, prob * p[k], [*path, k])

    index = {x: k for k, x in enumerate(pieces.all)}
    go(0, 1.0, [])
    return total, {k: v / total for k, v in used.items()}


def test_forward_and_backward_against_all_segmentations():
    v = lattice.pieces(PATH)
    words = [b"the", b"a", "é".encode(), b"information", b"\xff\x00", b"xq", b"the"]
    sizes = np.array(list(map(len, words)))
    counts = np.array([3, 1, 2, 1, 1, 5, 2])
    got, used = lattice.likelihood(v, v.first, np.frombuffer(b"".join(words), np.uint8), sizes, counts, most=500)
    want = np.zeros(len(v.all))
    for word, log, n in zip(words, got, counts, strict=True):
        total, uses = brute_word(v, np.exp(v.first), word)
        assert math.isclose(log, math.log(total), rel_tol=1e-9)
        for k, x in uses.items():
            want[k] += n * x
    assert np.allclose(used, want)


def test_counts_and_scores(spark):
    docs = documents(spark).repartition(4).cache()
    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    rows = docs.withColumn("h", held).collect()
    split = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
    counts = Counter()
    for r in rows:
        if not r.h:
            counts.update(split(r.text))
            counts["end"] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        tokens = [*split(r.text), "end"]
        want.append((str(r.doc_id), r.h, len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)))
    got = lattice.scored(docs, PATH, held, rounds=1, block_words=50).collect()
    for a, b in zip(sorted(want), sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    same = [r.score for r in got if r.doc_id in (0, 4)]
    assert math.isclose(same[0], same[1])
    assert lattice.scored(spark.createDataFrame([], SCHEMA), PATH, F.lit(False)).collect() == []
    alone = lattice.scored(docs, PATH, F.lit(True), block_words=50).collect()
    assert all(r.base_score == 0 and r.n_known == 0 for r in alone)


def test_long_words_by_a_sliding_window(monkeypatch):
    v = lattice.pieces(PATH)
    rng = np.random.default_rng(3)
    words = [b"information" * 60, bytes(rng.integers(33, 250, 700).astype(np.uint8)), "международныйуниверситет".encode() * 20, b"q" * 513]
    sizes, letters, counts = np.array(list(map(len, words))), np.frombuffer(b"".join(words), np.uint8), np.array([1, 2, 3, 4])
    lp = np.append(v.first, -np.inf)
    got, used = lattice.likelihood(v, v.first, letters, sizes, counts)
    again = np.zeros(len(lp))
    small = [lattice.long_likelihood(v, lp, np.append(np.uint8(32), np.frombuffer(w, np.uint8)), n, again, chunk=100) for w, n in zip(words, counts.tolist(), strict=True)]
    monkeypatch.setattr(lattice, "LONG", 10**6)
    want, uses = lattice.likelihood(v, v.first, letters, sizes, counts)
    assert np.allclose(got, want, rtol=1e-10) and np.allclose(small, want, rtol=1e-10)
    assert np.allclose(used, uses) and np.allclose(again[:-1], uses)


def test_every_lower_case_piece_counts():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [model.id_to_piece(k).replace("▁", " ") for k in range(model.get_piece_size()) if not (model.is_byte(k) or model.is_unknown(k) or model.is_control(k))]
    want = {x.encode() for x in texts if " " not in x[1:] and x.encode() == x.encode().lower()}
    have = set(lattice.pieces(PATH).all)
    assert want <= have and all(len(x) == 1 for x in have - want) and max(map(len, want)) > 16


def test_scores_against_a_plain_computation(spark):
    """The score's formula on a few documents, with every segmentation listed."""
    v = lattice.pieces(PATH)
    texts = ["ab ab the", "the cat ab", None, "unseen the", "cat CAT dog"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lattice.scored(docs, PATH, F.col("doc_id") == 3, rounds=0).collect()}
    split = lambda t: (t or "").lower().encode().split()
    seen = Counter(w for k, t in enumerate(texts) if k != 3 for w in split(t))
    ends = 4
    n, types, n1, n2 = sum(seen.values()) + ends, len(seen), sum(c == 1 for c in seen.values()), sum(c == 2 for c in seen.values())
    less = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    for k, t in enumerate(texts):
        log = math.log10(ends / n)
        for w in split(t):
            p = brute_word(v, np.exp(v.first), w)[0] * less * types / n + (max(0, seen[w] - less) / n if w in seen else 0)
            log += math.log10(p)
        assert math.isclose(got[k], log, rel_tol=1e-9), (k, got[k], log)
