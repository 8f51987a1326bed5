import random

import numpy as np
import public_tokenizers
from tessaly.llm import repair
from tokenizers import Tokenizer

from .cases import SCHEMA, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    shapes = [np.zeros(0, np.uint32), np.array([7], np.uint32), np.full(5000, 3, np.uint32), rng.integers(0, 9, 20000).astype(np.uint32), np.tile(rng.integers(0, 50000, 60), 300).astype(np.uint32), (rng.zipf(1.3, 30000) % 70000).astype(np.uint32)]
    for ids in shapes:
        payload = repair.dump(ids)
        assert repair.load(payload).tolist() == ids.tolist()
        seq, rules, sizes, base = repair.parts(payload)
        for k in range(0, len(rules), max(1, len(rules) // 50)):
            assert len(repair.expand(np.array([base + k]), rules, sizes, base)) == sizes[k]
        for _ in range(20):
            a, b = sorted(random.Random(len(ids) + _).choices(range(len(ids) + 1), k=2))
            assert repair.load(payload, a, b).tolist() == ids[a:b].tolist()
    assert len(repair.dump(shapes[4])) < len(shapes[4]) * 4 / 20


def test_documents(spark):
    model = Tokenizer.from_file(PATH)
    docs = documents(spark).repartition(4)
    want = sorted(((r.doc_id, [*model.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs.collect()), key=lambda x: -1 if x[0] is None else x[0])
    blocks = repair.write(docs, PATH, block_tokens=300)
    got = sorted(repair.read(blocks).collect(), key=lambda r: r.start)
    at = 0
    for r, (doc, ids) in zip(got, want, strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    assert repair.read(repair.write(spark.createDataFrame([], SCHEMA), PATH)).collect() == []


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(8)
    deep = np.tile(rng.integers(0, 50000, 3000), 40).astype(np.uint32)
    for ids in (deep, (rng.zipf(1.4, 60000) % 500).astype(np.uint32), np.full(70000, 3, np.uint32)):
        seq, rules, sizes, base = repair.pair_up(ids, least=16)
        assert repair.expand(seq, rules, sizes, base).tolist() == ids.tolist()
        code, last, times = seq[:-1] << np.uint64(32) | seq[1:], {}, {}
        for k, x in enumerate(code.tolist()):
            if last.get(x, -2) < k - 1:
                last[x], times[x] = k, times.get(x, 0) + 1
        assert max(times.values(), default=0) < 16
    assert repair.pair_up(deep)[2].max() > 1 << 10
