import random
import zlib

import numpy as np
import public_tokenizers
from tessaly.llm import pack
from tokenizers import Tokenizer

from .cases import SCHEMA, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_fill_is_the_best_sum():
    rng = random.Random(3)
    for _ in range(200):
        items = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(1, 60)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= room}
        counts = np.bincount(items, minlength=room + 31) if items else np.zeros(room + 31, int)
        took = pack.fill(counts, room)
        assert all(n <= counts[x] for x, n in took)
        assert sum(x * n for x, n in took) == max(sums)


def test_plan_places_each_token_once():
    rng = random.Random(4)
    for _ in range(50):
        lengths = [rng.choice([0, 1, 7, 40, 63, rng.randint(1, 63)]) for _ in range(rng.randint(0, 80))]
        made = pack.plan(lengths, 64)
        sizes = [sum(n for _, _, n in w) for w in made]
        full = sum(lengths) // 64
        assert sizes[:full] == [64] * full and all(s & (s - 1) == 0 for s in sizes)
        own = [[] for _ in lengths]
        for w in made:
            for item, start, n in w:
                own[item].append((start, n))
        for n, got in zip(lengths, own, strict=True):
            at = 0
            for start, size in sorted(got):
                assert start == at and size > 0
                at += size
            assert at == n


def test_pieces_of_awkward_documents(spark):
    model = Tokenizer.from_file(PATH)
    docs = documents(spark).repartition(3)
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append([*model.encode(r.text or "", add_special_tokens=False).ids, 1])
    rows = pack.pack(docs, PATH, window=64, shard_tokens=500).collect()
    assert sum(r.length for r in rows) == sum(len(x) for v in want.values() for x in v)
    windows = {}
    for r in rows:
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in want[r.doc_id])
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in windows.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 64 and at & (at - 1) == 0
    assert pack.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
