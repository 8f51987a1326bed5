import random
from collections import Counter

import numpy as np
import pytest
from tessaly.llm import exchange
from tessaly.llm._shared import mix, span_hashes, byte_cells


def test_golomb_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 1 << 60), (5, 6), (100_000, 1 << 50), (70_001, 80_000)):
        values = np.unique(rng.integers(0, top, n))
        assert exchange.ungolomb(exchange.golomb(values)).tolist() == values.tolist()


@pytest.mark.parametrize(("owners", "wide", "most"), [(8, 1024, 254), (8, 1024, 1), (40, 6, 254), (40, 6, 1)])
def test_counts_of_other_blocks(spark, owners, wide, most):
    rng = random.Random(owners)
    blocks = [[rng.choice([rng.randrange(50), rng.randrange(10**6), 7]) for _ in range(rng.choice([0, 1, 30, 300]))] for _ in range(25)]
    frame = spark.createDataFrame([(k, np.array(x, "<u8").tobytes()) for k, x in enumerate(blocks)], "block long, data binary").repartition(5)
    hashes = lambda row: mix(np.frombuffer(row["data"], "<u8").astype(np.uint64))
    told = {r.block: r.answer for r in exchange.answers(frame, hashes, ["data"], owners, most, wide).collect()}
    total = Counter(v for b in blocks for v in b)
    for k, x in enumerate(blocks):
        got = exchange.unpack(mix(np.array(x, np.uint64)), [r.asDict() for r in told.get(k, [])], owners, most, wide)
        # A block's own count is held at 255 before it travels.
        assert got.tolist() == [min(total[v] - 1, most) for v in x]


def test_spans_longer_than_a_slice(monkeypatch):
    from tessaly.llm import _shared

    data = np.frombuffer(random.Random(2).randbytes(3000), np.uint8)
    start, end = np.array([0, 10, 700, 2500]), np.array([10, 600, 2500, 3000])
    want = span_hashes(byte_cells(), data, start, end)
    monkeypatch.setattr(_shared, "SLICE", 64)
    assert span_hashes(byte_cells(), data, start, end).tolist() == want.tolist()
