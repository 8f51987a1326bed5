import hashlib
import re
from collections import defaultdict

import numpy as np
from tessaly.llm import exact, exchange

from .cases import SCHEMA, documents


def test_golomb():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 5000):
        for top in (1, 100, 1 << 40):
            x = np.unique(rng.integers(0, top, n))
            assert exchange.ungolomb(exchange.golomb(x)).tolist() == x.tolist()


def test_against_brute_force(spark):
    docs = documents(spark)
    docs = docs.union(docs.where("doc_id in (0, 6)").withColumn("doc_id", docs.doc_id + 100)).repartition(3)
    groups = defaultdict(list)
    for r in docs.collect():
        t = r.text or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), r.doc_id is None, r.doc_id or 0))
    want = []
    for t, g in groups.items():
        sha = hashlib.sha256(t.encode()).hexdigest()
        for k, (_, none, doc) in enumerate(sorted(g)):
            first = sorted(g)[0]
            want.append((None if none else doc, None if first[1] else first[2], len(g), k == 0, sha))
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.duplicates(docs, block_docs=2).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert exact.duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
