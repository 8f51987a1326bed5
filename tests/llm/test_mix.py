import re
from collections import defaultdict

from pyspark.sql import functions as F
from tessaly.llm import mix

from .cases import SCHEMA, documents


def test_targets_and_epochs(spark):
    docs = documents(spark)
    more = spark.range(3000).select((F.col("id") + 1000).alias("doc_id"), F.expr("repeat('ab cde ', cast(1 + id % 17 as int))").alias("text"), F.lit("en").alias("lang"), F.expr("if(id % 3 = 0, 'hot', concat('s', id % 7))").alias("source"), F.lit(0).cast("long").alias("n_chars"), F.lit("x").alias("length"), F.lit("y").alias("kept"))
    docs = docs.union(more).repartition(5)
    got = mix.mix(docs).collect()
    size = defaultdict(int)
    rows = docs.collect()
    count = {(r.doc_id, r.source): len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    for r in rows:
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, level = set(), 0
    while True:  # share what is left until none is above
        rest = sum(size.values()) * 1.5 - sum(2 * size[s] for s in full)
        level = rest / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * level > 2 * size[s]}
        if not over:
            break
        full |= over
    want = {s: 2 * size[s] if s in full else weight[s] * level for s in names}
    assert len(got) == len(rows)
    source = {r.doc_id: r.source for r in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.size == count[r.doc_id, s] and r.source_size == size[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        assert int(want[s] // size[s]) * r.size <= r.taken <= 2 * r.size if size[s] else r.taken == 0
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mix.mix(docs.repartition(3)).collect()))
    edge = mix.mix(docs, whole=True).collect()
    assert all(r.taken == r.copies * r.size for r in edge)
    full = mix.mix(docs, whole=True, carry=tuple(docs.columns)).where("copies > 0").select("carried.*")
    assert full.exceptAll(docs).count() == 0
    assert mix.mix(spark.createDataFrame([], SCHEMA)).collect() == []


def test_heavier_documents_come_first(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat(if(id % 2 = 0, 'abcde ', 'abcdefghijklmnopqrstuvwxyzabcdefghijk '), 10)").alias("text"), F.lit("a").alias("source"))
    got = mix.mix(docs, share=0.3).groupBy(F.col("doc_id") % 2).agg(F.sum("taken").alias("n")).collect()
    n = {r[0]: r.n for r in got}
    assert n[0] > 2 * n[1]
