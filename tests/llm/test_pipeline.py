import re

import corpus_pipeline as pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tessaly.llm import mix
from tokenizers import Tokenizer

from .cases import SCHEMA, documents
from .test_jaccard import brute


def test_stages(spark):
    docs = documents(spark)
    near = docs.where("doc_id = 6").withColumn("doc_id", docs.doc_id + 94)
    docs = docs.union(near).repartition(3).cache()
    rows = docs.collect()
    told = pipeline.language_id(spark, docs, "").cache()
    assert told.columns == docs.columns
    kept = {r.doc_id for r in told.collect()}
    assert not kept & {1, 2, 3, 8} and {0, 6, 7} <= kept
    once = pipeline.exact_dedup(spark, docs, "").cache()
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    best = {}
    for r in rows:
        key = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
        best[squeeze(r.text)] = min(best.get(squeeze(r.text), key), key)
    assert sorted(map(str, [r.doc_id for r in once.collect()])) == sorted(str(None if k[1] else k[2]) for k in best.values())
    apart = pipeline.near_dedup(spark, once, "").cache()
    own = [(r.doc_id, r.text) for r in once.collect()]
    assert 7 not in {r.doc_id for r in apart.collect()}
    assert {r.doc_id for r in apart.collect()} == {d for d, _, c in brute(own, 80) if d == c}
    mixed = pipeline.mix_sources(spark, apart, "").cache()
    times = {(r.doc_id, r.carried.source): r.copies for r in mix.mix(apart, whole=True, carry=("source",)).collect()}
    assert mixed.columns == docs.columns and mixed.count() == sum(times.values())
    pieces = pipeline.pack_windows(spark, mixed, "").collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in pieces) == sum(len(model.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []


def test_columns_of_any_name_pass(spark):
    names = ["size", "source_size", "target", "taken", "copies", "carried", "score", "lang_pred", "_text", "_id", "_sha", "_points", "a.b", "mark", "key", "n", "id", "void", "sha", "points", "col"]
    docs = documents(spark)
    for k, c in enumerate(names):
        docs = docs.withColumn(c, F.lit(f"own {k}"))
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name != "pack":
            docs = docs.cache()
            assert docs.columns[-len(names) :] == names and docs.count()
            assert all(tuple(r)[-len(names) :] == tuple(f"own {k}" for k in range(len(names))) for r in docs.collect())
    assert docs.count()


def test_null_and_largest_id_stay_apart(spark):
    top = (1 << 63) - 1
    text = "one text that both of them hold"
    docs = spark.createDataFrame([(top, text, "en", "a", 1, "x", "y"), (None, text, "en", "a", 1, "x", "y")], SCHEMA)
    assert [r.doc_id for r in pipeline.exact_dedup(spark, docs, "").collect()] == [top]
