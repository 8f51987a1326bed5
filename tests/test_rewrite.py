from pyspark.sql import functions as F
from tessaly.functions import text as T
from tessaly.operators import flow, rewrite
from tessaly.plans import rewrites


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).collect()[0]


def test_texts_and_fallbacks(spark):
    chain = F.array(F.lit("甲"), F.lit("乙"))
    none = F.lit(None).cast("array<string>")
    r = one(spark, rewrite.join_chain(chain), rewrite.plain_text(F.lit(""), chain), rewrite.plain_text(F.lit("n"), none), rewrite.triple_text(F.lit(""), F.lit("oppose"), chain), rewrite.triple_text(F.lit("n"), F.lit("s"), none))
    assert tuple(r) == ("甲\n乙", "甲\n乙", "n\n", "oppose\n甲\n乙", "n s")
    r = one(spark, rewrite.alpha(F.lit("n"), chain, F.lit("n"), chain), rewrite.alpha(F.lit("a"), none, F.lit("b"), none))
    assert r[0] == 1.0 and abs(r[1] - 0.5) < 1e-9
    r = one(spark, rewrite.fallback_future(F.lit(" " + "x" * 50)), rewrite.fallback_future(F.lit("y" * 30), rewrite.SHORT_FUTURE), rewrite.seed(F.lit("SAMPLE_0012"), 5), rewrite.seed(F.lit("none"), 5))
    assert r[0] == f"后续将延续「{'x' * 40}」所体现的现有安排。" and r[1] == f"接下来双方将围绕「{'y' * 24}」进一步落实相关安排。" and tuple(r)[2:] == (17, 5)
    sizes = [rewrite.longest_text(F.lit(g), F.lit(a)) for g, a in ((80, 0), (45, 0), (40, 0), (32, 0), (80, 3072))]
    assert tuple(one(spark, *sizes)) == (6144, 6144, 4096, 3072, 3072)
    kinds = [rewrite.rule_record(F.lit("s"), F.lit(k))["stance"] for k in ("政策文件", "记者会", "国际新闻报道")]
    assert tuple(one(spark, *kinds, rewrite.rule_record(F.lit(None).cast("string"), F.lit("x")))) == ("support", "support", "neutral", None)
    text = F.lit("短。这是一个足够长的句子用来测试。这也是一个足够长的句子测试它。")
    assert tuple(one(spark, rewrite.longest_sentence(text), rewrite.longest_sentence(F.lit("短。")))) == ("这是一个足够长的句子用来测试。", "短。")
    assert tuple(one(spark, rewrite.future_line(F.lit("x\n FUTURE 甲 \nFUTURE 乙"), F.lit("e")), rewrite.future_line(F.lit("none"), F.lit("e")))) == ("甲", "e")


def test_chains_and_forced_evidence(spark):
    a, b = "关于农产品准入的长期安排已经确定", "完全不同的另一段内容在这里出现"
    r = one(spark, rewrite.distinct_chain(F.array(F.lit(a), F.lit(a + "。"), F.lit(b))), rewrite.trim_chain(F.lit("n"), F.array(F.lit(a), F.lit(a))))
    assert r[0] == [a, b] and r[1] == [a]
    full = "原文里有一句非常重要的话说明了安排。"
    assert rewrite.forced("非常重要的话说明", full) == "非常重要的话说明"
    assert rewrite.forced("有一句非常重要的话说明了" + "虚构尾巴", full) == "有一句非常重要的话说明了"
    assert rewrite.forced("凭空编造的内容没有出处", full) == "" and rewrite.forced("太短", full) == "" and rewrite.forced(None, None) == ""
    got = spark.createDataFrame([(a, a), (a, b), ("", "x"), (a, None)], "gold string, got string")
    r = rewrite.coverage(got).collect()[0]
    assert r.n == 3 and 0.3 < r.recall < 0.6 and r.fully_kept == round(1 / 3, 6)


def test_normalised(spark):
    issue = "array<struct<name:string,stance:string,evidence:array<string>>>"
    full = "小麦进口配额将在年底前进一步提高。双方同意继续谈判。"
    issues = [("", "support", ["双方同意继续谈判"]), ("小麦配额", "支持", ["小麦进口配额将在", "小麦进口配额将在"]), ("谈判", "bad", ["双方同意继续谈判"]), ("继续谈判", "oppose", ["编造的证据不存在", "双方同意继续谈判"])]
    rows = spark.createDataFrame([("A", issues, ["小麦将继续", "", "x"], ["别的文本没有内容", full])], f"sample_id string, issues {issue}, futures array<string>, texts array<string>")
    got = rewrite.normalised(rows).collect()[0].issues
    assert [(x.name, x.stance, x.evidence) for x in got] == [("小麦配额", "support", ["小麦进口配额将在"]), ("继续谈判", "oppose", ["双方同意继续谈判"])]
    assert got[0].future == "小麦将继续" and got[1].future == "接下来双方将围绕「双方同意继续谈判」进一步落实相关安排。"


def test_parties_and_protocol(spark):
    s = spark.createDataFrame([("A", d, n, f"S{n:02d}", f"text {n}") for d, n in ((0, 1), (0, 2), (1, 3), (2, 4), (3, 5))], "sample_id string, doc_index int, sent_no int, sid string, text string")
    issues = spark.createDataFrame([("A", 0, "main", "support", ["S02", "S04"], ["text 2", "text 4"], "f0"), ("A", 1, "sub", "oppose", ["S03"], ["text 3"], "")], "sample_id string, issue_no int, name string, stance string, sids array<string>, evidence array<string>, future string")
    got = rewrite.parties(issues, s).orderBy("place").collect()
    assert [(r.name, r.speaker, r.sids) for r in got] == [("main", "P1", ["S02"]), ("main", "P2", ["S03"]), ("main", "P3", ["S04"]), ("sub", "P2", ["S03"])]
    assert got[3].future == "后续将延续「text 3」所体现的现有安排。"
    lines = rewrite.protocol_lines(issues.withColumnRenamed("sids", "tokens")).collect()[0].protocol
    assert lines == "ISSUE main ||| support ||| S02,S04\nISSUE sub ||| oppose ||| S03\nFUTURE f0\nFUTURE "
    covers = spark.createDataFrame([("A", 0, 1, ["S03"]), ("A", 0, 0, ["S01", "S02"]), ("A", 0, 2, ["S03"]), ("A", 1, 0, None)], "sample_id string, issue_no int, evidence_no int, sids array<string>")
    assert [(r.issue_no, r.sids) for r in rewrite.aligned(covers).collect()] == [(0, ["S01", "S02", "S03"])]


def test_few_shot(spark):
    kind = "sample_no int, full_text string, issues array<struct<name:string,stance:string,evidence:array<string>>>, futures array<string>"
    text = "甲。乙。丙。" + "x" * 20 + "丁"
    same = [("a", "support", ["甲"]), ("b", "support", ["乙"]), ("c", "support", ["丙"])]
    other = [("a", "support", ["甲"]), ("b", "oppose", ["乙"]), ("c", "neutral", ["丙"])]
    rows = [(1, text, same, ["1", "2", "3"]), (2, text, other, ["1", "2", "3"]), (3, text, [*same[:2], ("c", "oppose", ["丁"])], ["1", "2", "3"]), (4, "甲。", same, ["1", "2", "3"]), (5, text, same, ["1"])]
    got = rewrite.few_shot(spark.createDataFrame(rows, kind), 2, prefix=10).collect()
    assert [(r.sample_no, r.diverse, r["head"]) for r in got] == [(2, 3, "甲。乙。丙。"), (1, 1, "甲。乙。丙。")]


def test_flows(spark):
    samples = spark.createDataFrame([("S1", "p"), ("S2", "p"), ("S7", "p")], "sample_id string, prompt string")
    said = lambda p, s: F.when(p.isNull() | (s % 1000 == 7), F.lit(None)).when(s == 1, "nothing").otherwise("<think>ISSUE</think>ISSUE a ||| support ||| S01")
    asked = flow.replies(samples, said).orderBy("sample_id").collect()
    assert [(r.n_issues, r.attempts, r.failed) for r in asked] == [(1, 2, False), (1, 1, False), (0, 2, True)]
    assert [r.sample_id for r in flow.failures(flow.replies(samples, said)).collect()] == ["S7"]
    assert flow.dry_run(samples, 2).count() == 2 and flow.draws(samples, said, 3).count() == 9
    records = spark.createDataFrame([("S1", 0, "农产品", ["证据"], "旧"), ("S2", 0, "甲乙", ["证据"], "")], "sample_id string, issue_no int, name string, evidence array<string>, future string")
    got = flow.futures(records, lambda p, s: F.when(s == 1, "no line").otherwise("FUTURE 新"), lambda n, e: n).orderBy("sample_id").collect()
    assert [r.future for r in got] == ["关于农产品，旧", "关于甲乙，新"]


def test_semantic_trim(spark):
    """The clause run closest to the name by inner product, here of counts of two words; near duplicates collapse."""
    encode = lambda t: F.array(F.contains(t, F.lit("小麦")).cast("double"), F.contains(t, F.lit("关税")).cast("double") * -1)
    long = "甲" * 30 + "，小麦进口将扩大，" + "关税" + "乙" * 40 + "。"
    got = one(spark, rewrite.semantic_trim(F.lit("小麦"), F.array(F.lit(long), F.lit(long), F.lit("短句。")), encode), rewrite.semantic_trim(F.lit("n"), F.lit(None).cast("array<string>"), encode))
    assert got[0] == ["甲" * 30 + "，小麦进口将扩大", "短句。"] and got[1] == []


def test_ends_of_forced_evidence(spark):
    """The operator strips white space, or what it is told; a cut leaves what stands there."""
    text = "\n　先说  有一句非常重要的话说明了安排。\n后面还有一段内容在这里出现。"
    tried = ("说  有一句非常重要的话说明了安排。\n", "\n　先说  有一句非常重要的话说明了" + "#" * 12)
    for strip, want in (((), ("说  有一句非常重要的话说明了安排。", "先说  有一句非常重要的话说明了")), ((T.strip_spaces,), (tried[0], tried[1][:-12]))):
        assert tuple(one(spark, *[rewrite.force_substring(F.lit(e), F.lit(text), *strip) for e in tried])) == want
    # 220 characters are left, so 109 that both have are less than half.
    assert one(spark, rewrite.force_substring(F.lit(" " + "x" * 218 + "  z"), F.lit("x" * 109)), rewrite.force_substring(F.lit("x" * 218), F.lit("x" * 109))) == ("", "x" * 109)


def test_forced_query_trims_as_its_sql(spark, tmp_path):
    """SQL's trim takes spaces of any width and leaves tabs and line ends."""
    rows = [(1, "0123456789" + "ab " * 13 + "\n" + "cd " * 30), (2, "0123456789" + "\n" + "efgh " * 30), (3, "0123456789" + " 　" + "ijkl " * 7 + "mno" + "pq " * 30), (4, "0123456789" + "\t" + "r s t u " * 4 + "v w xyz " + "r " * 60)]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(tuple(r) for r in rewrites.forced_substrings(spark, str(tmp_path)).collect())
    trim = lambda x: x.strip(" 　")
    assert got == [(i, k, x) for i, t in rows for k, x in enumerate((trim(t[10:50]), t[10:40].lstrip(" 　"), "", ""))]
