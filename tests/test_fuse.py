from pyspark.sql import functions as F

from tessaly.operators import fuse, protocol


def issue(name, stance="support", evidence=("某处的证据",), future=""):
    return {"name": name, "stance": stance, "evidence": list(evidence), "future": future}


def test_anchored_fusion():
    a = {"variant": 0, "issues": [issue("关税问题", "support", ["证据甲的内容"], "后续一"), issue("能源合作"), issue("单文件幻影", "neutral")]}
    b = {"variant": 1, "issues": [issue("关税问题", "oppose", ["证据乙完全不同"], "别的"), issue("能源合作"), issue("服务贸易"), issue("只此一处")]}
    c = {"variant": 2, "issues": [issue("服务贸易", "neutral")]}
    got = fuse.fused([a, b, c], fuse.ANCHORED)
    assert [x["name"] for x in got] == ["关税问题", "能源合作", "单文件幻影", "服务贸易"]
    assert got[0]["stance"] == "support" and got[0]["evidence"] == ["证据甲的内容", "证据乙完全不同"] and got[0]["future"] == "后续一"
    assert [x["name"] for x in fuse.fused([a, b, c], fuse.CONSENSUS)] == ["关税问题", "能源合作", "服务贸易"]
    assert len(fuse.fused([a, b, c], fuse.UNION)) == 5
    assert fuse.majority(["a", "b", "b", "a"]) == "a" and fuse.majority([None]) is None


def test_in_rows(spark):
    kind = f"sample_id long, v array<struct<variant:int,issues:{fuse.RECORDS}>>"
    rows = [(1, [(0, [("关税问题", "support", ["x"], "f")]), (1, [("能源合作", "oppose", ["y"], "")]), (2, [("能源合作", "oppose", [], "g"), ("无证据的", "oppose", None, "g")])]), (2, [(0, None)])]
    df = spark.createDataFrame(rows, kind)
    got = {r.sample_id: r for r in df.select("sample_id", fuse.fuse(F.col("v")).alias("f"), fuse.closest(F.col("v")).alias("c")).collect()}
    assert [x.name for x in got[1].f] == ["关税问题", "能源合作"] and got[1].f[1].future == "后续将延续「y」所体现的现有安排。"
    assert got[2].f == [] and got[2].c == 0


def test_protocol(spark):
    s = spark.createDataFrame([(1, "S01", "甲方认为，乙方同意；丙方、反对。"), (1, "S02", "全句。")], "sample_id long, sid string, text string")
    reply = "ISSUE 关税 ||| Support ||| S01.②, S02, S02\nnoise\nissue 能源 ||| oppose ||| S99\nISSUE 关税 ||| support ||| S01, S02\nISSUE 合作 ||| neutral ||| S01.⑨\nFUTURE 一\nFUTURE 二"
    r = spark.createDataFrame([(1, reply)], "sample_id long, reply string")
    got = protocol.compile_replies(r, s).orderBy("issue_no").collect()
    assert [(x.name, x.stance, x.evidence, x.future) for x in got] == [("关税", "support", ["乙方同意", "全句。"], "一"), ("合作", "neutral", ["甲方认为，乙方同意；丙方、反对。"], "二")]
    t = spark.createDataFrame([("S01.②-③",), ("S01.c1-c2",), ("S01:0-3",), ("S01:5-99",), ("S01.③-⑨",)], "t string")
    text = F.lit("甲方认为，乙方同意；丙方、反对。")
    assert [x.x for x in t.select(protocol.token_text(F.col("t"), text).alias("x")).collect()] == ["乙方同意；丙方", "甲方认为，乙方同意", "甲方认", "甲方认为，乙方同意；丙方、反对。", "丙方"]
