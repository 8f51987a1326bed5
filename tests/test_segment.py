import itertools
import json
import random

from pyspark.sql import functions as F

from tessaly.functions import lcs
from tessaly.operators import repair, segment


def test_spans():
    p = segment.Profile()
    cut = lambda t, m="。！？\n": [t[a:b] for a, b in p.spans(t, m)]
    assert cut("甲。乙！丙") == ["甲。", "乙！", "丙"]
    assert cut("a“b。c”。d。") == ["a“b。c”。", "d。"]
    assert cut("甲“乙。丙。丁") == ["甲“乙。丙。丁"]
    assert cut("甲“乙「丙”。丁」。") == ["甲“乙「丙”。", "丁」。"]
    assert cut(" 。\n　\n甲") == [" 。", "甲"]
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choices("甲乙。！\n；，, “”「」x", k=rng.randint(0, 900)))
        spans = p.sentences(t)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in itertools.pairwise(spans))
        covered = {k for a, b in spans for k in range(a, b)}
        assert all(t[k].isspace() for k in range(len(t)) if k not in covered)
        assert all(b - a <= 220 or len(p.spans(t[a:b], "，,")) == 1 for a, b in spans)


def test_numbers_run_over_documents(spark):
    long = "这是一个足够长的句子用来避免与相邻的句子合并在一起因此需要超过三十二个字符才行。"
    docs = spark.createDataFrame([(1, 0, "  " + long + long), (1, 1, long), (2, 0, None)], "sample_id long, doc_index int, full_text string")
    got = segment.sentences(docs).orderBy("sample_id", "sent_no").collect()
    assert [(r.sid, r.doc_index) for r in got] == [("S01", 0), ("S02", 0), ("S03", 1)]
    assert got[0].text == long and got[0].start == 2
    near = segment.neighbourhood(segment.sentences(docs), spark.createDataFrame([(1, 2)], "sample_id long, sent_no int"), 1)
    assert sorted(r.sent_no for r in near.collect()) == [1, 2, 3]


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc甲😀", k=rng.randint(0, 9))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = list(itertools.accumulate(range(len(b)), lambda left, j, x=x, row=row: row[j] + 1 if b[j] == x else max(left, row[j + 1]), initial=0))
        assert lcs.length(a, b) == row[-1]


def test_rouge(spark):
    df = spark.createDataFrame([("甲乙丙", "甲乙丙"), ("甲乙", "甲丙"), ("", "甲"), ("", "")], "a string, b string")
    assert [r.x for r in df.select(lcs.rouge_l(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.5, 0.0, 0.0]


def test_json_repair():
    for text, want in [
        ('```json\n{"a": [1, 2]}\n```', {"a": [1, 2]}),
        ('{"a": [1, 2,], }', {"a": [1, 2]}),
        ('<think>{"x":1}</think> {"a": "b}{"} tail', {"a": "b}{"}),
        ('{"a": [{"n": "x"}, {"n": "cut he', {"a": [{"n": "x"}, {}]}),
        ('{"a":"x\\u12', {}),
        ('{"a":1', {}),
        ('{"a":["x", "y', {"a": ["x"]}),
        ('{"a":[1, 2', {"a": [1]}),
        ('{"a": 1, "key', {"a": 1}),
        ('{"a": 1, "key":', {"a": 1}),
        ('{"a": 1, "b": tru', {"a": 1}),
        ("no object", None),
        ('{"a": 1]', None),
        ("{}", {}),
        (None, None),
    ]:
        got = repair.extract(text)
        assert (None if got is None else json.loads(got)) == want, text
