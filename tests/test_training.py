import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from tessaly.functions import encoders
from tessaly.operators import training


def test_rows(spark):
    issues = spark.createDataFrame(
        [(1, 0, "a", "support", "f0"), (1, 1, "b", "oppose", "f\n1"), (1, 2, "a", "neutral", None), (2, 0, "c", "support", "g"), (3, 0, None, None, None)],
        "sample_id long, issue_no int, name string, stance string, future string",
    )
    tokens = spark.createDataFrame([(1, 1, ["S02", "S01", "S02", "S01"]), (1, 2, ["S01", "S09"]), (2, 0, ["S07"])], "sample_id long, issue_no int, tokens array<string>")
    sentences = spark.createDataFrame([(1, "S01", "one"), (1, "S02", "two"), (2, "S01", "three")], "sample_id long, sid string, text string")
    bodies = spark.createDataFrame([(1, "[S01] one"), (2, "x"), (3, "y")], "sample_id long, body string")
    args = (issues, tokens, sentences, bodies, ("e", "E"), ("u", "U"))
    got = sorted(((r.sample_id, r.task, r.issue_no, r.copy, [m.content for m in r.messages], r.chars) for r in training.rows(*args, repeat=2, boost=2).collect()), key=str)
    lines = "ISSUE b ||| oppose ||| S02,S01,S02\nISSUE a ||| neutral ||| S01,S09"
    first = ["e", "E\n[S01] one", lines]
    want = [(1, "extract", None, k, first, len("\n".join(first))) for k in (1, 2, 3, 4)]
    # The first issue named a takes the first line of that name; none is left for the second.
    for no, stance, chain, name, future in ((0, "support", ["one"], "a", "f0"), (1, "oppose", ["two", "one", "two"], "b", "f1")):
        said = ["u", f"U\n议题：{name}\n立场：{stance}\n证据：\n" + "\n".join(f"- {x}" for x in chain) + "\n", f"FUTURE {future}"]
        want.append((1, "future", no, 1, said, len("\n".join(said))))
    second = ["e", "E\nx", "ISSUE c ||| support ||| S07"]
    want += [(2, "extract", None, k, second, len("\n".join(second))) for k in (1, 2)]
    assert got == sorted(want, key=str)
    taught = spark.createDataFrame([(2, 0, "ISSUE won ||| neutral ||| S01")], "sample_id long, line_no int, line string")
    won = training.rows(*args, taught=taught).where("sample_id = 2").collect()
    assert [r.messages[-1].content for r in won] == ["ISSUE won ||| neutral ||| S01"]
    assert training.rows(issues.limit(0), *args[1:]).count() == 0


def test_masked_and_padded(spark):
    d = spark.createDataFrame([(0, 0, "p:", "ab"), (0, 1, "pp:", "a"), (0, 2, "p", " "), (0, 3, "p", None), (1, 4, "p", "x" * 50), (1, 5, "q", "z")], "batch int, id int, p string, a string")
    code = lambda: lambda t: [ord(c) for c in t]
    x = d.select("batch", "id", training.masked(F.col("p"), F.col("a"), code, "$", 20).alias("x")).select("batch", "id", "x.*").where("input_ids is not null")
    got = {r.id: r for r in training.padded(x, 0).collect()}
    assert sorted(got) == [0, 1, 5]
    ids = [ord(c) for c in "p:ab$\n"]
    assert (got[0].input_ids, got[0].labels, got[0].attention_mask) == (ids, [-100] * 2 + ids[2:], [1] * 6)
    assert got[5].input_ids == [ord(c) for c in "qz$\n"]
    joined = lambda: lambda t: [len(t)]
    with pytest.raises(PythonException, match="don't begin"):
        d.select(training.masked(F.col("p"), F.col("a"), joined, "$", 20).alias("x")).collect()
    empty = d.limit(0).select("batch", training.masked(F.col("p"), F.col("a"), code, "$", 20).alias("x")).select("batch", "x.*")
    assert training.padded(empty, 0).collect() == []


def test_encoders(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "b")], "a string, b string")
    score = encoders.scores(lambda: lambda a, b: [0.25] * len(a))
    got = d.select(encoders.orthogonal(F.col("a"), F.col("b")).alias("o"), score("a", "b").alias("s"), encoders.vectors(lambda: lambda t: [[float(len(x))] for x in t])("a").alias("v")).collect()
    assert [(r.o, r.s, r.v) for r in got] == [(1.0, 1.0, [1.0]), (0.0, 0.25, [1.0]), (None, 0.25, [0.0])]

    def missing():
        raise ImportError("no model")

    makers = {"real": missing, "plain": lambda: 7}
    with pytest.warns(UserWarning, match="plain takes its place"):
        assert encoders.pick("auto", makers, "real", "plain") == 7
    with pytest.raises(ImportError):
        encoders.pick("real", makers, "real", "plain")
    with pytest.raises(ValueError, match="unknown"):
        encoders.pick("other", makers, "real", "plain")
