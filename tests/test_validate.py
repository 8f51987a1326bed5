import json

from tessaly.operators import validate
from tessaly.plans import records


def line(sample="a", issues=None, futures=None, **more):
    issues = [{"issue_name": "n", "stance": "support", "argument_chain": ["e"]}] if issues is None else issues
    return json.dumps({"sample_id": sample, "issue_list": issues, "future_argument": ["f"] * len(issues) if futures is None else futures, **more}, ensure_ascii=False)


def test_every_rule(spark, tmp_path):
    issue = {"issue_name": "n", "stance": "support", "argument_chain": ["e"]}
    rows = [
        line("good"), "", " \t", None, "{", "3", "[1]", line("x", more=1), '{"sample_id":"y"}', line(5), line("arr", futures={}),
        line("len", futures=["f", "g"]), line("none", []), line("obj", ["text"]), line("keys", [{**issue, "z": 1}]),
        line("stance", [{**issue, "stance": "Support"}]), line("name", [{**issue, "issue_name": 7}]), line("chain", [issue, {**issue, "argument_chain": "e"}]),
        line("ev", [{**issue, "argument_chain": ["e", " ", 4]}]), line("fut", futures=["　"]), line("twice"), line("twice"), line("src", [{**issue, "argument_chain": ["e", "zz"]}]),
    ]
    d = spark.createDataFrame(list(enumerate(rows, 1)), "line_no long, line string")
    expected = spark.createDataFrame([(x,) for x in ("good", "arr", "len", "none", "obj", "keys", "stance", "name", "chain", "ev", "fut", "twice", "src", "gone", "gone")], "sample_id string")
    docs = spark.createDataFrame([("src", "xex"), ("src", "y"), ("good", "e"), ("stance", None)], "sample_id string, text string")
    got = sorted(((r.line_no, r.sample_id, r.place, r.rule) for r in validate.violations(d, expected, docs).collect()), key=str)
    want = [
        (2, None, None, "blank"), (3, None, None, "blank"), (4, None, None, "blank"), (5, None, None, "invalid_json"), (6, None, None, "not_object"), (7, None, None, "not_object"),
        (8, "x", None, "extra_keys"), (9, None, None, "missing_keys"), (10, None, None, "id_no_string"), (11, "arr", None, "no_arrays"), (12, "len", None, "lengths_differ"),
        (13, "none", None, "empty_list"), (14, "obj", "issue 0", "issue_not_object"), (15, "keys", "issue 0", "issue_keys"), (16, "stance", "issue 0", "bad_stance"),
        (17, "name", "issue 0", "blank_name"), (18, "chain", "issue 1", "empty_chain"), (19, "ev", "issue 0 evidence 1", "blank_evidence"), (19, "ev", "issue 0 evidence 2", "blank_evidence"),
        (20, "fut", "future 0", "blank_future"), (None, "twice", None, "duplicate_id"), (None, "x", None, "unexpected_id"), (None, "gone", None, "missing_id"),
        (23, "src", "issue 0 evidence 1", "not_in_source"), (16, "stance", "issue 0 evidence 0", "not_in_source"),
    ]
    assert got == sorted(want, key=str)
    array = spark.createDataFrame([(1, " [" + line()), (2, "]")], "line_no long, line string")
    assert sorted(r.rule for r in validate.violations(array).collect()) == ["invalid_json", "invalid_json", "outer_array"]
    assert [r.rule for r in validate.violations(d.limit(0)).collect()] == ["empty_file"]
    (tmp_path / "a.jsonl").write_bytes(b"\xef\xbb\xbf" + line().encode())
    (tmp_path / "b.jsonl").write_bytes(line().encode() + b"\n\xff\xfe\n")
    assert [x.rpartition("/")[2] for x in validate.marked_files(spark, str(tmp_path))] == ["a.jsonl"]
    read = spark.read.text(str(tmp_path / "b.jsonl")).selectExpr("monotonically_increasing_id() AS line_no", "value AS line")
    assert [r.rule for r in validate.violations(read).collect()] == ["not_utf8"]


def test_ids_of_broken_lines(spark, tmp_path):
    """A line that breaks off names its id all the same; an id cut short, or a key of an inner object, names none."""
    rows = [
        line("a")[:-1], line("a"), line("b")[:-1], line("b")[:-1], '{"sample_id":"c', line("c"), line("a"),
        '{"issue_list":[{"sample_id":"d"}],"sample_id" : "e\\"", "x', line("d"), line('e"'), '{"sample_id":7,', line("7"), '{"sample_id":70', line("70"),
        '{"issue_list":[]}', '{"issue_list":[]}', line("f") + " x", line("f"), "", None, '"sample_id":"g"', line("g"), '{"text":"\\"sample_id\\":\\"h\\"", "sample_id":"i", z', line("h"), line("i"),
    ]
    got = records.violations(spark.createDataFrame(list(enumerate(rows, 1)), "line_no long, line string")).collect()
    assert sorted(r.line_no for r in got if r.rule == "duplicate_id") == [2, 7, 10, 12, 18, 25]
    assert sorted(r.line_no for r in got if r.rule == "bad_json") == [1, 3, 4, 5, 8, 11, 13, 17, 19, 20, 21, 23]
    spark.range(790, 810).selectExpr("id AS doc_id", "1 AS quality").write.parquet(str(tmp_path / "labels.parquet"))
    told = {(r.line_no, r.rule) for r in records.validate_rows(spark, str(tmp_path)).collect()}
    assert {x for x in told if x[0] in (798, 799)} == {(798, "bad_json"), (799, "duplicate_id")}
