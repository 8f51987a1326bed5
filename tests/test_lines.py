import zipfile

import pytest
from pyspark.sql import functions as F
from tessaly.sources import lines


def test_numbers_follow_files_and_splits(spark, tmp_path):
    n = 20_000
    (tmp_path / "a.jsonl").write_text("".join(f"line {k}\n" for k in range(n)))
    (tmp_path / "b.jsonl").write_text("x\n\ny")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = lines.numbered(spark, str(tmp_path)).select(F.element_at(F.split("file", "/"), -1).alias("f"), "line_no", "line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line_no, r.line) for r in got if r.f == "a.jsonl") == [(k + 1, f"line {k}") for k in range(n)]
    assert sorted((r.line_no, r.line) for r in got if r.f == "b.jsonl") == [(1, "x"), (2, ""), (3, "y")]


def test_strict_and_keyed(spark, tmp_path):
    rows = ['{"sample_id":"A","v":1}', "", '{"sample_id":"B","v":2}', '{"sample_id":"A","v":3}']
    path = tmp_path / "train.jsonl"
    path.write_text("\n".join(rows))
    got = lines.some(lines.strict(lines.numbered(spark, str(path)), "sample_id string, v long"))
    assert sorted((r.sample_id, r.v, r.place) for r in lines.keyed(got).collect()) == [("A", 3, 1), ("B", 2, 3)]
    assert [r.v for r in lines.load_split(spark, str(tmp_path), "train", "v long").orderBy("line_no").collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        lines.split_path("x", "other")
    with pytest.raises(ValueError):
        lines.some(got.where("false"))
    for bad, where in (('{"sample_id":"C"', ":2: no JSON object"), ("[1]", ":2: no JSON object"), ('{"sample_id":7}', ":2: sample_id is no string")):
        path.write_text(rows[0] + "\n" + bad)
        with pytest.raises(Exception, match="train.jsonl" + where):
            lines.strict(lines.numbered(spark, str(path)), "sample_id string").collect()


def test_resume_after_a_cut_line(spark, tmp_path):
    path = str(tmp_path / "out")
    lines.write_lines(spark.createDataFrame([('{"sample_id":"A"}',), ('{"sample_id":"B","issue',)], "line string"), path)
    rows = spark.createDataFrame([("A",), ("B",), ("C",)], "sample_id string")
    for _ in range(2):
        lines.append_missing(spark, rows, path)
    got = lines.repaired(spark.read.text(path).withColumnRenamed("value", "line"))
    assert sorted(r[0] for r in got.select(F.get_json_object("line", "$.sample_id")).collect()) == ["A", "B", "C"]
    lines.log_failures(spark.createDataFrame([("A", 2, "e", True)], "sample_id string, attempt int, error string, recovered boolean"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).collect()[0].recovered
    lines.write_report(rows.agg(F.count("*").alias("n"), F.lit(None).cast("string").alias("none")), str(tmp_path / "report"))
    assert "".join(r.value for r in spark.read.text(str(tmp_path / "report")).collect()).replace(" ", "") == '{"n":3,"none":null}'
    lines.write_ids(rows.union(rows), str(tmp_path / "ids"))
    assert [r.id for r in lines.id_list(lines.numbered(spark, str(tmp_path / "ids"))).orderBy("id").collect()] == ["A", "B", "C"]


def test_archive_and_templates(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("train.jsonl", '{"sample_id":"A"}')
    for _ in range(2):
        folder = lines.unpacked(str(tmp_path / "x.zip"), str(tmp_path / "x"))
    assert lines.load_split(spark, folder, "train", "sample_id string").count() == 1
    got = spark.range(1).select(lines.filled("a {x} b {y}{x}", x=F.lit("1"), y=F.lit(None).cast("string")).alias("t")).collect()
    assert got[0].t == "a 1 b 1"
