"""Rules that a file of result lines must keep, as one table of violations.

Lines are parsed as variants, so a value's type counts and not only whether it can be cast. A line that can't be parsed,
is no object, lacks a key, or has a wrong type where records should be is judged no further. Repeated keys of one object
are invalid JSON here.

Cases: null lines are blank ones; an empty table breaks one rule, empty_file; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ustrip

# The keys and stances of the format.
TOP = ("sample_id", "issue_list", "future_argument")
ISSUE = ("issue_name", "stance", "argument_chain")
STANCES = ("support", "oppose", "neutral")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _string(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _blank(c: Column) -> Column:
    return F.length(ustrip(F.coalesce(c, F.lit("")))) == 0


def _none(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def _hit(broken: Column, rule: str, place: Column) -> Column:
    return F.when(F.coalesce(broken, F.lit(False)), F.struct(place.alias("place"), F.lit(rule).alias("rule")))


def _names(*x: str) -> Column:
    return F.array(*map(F.lit, x))


def _issue_rules(x: Column, k: Column) -> Column:
    o, place = _object(x), F.concat(F.lit("issue "), k)
    chain = _array(o["argument_chain"])
    keys = F.map_keys(o)
    own = F.array(
        _hit((F.size(keys) != len(ISSUE)) | (F.size(F.array_except(_names(*ISSUE), keys)) > 0), "issue_keys", place),
        _hit(~F.coalesce(_string(o["stance"]).isin(*STANCES), F.lit(False)), "bad_stance", place),
        _hit(_blank(_string(o["issue_name"])), "blank_name", place),
        _hit(_none(chain), "empty_chain", place),
    )
    each = F.transform(F.coalesce(chain, F.array().cast("array<variant>")), lambda e, t: _hit(_blank(_string(e)), "blank_evidence", F.concat(place, F.lit(" evidence "), t)))
    return F.when(o.isNull(), F.array(_hit(F.lit(True), "issue_not_object", place))).otherwise(F.concat(own, each))


def violations(lines: DataFrame, expected: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """line_no (null for rules of the whole), sample_id, place, rule; one row for each breach.

    lines: line_no, line. expected: sample_id, the ids that must be there. docs: sample_id, text, source texts, one of
    which must hold each piece of evidence; samples without texts are not held against any."""
    nowhere = F.lit(None).cast("string")
    p = lines.select("line_no", "line", F.try_parse_json(F.when(F.is_valid_utf8("line"), F.col("line"))).alias("v"))
    p = p.withColumn("m", _object(F.col("v"))).withColumns({"sample_id": _string(F.col("m.sample_id")), "issues": _array(F.col("m.issue_list")), "futures": _array(F.col("m.future_argument"))})
    keys, blank = F.map_keys("m"), _blank(F.col("line"))
    missing = F.size(F.array_except(_names(*TOP), keys)) > 0
    read = F.col("m").isNotNull() & ~missing & F.col("sample_id").isNotNull()
    whole = read & F.col("issues").isNotNull() & F.col("futures").isNotNull()
    utf8 = F.coalesce(F.is_valid_utf8("line"), F.lit(True))
    own = F.array(
        _hit(~utf8, "not_utf8", nowhere),
        _hit(blank, "blank", nowhere),
        _hit(utf8 & ~blank & F.col("v").isNull(), "invalid_json", nowhere),
        _hit(F.col("v").isNotNull() & F.col("m").isNull(), "not_object", nowhere),
        _hit(F.size(F.array_except(keys, _names(*TOP))) > 0, "extra_keys", nowhere),
        _hit(missing, "missing_keys", nowhere),
        _hit(~missing & F.col("sample_id").isNull(), "id_no_string", nowhere),
        _hit(read & ~whole, "no_arrays", nowhere),
        _hit(whole & (F.size("issues") != F.size("futures")), "lengths_differ", nowhere),
        _hit(whole & _none(F.col("issues")), "empty_list", nowhere),
    )
    inner = F.concat(F.flatten(F.transform("issues", _issue_rules)), F.transform("futures", lambda f, k: _hit(_blank(_string(f)), "blank_future", F.concat(F.lit("future "), k))))
    told = F.filter(F.concat(own, F.when(whole, inner).otherwise(F.array())), lambda x: x.isNotNull())
    out = p.select("line_no", F.when(read, F.col("sample_id")).alias("sample_id"), F.explode(told).alias("x")).select("line_no", "sample_id", "x.*")

    texts = lines.where(~_blank(F.col("line")))
    first = texts.agg(F.min_by("line", "line_no").alias("line"), F.min("line_no").alias("line_no"))
    total = first.select("line_no", nowhere.alias("sample_id"), nowhere.alias("place"), F.when(F.col("line_no").isNull(), "empty_file").when(F.startswith(ustrip(F.col("line")), F.lit("[")), "outer_array").alias("rule")).where("rule is not null")
    ids = p.where(read).groupBy("sample_id").agg(F.count("*").alias("n"))
    said = lambda d, rule: d.select(F.lit(None).cast("long").alias("line_no"), "sample_id", nowhere.alias("place"), F.lit(rule).alias("rule"))
    out = out.unionByName(total).unionByName(said(ids.where("n > 1"), "duplicate_id"))
    if expected is not None:
        want = expected.select("sample_id").distinct()
        out = out.unionByName(said(ids.join(want, "sample_id", "left_anti"), "unexpected_id")).unionByName(said(want.join(ids, "sample_id", "left_anti"), "missing_id"))
    if docs is not None:
        chains = p.where(whole).select("line_no", "sample_id", F.posexplode("issues").alias("k", "issue")).select("line_no", "sample_id", "k", F.posexplode(_array(_object(F.col("issue"))["argument_chain"])).alias("t", "e"))
        cited = chains.withColumn("evidence", _string(F.col("e"))).where(~_blank(F.col("evidence"))).drop("e")
        held = cited.join(docs.select("sample_id", "text"), "sample_id").groupBy("line_no", "sample_id", "k", "t").agg(F.coalesce(F.max(F.contains("text", F.col("evidence"))), F.lit(False)).alias("held"))
        place = F.concat(F.lit("issue "), F.col("k"), F.lit(" evidence "), F.col("t"))
        out = out.unionByName(held.where(~F.col("held")).select("line_no", "sample_id", place.alias("place"), F.lit("not_in_source").alias("rule")))
    return out


def marked_files(spark: SparkSession, path: str) -> list[str]:
    """Files of a path that start with a byte order mark, which reading by lines doesn't show: three bytes of each."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = jvm.org.apache.hadoop.fs.Path(path)
    fs, out = there.getFileSystem(conf), []
    for f in fs.listStatus(there):
        if f.isFile() and f.getLen() >= 3:
            stream = fs.open(f.getPath())
            if [stream.read() for _ in range(3)] == [0xEF, 0xBB, 0xBF]:
                out.append(f.getPath().toString())
            stream.close()
    return sorted(out)
