"""Line files in file order, and records as one JSON object a line.

Lines are numbered by file: within a split by place, splits by their start in the file, so no task sees a whole file.
Nothing is collected; what is strict raises its error in the task that meets the bad line.

Cases: blank lines are no records, but count as lines; an absent path is Spark's error; an empty file has no records."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ustrip

SPLITS = ("train", "val", "test")


def unpacked(archive: str, folder: str) -> str:
    """The folder of a zip archive's files; extracted once. It must be one that all executors see."""
    if not os.path.isdir(folder):
        part = f"{folder}.part"
        with zipfile.ZipFile(archive) as z:
            z.extractall(part)
        os.rename(part, folder)
    return folder


def split_path(root: str, name: str) -> str:
    if name not in SPLITS:
        raise ValueError(f"no such split: {name}")
    return f"{root.rstrip('/')}/{name}.jsonl"


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1) and line."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("n"))  # one row for each split
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).drop("n")
    place = F.row_number().over(Window.partitionBy("file", "block").orderBy("pos"))
    return raw.withColumn("place", place).join(before, ["file", "block"]).select("file", (F.col("place") + F.col("before")).alias("line_no"), "line")


def records(lines: DataFrame, schema: str) -> DataFrame:
    """file, line_no and the fields of each line that isn't blank; fields of a line that is no JSON are null."""
    some = lines.where(F.length(ustrip(F.col("line"))) > 0)
    return some.select("file", "line_no", F.from_json("line", schema).alias("r")).select("file", "line_no", "r.*")


def load_split(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    return records(numbered(spark, split_path(root, name)), schema)


def is_object(line: Column) -> Column:
    """Whether a line is one JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(line)).startswith("OBJECT"), F.lit(False))


def strict(lines: DataFrame, schema: str, key: str = "sample_id") -> DataFrame:
    """As records; a line that is no JSON object, or whose key is no string, is an error that names file and line."""
    some = lines.where(F.length(ustrip(F.col("line"))) > 0)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("line"), f"$.{key}", "variant"))
    at = F.concat(F.col("file"), F.lit(":"), F.col("line_no"))
    ok = F.when(~is_object(F.col("line")), F.raise_error(F.concat(at, F.lit(": no JSON object"))).cast("string")).when(~F.coalesce(kind == "STRING", F.lit(False)), F.raise_error(F.concat(at, F.lit(f": {key} is no string"))).cast("string")).otherwise(F.col("line"))
    return some.select("file", "line_no", F.from_json(ok, schema).alias("r")).select("file", "line_no", "r.*")


def some(rows: DataFrame) -> DataFrame:
    """The rows; none at all is an error."""
    if rows.isEmpty():
        raise ValueError("no records")
    return rows


def keyed(rows: DataFrame, key: str = "sample_id", order: str = "line_no") -> DataFrame:
    """Of rows with one key the last, at the place (column place) of the first."""
    by = Window.partitionBy(key)
    ranked = rows.withColumns({"place": F.min(order).over(by), "last_": F.max(order).over(by)})
    return ranked.where(F.col(order) == F.col("last_")).drop("last_")


def id_list(lines: DataFrame) -> DataFrame:
    """id: each stripped line once, without blank ones."""
    return lines.select(ustrip(F.col("line")).alias("id")).where("id <> ''").distinct()


def listed(rows: DataFrame, ids: DataFrame, key: str = "sample_id") -> DataFrame:
    return rows.join(ids, F.col(key).cast("string") == ids["id"], "left_semi")


def first(rows: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    """The first n rows in file order: a limit that the caller asks for."""
    return rows.orderBy(order).limit(n)


def filled(template: str, **values: Column) -> Column:
    """A template with its {names} replaced by values, one after the other."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def as_lines(rows: DataFrame, *fields: str) -> DataFrame:
    """line: one JSON object a row, null fields kept, text as it is."""
    return rows.select(F.to_json(F.struct(*fields or rows.columns), {"ignoreNullFields": "false"}).alias("line"))


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """mode overwrite is how a batch run starts anew; append is for rows that aren't there yet."""
    lines.select(F.col("line").alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def write_report(row: DataFrame, path: str) -> None:
    """A report of one row as one indented JSON object."""
    write_lines(row.limit(1).select(F.to_json(F.struct(*row.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("line")).coalesce(1), path, "overwrite")


def write_ids(rows: DataFrame, path: str, key: str = "sample_id") -> None:
    """Distinct ids in order, range-partitioned: files in order of name hold them in order."""
    write_lines(rows.select(F.col(key).cast("string").alias("line")).distinct().orderBy("line"), path, "overwrite")


def repaired(lines: DataFrame) -> DataFrame:
    """Lines that hold a JSON object: a last line cut short goes, a whole one without its end stays."""
    return lines.where(is_object(F.col("line")))


def append_missing(spark: SparkSession, rows: DataFrame, path: str, key: str = "sample_id", repair: bool = True) -> None:
    """Append those rows, as lines, whose key no line there has. A task's file appears only when its task has ended, so
    runs can stop at any time; lines cut short by others count as absent (without repair, as present if their key reads)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(conf).exists(there):
        old = spark.read.text(path).select(F.col("value").alias("line"))
        done = F.get_json_object("line", f"$.{key}") if repair else F.regexp_extract("line", f'"{key}"\\s*:\\s*"?([^",}}]*)', 1)
        have = (repaired(old) if repair else old).select(done.alias("done")).where("done is not null").distinct()
        rows = rows.join(have, F.col(key).cast("string") == F.col("done"), "left_anti")
    write_lines(as_lines(rows), path, "append")


def log_failures(rows: DataFrame, path: str) -> None:
    """Append rows of sample_id, attempt, error and recovered to a failure log."""
    write_lines(as_lines(rows, "sample_id", "attempt", "error", "recovered"), path, "append")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local session without one gets a local one."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="lines-")
