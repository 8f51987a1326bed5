"""Lines that other documents have, by range-partitioned hashes; DataFrame operations only.

Each line long enough becomes a row of its key's hash, its document and its position. Rows are range-partitioned by hash
and sorted within partitions by hash, document and position; a running first value streams each hash's first document,
and rows of other documents are dropped lines. Their positions return as bitmaps of 64 lines a word, with words of
zeros left out, one for each document that loses a line; the text meets its bitmap once and never travels by line.

Hot lines: a sketch of the most frequent hashes, of fixed size, names those that could fill a partition. Such a hash is
dealt over `salts` parts by document, each part streams its own first document, and the parts' firsts (at most `hot`
times `salts` rows) are reduced to one by hash. All other hashes have one part. The sketch only deals rows; results
don't depend on it.

Keys are compared by two 64-bit hashes (128 bits together).

Cases: null and empty texts are one empty line; a null id counts as 2**63 - 1, the largest, where documents are
compared; rows with one id count as one document there, and get their own bitmaps; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import stored

LAST = (1 << 63) - 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key(line: Column) -> Column:
    """The line without white space at its ends, in lower case (A-Z only)."""
    return F.translate(F.trim(line, F.lit(" \t\n\x0b\x0c\r")), UPPER, LOWER)


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped(docs: DataFrame, least: int = 10, hot: int = 256, salts: int = 64) -> DataFrame:
    """doc, print and bits (word and 64 lines' drop bits, in order) of documents that lose a line. docs: doc_id, text."""
    doc, mark = F.coalesce("doc_id", F.lit(LAST)), F.xxhash64("text")
    lines = docs.select(doc.alias("doc"), mark.alias("print"), F.posexplode(F.transform(_split(F.col("text")), key)).alias("pos", "key")).where(F.length("key") >= least)
    rows = lines.select("doc", "print", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"))
    # At most `hot` numbers come to the driver.
    top = rows.agg(F.expr(f"approx_top_k(h, {hot}, {64 * hot})").alias("top")).first()["top"]
    named = [x["item"] for x in top or []]
    salt = F.when(F.col("h").isin(named), F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int")).otherwise(F.lit(-1))
    rows = rows.withColumn("salt", salt)
    dealt = rows.repartitionByRange("h", "g", "salt").sortWithinPartitions("h", "g", "salt", "doc", "pos")
    stream = Window.partitionBy("h", "g", "salt").orderBy("doc", "pos")
    first = dealt.withColumn("first", F.first("doc").over(stream)).where("doc > first or salt >= 0")
    first = stored(first.select("h", "g", "salt", "doc", "print", "pos", "first"), "repeated-lines")  # so that lines are dealt once
    parts = first.where("salt >= 0").groupBy("h", "g").agg(F.min("first").alias("least"))
    found = first.where("salt < 0 and doc > first").select("doc", "print", "pos")
    found = found.unionByName(first.where("salt >= 0").join(F.broadcast(parts), ["h", "g"]).where("doc > least").select("doc", "print", "pos"))
    words = found.groupBy("doc", "print", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % 64)).alias("bits"))
    return words.groupBy("doc", "print").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("bits"))


def deduplicate(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text for each document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lost = dropped(docs, least).alias("b")
    both = docs.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))).withColumn("print", F.xxhash64("text")).alias("d")
    both = both.join(lost, ["doc", "print"], "left").select("doc_id", "text", "bits")
    zeros = lambda x, i: F.array_repeat(F.lit(0).cast("long"), x["word"] - F.when(i > 0, F.get("bits", i - 1)["word"]).otherwise(-1) - 1)
    dense = F.flatten(F.transform("bits", lambda x, i: F.concat(zeros(x, i), F.array(x["bits"]))))
    lines = _split(F.col("text"))
    out = both.select("doc_id", lines.alias("lines"), dense.alias("bits"))
    gone = lambda i: F.call_function("shiftright", F.coalesce(F.get("bits", F.floor(i / 64).cast("int")), F.lit(0).cast("long")), i % 64).bitwiseAND(F.lit(1).cast("long")) == 1
    kept = F.when(F.col("bits").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~gone(i)))
    out = out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), e AS (
  SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e
), m AS (
  SELECT *, min(doc_id) OVER (PARTITION BY key) AS first FROM k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (length(key) >= 10 AND doc_id > first) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (length(key) >= 10 AND doc_id > first)), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
