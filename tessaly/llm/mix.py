"""Mixing sources to target weights by weighted random keys.

A document's key is an exponential variate divided by its quality weight (Efraimidis and Spirakis), from a hash of its
id and a seed: the order within a source is a weighted sample without replacement, and reruns agree. A source's target
is met with as many complete epochs as fit in it, then with the documents of smallest keys while their running sum of
sizes fits; the document at the edge gives the words that are still missing. Running sums have two levels: sizes are
first summed by source and key range, those sums run within each source, and only documents of one key range are
ranked together, so a source with a third of all rows is dealt over many tasks.

Targets: sources in code point order, null last, get the weights in turn and share `share` of all sizes by them; none
gets more than `most` times its own size, and what is over is shared again by weight among the rest.

Cases: null and empty texts have size 0 and give nothing; a source without words gets target 0; a null id's key comes
from its text; ties in key go to the smaller id, then to the smaller hash of the text; other columns are ignored, and
those carried along are fields of `carried`, so no name of theirs can clash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(ident: Column, text: Column, seed: str) -> Column:
    """In (0, 1), from the first 13 digits of a digest of the id, or of the text where that is null."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(ident.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def quality(text: Column, size: Column) -> Column:
    """From 0 to 1: highest where a word takes six characters with its separator, as in prose."""
    return F.when(size > 0, 1.0 / (1.0 + F.abs(F.length(text) / size - 6.0) / 6.0)).otherwise(1.0)


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: one row for each source, from columns source and size."""
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    each = each.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    # Sources fill up in the order of cap / weight. With those before it full, a source sees this level for a weight of 1.
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = each.withColumn("ratio", F.col("cap") / F.col("weight"))
    level = (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    each = each.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return each.withColumn("found", found).select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * F.col("found")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix-1:", per_range: int = 200_000, whole: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target (its source's), taken, copies and carried (a struct of the columns `carry`; without
    any, none), for each row of doc_id, text and source. There are as many key ranges as keep about `per_range` rows in one.

    copies: complete epochs, and one more for a document that gives words to the fraction.

    whole: the document at the edge is taken whole when at least half of it is missing, else not at all."""
    size = words(F.col("text"))
    ranges = max(2048, docs.count() // per_range)
    kept = ["carried"] if carry else []
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("row_hash"), size.alias("size"), (-F.log(uniform(F.col("doc_id"), F.col("text"), seed)) / quality(F.col("text"), size)).alias("key"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []))
    if not carry:  # small rows, read three times; texts that are carried are read again instead
        rows = stored(rows, "sizes")
    rows = rows.withColumn("range", F.floor(F.col("key") / (1.0 + F.col("key")) * ranges).cast("int"))
    goals = targets(rows, weights, share, most)
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    run = Window.partitionBy("source").orderBy("range")
    sums = sums.withColumn("before", F.sum("range_size").over(run) - F.col("range_size")).alias("s").join(goals.alias("g"), F.expr("s.source <=> g.source")).select("s.source", "s.range", "before", "source_size", "target")
    rows = rows.alias("r").join(sums.alias("s"), F.expr("r.source <=> s.source and r.range = s.range")).select("doc_id", "r.source", "r.range", "row_hash", "size", "key", "before", "source_size", "target", *kept)
    order = Window.partitionBy("source", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "row_hash")
    start = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")) - F.col("start")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))
    if whole:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("start", start).withColumn("epochs", epochs.cast("long"))
    copies = F.col("epochs") + (part > 0).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), copies.alias("copies"), *kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, source, text, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), k AS (
  SELECT *, -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)
    / (CASE WHEN size > 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + abs(length(text)::DOUBLE / size - 6.0::DOUBLE) / 6.0::DOUBLE) ELSE 1.0::DOUBLE END) AS key FROM t
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM t GROUP BY source
), w AS (
  SELECT source, source_size, ([5.0, 2.0, 1.0])[(n % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), f AS (
  SELECT source, source_size, least(cap, weight * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio)) AS target FROM l
), r AS (
  SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target - epochs * source_size)::BIGINT - start)))::BIGINT AS taken FROM r
"""
