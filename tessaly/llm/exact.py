"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Each task digests its documents' texts without white space and keeps, block by block, ids, lengths and digests. Blocks
send sorted compressed fingerprints to their owners and get duplicate bitmaps back; only documents whose fingerprint was
sent more than once are suspects. Suspects' texts are then compared byte by byte: grouped by the whole
normalised text, with partial sums before the shuffle, so a large group of copies sends one row from each task.

Cases: null text counts as empty, and empty texts are equal; of rows that repeat wholly one is kept; a null id is
larger than any other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from ._shared import block_rows, lean, partitions, stored

SPACE = b" \t\n\x0b\x0c\r"


def digests(docs: DataFrame, block_docs: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, shas, n = [], [], [], 0

        def out() -> pa.RecordBatch:
            block = TaskContext.get().partitionId() << 32 | n
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([points], pa.list_(pa.int64())), pa.array([b"".join(shas)], pa.binary())], ["block", "ids", "points", "shas"])

        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            points += pc.utf8_length(text).to_pylist()
            ids += batch.column("doc_id").to_pylist()
            shas += [hashlib.sha256(x.translate(None, SPACE)).digest() for x in text.cast(pa.binary()).to_pylist()]
            if len(ids) >= block_docs:
                yield out()
                ids, points, shas, n = [], [], [], n + 1
        if ids:
            yield out()

    return stored(docs.mapInArrow(lean(run), "block long, ids array<long>, points array<long>, shas binary"), "digests")


def prints(row: dict) -> np.ndarray:
    return np.frombuffer(row["shas"], "<u8").reshape(-1, 4)[:, 0]


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_docs: int = 50_000) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256, and points (characters of its text)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = digests(docs, block_docs)
    n = blocks.agg(F.sum(F.size("ids"))).first()[0] or 0
    owners = max(partitions(docs.sparkSession), n // 1_000_000)
    told = exchange.answers(blocks, prints, ["shas"], owners)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            h = prints(row)
            suspect = exchange.unpack(h, row["answer"], owners) > 0
            shas = np.frombuffer(row["shas"], np.uint8).reshape(-1, 32)
            place = np.arange(len(h)) | np.int64(row["block"] << 20)
            yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["points"], pa.int64()), pa.array([x.tobytes().hex() for x in shas], pa.string()), pa.array(place, pa.int64()), pa.array(suspect)], ["doc_id", "points", "sha", "place", "suspect"])

    joined = blocks.join(told, "block", "left").select("block", "ids", "points", "shas", "answer")
    rows = stored(joined.mapInArrow(lean(flag), "doc_id long, points long, sha string, place long, suspect boolean"), "suspects")
    suspects = rows.where("suspect")
    texts = docs.alias("d").join(suspects.select("doc_id").distinct().alias("s"), F.expr("d.doc_id <=> s.doc_id"), "left_semi")
    same = F.translate(F.coalesce("text", F.lit("")), SPACE.decode(), "")
    # One row for each normalised text, of equal bytes; two for one digest would be a collision of SHA-256.
    equal = texts.select(same.alias("same")).groupBy("same").agg(F.count("*").alias("equal")).select(F.sha2("same", 256).alias("sha"), "equal")
    # Ties: the longest text, the smallest id (a null one last), the first row.
    best = suspects.groupBy("sha").agg(F.min(F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id", "place")).alias("best"), F.count("*").alias("size"))
    # Stored, so that the join below deals rows anew and may split the digest of a large group.
    groups = stored(best.join(equal, "sha").select("sha", F.col("best.doc_id").alias("keep"), F.col("best.place").alias("first"), "size", "equal"), "groups")
    out = rows.join(groups, "sha", "left")
    group = F.coalesce("size", F.lit(1).cast("long"))
    wrong = F.raise_error(F.concat(F.lit("texts differ under one digest: "), F.col("sha")))
    return out.select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.when(F.col("size") > F.col("equal"), wrong.cast("long")).otherwise(group).alias("group_size"),
        F.coalesce(F.col("first") == F.col("place"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "points",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("points")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
    row_number() OVER (PARTITION BY h ORDER BY n DESC, doc_id) = 1 AS kept FROM d
)
SELECT doc_id, keep_id, group_size, kept, h AS text_sha256 FROM r
"""
