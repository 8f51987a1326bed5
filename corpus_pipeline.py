"""A training corpus from raw documents in five stages, each an operator of tessaly.llm over all that the one before kept.

1. language_id: documents whose language no dictionary tells, or by too narrow a margin for
   their size (a score of 0.5 at most, see langid), go; short ones are told as well as long ones.
2. exact_dedup: of texts equal without white space one stays, the longest, then the smallest id.
3. near_dedup: of documents linked by sets of five-word shingles at a Jaccard similarity of 0.8 one stays, the smallest id.
4. mix_sources: sources are mixed to target weights; a document taken more than once is repeated. Documents are whole.
5. pack: token windows of 2048; one row for each piece.

Cases: null and empty texts go in the first stage, as they have no language; rows without an id stay apart in stage 3
only from documents with one; rows that share an id stay there if one of them does; all columns of documents pass
through stages 1 to 4 under any name (they travel as one struct); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaly.llm import exact, jaccard, langid, mix, pack
from tessaly.llm._shared import discard, stored


def _folded(docs: DataFrame, *own: str) -> DataFrame:
    """The named columns, and all columns as `carried`: what operators add can't clash with it."""
    return docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    told = langid.classify(docs, langid.learn(docs))
    return told.where((F.col("lang_pred") != "und") & (F.col("score") > least)).select("carried.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = [F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("void")]
    kept = exact.duplicates(docs).where("kept").select(*key, F.col("text_sha256").alias("sha"), "points")
    text = F.coalesce("text", F.lit(""))
    rows = _folded(docs, "doc_id", "text").select(*key, F.sha2(F.translate(text, exact.SPACE.decode(), ""), 256).alias("sha"), F.length(text).cast("long").alias("points"), "carried")
    keys = ["id", "void", "sha", "points"]
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).select("carried.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = jaccard.linked(docs, shingle=5, percent=80).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return _folded(docs, "doc_id").alias("d").join(kept.alias("k"), F.expr("d.doc_id <=> k.doc_id"), "left_semi").select("carried.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mix.mix(docs, whole=True, carry=tuple(docs.columns)).where("copies > 0")
    return taken.select("carried", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("carried.*")


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack_windows)]
#: Token ids and compressed sizes are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
            if last is not None:
                discard(last)
            last = docs
    return docs
