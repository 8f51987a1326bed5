"""Language by compression: the language whose dictionary makes a text smallest.

A bounded sample of labelled documents (at most `texts` of each language, drawn by a hash of id and text, each whole; a
text of more than `longest` characters comes after all shorter ones, the shortest first, and beyond `texts * longest`
characters in all only the first document is taken) becomes one raw-content zstandard dictionary for each language, in lower case. A text, in lower case too, is cut into chunks of `chunk` bytes, so that
the dictionary keeps its weight in long texts; all chunks of the whole text are compressed with every dictionary and the
sizes summed. The margin is the runner-up's excess as a share of the smallest size. Where it is narrow (under NARROW), or
the text is short (under SHORT bytes: compressed sizes are whole bytes and tie), the dictionaries' byte trigrams
decide instead, and the margin is the runner-up's excess in bits for each byte, narrow under BITS. With m the margin
as a multiple of what is narrow, the score is m / (1 + m): 0 for a tie, 0.5 where a margin stops being narrow, whatever
the text's size. Labels are read for learning only; there is one dictionary for each label, and more than `most` labels are an error.

Cases: columns carried along are fields of `carried`, so no name of theirs can clash; null texts and texts without a letter are `und` with score 0, as is everything when nothing could be learned;
ties in both measures go to the first language in code point order with score 0, and an only language has score 1; repeated rows are each answered; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import lean, small_batches

NARROW, SHORT, BITS = 0.03, 256, 0.5
_ready: dict = {}


def learn(labelled: DataFrame, texts: int = 150, longest: int = 2000, most: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Each language's dictionary, from columns of text and language; null ones teach nothing."""
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(most + 1).collect()}
    if not counts:
        return {}
    if len(counts) > most:
        raise ValueError(f"more than {most} languages")
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 3.0 * texts / n))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) / 1e6
    # About three times the wanted number pass the first draw, so the ranking sees few rows of each language.
    drawn = rows.withColumn("draw", draw).where(F.col("draw") <= share[F.col("lang")])
    size = F.length("text").cast("long")
    order = Window.partitionBy("lang").orderBy("rank", "draw", "id", "text")
    few = drawn.select("lang", F.when(size > longest, size).otherwise(0).alias("rank"), "draw", "id", "text").withColumn("k", F.row_number().over(order)).where(F.col("k") <= texts)
    few = few.withColumn("upto", F.sum(F.length("text")).over(order)).where((F.col("k") == 1) | (F.col("upto") <= texts * longest))
    out: dict[str, list[bytes]] = {}
    for r in sorted(few.select("lang", "k", "text").collect(), key=lambda r: (r.lang, -r.k)):
        out.setdefault(r.lang, []).append(r.text.lower().encode())
    return {k: b"\n".join(v) for k, v in out.items()}


def _grams(text: str) -> Iterator[np.ndarray]:
    """The text's byte trigrams as numbers, in pieces of bounded size."""
    data = np.frombuffer(f" {text} ".encode(), np.uint8)
    for k in range(0, len(data) - 2, 1 << 17):
        a = data[k : k + (1 << 17) + 2].astype(np.int32)
        yield (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]


class Trigrams:
    """A language's bytes given the two before them, from its dictionary's counts with a little added to each."""

    def __init__(self, data: bytes, add: float = 0.1):
        grams = np.concatenate([*_grams(data.decode(errors="replace")), np.zeros(0, np.int32)])
        self.add, self.tables = add, [np.unique(x, return_counts=True) for x in (grams, grams >> 8)]

    def _count(self, table: int, x: np.ndarray) -> np.ndarray:
        keys, counts = self.tables[table]
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[at] == x, counts[at], 0)

    def bits(self, grams: np.ndarray) -> float:
        return float(np.log2((self._count(1, grams >> 8) + 256 * self.add) / (self._count(0, grams) + self.add)).sum())


def _margin(costs: np.ndarray) -> tuple[int, float]:
    """The cheapest place, and by how much it leads."""
    best = int(np.argmin(costs))
    return best, float(np.delete(costs, best).min(initial=np.inf) - costs[best])


def _compressors(model: dict[str, bytes], level: int) -> list[tuple[str, object, Trigrams]]:
    key = (tuple(sorted((k, hash(v)) for k, v in model.items())), level)
    if _ready.get("key") != key:
        import zstandard as z

        made = []
        for lang, data in sorted(model.items()):
            words = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=level)
            made.append((lang, z.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False), Trigrams(data)))
        _ready.update(key=key, made=made)
    return _ready["made"]


def classify(docs: DataFrame, model: dict[str, bytes], chunk: int = 2048, level: int = 3, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """carried (a struct of the columns `keep`; all, if None), lang_pred and score."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("carried"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = rows.drop("text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _compressors(model, level)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                if not text or not coders or not any(map(str.isalpha, text)):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                text = text.lower()
                data = text.encode()
                parts = [data[k : k + chunk] for k in range(0, len(data), chunk)]
                sizes = np.array([sum(len(c.compress(x)) for x in parts) for _, c, _ in coders], float)
                best, lead = _margin(sizes)
                times = lead / sizes[best] / NARROW
                if len(data) < SHORT or times < 1:
                    best, lead = _margin(sum(np.array([t.bits(g) for *_, t in coders]) for g in _grams(text)))
                    times = lead / len(data) / BITS
                langs.append(coders[best][0])
                scores.append(1 - 1 / (1 + times))
            yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["carried", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    return rows.mapInArrow(lean(run), out)


def held_out(id_col: str = "doc_id"):
    """Documents that teach nothing."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out()))
    return classify(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"]).select("carried.*", "lang_pred", "score")
