"""Packing documents into token windows by minimum bin slack.

Each shard (the documents that one task reads, closed at `shard_tokens`) is packed on its own: no shuffle, and nothing
grows with the input but the output. A document's whole windows stand alone; of what remains of each document a
multiset of lengths is kept. The longest one opens a window, and a subset-sum over the lengths that still fit, on the
bits of one integer, finds the sum closest to the free room; the counts taken of each length are traced back. Where no
sum fills the window, one more remainder is cut to fill it. A shard's last tokens, less than a window, are laid out in
windows of powers of two, which need no padding.

Cases: null text is an empty text (its end token alone); documents that repeat, in id or text, are packed each for
itself; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import lean, slices, small_batches
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fill(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, how many) from a multiset, counts by length, whose sum is at most room and closest to it."""
    reach, trail, goal = 1, [], 1 << room
    below = (goal << 1) - 1
    for size in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, step = min(int(counts[size]), room // size), 1
        while left:  # 1, 2, 4, ... copies, then the rest
            step = min(step, left)
            trail.append((size, step, reach))
            reach |= (reach << size * step) & below
            left, step = left - step, step * 2
        if reach & goal:
            break
    total, took = reach.bit_length() - 1, {}
    for size, step, before in reversed(trail):
        if not before >> total & 1:
            total -= size * step
            took[size] = took.get(size, 0) + step
    return list(took.items())


def plan(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, first token, tokens). All are full but the last, which are of powers of two."""
    stacks: dict[int, list[tuple[int, int]]] = {}
    counts = np.zeros(window + 1, np.int64)
    for k, n in enumerate(lengths):
        if n:
            stacks.setdefault(n, []).append((k, 0))
            counts[n] += 1
    left, top, out = sum(lengths), window, []

    def take(size: int) -> tuple[int, int, int]:
        counts[size] -= 1
        item, start = stacks[size].pop()
        return item, start, size

    def back(item: int, start: int, size: int) -> None:
        counts[size] += 1
        stacks.setdefault(size, []).append((item, start))

    while left:
        room = window if left >= window else 1 << left.bit_length() - 1
        left -= room
        while not counts[top]:
            top -= 1
        made = []
        item, start, size = take(top)
        if size > room:
            back(item, start + room, size - room)
            size = room
        made.append((item, start, size))
        room -= size
        for each, n in fill(counts, room) if room else ():
            for _ in range(n):
                made.append(take(each))
            room -= each * n
        if room:  # whatever is left is longer
            item, start, size = take(int(np.flatnonzero(counts)[-1]))
            made.append((item, start, room))
            back(item, start + room, size - room)
        out.append(made)
    return out


def shard_rows(docs: list[tuple[int | None, int, np.ndarray]], window: int, first: int) -> list[tuple]:
    """docs: id, number of ids, and the ids after the last whole window, which have been given out before."""
    made, rows = plan([len(tail) for _, _, tail in docs], window), []
    for k, pieces in enumerate(made):
        at = 0
        for item, start, size in pieces:
            doc, n, tail = docs[item]
            rows.append((doc, n - len(tail) + start, size, zlib.crc32(tail[start : start + size].astype("<u4").tobytes()), n, first + k, at))
            at += size
    return rows


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, shard_tokens: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document: where it comes from, its ids' checksum, and its window and offset there.

    Windows are numbered within their task's range of 2**36."""
    if window < 1 or window >= 1 << 24:
        raise ValueError("window must be from 1 to 2**24")
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence = encoder(tokenizer), TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        tails: list[tuple] = []
        tokens = 0

        def out() -> Iterator[pa.RecordBatch]:
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)
            rows.clear()

        for batch in slices(batches, "text"):
            ids, offs = encode.batch(pc.fill_null(batch.column("text"), "").to_pylist())
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[offs[k] : offs[k + 1]], np.uint32(end_id))
                n, whole = len(own), len(own) // window * window
                for at in range(0, whole, window):
                    rows.append((doc, at, window, zlib.crc32(own[at : at + window].astype("<u4").tobytes()), n, sequence, 0))
                    sequence += 1
                tails.append((doc, n, own[whole:].copy()))
                tokens += n
                if tokens >= shard_tokens:
                    made = shard_rows(tails, window, sequence)
                    sequence = made[-1][5] + 1 if made else sequence
                    rows += made
                    tails, tokens = [], 0
            if len(rows) > 20_000:
                yield from out()
        rows += shard_rows(tails, window, sequence)
        yield from out()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
