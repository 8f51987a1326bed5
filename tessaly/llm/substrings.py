"""Passages that earlier documents have, by compressed full-text indexes.

1. Anchors. Each window of `window` words has one anchor, the smallest hash of its 8-word grams (the leftmost of equal
   ones). Equal windows have equal anchors, so only windows whose anchor occurs again can repeat; a packed exchange
   counts anchors over all documents, and all other windows are done.
2. Segments. Consecutive windows with one anchor make a segment. A block sends each distinct segment once, with the
   smallest document that has it, to the shard of its anchor: all equal windows meet in one shard.
3. Index. A shard's distinct segments become one FM-index: a suffix array (prefix doubling), its Burrows-Wheeler
   transform in a wavelet matrix of packed bits with rank directories, and the documents in suffix order. To search in
   few steps, its symbols are `step`-word grams, and each segment is laid out in `step` strides, so that a window is
   window / step symbols in a row. All segments are streamed over it: a backward search from each word gives matching
   statistics up to the threshold and the interval of suffixes, and the smallest document of an interval that reaches
   the threshold is the first to have that window.
4. Answers go back to the blocks, which drop the covered words of all documents larger than a window's first.

Anchors and segments follow content, so a document meets only the shards that may hold its passages, and a family of
copies sends one segment from each block. Words are compared by 40-bit hashes within equal-anchor segments.

Cases: null texts and texts without words have no words; a null id counts as 2**63 - 1, the largest, where documents are
compared; rows with one id don't count as smaller than each other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from ._shared import block_rows, gram_hashes, joined, lean, mix, partitions, raw, release, slices, stored, word_hashes, words

LAST = (1 << 63) - 1
GRAM = 8
WORD = np.uint64((1 << 40) - 1)


class FMIndex:
    """Of sequences of positive integers, laid end to end with a 0 after each."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.n, self.top = n, int(text.max(initial=0)) + 1
        ends = np.flatnonzero(text == 0)
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))  # each end is another, so no order runs past one
        k = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:] + 1
            key = rank * (n + self.top + 2) + after
            order = np.argsort(key, kind="stable")
            got = key[order]
            fresh = np.ones(n, np.int64)
            fresh[1:] = got[1:] != got[:-1]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(fresh) - 1
            rank, k = new, 2 * k
            if not n or rank.max() == n - 1 or k > n:
                break
        self.suffixes = order
        bwt = text[order - 1]
        self.before = np.searchsorted(np.sort(text), np.arange(self.top + 1))
        self.levels, self.bits, self.ranks, self.zeros = max(1, (self.top - 1).bit_length()), [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = bwt >> level & 1
            packed = np.packbits(np.append(bit, np.zeros(-n % 64 + 64, np.int64)).astype(np.uint8), bitorder="little").view("<u8")
            self.bits.append(packed)
            self.ranks.append(np.append(0, np.cumsum(np.bitwise_count(packed))).astype(np.int32))
            self.zeros.append(n - int(bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.origin = np.zeros(self.top + 1, np.int64)
        if n:
            fresh = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
            self.origin[bwt[fresh]] = fresh

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        cell = at >> 6
        low = self.bits[level][cell] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.ranks[level][cell] + np.bitwise_count(low)

    def back(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that start with a symbol before those of the given intervals."""
        both = np.concatenate([low, high])
        for level in range(self.levels):
            bit = np.tile(symbols >> (self.levels - 1 - level) & 1, 2)
            ones = self._ones(level, both)
            both = np.where(bit == 1, self.zeros[level] + ones, both - ones)
        both = both + np.tile(self.before[symbols] - self.origin[symbols], 2)
        return both[: len(low)], both[len(low) :]

    def statistics(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of symbols: how many of its last ones occur in a row, and the interval of suffixes that start so."""
        n, m = patterns.shape
        low, high, size = np.zeros(n, np.int64), np.full(n, self.n), np.zeros(n, np.int64)
        live = np.arange(n)
        for k in range(m - 1, -1, -1):
            a, b = self.back(patterns[live, k], low[live], high[live])
            some = a < b
            live = live[some]
            low[live], high[live] = a[some], b[some]
            size[live] += 1
        return size, low, high


def first_documents(codes: np.ndarray, lengths: np.ndarray, docs: np.ndarray, window: int, step: int) -> np.ndarray:
    """For each window of each segment, in order, the smallest document of all segments that have it."""
    ends = np.cumsum(lengths)
    grams = gram_hashes(codes, step)
    seg = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(len(codes)) - (ends - lengths)[seg]
    here = np.flatnonzero(pos <= lengths[seg] - step)
    _, symbol = np.unique(grams[here], return_inverse=True)
    symbol_at = np.zeros(len(codes), np.int64)
    symbol_at[here] = symbol + 1
    # Strides of one segment one after the other, each with an end.
    stride = np.arange(min(step, int(lengths.max())))
    tail_seg, tail_pos = np.repeat(np.arange(len(lengths)), len(stride)), np.tile(stride, len(lengths))
    owner, phase = np.concatenate([seg[here], tail_seg]), np.concatenate([pos[here] % step, tail_pos])
    at = np.concatenate([pos[here], np.full(len(tail_seg), 1 << 40)])
    order = np.lexsort((at, phase, owner))
    text = np.concatenate([symbol_at[here], np.zeros(len(tail_seg), np.int64)])[order]
    index = FMIndex(text)
    doc_of = docs[owner[order]][index.suffixes]
    start = np.flatnonzero(pos <= lengths[seg] - window)
    out = np.empty(len(start), np.int64)
    for a in range(0, len(start), 1 << 18):
        s = start[a : a + (1 << 18)]
        size, low, high = index.statistics(symbol_at[s[:, None] + np.arange(0, window, step)[None, :]])
        if (size < window // step).any():
            raise ValueError("a segment's own window isn't in the index")
        # Intervals of one length are equal or apart.
        low_, where = np.unique(low, return_inverse=True)
        high_ = np.zeros(len(low_), np.int64)
        high_[where] = high
        cuts = np.stack([low_, high_], 1).reshape(-1)
        out[a : a + len(s)] = np.minimum.reduceat(np.append(doc_of, LAST), cuts)[::2][where]
    return out


def anchors(h: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start word of each window inside one document, its anchor's word, and all grams' hashes."""
    grams = mix(gram_hashes(h, GRAM))
    size = np.diff(first)
    many = np.maximum(size - window + 1, 0)
    start = np.repeat(first[:-1] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    at = np.empty(len(start), np.int64)
    if len(start):
        view = np.lib.stride_tricks.sliding_window_view(grams, window - GRAM + 1)
        for a in range(0, len(start), 1 << 16):
            s = start[a : a + (1 << 16)]
            at[a : a + len(s)] = s + view[s].argmin(axis=1)
    return start, at, grams


def marked(docs: DataFrame, window: int, block_words: int) -> DataFrame:
    """Blocks of documents with their anchors."""
    names = ["block", "ids", "voids", "prints", "sizes", "shas", "counts", "places", "hashes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[] for _ in range(8)]
        held = number = 0

        def out() -> pa.RecordBatch:
            cols = [pa.array([TaskContext.get().partitionId() << 32 | number])]
            cols += [pa.array([x], pa.list_(t)) for x, t in zip(rows[:6], (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)]
            return pa.RecordBatch.from_arrays([*cols, *(pa.array([b"".join(x)], pa.binary()) for x in rows[6:])], names)

        for batch in slices(batches, "text"):
            data, offs = raw(batch.column("text"))
            start, end, first = words(data, offs)
            h = word_hashes(data, start, end)
            _, at, grams = anchors(h, first, window)
            at = np.unique(at)
            cuts = np.searchsorted(at, first)
            ids, voids, prints = (batch.column(c).to_pylist() for c in ("doc", "void", "print"))
            for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                own = at[cuts[k] : cuts[k + 1]]
                for col, x in zip(rows, (ids[k], voids[k], prints[k], b - a, hashlib.sha256(joined(data, start[a:b], end[a:b])).hexdigest(), len(own), (own - a).astype("<u4").tobytes(), grams[own].astype("<u8").tobytes()), strict=True):
                    col.append(x)
            held += len(h)
            if held >= block_words or len(rows[0]) >= 200_000:
                yield out()
                rows, held, number = [[] for _ in range(8)], 0, number + 1
        if rows[0]:
            yield out()

    return stored(docs.mapInArrow(lean(run), "block long, ids array<long>, voids array<boolean>, prints array<long>, sizes array<long>, shas array<string>, counts array<long>, places binary, hashes binary"), "anchors")


def flagged(blocks: DataFrame, owners: int) -> DataFrame:
    """One row for each document, with the places of anchors that occur again."""
    key = lambda row: np.frombuffer(row["hashes"], "<u8")
    told = exchange.answers(blocks, key, ["hashes"], owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            again = exchange.unpack(key(row), row["answer"], owners) > 0
            offs = np.append(0, np.cumsum(again))[np.append(0, np.cumsum(row["counts"]))]
            places = np.frombuffer(row["places"], "<u4")[again].astype(np.int32)
            cols = [pa.array(row["ids"], pa.int64()), pa.array(row["voids"], pa.bool_()), pa.array(row["prints"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(row["shas"], pa.string()), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(places))]
            yield pa.RecordBatch.from_arrays(cols, ["doc", "void", "print", "n_words", "sha", "places"])

    both = blocks.join(told, "block", "left").select("ids", "voids", "prints", "sizes", "shas", "counts", "places", "hashes", "answer")
    return stored(both.mapInArrow(lean(run), "doc long, void boolean, print long, n_words long, sha string, places array<int>"), "flagged")


def segmented(docs: DataFrame, window: int, block_words: int) -> DataFrame:
    """Blocks of documents whose windows may repeat: their words, runs of such windows, and distinct segments."""
    kind = "block long, ids array<long>, voids array<boolean>, sizes array<long>, letters binary, run_start binary, run_size binary, run_segment binary, seg_start binary, seg_size binary, seg_anchor binary, seg_doc binary"
    names = [x.split(" ")[0] for x in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"number": 0}

        def clear() -> None:
            state.update(ids=[], voids=[], sizes=[], letters=[], runs=[], words=0)

        def out() -> pa.RecordBatch:
            start, many, anchor, print_, doc = (np.concatenate(x) for x in zip(*state["runs"], strict=True))
            _, first, where = np.unique(print_, return_index=True, return_inverse=True)
            least = np.full(len(first), LAST, np.int64)
            np.minimum.at(least, where, doc)
            arrays = [start.astype("<i8"), many.astype("<i8"), where.astype("<i8"), start[first].astype("<i8"), (many[first] + window - 1).astype("<i8"), anchor[first].astype("<u8"), least]
            row = [TaskContext.get().partitionId() << 32 | state["number"], state["ids"], state["voids"], state["sizes"], zlib.compress(b" ".join(state["letters"]), 1), *(zlib.compress(x.tobytes(), 1) for x in arrays)]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), *[pa.binary()] * 8]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        clear()
        for batch in slices(batches, "text"):
            data, offs = raw(batch.column("text"))
            start, end, first = words(data, offs)
            h = word_hashes(data, start, end)
            begin, at, grams = anchors(h, first, window)
            places = batch.column("places")
            count = np.diff(np.asarray(places.offsets))
            good = np.repeat(first[:-1], count) + np.asarray(places.flatten(), dtype=np.int64)
            keep = np.isin(at, good)
            begin, at = begin[keep], at[keep]
            new = np.ones(len(begin), bool)
            new[1:] = (at[1:] != at[:-1]) | (begin[1:] != begin[:-1] + 1)
            head = np.flatnonzero(new)
            many = np.diff(np.append(head, len(begin)))
            begin, at = begin[head], at[head]
            ids = np.asarray(batch.column("doc"))
            # The hash of a run's words: a polynomial of word hashes, wherever it stands.
            up = np.cumprod(np.append(np.uint64(1), np.full(len(h), 0xD1342543DE82EF95, np.uint64)))
            down = np.cumprod(np.append(np.uint64(1), np.full(len(h), pow(0xD1342543DE82EF95, -1, 1 << 64), np.uint64)))
            sums = np.append(np.uint64(0), np.cumsum(h * up[:-1]))
            size = many + window - 1
            print_ = mix((sums[begin + size] - sums[begin]) * down[begin] + size.astype(np.uint64))
            doc = ids[np.searchsorted(first, begin, side="right") - 1]
            state["runs"].append((begin + state["words"], many, grams[at], print_, doc))
            state["ids"] += ids.tolist()
            state["voids"] += batch.column("void").to_pylist()
            state["sizes"] += np.diff(first).tolist()
            state["letters"].append(joined(data, start, end))
            state["words"] += len(h)
            if state["words"] >= block_words:
                yield out()
                clear()
                state["number"] += 1
        if state["ids"]:
            yield out()

    return stored(docs.mapInArrow(lean(run), kind), "segments")


def _un(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def _pack40(h: np.ndarray) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def shard_answers(blocks: DataFrame, window: int, step: int, owners: int) -> DataFrame:
    """For each block: answer, a list of (segments, firsts): numbers of its distinct segments, and their windows' first documents."""
    columns = ["letters", "seg_start", "seg_size", "seg_anchor", "seg_doc"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            data = np.frombuffer(zlib.decompress(row["letters"]), np.uint8)
            start, end, _ = words(data, np.array([0, len(data)]))
            h = word_hashes(data, start, end) & WORD
            begin, size, doc = _un(row["seg_start"], "<i8"), _un(row["seg_size"], "<i8"), _un(row["seg_doc"], "<i8")
            owner = (mix(_un(row["seg_anchor"], "<u8")) % np.uint64(owners)).astype(np.int64)
            by, got = np.argsort(owner, kind="stable"), []
            for own in np.split(by, np.flatnonzero(np.diff(owner[by])) + 1) if len(by) else ():
                each = size[own]
                at = np.repeat(begin[own] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
                got.append((int(owner[own[0]]), row["block"], own.astype("<i8").tobytes(), each.astype("<i8").tobytes(), doc[own].tobytes(), _pack40(h[at])))
            cols = list(zip(*got, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int64(), *[pa.binary()] * 4], strict=True)], ["owner", "block", "segments", "lengths", "docs", "codes"])

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = [np.frombuffer(x, "<i8") for x in frame["lengths"]]
        size, docs, codes = np.concatenate(lengths), np.concatenate([np.frombuffer(x, "<i8") for x in frame["docs"]]), _unpack40(b"".join(frame["codes"]))
        ends = np.cumsum(size)
        # Equal segments of several blocks are indexed once, under their smallest document.
        seg = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(codes)) - (ends - size)[seg]
        print_ = np.add.reduceat(mix(codes + mix(pos.astype(np.uint64) + np.uint64(1))), ends - size) + mix(size.astype(np.uint64))
        _, first, where = np.unique(print_, return_index=True, return_inverse=True)
        least = np.full(len(first), LAST, np.int64)
        np.minimum.at(least, where, docs)
        each = size[first]
        at = np.repeat((ends - size)[first] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        found = first_documents(codes[at], each, least, window, step)
        many = each - window + 1
        begin = np.cumsum(many) - many
        out, k = [], 0
        for n in map(len, lengths):
            w = where[k : k + n]
            out.append(zlib.compress(found[np.repeat(begin[w] - (np.cumsum(many[w]) - many[w]), many[w]) + np.arange(int(many[w].sum()))].tobytes(), 1))
            k += n
        release()
        return pd.DataFrame({"block": frame["block"], "segments": frame["segments"], "firsts": out})

    sent = blocks.select("block", *columns).mapInArrow(lean(send), "owner int, block long, segments binary, lengths binary, docs binary, codes binary")
    told = sent.groupBy("owner").applyInPandas(own, "block long, segments binary, firsts binary")
    return told.groupBy("block").agg(F.collect_list(F.struct("segments", "firsts")).alias("answer"))


def remove(docs: DataFrame, window: int = 50, step: int = 10, block_words: int = 500_000, shard_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each document."""
    if window % step or window < GRAM:
        raise ValueError("window must be a multiple of step, and 8 at least")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.col(id_col).isNull().alias("void"), F.col(text_col).cast("string").alias("text")).withColumn("print", F.xxhash64("text"))
    blocks = marked(rows, window, block_words)
    n = blocks.agg(F.sum(F.length("hashes") / 8)).first()[0] or 0
    parts = partitions(docs.sparkSession)
    found = flagged(blocks, max(parts, int(n) // 2_000_000))
    some = found.where(F.size("places") > 0)
    total = some.agg(F.sum(F.size("places"))).first()[0] or 0
    owners = max(parts, total * (3 * window // 2) // shard_words)
    again = rows.join(some.dropDuplicates(["doc", "void", "print"]).select("doc", "void", "print", "places"), ["doc", "void", "print"]).select("doc", "void", "text", "places")
    held = segmented(again, window, block_words)
    told = shard_answers(held, window, step, owners)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            data = np.frombuffer(zlib.decompress(row["letters"]), np.uint8)
            start, end, _ = words(data, np.array([0, len(data)]))
            first = np.append(0, np.cumsum(row["sizes"]))
            ids = np.array(row["ids"], np.int64)
            begin, many, seg = _un(row["run_start"], "<i8"), _un(row["run_size"], "<i8"), _un(row["run_segment"], "<i8")
            n = _un(row["seg_size"], "<i8") - window + 1
            offs = np.append(0, np.cumsum(n))
            firsts = np.full(int(offs[-1]), LAST, np.int64)
            for x in row["answer"] or []:
                own = np.frombuffer(x["segments"], "<i8")
                at = np.repeat(offs[own] - (np.cumsum(n[own]) - n[own]), n[own]) + np.arange(int(n[own].sum()))
                firsts[at] = _un(x["firsts"], "<i8")
            shift = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            window_at = np.repeat(begin, many) + shift
            doc = ids[np.searchsorted(first, begin, side="right") - 1]
            gone = firsts[np.repeat(offs[seg], many) + shift] < np.repeat(doc, many)
            cover = np.zeros(len(start) + 1, np.int64)
            np.add.at(cover, window_at[gone], 1)
            np.subtract.at(cover, window_at[gone] + window, 1)
            keep = np.cumsum(cover[:-1]) == 0
            shas, lost = [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                k = np.flatnonzero(keep[a:b]) + a
                lost.append(b - a - len(k))
                each = end[k] - start[k] + 1
                at = np.repeat(start[k] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
                body = np.append(data, np.uint8(32))[at]
                body[np.cumsum(each) - 1] = 32
                shas.append(hashlib.sha256(body[:-1].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(row["voids"], pa.bool_()), pa.array(row["sizes"], pa.int64()), pa.array(lost, pa.int64()), pa.array(shas, pa.string())], ["doc", "void", "n_words", "n_removed", "kept_sha256"])

    both = held.drop("seg_start", "seg_anchor", "seg_doc").join(told, "block", "left").select("ids", "voids", "sizes", "letters", "run_start", "run_size", "run_segment", "seg_size", "answer")
    out = both.mapInArrow(lean(cut), "doc long, void boolean, n_words long, n_removed long, kept_sha256 string")
    out = out.unionByName(found.where(F.size("places") == 0).select("doc", "void", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256")))
    return out.select(F.when(~F.col("void"), F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents
), s AS (
  SELECT r, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS key FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), g AS (
  SELECT r, i, doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM s
), p AS (
  SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), c AS (
  SELECT p.r, p.word, p.i, coalesce(bool_or(g.gone) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS cut
  FROM p LEFT JOIN g ON p.r = g.r AND p.i = g.i
), k AS (
  SELECT r, count(*) FILTER (cut) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT cut), '')) AS kept_sha256 FROM c GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""
