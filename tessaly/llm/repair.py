"""Token ids in grammar-compressed shards with random access.

Documents are range-partitioned by id; each partition is a shard, encoded in order and cut into blocks of about
`block_tokens` ids at document ends, so memory holds one block, and each block has a grammar of its own: it is decoded
alone. Its ids are compressed by recursive pairing: in each round the pairs of neighbouring symbols are counted, and where
frequent pairs overlap the more frequent one wins; each winner becomes a nonterminal; rounds go on until no pair is
frequent. The payload holds the rules, every rule's expansion length, and the remaining
symbols, so any range of ids is found by the running sum of lengths and only the symbols that cover it are expanded.
Payloads lie in a Parquet table in the shared folder, written through Spark's commit protocol: a repeated task replaces
its output.

Cases: null text is an empty text (its end id alone); null ids come first; rows with one id stand next to each other in
any order; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import block_rows, lean, slices, stored
from .tokens import encoder

MAGIC = b"RPG1"
HEAD = struct.Struct("<4sIIIB")
SHARDS = "shard int, block int, start long, doc_ids array<long>, sizes array<long>, payload binary"


def pair_up(ids: np.ndarray, least: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, rules (two symbols each), the rules' expansion lengths, and the first nonterminal.

    A pair is frequent if it occurs `least` times without overlapping itself; rounds go on until none is. A rule is made
    where a pair wins half as often over its neighbours; when no pair does, the most frequent one is replaced alone.
    A pair of symbols never gains occurrences, so each round looks only at pairs that were frequent or are new, and at
    pairs of one symbol, whose runs are counted whole."""
    base = int(ids.max()) + 1 if len(ids) else 0
    seq, rules, sizes, top = ids.astype(np.uint32), [], np.ones(base, np.int64), base
    live = np.ones(len(seq), bool)
    while len(seq) > 1:
        n = len(seq)
        at = np.flatnonzero(live[:-1])
        first, second = seq[at], seq[at + 1]
        code = first.astype(np.uint64) << np.uint64(32) | second
        bits = min(max(len(at).bit_length() - 1, 8), 18)
        cell = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)
        maybe = np.flatnonzero((np.bincount(cell, minlength=1 << bits) >= least)[cell])
        twins = np.flatnonzero(first == second)
        again = twins[1:][(np.diff(at[twins]) == 1)] if len(twins) else twins
        if len(again):  # in a run of one pair every other occurrence counts
            head = np.flatnonzero(np.append(True, np.diff(at[again]) != 1))
            odd = (at[again] - np.repeat(at[again[head]] - 1, np.diff(np.append(head, len(again))))) % 2 == 1
            alone = np.ones(len(at), bool)
            alone[again[odd]] = False
            maybe = maybe[alone[maybe]]
        found = code[maybe]
        by = np.argsort(found)
        found = found[by]
        fresh = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else by
        counts = np.diff(np.append(fresh, len(found)))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        often = often[np.argsort(counts[often], kind="stable")]  # a pair's number is its rank
        rank = np.full(len(counts), -1, np.int32)
        rank[often] = np.arange(len(often))
        own = np.repeat(rank, counts)
        some = own >= 0
        place, own = at[maybe[by[some]]], own[some]
        weight = np.full(n + 1, -1, np.int32)  # of the pair that starts at each place, with a border
        weight[1 + place] = own
        won = (own >= weight[place]) & (own >= weight[place + 2])
        wins, number = place[won], own[won]
        enough = 2 * np.bincount(number, minlength=len(often)) >= least
        if not enough.any():
            enough[-1] = True
            wins, number = place, own
        some = enough[number]
        wins, number = wins[some], (np.cumsum(enough) - 1)[number[some]]
        made = found[fresh[often[enough]]]
        left, right = (made >> np.uint64(32)).astype(np.int64), (made & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rules.append(np.stack([left, right], 1))
        sizes = np.append(sizes, sizes[left] + sizes[right])
        seq[wins] = (top + number).astype(np.uint32)
        top += len(made)
        live[:] = False
        live[place] = live[at[twins]] = live[wins] = live[np.maximum(wins, 1) - 1] = True
        keep = np.ones(n, bool)
        keep[wins + 1] = False
        seq, live = seq[keep], live[keep]
    flat = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return seq, flat, sizes[base:], base


def _levels(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for; one level of the grammar in each round."""
    while len(deep := np.flatnonzero(seq >= base)):
        twice = np.ones(len(seq), np.int64)
        twice[deep] = 2
        pair = rules[seq[deep] - base]
        seq = np.repeat(seq, twice)
        at = deep + np.arange(len(deep))
        seq[at], seq[at + 1] = pair[:, 0], pair[:, 1]
    return seq


def expand(seq: np.ndarray, rules: np.ndarray, sizes: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for; each nonterminal is expanded once and copied."""
    seq = seq.astype(np.int64)
    deep = np.flatnonzero(seq >= base)
    used, which = np.unique(seq[deep], return_inverse=True)
    flat, each = _levels(used, rules, base), sizes[used - base]
    size = np.ones(len(seq), np.int64)
    size[deep] = each[which]
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint32)
    plain = np.flatnonzero(seq < base)
    out[start[plain]] = seq[plain]
    step = np.arange(int(size[deep].sum())) - np.repeat(np.cumsum(size[deep]) - size[deep], size[deep])
    out[np.repeat(start[deep], size[deep]) + step] = flat[np.repeat((np.cumsum(each) - each)[which], size[deep]) + step]
    return out


def dump(ids: np.ndarray) -> bytes:
    seq, rules, sizes, base = pair_up(ids)
    top = base + len(rules)
    width = 2 if top <= 1 << 16 else 3 if top <= 1 << 24 else 4
    body = seq.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    return HEAD.pack(MAGIC, base, len(rules), len(seq), width) + rules.astype("<u4").tobytes() + sizes.astype("<u4").tobytes() + body


def parts(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, rules, each rule's expansion length, and the first nonterminal."""
    magic, base, n_rules, n_seq, width = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a grammar block")
    at = HEAD.size
    rules = np.frombuffer(payload, "<u4", 2 * n_rules, at).reshape(-1, 2).astype(np.int64)
    sizes = np.frombuffer(payload, "<u4", n_rules, at + 8 * n_rules).astype(np.int64)
    raw = np.zeros((n_seq, 4), np.uint8)
    raw[:, :width] = np.frombuffer(payload, np.uint8, n_seq * width, at + 12 * n_rules).reshape(n_seq, width)
    return raw.reshape(-1).view("<u4").astype(np.int64), rules, sizes, base


def load(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from start to stop; expands only the symbols that cover them."""
    seq, rules, sizes, base = parts(payload)
    if start == 0 and stop is None:
        return expand(seq, rules, sizes, base)
    each = np.ones(len(seq), np.int64)
    deep = seq >= base
    each[deep] = sizes[seq[deep] - base]
    ends = np.cumsum(each)
    stop = int(ends[-1]) if stop is None and len(ends) else min(stop or 0, int(ends[-1]) if len(ends) else 0)
    if start >= stop:
        return np.zeros(0, np.uint32)
    a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
    skip = start - int(ends[a] - each[a])
    return expand(seq[a:b], rules, sizes, base)[skip : skip + stop - start]


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, block_tokens: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, compress and store; the stored table of blocks, by shard and block in ascending document order."""
    names = [x.split(" ")[0] for x in SHARDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(tokenizer), TaskContext.get().partitionId()
        ids, docs_, sizes, held, start, block = [], [], [], 0, 0, 0
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

        def out() -> pa.RecordBatch:
            row = [shard, block, start, docs_, sizes, dump(np.concatenate(ids))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for batch in slices(batches, "text"):
            flat, offs = encode.batch(pc.fill_null(batch.column("text"), "").to_pylist())
            flat = np.insert(flat, offs[1:], np.uint32(end_id))
            offs = offs + np.arange(len(offs))
            each = np.diff(offs)
            at = 0
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                docs_.append(doc)
                sizes.append(int(each[k]))
                held += int(each[k])
                if held >= block_tokens:
                    ids.append(flat[offs[at] : offs[k + 1]])
                    yield out()
                    at, start, block = k + 1, start + held, block + 1
                    ids, docs_, sizes, held = [], [], [], 0
            ids.append(flat[offs[at] :])
        if docs_:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("tie"))
    # The tie lets rows of one id spread over shards.
    return stored(rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(lean(run), SHARDS), "token-shards")


def read(blocks: DataFrame) -> DataFrame:
    """Decode stored blocks: doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit, little-endian)."""
    names = ["shard", "start", "doc_id", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in block_rows(batches):
            ids, n = load(r["payload"]).astype("<u4"), len(r["doc_ids"])
            offs = np.append(0, np.cumsum(r["sizes"]))
            if offs[-1] != len(ids):
                raise ValueError("a block's ids don't match its documents")
            cols = [pa.array([r["shard"]] * n, pa.int32()), pa.array(offs[:-1] + r["start"]), pa.array(r["doc_ids"], pa.int64()), pa.array(np.diff(offs)), pa.array([ids[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    # One row for each shard, of which there are no more than shuffle partitions.
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("before"))
    rows = blocks.select("shard", "start", "doc_ids", "sizes", "payload").mapInArrow(lean(run), "shard int, start long, doc_id long, n_tokens long, ids binary")
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    blocks = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return read(blocks).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
