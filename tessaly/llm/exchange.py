"""A packed exchange of fingerprints between blocks of documents and the owners of fingerprint ranges.

A block sends each owner its distinct fingerprints, sorted and Golomb-Rice coded; an owner answers every block with a
few bits for each of them. A value costs some 30 bits there and a few back, and however often a value occurs, a block
sends it once, with its count where that is over 1.

Owners grow with the input while blocks don't, so beyond `wide` owners there are two levels: owners form groups, about as
many as owners in each; a block sends to groups; a relay merges what as many blocks send to one group and is itself a
block towards that group's owners. A message then holds many values at any size of the input, and a value travels twice.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import block_rows, lean, release, stored

HEAD = struct.Struct("<IB")
BITS = 40
WIDE = 1024
CHUNK = 1 << 15
SENT = "owner long, block long, coded binary, times binary"
TYPES = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def golomb(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as gaps: low bits as they are, the rest in unary."""
    n = len(values)
    if not n:
        return HEAD.pack(0, 0)
    gaps = np.diff(values.astype(np.int64), prepend=0)
    k = max(0, int(np.log2(max(1.0, float(values[-1]) / n))))
    high = gaps >> k
    unary = np.zeros(int(high.sum()) + n, np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    low = [np.packbits(((gaps[a : a + CHUNK, None] >> np.arange(k)) & 1).astype(np.uint8).reshape(-1)).tobytes() for a in range(0, n, CHUNK)]
    return HEAD.pack(n, k) + b"".join(low) + np.packbits(unary).tobytes()


def ungolomb(coded: bytes) -> np.ndarray:
    n, k = HEAD.unpack_from(coded)
    if not n:
        return np.zeros(0, np.int64)
    size, low = (n * k + 7) // 8, np.zeros(n, np.int64)
    for a in range(0, n if k else 0, CHUNK):
        m = min(CHUNK, n - a)
        bits = np.unpackbits(np.frombuffer(coded, np.uint8, (m * k + 7) // 8, HEAD.size + a * k // 8), count=m * k).reshape(m, k)
        for j in range(k):
            low[a : a + m] |= bits[:, j].astype(np.int64) << j
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(coded, np.uint8, -1, HEAD.size + size)))[:n]
    return np.cumsum((np.diff(ends, prepend=-1) - 1 << k) + low)


def levels(owners: int, wide: int) -> tuple[int, int]:
    """How many groups of owners there are, and owners in each."""
    groups = owners if owners <= wide else math.isqrt(owners - 1) + 1
    return groups, -(-owners // groups)


def split(values: np.ndarray, groups: int, subs: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of 64-bit hashes: each one's group and value there; the value's high bits name the owner in the group."""
    high = values >> np.uint64(BITS)
    sub = high // np.uint64(groups) % np.uint64(subs)
    return (high % np.uint64(groups)).astype(np.int64), (sub << np.uint64(BITS) | values & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _messages(owner: np.ndarray, value: np.ndarray, times: np.ndarray, block: int) -> pa.RecordBatch:
    order = np.lexsort((value, owner))
    owner, value, got = owner[order], value[order], ([], [], [], [])
    if len(value):
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])))
        times = np.minimum(np.add.reduceat(times[order], first), 255).astype(np.uint8)
        owner, value = owner[first], value[first]
        cuts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(owner)), strict=True):
            for col, x in zip(got, (int(owner[a]), block, golomb(value[a:b]), times[a:b].tobytes() if times[a:b].max() > 1 else b""), strict=True):
                col.append(x)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(got, TYPES, strict=True)], ["owner", "block", "coded", "times"])


def _union(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """All messages' distinct values, their summed counts, each sent value's place among them, and messages' sizes."""
    lists = [ungolomb(x) for x in frame["coded"]]
    times = [np.frombuffer(t, np.uint8) if t else np.ones(len(x), np.uint8) for t, x in zip(frame["times"], lists, strict=True)]
    values, where = np.unique(np.concatenate(lists), return_inverse=True)
    return values, np.bincount(where, weights=np.concatenate(times)).astype(np.int64), where, [len(x) for x in lists]


def _packed(others: np.ndarray, most: int) -> bytes:
    return (np.packbits(others) if most == 1 else others).tobytes()


def _unpacked(packed: bytes, n: int, most: int) -> np.ndarray:
    got = np.frombuffer(packed, np.uint8)
    return np.unpackbits(got, count=n) if most == 1 else got


def _owned(sent: DataFrame, most: int) -> DataFrame:
    """block, owner, packed: each owner's answers."""

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        _, total, where, sizes = _union(frame)
        others = np.minimum(total[where] - 1, most).astype(np.uint8)
        packed = [_packed(x, most) for x in np.split(others, np.cumsum(sizes)[:-1])]
        out = pd.DataFrame({"block": frame["block"], "owner": frame["owner"], "packed": packed})
        release()
        return out

    return sent.groupBy("owner").applyInPandas(own, "block long, owner long, packed binary")


def _gathered(told: DataFrame) -> DataFrame:
    return told.groupBy("block").agg(F.collect_list(F.struct("owner", "packed")).alias("answer"))


def _relayed(sent: DataFrame, blocks: int, groups: int, subs: int, most: int) -> DataFrame:
    """block, owner, packed: each group's answers, by way of relays. sent: what blocks send to groups."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        values, total, _, _ = _union(frame)
        row = {"block": int(frame["owner"].iloc[0]) << 32 | int(frame["bucket"].iloc[0]), "grp": int(frame["owner"].iloc[0]), "coded": golomb(values), "times": np.minimum(total, 255).astype(np.uint8).tobytes(), "members": frame["block"].tolist(), "parts": frame["coded"].tolist()}
        release()
        return pd.DataFrame([row])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            value = ungolomb(row["coded"])
            yield _messages(row["grp"] * subs + (value >> BITS), value & ((1 << BITS) - 1), np.frombuffer(row["times"], np.uint8).astype(np.int64), row["block"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            value = ungolomb(row["coded"])
            owner, others = row["grp"] * subs + (value >> BITS), np.zeros(len(value), np.uint8)
            for x in row["answer"]:
                a, b = np.searchsorted(owner, [x["owner"], x["owner"] + 1])
                others[a:b] = _unpacked(x["packed"], b - a, most)
            packed = [_packed(others[np.searchsorted(value, ungolomb(x))], most) for x in row["parts"]]
            n = len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(row["members"], pa.int64()), pa.array([row["grp"]] * n, pa.int64()), pa.array(packed, pa.binary())], ["block", "owner", "packed"])

    buckets = max(1, -(-blocks // groups))
    made = sent.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets))).groupBy("owner", "bucket").applyInPandas(merge, "block long, grp long, coded binary, times binary, members array<long>, parts array<binary>")
    relays = stored(made, "relays")
    told = _gathered(_owned(relays.select("block", "grp", "coded", "times").mapInArrow(lean(send), SENT), most))
    return relays.drop("times").join(told, "block").mapInArrow(lean(back), "block long, owner long, packed binary")


def answers(blocks: DataFrame, hashes: Callable[[dict], np.ndarray], columns: list[str], owners: int, most: int = 1, wide: int = WIDE) -> DataFrame:
    """For each block: answer, a list of (owner, packed): for each distinct value sent, in order, how often else it was
    sent, in this block or others, `most` (up to 254) at most. hashes: 64-bit hashes from a block's row, a dict of
    `columns` and block."""
    groups, subs = levels(owners, wide)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            owner, value = split(hashes(row), groups, subs)
            yield _messages(owner, value, np.ones(len(value), np.int64), row["block"])

    sent = blocks.select("block", *columns).mapInArrow(lean(send), SENT)
    return _gathered(_owned(sent, most) if subs == 1 else _relayed(sent, blocks.count(), groups, subs, most))


def unpack(hashes: np.ndarray, answer: list[dict], owners: int, most: int = 1, wide: int = WIDE) -> np.ndarray:
    """The answer for each of a block's hashes, in their order."""
    owner, value = split(hashes, *levels(owners, wide))
    order = np.lexsort((value, owner))
    owner, value, out = owner[order], value[order], np.zeros(len(hashes), np.uint8)
    for x in answer or []:
        a, b = np.searchsorted(owner, [x["owner"], x["owner"] + 1])
        place = np.cumsum(np.append(False, value[a + 1 : b] != value[a : b - 1])) if b > a else np.zeros(0, np.int64)
        out[order[a:b]] = _unpacked(x["packed"], int(place[-1]) + 1 if b > a else 0, most)[place]
    return out
