"""What the corpus operators share: the folder for intermediate tables, Arrow batches, word arrays and hashes.

A worker's memory is bounded by three numbers: bytes of an Arrow batch (BATCH), bytes of text worked on at once (SLICE; a
longer text alone), and the entries of tables that a worker keeps. What a task leaves free goes back to the system.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. All work
is done on UTF-8 bytes: those separators never occur inside a multi-byte character.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE = 1 << 19
BATCH = 4 << 20
BASE = 0xD1342543DE82EF95
_M = np.uint64
_tables: dict[str, np.ndarray] = {}
WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. A local session without one (a test) gets a local one; a cluster must name it."""
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not (found := getattr(spark, "_own_shared_folder", None)):
            found = spark._own_shared_folder = tempfile.mkdtemp(prefix="shared-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table to the shared folder and read it back: a lost executor costs no recomputation beyond it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    small_batches(spark)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again: all that was made from them is stored itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session are cut by bytes too, not by rows alone: rows here may hold a whole block of documents."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def release() -> None:
    """Give freed memory back to the system: workers are reused, and would keep the most that any task took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function, giving memory back at its end. With block rows in, one row at a time comes in."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return held


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows that hold a block each, one by one."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column's texts have about `limit` bytes at most, or one row."""
    for batch in batches:
        at, n = 0, batch.num_rows
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
        while at < n:
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, null as empty, and each row's offset in them (one more than rows)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and each row's offset in them (one more than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~WS[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> _M(30))
    h = h * _M(0xBF58476D1CE4E5B9)
    h ^= h >> _M(27)
    h *= _M(0x94D049BB133111EB)
    return h ^ (h >> _M(31))


def powers(n: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of a base and of its inverse; made once, for SLICE."""
    if "up" not in _tables:
        for key, x in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            run = np.full(SLICE + 1, x, np.uint64)
            run[:1] = 1
            _tables[key] = np.cumprod(run)
    return _tables["up"][: n + 1], _tables["down"][: n + 1]


def byte_cells() -> np.ndarray:
    if "byte" not in _tables:
        _tables["byte"] = mix(np.arange(1, 257, dtype=np.uint64) * _M(0x9E3779B97F4A7C15))
    return _tables["byte"]


def _long_span(cells: np.ndarray, part: np.ndarray) -> int:
    """The polynomial of a span of any length, chunk by chunk."""
    up, total = powers()[0], 0
    for a in range(0, len(part), SLICE):
        x = cells[part[a : a + SLICE]]
        total += int((x * up[: len(x)]).sum(dtype=np.uint64)) * pow(BASE, a, 1 << 64)
    return total % (1 << 64)


def span_hashes(cells: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of data, the same wherever it stands: a polynomial of its symbols' cells. Spans are in
    order, apart; SLICE symbols at most are worked on at once."""
    out, at, n = np.empty(len(start), np.uint64), 0, len(start)
    up, down = powers()
    while at < n:
        to = int(np.searchsorted(end, start[at] + SLICE, side="right"))
        if to <= at:
            out[at] = mix(np.array([_long_span(cells, data[start[at] : end[at]])], np.uint64) + _M(end[at] - start[at]))[0]
            at += 1
            continue
        a, b = int(start[at]), int(end[to - 1])
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(cells[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = start[at:to] - a, end[at:to] - a
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    return span_hashes(byte_cells(), data, start, end)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive word hashes; in doubling steps."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    have, out = 1, h.copy()
    while have < n:
        step = min(have, n - have)
        out = mix(out[: len(out) - step] * _M(0x9FB21C651E98DF25) + out[step:] + _M(have))
        have += step
    return out


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words with one space between."""
    if not len(start):
        return b""
    each = end - start + 1
    at = np.repeat(start - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    part = data[np.minimum(at, len(data) - 1)]
    part[np.cumsum(each) - 1] = 32
    return part[:-1].tobytes()
