"""Jaccard joins of word-shingle sets by prefixes of tokens and of token combinations.

A document is the set of hashes of its n-word shingles. With a similarity of at least t, a set of n tokens misses at most
d(n) = n - ceil(t * n) of them in a partner. The prefix is extended to the 2 d(n) + 1 smallest hashes: two similar sets
then share at least k(n) = d(n) + 1 tokens of their prefixes, n being the smaller size. Only prefixes are exchanged.

1. Blocks keep each set's fingerprint, size and prefix. How often a prefix token occurs is counted by a packed exchange
   over all documents. A set with fewer than k tokens that any other set has is linked with nothing; the others are
   built whole, and their tokens counted among themselves by another exchange.
2. Tokens are ordered by frequency, rare ones first. Partners of sizes m <= n share at least a(m, n) = ceil(t / (1 + t)
   (m + n)) tokens, so the first m - a(m, m) + 1 of the smaller and n - a(m, n) + 1 of the larger one meet. Sets are
   indexed by narrow bands of the smaller one's size: once as the smaller, and in each band that it may probe as the
   larger one, with the prefix that the band needs. Rare tokens, below `rare` occurrences, are indexed alone: if the
   first common token is rare, it is in both prefixes. Else all common tokens are frequent: the prefixes are extended
   by a number of classes g, which the band fixes, so at least g + 1 tokens in them are common; dealt by hash into g
   classes two of them meet, and a set indexes the pairs of its frequent tokens within each class. No key is dropped
   and no list is cut.
3. Lists don't become pairs. In each list every set is first compared with one leader, a smaller one; the links found make groups; this
   is done again between groups, where each list has leaders of its own, 4 and then 16, so that a set meets many members of a family; only what remains of lists that still span groups is paired, and
   only across groups. Pairs inside a group can't change it. So a large family of near copies costs comparisons in
   proportion to its size.
4. A pair whose parity bitmaps (256 bits, each flipped once for each token that hashes to it) differ in more bits than
   similar sets of their sizes may differ in tokens is no candidate: bits never differ in more places than tokens.
   Candidates are verified on whole sets, which only documents in question build, from whole texts.

Equal sets are one class from the start (128-bit fingerprints; shingles are 64-bit hashes of 64-bit word hashes).

Cases: a text of fewer words is one shingle; null texts and texts without words are empty sets, linked with nothing, not
even each other; a null id is larger than any other and is told as null; repeated rows are linked; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from ._shared import LOWER, block_rows, discard, gram_hashes, lean, mix, partitions, raw, slices, stored, word_hashes, words
from .components import components

LAST = (1 << 63) - 1
LOW48 = np.uint64((1 << 48) - 1)


def sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, sorted within each text, and each text's offset in them (one more than texts)."""
    data, offs = raw(texts)
    start, end, first = words(LOWER[data], offs)
    h = word_hashes(LOWER[data], start, end)
    docs = len(offs) - 1
    size = np.diff(first)
    grams = gram_hashes(h, n)
    doc = np.repeat(np.arange(docs), size)
    inside = doc[: len(grams)] == doc[n - 1 :][: len(grams)] if len(grams) else np.zeros(0, bool)
    hashes, owner = [grams[inside]], [doc[: len(grams)][inside]]
    for k in np.flatnonzero((size > 0) & (size < n)).tolist():
        hashes.append(mix(gram_hashes(h[first[k] : first[k + 1]], int(size[k])) + np.uint64(size[k])))
        owner.append(np.array([k]))
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(docs + 1))


def prints(tokens: np.ndarray, offs: np.ndarray) -> list[bytes | None]:
    """128-bit fingerprints of sets; None for an empty one."""
    some = np.flatnonzero(np.diff(offs) > 0)
    out: list[bytes | None] = [None] * (len(offs) - 1)
    if len(some):
        both = np.stack([np.add.reduceat(mix(tokens ^ np.uint64(salt)), offs[some]) for salt in (0x51ED270B7F2C4A11, 0xA0761D6478BD642F)], 1)
        for k, x in zip(some.tolist(), both, strict=True):
            out[k] = x.astype(">u8").tobytes()
    return out


class Rule:
    """What a threshold of percent / 100 means for sets of n tokens."""

    def __init__(self, percent: int):
        self.percent = percent

    def lost(self, n):
        return n * (100 - self.percent) // 100

    def prefix(self, n):
        return np.minimum(n, 2 * self.lost(n) + 1)

    def least(self, n: int) -> int:
        """The smallest partner."""
        return -(-n * self.percent // 100)

    def common(self, n: int) -> int:
        """Prefix tokens shared with any partner."""
        return self.lost(self.least(n)) + 1

    def shared(self, m: int, n: int) -> int:
        """Common tokens of similar sets of m and n."""
        return -(-(m + n) * self.percent // (100 + self.percent))

    def band(self, n: int) -> int:
        return int(np.log(n) / np.log(1.03) + 1e-9)

    def bands(self, n: int) -> list[tuple[int, int, int]]:
        """(band, smallest partner in it, classes) of the smaller partners of a set of n tokens."""
        out, m = [], self.least(n)
        while m <= n:
            b = self.band(m)
            floor = int(np.ceil(1.03**b - 1e-6))
            out.append((b, m, 1 << max(1, (floor - self.shared(floor, floor)) // 4).bit_length() - 1))
            m = max(m + 1, int(np.ceil(1.03 ** (b + 1) - 1e-6)))
            while self.band(m - 1) > b and m - 1 > out[-1][1]:
                m -= 1
        return out


def pack48(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def blocks(docs: DataFrame, n: int, rule: Rule, block_tokens: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, marks, own, tokens, held, count, seen = [], [], [], [], [], 0, 0, set()
        names = ["block", "ids", "sizes", "marks", "own", "tokens"]

        def out() -> pa.RecordBatch:
            cols = [pa.array([TaskContext.get().partitionId() << 32 | count]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([marks], pa.list_(pa.binary())), pa.array([own], pa.list_(pa.bool_())), pa.array([b"".join(tokens)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in slices(batches, "text"):
            flat, offs = sets(batch.column("text"), n)
            each = np.diff(offs)
            keep = rule.prefix(each)
            for k, (doc, mark) in enumerate(zip(batch.column("doc_id").to_pylist(), prints(flat, offs), strict=True)):
                new = mark is not None and mark not in seen
                ids.append(doc)
                sizes.append(int(each[k]))
                marks.append(mark)
                own.append(new)
                if new:
                    seen.add(mark)
                    tokens.append(pack48(flat[offs[k] : offs[k] + keep[k]] & LOW48))
                    held += int(keep[k])
            if held >= block_tokens or len(ids) >= 100_000:
                yield out()
                ids, sizes, marks, own, tokens, held, count, seen = [], [], [], [], [], 0, count + 1, set()
        if ids:
            yield out()

    return stored(docs.mapInArrow(lean(run), "block long, ids array<long>, sizes array<int>, marks array<binary>, own array<boolean>, tokens binary"), "prefixes")


def token_keys(row: dict) -> np.ndarray:
    return mix(unpack48(row["tokens"]))


def survivors(blocks_: DataFrame, rule: Rule, owners: int) -> DataFrame:
    """mark of each set with enough prefix tokens that occur again."""
    told = exchange.answers(blocks_, token_keys, ["tokens"], owners)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            tokens = unpack48(row["tokens"])
            again = exchange.unpack(mix(tokens), row["answer"], owners)
            own = np.array(row["own"], bool)
            size = np.array(row["sizes"], np.int64)[own]
            cuts = np.append(0, np.cumsum(rule.prefix(size)))
            shared = np.diff(np.append(0, np.cumsum(again, dtype=np.int64))[cuts])
            marks = [m for m, o in zip(row["marks"], own, strict=True) if o]
            yield pa.RecordBatch.from_arrays([pa.array([marks[k] for k in np.flatnonzero(shared >= rule.common(size))], pa.binary())], ["mark"])

    joined = blocks_.select("block", "sizes", "marks", "own", "tokens").join(told, "block", "left")
    return stored(joined.mapInArrow(lean(run), "mark binary").distinct(), "survivors")


def _keys(tokens: np.ndarray, often: np.ndarray, order: np.ndarray, lost: int, band: int, g: int, rare: int) -> np.ndarray:
    alone = order[: lost + 1]
    salt = mix(np.array([band], np.uint64))
    out = [mix(tokens[alone[(often[alone] > 0) & (often[alone] < rare)]] ^ salt)]
    first = order[: lost + 1 + g]
    hot = np.sort(tokens[first[often[first] >= rare]])
    cls = (mix(hot) >> np.uint64(20)).astype(np.int64) & (g - 1)
    by = np.argsort(cls, kind="stable")
    t, c = hot[by], cls[by]
    for step in range(1, len(t)):
        same = np.flatnonzero(c[step:] == c[:-step])
        if not len(same):
            break
        out.append(mix(mix(t[same] ^ ~salt) + t[same + step]))
    return np.concatenate(out)


def keys_of(tokens: np.ndarray, often: np.ndarray, rule: Rule, rare: int) -> tuple[np.ndarray, np.ndarray]:
    """The index keys of a whole set, and which of them it has as the smaller partner. often: how often else a token occurs."""
    n = len(tokens)
    order = np.lexsort((tokens, often))
    keys, small = [], []
    for band, m, g in rule.bands(n):
        large = _keys(tokens, often, order, n - rule.shared(m, n), band, g, rare)
        own = _keys(tokens, often, order, n - rule.shared(n, n), band, g, rare) if band == rule.band(n) else large[:0]
        keys.append(large)
        small.append(np.isin(large, own))
    return np.concatenate(keys), np.concatenate(small)


BITS = ["b0", "b1", "b2", "b3"]


def repeated(marks: list[bytes], counts: list[int]) -> pa.Array:
    """Each mark (16 bytes) as often as its count says."""
    data = np.repeat(np.frombuffer(b"".join(marks), np.uint8).reshape(-1, 16), counts, axis=0)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32) * 16), pa.py_buffer(data.tobytes())])


def parity(tokens: np.ndarray) -> np.ndarray:
    """256 bits, each the parity of the number of tokens that hash to it."""
    cells = np.bincount((mix(tokens) >> np.uint64(40)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(cells.astype(np.uint8)).view("<i8")


def index(full: DataFrame, rule: Rule, owners: int, rare: int, block_tokens: int) -> DataFrame:
    """key, mark, n, small and bits: what sets are indexed under, in lists of two sets at least, one of them as the smaller."""
    names = ["block", "marks", "sizes", "tokens"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, sizes, tokens, held, count = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            cols = [pa.array([TaskContext.get().partitionId() << 32 | count]), pa.array([marks], pa.list_(pa.binary())), pa.array([sizes], pa.list_(pa.int32())), pa.array([b"".join(tokens)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            for mark, body in zip(batch.column("mark"), batch.column("tokens"), strict=True):
                marks.append(mark.as_py())
                sizes.append(len(body.as_buffer()) // 8)
                tokens.append(pack48(np.frombuffer(body.as_buffer(), "<u8") & LOW48))
                held += sizes[-1]
                if held >= block_tokens:
                    yield out()
                    marks, sizes, tokens, held, count = [], [], [], 0, count + 1
        if marks:
            yield out()

    held = stored(full.mapInArrow(lean(gather), "block long, marks array<binary>, sizes array<int>, tokens binary"), "set-blocks")
    told = exchange.answers(held, token_keys, ["tokens"], owners, 254)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            tokens = unpack48(row["tokens"])
            often = exchange.unpack(mix(tokens), row["answer"], owners, 254)
            at, keys, marks, counts, sizes, small, bits, last = 0, [], [], [], [], [], [], len(row["marks"]) - 1
            for k, (n, mark) in enumerate(zip(row["sizes"], row["marks"], strict=True)):
                got, role = keys_of(tokens[at : at + n], often[at : at + n], rule, rare)
                if len(got):
                    keys.append(got.view(np.int64))
                    small.append(role)
                    bits.append(parity(tokens[at : at + n]))
                    marks.append(mark)
                    counts.append(len(got))
                    sizes.append(n)
                at += n
                if keys and (sum(counts) > 20_000 or k == last):
                    each = np.repeat(np.stack(bits, 1), counts, axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), repeated(marks, counts), pa.array(np.repeat(np.array(sizes, np.int32), counts)), pa.array(np.concatenate(small)), *map(pa.array, each)], ["key", "mark", "n", "small", *BITS])
                    keys, marks, counts, sizes, small, bits = [], [], [], [], [], []

    found = stored(held.join(told, "block", "left").select("marks", "sizes", "tokens", "answer").mapInArrow(lean(run), "key long, mark binary, n int, small boolean, b0 long, b1 long, b2 long, b3 long"), "index")
    # Keys that a single set has are gone after the partial counts: no list is gathered. Stored, so that the join deals
    # both sides anew and may split a key with many sets.
    shared = found.groupBy("key").agg(F.min("mark").alias("low"), F.max("mark").alias("high"), F.max("small").alias("small")).where("low <> high and small")
    shared = stored(shared.select("key"), "shared-keys")
    out = stored(found.join(shared, "key", "left_semi"), "lists")
    discard(held, found, shared)
    return out


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int, bits: int = 25) -> DataFrame:
    """mark and tokens of each wanted set. wanted: mark, doc_id (null as LAST) of one document that has it.

    A filter of 2**bits bits, whatever the number wanted, lets most other documents pass by before their words are cut."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    cells = wanted.select(F.floor(slot / 64).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("bit"))
    table = np.zeros((1 << bits) // 64, np.int64)
    for r in cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect():
        table[r.cell] = r.bits
    cast = docs.sparkSession.sparkContext.broadcast(table)
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text").withColumn("slot", slot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = cast.value
        for batch in slices(batches, "text"):
            at = np.asarray(batch.column("slot"))
            keep = np.flatnonzero(filter_[at // 64] >> (at % 64) & 1)
            if len(keep):
                few = batch.take(pa.array(keep))
                flat, offs = sets(few.column("text"), n)
                flat = flat.astype("<u8")
                bodies = [flat[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(prints(flat, offs), pa.binary()), few.column("doc_id"), pa.array(bodies, pa.binary())], ["mark", "doc_id", "tokens"])

    made = rows.mapInArrow(lean(run), "mark binary, doc_id long, tokens binary")
    return stored(made.join(wanted, ["mark", "doc_id"], "left_semi").dropDuplicates(["mark"]).select("mark", "tokens"), "sets")


def verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs u, v of sets that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            a, b = batch.column("a"), batch.column("b")
            for k in range(batch.num_rows):  # without a copy of all sets of a batch
                x, y = np.frombuffer(a[k].as_buffer(), np.uint64), np.frombuffer(b[k].as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("u", "v")], ["u", "v"])

    left = pairs.join(full.select(F.col("mark").alias("u"), F.col("tokens").alias("a")), "u")
    return left.join(full.select(F.col("mark").alias("v"), F.col("tokens").alias("b")), "v").select("u", "v", "a", "b").mapInArrow(lean(run), "u binary, v binary")


def linked(docs: DataFrame, shingle: int = 4, percent: int = 85, rare: int = 24, rounds: int = 3, block_tokens: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rule = Rule(percent)
    stored_ = blocks(docs, shingle, rule, block_tokens)
    total = stored_.agg(F.sum(F.length("tokens") / 6)).first()[0] or 0
    owners = max(partitions(docs.sparkSession), int(total) // (4 << 20))
    live = survivors(stored_, rule, owners)
    members = stored_.select(F.explode(F.arrays_zip("ids", "sizes", "marks")).alias("x")).select(F.col("x.ids").alias("doc_id"), F.col("x.sizes").alias("n"), F.col("x.marks").alias("mark"))
    wanted = members.where("mark is not null").groupBy("mark").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("doc_id")).join(live, "mark", "left_semi")
    full = whole_sets(docs, wanted, shingle)
    count = full.agg(F.sum(F.length("tokens") / 8)).first()[0] or 0
    lists = index(full, rule, max(partitions(docs.sparkSession), int(count) // (4 << 20)), rare, block_tokens)

    differ = " + ".join(f"bit_count(u{b} ^ v{b})" for b in BITS)
    near = f"{differ} <= nu + nv - 2 * (((nu + nv) * {percent} + {99 + percent}) div {100 + percent}) and least(nu, nv) * 100 >= greatest(nu, nv) * {percent}"
    roots, lists_ = None, lists
    for step in range(rounds + 1):
        rows = lists.withColumn("group", F.col("mark"))
        if roots is not None:
            rows = lists.join(roots.select(F.col("node").alias("mark"), "root"), "mark", "left").select("key", "mark", "n", "small", *BITS, F.coalesce("root", "mark").alias("group"))
            open_ = stored(rows.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("key"), "open-keys")
            rows = stored(rows.join(open_, "key", "left_semi"), "lists")
            discard(lists_, open_)
            lists_ = rows
            lists = rows.drop("group")
            if lists.isEmpty():
                break
        v = rows.select("key", F.col("mark").alias("v"), F.col("n").alias("nv"), F.col("group").alias("gv"), *[F.col(b).alias(f"v{b}") for b in BITS])
        u = rows.where("small").select("key", F.col("mark").alias("u"), F.col("n").alias("nu"), F.col("group").alias("gu"), *[F.col(b).alias(f"u{b}") for b in BITS])
        if step < rounds:
            # One leader of like lists at first; then each list has 4, and 16, of its own, so that a set meets many.
            least = [F.min(F.struct(F.xxhash64("u", *(["key"] if step else []), F.lit(step), F.lit(k)).alias("h"), "u", "nu", "gu", *[f"u{b}" for b in BITS])).alias(f"l{k}") for k in range(4**step)]
            leaders = u.groupBy("key").agg(*least).select("key", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"l{k}")[c].alias(c) for c in ("u", "nu", "gu", *(f"u{b}" for b in BITS))]) for k in range(4**step)]))).alias("lead"))
            pairs = v.join(stored(leaders.select("key", "lead.*"), "leaders"), "key")
        else:
            # What still spans groups, across groups only.
            pairs = v.join(u, "key").where("nu <= nv")
        pairs = pairs.where(f"gu <> gv and {near}").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        new = stored(verified(pairs, full, percent), "links")
        if roots is None:
            roots = components(new)
        elif not new.isEmpty():  # what was joined before goes on as a star
            roots = components(new.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    # Of each set that several documents have or that is linked: the least document of its component.
    least = members.where("mark is not null").groupBy("mark").agg(F.min("doc_id").alias("low"), F.count("*").alias("times"))
    nodes = stored(roots.select(F.col("node").alias("mark"), "root").union(roots.select(F.col("root").alias("mark"), "root").distinct()), "roots")
    own = stored(least.join(nodes, "mark", "left").where("times > 1 or root is not null").select("mark", "low", F.coalesce("root", "mark").alias("root")), "sets")
    lowest = stored(own.groupBy("root").agg(F.min("low").alias("least")), "least")
    ends = stored(own.join(lowest, "root").select("mark", "least"), "components")
    some = members.where("mark is not null").join(ends.withColumn("found", F.lit(True)), "mark", "left").select("doc_id", "n", F.when(F.col("found"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
    none = members.where("mark is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d
), e AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
), k AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), c(u, v) AS (
  SELECT u, v FROM k UNION SELECT c.u, k.v FROM c JOIN k ON c.v = k.u
), m AS (
  SELECT u, min(v) AS low FROM c GROUP BY u
)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id FROM s LEFT JOIN m ON s.doc_id = m.u
"""
