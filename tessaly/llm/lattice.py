"""Document likelihood over all segmentations into an existing vocabulary's pieces.

A word is a space and its bytes; a text is its words in turn and an end. Words are made of pieces of an existing subword
vocabulary (its single bytes included, so every word can be made), and a text's probability sums over every way to cut
its words: log-space forward recursion over the lattice of pieces, word by word. Piece weights start from the
vocabulary's scores (ranks, as Zipf's law has them) and are re-estimated on the training documents' distinct words by
expectation maximisation: forward and backward over the same lattices. A training word also has an arc of its own, with
its discounted frequency; the lattice's other ways share what is discounted. All lower-case pieces of the vocabulary
count, whatever their length; a word of any length is computed, the recursion of a long one (over LONG bytes) by a
window that slides along it.

Words are counted exactly. A block of documents sends the owner of each word's hash the word once, with its count in
training documents. Owners add up counts, and hold each distinct word once, so each lattice is computed once for the
corpus, not once for each occurrence. Blocks ask again and get counts and log probabilities of their words, and sum them
by document. Only a table of pieces (the vocabulary, of fixed size) ever reaches the driver.

Cases: null, empty and blank texts are an end alone; without training documents the vocabulary's own weights score, and
the base is 1 for each token; repeated rows are each scored and each counted; a null id is not held out; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from math import exp, inf, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import LOWER, block_rows, byte_cells, lean, partitions, powers, raw, release, slices, stored, word_hashes, words
from .exchange import golomb, ungolomb

_made: dict = {}
CHUNK = 512
LONG = 512
BLOCK = "block long, ids array<long>, held array<boolean>, sizes array<int>, pairs binary, times binary, hashes binary, lengths binary, letters binary, counts binary"


class Pieces:
    """The vocabulary as bytes, a space standing for its mark of a word's start. Piece ids are places in this list."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found: dict[bytes, float] = {}
        n = model.get_piece_size()
        for i in range(n):
            if model.is_byte(i):
                found.setdefault(bytes([int(model.id_to_piece(i)[3:-1], 16)]), 2.0 * n)
            elif not (model.is_unknown(i) or model.is_control(i)):
                text = model.id_to_piece(i).replace("▁", " ")
                data = text.encode()
                if " " not in text[1:] and data == data.lower():
                    found[data] = min(found.get(data, 2.0 * n), max(0.0, -model.get_score(i)) if model.get_score(i) > -1e8 else 2.0 * n)
        self.all = sorted(found)
        self.longest = max(map(len, self.all))
        self.first = -np.log(np.array([found[x] for x in self.all]) + 20.0)
        self.first -= np.logaddexp.reduce(self.first)
        rows = [self.hash_rows(np.frombuffer(x, np.uint8)[None, :]) for x in self.all]
        h = np.array([self.cut(r, 0, len(x))[0] for r, x in zip(rows, self.all, strict=True)], np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]

    @staticmethod
    def hash_rows(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = table.shape[1]
        up, down = powers(n)
        sums = np.zeros((len(table), n + 1), np.uint64)
        np.cumsum(byte_cells()[table] * up[:n], axis=1, out=sums[:, 1:])
        return sums, down

    @staticmethod
    def cut(rows: tuple[np.ndarray, np.ndarray], a: int, b: int) -> np.ndarray:
        return (rows[0][:, b] - rows[0][:, a]) * rows[1][a] + np.uint64(b - a)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids, or the number of pieces where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], len(self.all)).astype(np.int32)


def pieces(path: str) -> Pieces:
    if path not in _made:
        _made[path] = Pieces(path)
    return _made[path]


def _sum(terms: list[np.ndarray]) -> np.ndarray:
    """Logarithm of a sum of exponentials."""
    table = np.stack(terms)
    top = table.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(table - safe).sum(axis=0))


def _arcs(vocabulary: Pieces, word: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and piece of the arcs that start from low to high, in order of start."""
    sums, down = vocabulary.hash_rows(word[None, low : high + vocabulary.longest])
    place, size = np.arange(high - low)[:, None], np.arange(1, vocabulary.longest + 1)[None, :]
    end = np.minimum(place + size, sums.shape[1] - 1)
    found = vocabulary.find((sums[0][end] - sums[0][place]) * down[place] + size.astype(np.uint64))
    start, k = np.nonzero((found < len(vocabulary.all)) & (place + size == end))
    return start + low, start + low + k + 1, found[start, k]


def long_likelihood(vocabulary: Pieces, lp: np.ndarray, word: np.ndarray, times: float, used: np.ndarray | None, chunk: int = 4096) -> float:
    """The same for one long word (its space included); holds one number for each byte and the arcs of a chunk."""
    n = len(word)
    ahead = array("d", [0.0]) + array("d", [-inf]) * n
    for low in range(0, n, chunk):
        start, end, piece = _arcs(vocabulary, word, low, min(n, low + chunk))
        for s, e, w in zip(start.tolist(), end.tolist(), lp[piece].tolist(), strict=True):
            x, y = ahead[s] + w, ahead[e]
            if x > -inf:
                ahead[e] = x if y == -inf else max(x, y) + log1p(exp(-abs(x - y)))
    if used is not None:
        back, forward = array("d", [-inf]) * n + array("d", [0.0]), np.frombuffer(ahead)
        for low in range((n - 1) // chunk * chunk, -1, -chunk):
            start, end, piece = _arcs(vocabulary, word, low, min(n, low + chunk))
            for s, e, w in zip(start[::-1].tolist(), end[::-1].tolist(), lp[piece][::-1].tolist(), strict=True):
                x, y = back[e] + w, back[s]
                if x > -inf:
                    back[s] = x if y == -inf else max(x, y) + log1p(exp(-abs(x - y)))
            share = np.exp(forward[start] + lp[piece] + np.frombuffer(back)[end] - ahead[n]) * times
            used += np.bincount(piece, weights=share, minlength=len(used))
    return ahead[n]


def likelihood(vocabulary: Pieces, weights: np.ndarray, letters: np.ndarray, lengths: np.ndarray, counts: np.ndarray | None = None, most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of each word (letters: all words' bytes), and with counts the expected uses of each piece."""
    n = len(vocabulary.all)
    lp = np.append(weights, -np.inf)
    out, used = np.zeros(len(lengths)), np.zeros(n + 1)
    starts = np.cumsum(lengths) - lengths
    for k in np.flatnonzero(lengths > LONG).tolist():
        word = np.append(np.uint8(32), letters[starts[k] : starts[k] + lengths[k]])
        out[k] = long_likelihood(vocabulary, lp, word, 0.0 if counts is None else float(counts[k]), None if counts is None else used)
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] <= LONG]
    at = 0
    while at < len(order):
        size = int(lengths[order[at]])
        reach = np.searchsorted(lengths[order], size + 1 + size // 8, side="right")
        to = min(int(reach), at + max(1, most // ((size + 2 + size // 8) * vocabulary.longest)))
        own = order[at:to]
        at = to
        long, m = int(lengths[own].max()) + 1, len(own)
        table = np.zeros((m, long), np.uint8)
        table[:, 0] = 32
        inside = np.arange(long - 1)[None, :] < lengths[own][:, None]
        where = starts[own][:, None] + np.arange(long - 1)[None, :]
        table[:, 1:][inside] = letters[where[inside]]
        rows = vocabulary.hash_rows(table)
        found = {(e - j, e): vocabulary.find(vocabulary.cut(rows, e - j, e)) for e in range(1, long + 1) for j in range(1, min(e, vocabulary.longest) + 1)}
        ahead = np.full((long + 1, m), -np.inf)
        ahead[0] = 0
        for e in range(1, long + 1):
            ahead[e] = _sum([ahead[s] + lp[found[s, e]] for s in range(max(0, e - vocabulary.longest), e)])
        ends = lengths[own] + 1
        total = ahead[ends, np.arange(m)]
        out[own] = total
        if counts is not None:
            back = np.full((long + 1, m), -np.inf)
            times = counts[own].astype(float)
            for s in range(long, -1, -1):
                done = np.where(ends == s, 0.0, -np.inf)
                nexts = range(s + 1, min(long, s + vocabulary.longest) + 1)
                back[s] = _sum([done, *[back[e] + lp[found[s, e]] for e in nexts]])
                for e in nexts:
                    got = found[s, e]
                    with np.errstate(invalid="ignore"):
                        share = np.exp(ahead[s] + lp[got] + back[e] - total) * times
                    used += np.bincount(got, weights=np.where(got < n, share, 0.0), minlength=n + 1)
    return out, used[:n]


def _z(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def _unz(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def blocks(docs: DataFrame, block_words: int) -> DataFrame:
    """docs: doc_id, text, held. Words of a block are numbered in the order of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"n": 0}

        def clear() -> None:
            state.update(ids=[], held=[], sizes=[], doc=[], h=[], new=[], lengths=[], letters=[], words=0, docs=0)

        def out() -> pa.RecordBatch:
            h, doc = np.concatenate([*state["h"], np.zeros(0, np.uint64)]), np.concatenate([*state["doc"], np.zeros(0, np.int64)])
            new, lengths, letters = np.concatenate([*state["new"], np.zeros(0, np.uint64)]), np.concatenate([*state["lengths"], np.zeros(0, np.int64)]), np.concatenate([*state["letters"], np.zeros(0, np.uint8)])
            hashes, first = np.unique(new, return_index=True)
            starts = np.cumsum(lengths) - lengths
            size = lengths[first]
            spot = np.repeat(starts[first] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            word = np.searchsorted(hashes, h)
            learn = ~np.array(state["held"], bool)
            counts = np.bincount(word, weights=learn[doc], minlength=len(hashes)).astype("<u4")
            pairs, times = np.unique(doc * max(1, len(hashes)) + word, return_counts=True)
            row = [TaskContext.get().partitionId() << 32 | state["n"], state["ids"], state["held"], state["sizes"], golomb(pairs), _z(times.astype("<u4")), hashes.astype("<u8").tobytes(), _z(size.astype("<u4")), zlib.compress(letters[spot].tobytes(), 1), _z(counts)]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [x.split(" ")[0] for x in BLOCK.split(", ")])

        clear()
        for batch in slices(batches, "text"):
            data, offs = raw(batch.column("text"))
            data = LOWER[data]
            start, end, first = words(data, offs)
            h = word_hashes(data, start, end)
            size = np.diff(first)
            state["doc"].append(np.repeat(np.arange(len(size)), size) + state["docs"])
            state["h"].append(h)
            new, at = np.unique(h, return_index=True)
            state["new"].append(new)
            state["lengths"].append(end[at] - start[at])
            each = end[at] - start[at]
            state["letters"].append(data[np.repeat(start[at] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))])
            state["ids"] += batch.column("doc_id").to_pylist()
            state["held"] += batch.column("held").to_pylist()
            state["sizes"] += size.tolist()
            state["words"] += len(h)
            state["docs"] += len(size)
            if state["words"] >= block_words or state["docs"] >= 200_000:
                yield out()
                clear()
                state["n"] += 1
        if state["docs"]:
            yield out()

    return stored(docs.mapInArrow(lean(run), BLOCK), "word-blocks")


def _requests(blocks_: DataFrame, owners: int, with_words: bool) -> DataFrame:
    columns = ["hashes", "lengths", "letters", "counts"] if with_words else ["hashes"]
    kind = "owner int, block long, coded binary" + (", lengths binary, letters binary, counts binary" if with_words else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            h = np.frombuffer(row["hashes"], "<u8")
            owner = (h % np.uint64(owners)).astype(np.int64)
            if with_words:
                size, letters, counts = _unz(row["lengths"], "<u4").astype(np.int64), _unz(row["letters"], np.uint8), _unz(row["counts"], "<u4")
                starts = np.cumsum(size) - size
            by, got = np.argsort(owner, kind="stable"), []
            for at in np.split(by, np.flatnonzero(np.diff(owner[by])) + 1) if len(by) else ():
                rest = ()
                if with_words:
                    each = size[at]
                    spot = np.repeat(starts[at] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
                    rest = (_z(each.astype("<u4")), zlib.compress(letters[spot].tobytes(), 1), _z(counts[at]))
                got.append((int(owner[at[0]]), row["block"], golomb(h[at] >> np.uint64(8)), *rest))
            names = [x.split(" ")[0] for x in kind.split(", ")]
            cols = list(zip(*got, strict=True)) or [()] * len(names)
            types = [pa.int32(), pa.int64(), *[pa.binary()] * (len(names) - 2)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return blocks_.select("block", *columns).mapInArrow(lean(run), kind)


def counted(blocks_: DataFrame, owners: int) -> DataFrame:
    """One row for each owner: its distinct words, in order of hash, and their training counts."""

    def own(frame: pd.DataFrame) -> pd.DataFrame:
        values = [ungolomb(x) for x in frame["coded"]]
        lengths = np.concatenate([_unz(x, "<u4") for x in frame["lengths"]]).astype(np.int64)
        letters = np.concatenate([_unz(x, np.uint8) for x in frame["letters"]])
        counts = np.concatenate([_unz(x, "<u4") for x in frame["counts"]])
        keys, first, where = np.unique(np.concatenate(values), return_index=True, return_inverse=True)
        total = np.bincount(where, weights=counts).astype("<i8")
        starts = (np.cumsum(lengths) - lengths)[first]
        each = lengths[first]
        spot = np.repeat(starts - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        row = {"owner": int(frame["owner"].iloc[0]), "coded": golomb(keys), "lengths": _z(each.astype("<u4")), "letters": zlib.compress(letters[spot].tobytes(), 1), "counts": _z(total), "n": int(total.sum()), "v": int((total > 0).sum()), "n1": int((total == 1).sum()), "n2": int((total == 2).sum())}
        release()
        return pd.DataFrame([row])

    kind = "owner int, coded binary, lengths binary, letters binary, counts binary, n long, v long, n1 long, n2 long"
    return stored(_requests(blocks_, owners, True).groupBy("owner").applyInPandas(own, kind), "vocabulary")


def trained(vocabulary: DataFrame, path: str, rounds: int) -> np.ndarray:
    """Log weights of pieces, after some rounds of expectation maximisation over all distinct training words."""
    weights = pieces(path).first
    for _ in range(rounds):
        held = weights

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own, total = pieces(path), None
            for row in block_rows(batches):
                counts, size = _unz(row["counts"], "<i8"), _unz(row["lengths"], "<u4").astype(np.int64)
                letters = _unz(row["letters"], np.uint8)
                seen = counts > 0
                _, used = likelihood(own, held, letters[np.repeat(seen, size)], size[seen], np.ones(int(seen.sum())))
                total = used if total is None else total + used
            if total is not None:
                cuts = range(0, len(total), CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array(list(cuts), pa.int32()), pa.array([total[c : c + CHUNK].astype("<f8").tobytes() for c in cuts], pa.binary())], ["first", "used"])

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(x, "<f8") for x in frame["used"]], axis=0)
            return pd.DataFrame({"first": [int(frame["first"].iloc[0])], "used": [total.tobytes()]})

        kind = "first int, used binary"
        got = vocabulary.select("lengths", "letters", "counts").mapInArrow(lean(expect), kind).groupBy("first").applyInPandas(add, kind).collect()
        if not got:
            break
        used = np.full(len(weights), 0.05)
        for r in got:
            used[r["first"] : r["first"] + CHUNK] += np.frombuffer(r.used, "<f8")
        weights = np.log(used / used.sum())
    return weights


def scored(docs: DataFrame, path: str, held_out: Column, rounds: int = 2, block_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the last two in log10."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held"))
    stored_ = blocks(rows, block_words)
    size, ends = stored_.agg(F.sum(F.length("hashes") / 8), F.sum(F.size(F.filter("held", lambda x: ~x)))).first()
    owners, ends = max(partitions(docs.sparkSession), int(size or 0) // 1_000_000), int(ends or 0)
    vocabulary = counted(stored_, owners)
    n, types, n1, n2 = (int(x or 0) for x in vocabulary.agg(F.sum("n"), F.sum("v"), F.sum("n1"), F.sum("n2")).first())
    n, v = n + ends, types + (ends > 0)
    weights = trained(vocabulary, path, rounds)
    less = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    new = float(np.log(less * types / n)) if types else float(np.log(0.999))
    end = float(np.log(ends / n if ends else 0.001))
    if not types and ends:
        new = float(np.log(1e-3))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for row in block_rows(batches):
            got, _ = likelihood(own, weights, _unz(row["letters"], np.uint8), _unz(row["lengths"], "<u4").astype(np.int64))
            seen = _unz(row["counts"], "<i8")
            got += new
            got[seen > 0] = np.logaddexp(got[seen > 0], np.log((seen[seen > 0] - less) / n))
            yield pa.RecordBatch.from_arrays([pa.array([row["owner"]], pa.int32()), pa.array([row["coded"]], pa.binary()), pa.array([row["counts"]], pa.binary()), pa.array([got.astype("<f8").tobytes()], pa.binary())], ["owner_", "keys", "counts", "logs"])

    known = vocabulary.select("owner", "coded", "lengths", "letters", "counts").mapInArrow(lean(score), "owner_ int, keys binary, counts binary, logs binary")

    def answer(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        keys, counts, logs = ungolomb(own["keys"].iloc[0]), _unz(own["counts"].iloc[0], "<i8"), np.frombuffer(own["logs"].iloc[0], "<f8")
        at = [np.searchsorted(keys, ungolomb(x)) for x in asked["coded"]]
        release()
        return pd.DataFrame({"block": asked["block"], "owner": asked["owner"], "counts": [_z(counts[x]) for x in at], "logs": [logs[x].tobytes() for x in at]})

    told = _requests(stored_, owners, False).groupBy("owner").cogroup(known.groupBy("owner_")).applyInPandas(answer, "block long, owner int, counts binary, logs binary")
    told = told.groupBy("block").agg(F.collect_list(F.struct("owner", "counts", "logs")).alias("answer"))
    none = float(np.log10(n + v + 1))
    last = float(np.log10(ends + 1)) - none

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in block_rows(batches):
            h = np.frombuffer(row["hashes"], "<u8")
            counts, logs = np.zeros(len(h), np.int64), np.zeros(len(h))
            owner = (h % np.uint64(owners)).astype(np.int64)
            by = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[by], np.arange(owners + 1))
            for x in row["answer"] or []:
                at = by[cuts[x["owner"]] : cuts[x["owner"] + 1]]
                counts[at], logs[at] = _unz(x["counts"], "<i8"), np.frombuffer(x["logs"], "<f8")
            pairs, times = ungolomb(row["pairs"]), _unz(row["times"], "<u4").astype(float)
            doc, word = pairs // max(1, len(h)), pairs % max(1, len(h))
            m = len(row["ids"])
            each = lambda w: np.bincount(doc, weights=times * w, minlength=m)
            size = np.array(row["sizes"], np.int64)
            base = each(np.log10(counts + 1.0)[word] - none) + last
            full = (each(logs[word]) + end) / np.log(10)
            seen = each((counts > 0)[word].astype(float)).astype(np.int64) + (ends > 0)
            cols = [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(size + 1), pa.array(seen), pa.array(np.full(m, n)), pa.array(base), pa.array(full)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    both = stored_.select("block", "ids", "held", "sizes", "pairs", "times", "hashes").join(told, "block", "left").select("ids", "held", "sizes", "pairs", "times", "hashes", "answer")
    return both.mapInArrow(lean(total), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), held)
