"""Encoding with a public byte-level BPE tokenizer, exact and fast where pre-tokens repeat.

Merges never cross pre-tokens, so a text's ids are its pre-tokens' ids in order. Pre-tokens are found for a whole batch
of texts at once with numpy (the pattern's rules as operations on character classes), identified by 64-bit hashes and
looked up in a table; the library's model encodes each unknown one. A full table (some 40 MB) is emptied. A text with one of the few
characters on whose class regular expression engines differ goes to the library whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

from ._shared import mix, span_hashes

#: Classes of these differ between engines; so do those of code points without a category.
ODD = [0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x180E, 0x200B, 0xFEFF]
_U = np.uint64
_made: dict = {}


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte: itself, or the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b if b in own else next(free)) for b in range(256)}


def classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 letter, 2 number, 3 anything else, 4 left to the library."""
    if "classes" not in _made:
        kinds = {"L": 1, "N": 2}
        out = np.fromiter((4 if (c := unicodedata.category(chr(x))) in ("Cn", "Co") else kinds.get(c[0], 3) for x in range(0x110000)), np.uint8, 0x110000)
        out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
        out[ODD] = 4
        _made["classes"] = out
        _made["code"] = mix(np.arange(1, 0x110001, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    return _made["classes"]


def starts(codes: np.ndarray, kind: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts laid end to end; kind: their classes; offs: where texts start, and the end."""
    n = len(codes)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.zeros(n, bool)  # a white space before something else of its text
    last[:-1] = (kind[:-1] == 0) & (kind[1:] != 0) & ~edge[1:n]
    at = np.flatnonzero(last)
    start[at] = True
    start[at[codes[at] == 32] + 1] = False
    quote = np.flatnonzero((codes == 39) & start)
    padded = np.append(codes, np.zeros(3, codes.dtype))
    ends = np.append(edge, [True, True, True])
    one, two = padded[quote + 1], padded[quote + 2]
    for size, found in ((2, np.isin(one, [100, 109, 115, 116])), (3, (two == 101) & ((one == 114) | (one == 118)) | (one == 108) & (two == 108))):
        inside = quote[found]
        for k in range(1, size):
            inside = inside[~ends[inside + k]]
        for k in range(1, size):
            start[inside + k] = False
        after = inside + size
        start[after[after < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """special: strings of special tokens are ordinary text. most: entries that the table holds."""

    def __init__(self, path: str, special: bool = True, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special
        self.model = self.whole.model
        self.letters = str.maketrans({chr(b): x for b, x in byte_letters().items()})
        self.special, self.most = special, most
        classes()
        self.clear()

    def clear(self, slots: int = 1 << 17) -> None:
        self.keys, self.at, self.n = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Each hash's slot, or minus one."""
        mask = _U(len(self.keys) - 1)
        slot = (h & mask).astype(np.int64)
        got = self.keys[slot]
        open_ = np.flatnonzero((got != h) & (got != 0))
        slot[got == 0] = -1
        step = slot[open_]
        while len(open_):
            step = (step + 1) & int(mask)
            got = self.keys[step]
            hit, empty = got == h[open_], got == 0
            slot[open_[hit]] = step[hit]
            slot[open_[empty]] = -1
            go = ~(hit | empty)
            open_, step = open_[go], step[go]
        return slot

    def put(self, h: np.ndarray, at: np.ndarray) -> None:
        """Distinct hashes that the table lacks."""
        if self.n + len(h) > len(self.keys) // 2:
            old = self.keys != 0
            h, at = np.append(h, self.keys[old]), np.append(at, self.at[old])
            slots = len(self.keys)
            while len(h) > slots // 4:
                slots *= 2
            self.keys, self.at, self.n = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), 0
        self.n += len(h)
        mask = len(self.keys) - 1
        slot = (h & _U(mask)).astype(np.int64)
        while len(h):
            free = np.flatnonzero(self.keys[slot] == 0)
            self.keys[slot[free]] = h[free]
            won = self.keys[slot] == h
            self.at[slot[won]] = at[won]
            h, at, slot = h[~won], at[~won], (slot[~won] + 1) & mask

    def learn(self, h: np.ndarray, tokens: list[str]) -> None:
        rows = [[x.id for x in self.model.tokenize(t.encode().decode("latin-1").translate(self.letters))] for t in tokens]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(len(self.ids), np.uint32))
        self.ids[self.used : self.used + len(flat)] = flat
        first = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        self.put(h, first << 24 | sizes)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and each text's offset in them (one more than texts)."""
        text = "".join(texts)
        offs = np.cumsum([0, *map(len, texts)])
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = classes()[codes]
        if not self.special or (kind == 4).any():
            odd = np.add.reduceat(np.append(kind == 4, False).astype(np.int64), offs[:-1]) * (offs[1:] > offs[:-1])
            rows = [np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) if x or not self.special else self.batch([t])[0] for t, x in zip(texts, odd, strict=True)]
            return np.concatenate([*rows, np.zeros(0, np.uint32)]), np.cumsum([0, *map(len, rows)])
        if not text:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        begin = starts(codes, kind, offs)
        end = np.append(begin[1:], len(codes))
        h = self.hashes(codes, begin, end)
        if self.n > self.most:
            self.clear()
        slot = self.find(h)
        if len(miss := np.flatnonzero(slot < 0)):
            new, where = np.unique(h[miss], return_index=True)
            where = miss[where]
            self.learn(new, [text[a:b] for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)])
            slot = self.find(h)
        packed = self.at[slot]
        sizes, first = packed & 0xFFFFFF, packed >> 24
        total = np.cumsum(sizes)
        ids = self.ids[np.repeat(first - total + sizes, sizes) + np.arange(total[-1])]
        return ids, np.append(0, total)[np.searchsorted(begin, offs)]

    def hashes(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = span_hashes(_made["code"], codes, begin, end)
        h[h == 0] = 1
        return h


def encoder(path: str, special: bool = True) -> Encoder:
    """One for each worker process and file."""
    if (path, special) not in _made:
        _made[path, special] = Encoder(path, special)
    return _made[path, special]
