"""One-to-one assignment on small weight matrices; a null weight forbids the pair, and nodes may stay alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRS = "array<struct<i:int,j:int>>"


def best_pairs(weights: list[list[float | None]], by_count: bool = False) -> list[tuple[int, int]]:
    """Pairs of the largest total weight (or the most pairs). Of equal totals the first in lexical order of rows' choices."""
    if len({len(r) for r in weights}) > 1:
        raise ValueError("rows of a weight matrix differ in length")
    n, m = len(weights), len(weights[0]) if weights else 0
    if not n or not m:
        return []
    gain = np.array([[-1.0 if w is None or w != w or w < 0 else 1.0 if by_count else w for w in r] for r in weights])
    return _by_subsets(gain) if m <= 12 else _in_order(gain)


def _by_subsets(gain: np.ndarray) -> list[tuple[int, int]]:
    """Exact over subsets of columns; rows from the last to the first."""
    n, m = gain.shape
    full = 1 << m
    used = np.arange(full)
    best = np.zeros(full)
    choice = np.full((n, full), -1)
    for i in range(n - 1, -1, -1):
        now, pick = best.copy(), np.full(full, -1)
        for j in range(m - 1, -1, -1):
            if gain[i, j] >= 0:
                free = used & (1 << j) == 0
                with_j = np.where(free, gain[i, j] + best[used | (1 << j)], -np.inf)
                better = with_j >= now
                now, pick = np.where(better, with_j, now), np.where(better, j, pick)
        best, choice[i] = now, pick
    out, mask = [], 0
    for i in range(n):
        j = int(choice[i, mask])
        if j >= 0:
            out.append((i, j))
            mask |= 1 << j
    return out


def _in_order(gain: np.ndarray, near: float = 1e-9) -> list[tuple[int, int]]:
    """The first of the best assignments in lexical order of rows' choices, staying alone last: row by row the smallest
    column that leaves the best total possible. Only columns without slack are tried."""
    out, free = [], np.arange(gain.shape[1])
    for i in range(len(gain)):
        rest = gain[i:][:, free]
        pairs, slack = _by_prices(rest)
        mine = next((j for r, j in pairs if r == 0), -1)
        value = sum(rest[r, j] for r, j in pairs)
        for j in np.flatnonzero((rest[0] >= 0) & (slack[0, : len(free)] <= near)).tolist():
            without = np.delete(rest[1:], j, axis=1)
            if j == mine or rest[0, j] + sum(without[r, c] for r, c in _by_prices(without)[0]) >= value - near:
                out.append((i, int(free[j])))
                free = np.delete(free, j)
                break
    return out


def _by_prices(gain: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Shortest augmenting paths with node prices, on the matrix with one dummy column for each row; and each cell's slack."""
    n, m = gain.shape
    cost = np.concatenate([np.where(gain >= 0, -gain, 1e6), np.zeros((n, n))], axis=1)
    row_price, col_price = np.zeros(n + 1), np.zeros(m + n + 1)
    owner = np.zeros(m + n + 1, int)
    for i in range(1, n + 1):
        owner[0] = i
        at, reach = 0, np.full(m + n + 1, np.inf)
        via, done = np.zeros(m + n + 1, int), np.zeros(m + n + 1, bool)
        while True:
            done[at] = True
            r = owner[at]
            step = cost[r - 1] - row_price[r] - col_price[1:]
            open_ = ~done[1:]
            closer = open_ & (step < reach[1:])
            reach[1:][closer] = step[closer]
            via[1:][closer] = at
            nxt = 1 + int(np.argmin(np.where(open_, reach[1:], np.inf)))
            delta = reach[nxt]
            row_price[owner[done]] += delta
            col_price[done] -= delta
            reach[~done] -= delta
            at = nxt
            if owner[at] == 0:
                break
        while at:
            owner[at] = owner[via[at]]
            at = via[at]
    pairs = sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j] and gain[owner[j] - 1, j - 1] >= 0)
    return pairs, cost - row_price[1:, None] - col_price[None, 1:]


def matched(weights: Column, by_count: bool = False) -> Column:
    """The best pairs of a matrix column (array of rows of doubles)."""

    @F.pandas_udf(PAIRS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda w: [] if w is None else [{"i": i, "j": j} for i, j in best_pairs([[None if x is None or x != x else float(x) for x in r] for r in w], by_count)])

    return run(weights)
