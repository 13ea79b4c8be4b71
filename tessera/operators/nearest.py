"""The k best of many queries, kept by a task over its batches in bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def slices(sizes: np.ndarray, rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of rows of these sizes: up to `rows` of them, and `most` together unless one alone is larger."""
    i, ends = 0, np.cumsum(sizes)
    while i < len(sizes):
        j = int(np.searchsorted(ends, most + (ends[i - 1] if i else 0), "right"))
        j = min(max(j, i + 1), i + rows, len(sizes))
        yield i, j
        i = j


class Best:
    """The k least values of each of n queries with their ids; equal values go by id."""

    #: Values that are compared at a time, as a bound for the matrices of callers.
    cells = 1 << 20

    def __init__(self, n: int, k: int) -> None:
        self.k, self.worst = k, np.full(n, np.inf)
        self.q, self.v, self.i = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, values: np.ndarray, ids: np.ndarray) -> None:
        """values: (queries, ids); infinite ones are no hits."""
        least = self.worst
        if values.shape[1] > self.k:
            least = np.minimum(least, np.partition(values, self.k - 1, axis=1)[:, self.k - 1])
        r, c = np.nonzero((values <= least[:, None]) & np.isfinite(values))
        if not len(r):
            return
        q, v, i = np.concatenate([self.q, r]), np.concatenate([self.v, values[r, c]]), np.concatenate([self.i, ids[c]])
        order = np.lexsort((i, v, q))
        nth = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[nth < self.k]
        self.q, self.v, self.i = q[order], v[order], i[order]
        full = nth[nth < self.k] == self.k - 1
        self.worst[self.q[full]] = self.v[full]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, value, id)."""
        return self.q, self.v, self.i
