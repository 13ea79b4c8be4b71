"""A hierarchical navigable small-world graph in NumPy, searched by many queries in step.

The usual algorithm, one beam search for each query, but all queries of a batch take
their next step together, so that each step is a few array operations.  Vectors go
in by batches too: those of a batch are searched for in the graph so far and
compared with each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Links of a node above and (twice as many) on the bottom layer, beam while building, queries in step, nodes expanded in one step.
LINKS, BEAM, TOGETHER, WIDTH = 12, 32, 512, 4
#: First beam of a search, and the beam from which on an exact product is made instead;
#: queries audited, and the shares of their pairs and of their nearest to be found.
FIRST, WIDEST, AUDITED, RECALL, NEAR = 24, 512, 64, 0.99, 0.9


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row, largest first."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        part = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(sims, part, 1), axis=1, kind="stable"), 1)


class Graph:
    """vectors: n x d float32, of length 1."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None, entry: int = 0, seed: int = 1) -> None:
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.layers, self.entry = layers or [], entry
        if layers is None:
            self._build(np.random.default_rng(seed))

    def _step(self, q: np.ndarray, entries: np.ndarray, beam: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of a beam search from entries (q x e; -1: none), best first; -1 fills up."""
        x, links, n = self.x, self.layers[layer], len(self.x)
        rows = np.arange(len(q))[:, None]
        ids = np.full((len(q), beam), -1, np.int32)
        sims = np.full((len(q), beam), -np.inf, np.float32)
        spent = np.zeros((len(q), beam), bool)
        seen = np.zeros((len(q), n + 1), bool)
        e = min(beam, entries.shape[1])
        ids[:, :e] = entries[:, :e]
        sims[:, :e] = np.where(ids[:, :e] >= 0, np.einsum("qd,qkd->qk", q, x[ids[:, :e]]), -np.inf)
        seen[rows, ids[:, :e]] = True
        active = np.arange(len(q))
        while len(active):
            open_ = np.where(spent[active] | (ids[active] < 0), -np.inf, sims[active])
            pick = _best(open_, min(WIDTH, beam))
            ok = np.take_along_axis(open_, pick, 1) > -np.inf
            on = ok[:, 0]
            active, pick, ok = active[on], pick[on], ok[on]
            if not len(active):
                break
            a = active[:, None]
            spent[a, pick] |= ok
            near = np.where(ok[:, :, None], links[ids[a, pick]], -1).reshape(len(active), -1)
            near.sort(axis=1)
            fresh = (near >= 0) & ~seen[a, near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            width = int(fresh.sum(1).max(initial=0))
            if not width:
                continue
            cols = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            near, fresh = np.take_along_axis(near, cols, 1), np.take_along_axis(fresh, cols, 1)
            near[~fresh] = n
            seen[a, near] = True
            near[~fresh] = -1
            s = np.einsum("qd,qkd->qk", q[active], x[near])
            s[~fresh] = -np.inf
            all_s = np.hstack([sims[active], s])
            keep = _best(all_s, beam)
            sims[active] = np.take_along_axis(all_s, keep, 1)
            ids[active] = np.take_along_axis(np.hstack([ids[active], near]), keep, 1)
            spent[active] = np.take_along_axis(np.hstack([spent[active], np.zeros_like(fresh)]), keep, 1)
        ids[sims == -np.inf] = -1
        return ids, sims

    def search(self, q: np.ndarray, beam: int, down_to: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The beam's vectors on a layer, best first, for each query (float32, of length 1)."""
        at = np.full((len(q), 1), self.entry, np.int32)
        for layer in range(len(self.layers) - 1, down_to, -1):
            at, _ = self._step(q, at, WIDTH, layer)
        return self._step(q, at, beam, down_to)

    def _choose(self, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
        """k links for each row: first those that lie nearer to it than to a better link, then the best of the rest."""
        out = np.full((len(ids), k), -1, np.int32)
        order = _best(sims, sims.shape[1])
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        v = self.x[ids]
        among = np.einsum("qad,qbd->qab", v, v)
        shade = np.full(sims.shape, -np.inf, np.float32)
        rank = np.full(sims.shape, np.inf)
        count = np.zeros(len(ids), int)
        for c in range(ids.shape[1]):
            take = (ids[:, c] >= 0) & (sims[:, c] > shade[:, c]) & (count < k)
            rank[take, c] = c
            count += take
            shade[take] = np.maximum(shade[take], among[take, c])
        rest = np.isinf(rank) & (ids >= 0)
        rank[rest] = ids.shape[1] + np.broadcast_to(np.arange(ids.shape[1]), ids.shape)[rest]
        cols = np.argsort(rank, axis=1, kind="stable")[:, :k]
        got = np.where(np.isinf(np.take_along_axis(rank, cols, 1)), -1, np.take_along_axis(ids, cols, 1))
        out[:, : got.shape[1]] = got
        return out

    def _link_back(self, nodes: np.ndarray, to: np.ndarray, layer: int) -> None:
        links = self.layers[layer]
        a, b = to.ravel(), np.repeat(nodes, to.shape[1])
        a, b = a[to.ravel() >= 0], b[to.ravel() >= 0]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
        nth = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        for r in range(0, int(nth.max(initial=-1)) + 1, LINKS):
            use = (nth >= r) & (nth < r + LINKS)
            hubs, row = np.unique(a[use], return_inverse=True)
            more = np.full((len(hubs), LINKS), -1, np.int32)
            more[row, nth[use] - r] = b[use]
            for k in range(0, len(hubs), TOGETHER):
                h = hubs[k : k + TOGETHER]
                ids = np.hstack([links[h], more[k : k + TOGETHER]])
                sims = np.where(ids >= 0, np.einsum("qd,qkd->qk", self.x[h], self.x[ids]), -np.inf).astype(np.float32)
                links[h] = self._choose(self.x[h], ids, sims, links.shape[1])

    def _build(self, rng: np.random.Generator) -> None:
        n = len(self.x)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 6)
        order = rng.permutation(n)
        top = int(level.max(initial=0))
        self.entry = int(np.argmax(level)) if n else 0
        order = np.concatenate([[self.entry], order[order != self.entry]]).astype(np.int64) if n else order
        self.layers = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(top + 1)]
        done = 1
        while done < n:
            new = order[done : done + min(done, TOGETHER)]
            for layer in range(top, -1, -1):
                at = new[level[new] >= layer]
                if not len(at):
                    continue
                ids, sims = self.search(self.x[at], BEAM, layer)
                own = self.x[at] @ self.x[at].T
                np.fill_diagonal(own, -np.inf)
                near = _best(own, min(LINKS, len(at)))
                own = np.take_along_axis(own, near, 1)
                peers = np.where(own > -np.inf, at[near], -1).astype(np.int32)
                self.layers[layer][at] = to = self._choose(self.x[at], np.hstack([ids, peers]), np.hstack([sims, own]), self.layers[layer].shape[1])
                self._link_back(at, to, layer)
            done += len(new)


@dataclass
class Found:
    """Pairs (row, col) of unsaturated queries; the beam they were found with; and what the
    audit wanted and got: pairs, and nearest neighbours."""

    row: np.ndarray
    col: np.ndarray
    saturated: np.ndarray
    beam: int
    pairs: tuple[int, int] = (0, 0)
    near: tuple[int, int] = (0, 0)


def _spread(x: np.ndarray, k: int) -> np.ndarray:
    return x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]


def range_search(graph: Graph, q: np.ndarray, least: float, own: bool = False, beam: int = FIRST, audit: int = AUDITED, recall: float = RECALL, near: float = NEAR) -> Found:
    """All pairs with a similarity of `least` or more that the graph finds for queries q.

    A query whose beam ends in a pair is searched again with a beam four times as wide;
    where that would be WIDEST or all vectors, it is `saturated` and left to an exact
    product, for a large group of near copies is cheaper to multiply than to walk.  The
    audit holds a spread of the queries, and of those with pairs, against all vectors:
    while fewer than `recall` of their pairs or `near` of their five nearest are found,
    all queries are searched again with twice the beam; beyond WIDEST all are saturated.
    own: the queries are the graph's vectors, and none is a pair of its own.
    """
    n = len(graph.x)
    itself = np.arange(len(q)) if own else np.full(len(q), -2)
    while beam < min(n, WIDEST):
        rows, cols, saturated = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(q), bool)
        nearest = np.full((len(q), 5), -1, np.int64)
        for k in range(0, len(q), TOGETHER):
            at, width = np.arange(k, min(k + TOGETHER, len(q))), beam
            while len(at):
                ids, sims = graph.search(q[at], width)
                nearest[at, : min(5, width)] = ids[:, :5]
                full = sims[:, -1] >= least
                r, c = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None] & (ids != itself[at][:, None]))
                rows.append(at[r])
                cols.append(ids[r, c].astype(np.int64))
                at, width = at[full], 4 * width
                if width >= min(n, WIDEST):
                    saturated[at] = True
                    break
        row, col = np.concatenate(rows), np.concatenate(cols)
        probe = np.setdiff1d(np.concatenate([_spread(np.arange(len(q)), audit), _spread(np.unique(row), audit)]), np.flatnonzero(saturated))
        true = q[probe] @ graph.x.T
        five = _best(true, min(5, n))
        wanted = (true >= least) & (np.arange(n) != itself[probe][:, None])
        out = Found(row, col, saturated, beam, (int(wanted.sum()), int(np.isin(row, probe).sum())), (five.size, sum(len(np.intersect1d(five[i], nearest[p])) for i, p in enumerate(probe))))
        if out.pairs[1] >= recall * out.pairs[0] and out.near[1] >= near * out.near[0]:
            return out
        beam *= 2
    return Found(np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(len(q), bool), n)
