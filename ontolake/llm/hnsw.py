"""Hierarchical navigable small-world graph of one shard of vectors, built and searched in batches of numpy operations."""

from __future__ import annotations

import pickle

import numpy as np

LINKS, BEAM, STEP, BATCH = 16, 64, 4, 256


def _spread(sims: np.ndarray, vecs: np.ndarray, ids: np.ndarray, links: int) -> np.ndarray:
    """Neighbours to keep of candidates sorted by falling similarity (ids -1: none): those nearer to the node than to any
    neighbour kept before, then the nearest of the rest. Rows by links, filled up with -1."""
    n, c = ids.shape
    kept = np.full((n, links), -1, np.int32)
    count = np.zeros(n, int)
    taken = np.zeros((n, c), bool)
    near = np.full((n, c), -np.inf, np.float32)  # similarity of each candidate to the nearest kept one
    at = np.arange(n)
    for i in range(c):
        good = (ids[:, i] >= 0) & (count < links) & (near[:, i] < sims[:, i])
        if good.any():
            rows = at[good]
            kept[rows, count[rows]] = ids[rows, i]
            taken[rows, i] = True
            count[rows] += 1
            if i + 1 < c:
                to = np.einsum("rcd,rd->rc", vecs[ids[rows, i + 1 :]], vecs[ids[rows, i]])
                near[rows, i + 1 :] = np.maximum(near[rows, i + 1 :], to)
    for i in range(c):
        good = (ids[:, i] >= 0) & (count < links) & ~taken[:, i]
        rows = at[good]
        kept[rows, count[rows]] = ids[rows, i]
        count[rows] += 1
    return kept


class Layer:
    """One layer: which nodes are in it, and up to `links` neighbours of each."""

    def __init__(self, n: int, links: int) -> None:
        self.near, self.links = np.full((n, links), -1, np.int32), links

    def search(self, vecs: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best nodes found from each query's entry nodes (rows of ids): (ids, similarities), by falling similarity."""
        q, n = len(queries), len(vecs)
        seen = np.zeros((q, n + 1), bool)  # the last column takes the place of -1
        rows = np.arange(q)
        ids = np.full((q, beam), -1, np.int32)
        sims = np.full((q, beam), -np.inf, np.float32)
        opened = np.ones((q, beam), bool)
        first = np.sort(entry, axis=1)
        first[:, 1:][first[:, 1:] == first[:, :-1]] = -1
        new, live = first, rows
        while True:
            # Score what is new for the live queries, and keep the best.
            s = np.einsum("rcd,rd->rc", vecs[new], queries[live]).astype(np.float32)
            s[new < 0] = -np.inf
            seen[live[:, None], new] = True
            all_ids, all_s = np.hstack([ids[live], new]), np.hstack([sims[live], s])
            all_open = np.hstack([opened[live], new < 0])
            best = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            r = np.arange(len(live))[:, None]
            ids[live], sims[live], opened[live] = all_ids[r, best], all_s[r, best], all_open[r, best]
            # Open the best that are not open yet.
            shut = np.where(opened[live], -np.inf, sims[live])
            pick = np.argpartition(-shut, min(STEP, beam) - 1, axis=1)[:, :STEP]
            can = np.take_along_axis(shut, pick, 1) > -np.inf
            going = can.any(1)
            live, pick, can = live[going], pick[going], can[going]
            if not len(live):
                return ids, sims
            r = np.arange(len(live))[:, None]
            nodes = np.where(can, ids[live][r, pick], -1)
            now = opened[live]
            np.put_along_axis(now, pick, True, 1)
            opened[live] = now
            new = np.where(nodes[:, :, None] >= 0, self.near[nodes], -1).reshape(len(live), -1)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[live[:, None], new]] = -1
            width = max(1, int((new >= 0).sum(1).max()))
            new = -np.sort(-new, axis=1)[:, :width]

    def insert(self, vecs: np.ndarray, nodes: np.ndarray, entry: np.ndarray, beam: int) -> None:
        """Adds nodes to the layer, whose nodes so far are reached from the entries."""
        ids, sims = self.search(vecs, vecs[nodes], entry, beam)
        among = vecs[nodes] @ vecs[nodes].T
        among[np.triu_indices(len(nodes))] = -np.inf  # of one batch, nodes see those before them
        top = min(self.links, len(nodes))
        near = np.argpartition(-among, top - 1, axis=1)[:, :top]
        near_s = np.take_along_axis(among, near, 1)
        near_ids = np.where(near_s > -np.inf, nodes[near], -1)
        self._choose(vecs, nodes, np.hstack([ids, near_ids]), np.hstack([sims, near_s]))
        # And back.
        src, dst = np.repeat(nodes, self.links), self.near[nodes].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        back_s = np.einsum("ij,ij->i", vecs[src], vecs[dst])
        order = np.lexsort((-back_s, dst))
        src, dst, back_s = src[order], dst[order], back_s[order]
        start = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        rank = np.arange(len(dst)) - np.repeat(start, np.diff(np.r_[start, len(dst)]))
        keep = rank < 2 * self.links
        targets = dst[start]
        more = np.full((len(targets), int(rank[keep].max()) + 1 if len(rank) else 0), -1, np.int32)
        more[np.searchsorted(targets, dst[keep]), rank[keep]] = src[keep]
        both = np.hstack([self.near[targets], more])
        s = np.einsum("rcd,rd->rc", vecs[both], vecs[targets])
        self._choose(vecs, targets, both, np.where(both >= 0, s, -np.inf))

    def _choose(self, vecs: np.ndarray, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        sims = np.where((ids < 0) | (ids == nodes[:, None]), -np.inf, sims)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        ids = np.where(sims > -np.inf, ids, -1).astype(np.int32)
        width = max(1, int((ids >= 0).sum(1).max()))
        ids, sims = ids[:, :width], sims[:, :width]
        room = (ids >= 0).sum(1) > self.links
        self.near[nodes[~room]] = np.pad(ids[~room][:, : self.links], ((0, 0), (0, max(0, self.links - width))), constant_values=-1)
        if room.any():
            self.near[nodes[room]] = _spread(sims[room].astype(np.float32), vecs, ids[room], self.links)


class Graph:
    """vecs: rows of length one, float32. Levels come from the ids, so that a rebuilt graph is the same graph."""

    def __init__(self, vecs: np.ndarray, levels: np.ndarray, links: int = LINKS, beam: int = BEAM) -> None:
        self.vecs, n = vecs, len(vecs)
        order = np.argsort(-levels, kind="stable")
        top = int(levels.max()) if n else 0
        self.layers: list[Layer] = []
        self.root = int(order[0]) if n else -1
        for level in range(top, -1, -1):
            layer = Layer(n, 2 * links if level == 0 else links)
            nodes = order[: int((levels >= level).sum())]
            done = 1
            while done < len(nodes):
                batch = nodes[done : done + min(BATCH, max(8, done))]
                layer.insert(vecs, batch, self.entries(vecs[batch], layer), beam)
                done += len(batch)
            self.layers.append(layer)

    def entries(self, queries: np.ndarray, new: Layer | None = None) -> np.ndarray:
        """The node nearest to each query in the layers above the one that is searched next."""
        at = np.full((len(queries), 1), self.root, np.int32)
        for layer in self.layers if new is not None else self.layers[:-1]:
            ids, _ = layer.search(self.vecs, queries, at, 8)
            at = ids[:, :4].copy()
            at[:, 1:] = np.where(at[:, 1:] < 0, at[:, :1], at[:, 1:])
        return at

    def within(self, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs found with similarity of `least` or more. A query whose whole beam lies within is asked
        again with a beam four times as wide; a beam as wide as the shard looks at every node."""
        out_q, out_n = [], []
        todo = np.arange(len(queries))
        while len(todo):
            again = []
            for i in range(0, len(todo), BATCH):
                part = todo[i : i + BATCH]
                if beam >= len(self.vecs):
                    q, node = np.nonzero(queries[part] @ self.vecs.T >= least)
                    out_q.append(part[q])
                    out_n.append(node)
                    continue
                ids, sims = self.layers[-1].search(self.vecs, queries[part], self.entries(queries[part]), beam)
                full = sims[:, -1] >= least
                again.append(part[full])
                q, c = np.nonzero((sims >= least) & ~full[:, None])
                out_q.append(part[q])
                out_n.append(ids[q, c])
            todo = np.concatenate(again) if again else np.empty(0, int)
            beam *= 4
        return np.concatenate(out_q or [np.empty(0, int)]), np.concatenate(out_n or [np.empty(0, int)]).astype(int)

    def pack(self) -> bytes:
        return pickle.dumps([self.root, [layer.near[: len(self.vecs)] for layer in self.layers]], protocol=5)

    @classmethod
    def unpack(cls, raw: bytes, vecs: np.ndarray) -> Graph:
        out = cls.__new__(cls)
        out.vecs, (out.root, near) = vecs, pickle.loads(raw)
        out.layers = []
        for x in near:
            layer = Layer.__new__(Layer)
            layer.near, layer.links = x, x.shape[1]
            out.layers.append(layer)
        return out


def links(a: Graph, b: Graph | None, least: float, wanted: float = 0.999, nearest: float = 0.9, sample: int = 64) -> tuple[np.ndarray, dict[str, int]]:
    """Which nodes of a and b (None: a itself) have a similarity of `least` or more, as a Boolean matrix, and the audit.
    Each graph is asked by every node of the other, and a pair counts if either finds it. Beams start at an eighth of the
    shard, BEAM at most, and widen until the audit finds the wanted share of its pairs, or every node has been looked at.

    The audit compares some nodes of both sides with all of the other: `sample` evenly spaced ones; as many of those with a
    link found, to anything but themselves; and as many of those whose best neighbour found is nearest to the threshold. Where
    no two vectors are that near, links tell nothing, so of all these nodes the nearest neighbour must be found too, for a
    share of `nearest`. It gives the beam, how many pairs there are (true) and were found (hit), how many nodes were audited
    (asked) and found their nearest (met), and whether every node was looked at."""
    rows, cols = a.vecs, a.vecs if b is None else b.vecs
    widest = max(len(rows), len(cols))
    beam = max(4, min(BEAM, widest // 8))
    edge = None
    while True:
        found = np.zeros((len(rows), len(cols)), bool)
        q, n = a.within(cols, least, beam)
        found[n, q] = True
        if b is None:
            found |= found.T
            np.fill_diagonal(found, False)
        else:
            q, n = b.within(rows, least, beam)
            found[q, n] = True
        if edge is None:
            edge = (_nearest_to(a if b is None else b, rows, least, sample, b is None), _nearest_to(a, cols, least, sample, b is None))
        true = hit = asked = met = 0
        for x, g, matrix, near in ((rows, a if b is None else b, found, edge[0]), (cols, a, found.T, edge[1])):
            linked = np.flatnonzero(matrix.any(1))
            some = np.unique(np.r_[_spaced(len(x), sample), linked[_spaced(len(linked), sample)], near])
            sims = x[some] @ g.vecs.T
            if b is None:
                sims[np.arange(len(some)), some] = -np.inf
            real = sims >= least
            asked += len(some)
            met += len(some)
            if beam < len(g.vecs) and len(some):
                ids, best = g.layers[-1].search(g.vecs, x[some], g.entries(x[some]), beam)
                best = np.where(ids == some[:, None], -np.inf, best) if b is None else best
                met -= int((best.max(1) < sims.max(1) - 1e-5).sum())
            true += int(real.sum())
            hit += int((real & matrix[some]).sum())
            if b is None:
                break
        if beam >= widest or hit >= wanted * true and met >= nearest * asked:
            return found, {"beam": beam, "true": true, "hit": hit, "asked": asked, "met": met, "every": int(beam >= widest)}
        beam *= 4


def _spaced(n: int, sample: int) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(sample, n)).astype(int)) if n else np.empty(0, int)


def _nearest_to(g: Graph, queries: np.ndarray, least: float, sample: int, own: bool) -> np.ndarray:
    """Queries whose best neighbour found, themselves aside, has a similarity next to `least`."""
    some = _spaced(len(queries), 8 * sample)
    if not len(some):
        return some
    _, sims = g.layers[-1].search(g.vecs, queries[some], g.entries(queries[some]), 4)
    best = sims[:, 1 if own else 0]
    return some[np.argsort(np.abs(best - least), kind="stable")[:sample]]


def levels_of(ids: np.ndarray, links: int = LINKS) -> np.ndarray:
    """Geometric levels from a mix of the ids' bits."""
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    u = (x.astype(np.float64) + 1) / (2.0**64 + 2)
    return np.minimum((-np.log(u) / np.log(links)).astype(int), 8)
