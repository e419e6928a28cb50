"""A hierarchical navigable small-world graph over one shard of unit vectors, built and searched in numpy batches.

Each vector has a random number of layers. In every layer it is linked with some of its nearest vectors, chosen so
that they lie in different directions. A search goes down greedily to the lowest layer and keeps a beam of the best
vectors there; all queries of a batch take their steps together.
"""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np

LINKS = 12  # in upper layers; twice as many in the lowest
BUILD_BEAM = 64
BATCH = 256


@dataclass
class Graph:
    x: np.ndarray  # unit vectors, float32
    layers: list[np.ndarray] = field(default_factory=list)  # by layer: links of every vector, -1 where there is none
    entry: int = 0

    def pack(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, entry=self.entry, **{f"layer{i}": a for i, a in enumerate(self.layers)}, **more)
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> tuple[Graph, dict[str, np.ndarray]]:
        got = dict(np.load(io.BytesIO(data)))
        layers = [got.pop(f"layer{i}") for i in range(sum(k.startswith("layer") for k in got))]
        return Graph(got.pop("x"), layers, int(got.pop("entry"))), got


def _beam(g: Graph, layer: int, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The best `width` vectors of a layer that a beam from `start` meets, and their cosines, best first; -1 where
    there are fewer."""
    links, n = g.layers[layer], len(q)
    step = max(2, width // 32)  # vectors opened at once
    ids = np.full((n, width), -1, np.int64)
    sims = np.full((n, width), -np.inf, np.float32)
    opened = np.ones((n, width), bool)
    ids[:, 0], opened[:, 0] = start, False
    sims[:, 0] = np.einsum("qd,qd->q", q, g.x[start])
    seen = np.zeros((n, len(g.x)), bool)
    seen[np.arange(n), start] = True
    live = np.arange(n)
    while len(live):
        want = np.where(opened[live], -np.inf, sims[live])
        pick = np.argpartition(-want, min(step, width) - 1, axis=1)[:, :step]
        good = np.take_along_axis(want, pick, 1) > -np.inf
        some = good.any(1)
        live, pick, good = live[some], pick[some], good[some]
        if not len(live):
            break
        opened[live[:, None], pick] = True
        near = np.where(good[:, :, None], links[ids[live[:, None], pick]], -1).reshape(len(live), -1)
        near = np.sort(near, 1)
        fresh = near >= 0
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        fresh &= ~seen[live[:, None], np.maximum(near, 0)]
        r, c = np.nonzero(fresh)
        seen[live[r], near[r, c]] = True
        got = np.full(near.shape, -np.inf, np.float32)
        got[r, c] = np.einsum("pd,pd->p", q[live[r]], g.x[near[r, c]])
        all_sims = np.concatenate([sims[live], got], 1)
        order = np.argsort(-all_sims, 1, kind="stable")[:, :width]
        sims[live] = np.take_along_axis(all_sims, order, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], 1), order, 1)
        opened[live] = np.take_along_axis(np.concatenate([opened[live], ~fresh], 1), order, 1)
    return ids, sims


def _descend(g: Graph, q: np.ndarray, to: int) -> np.ndarray:
    at = np.full(len(q), g.entry)
    for layer in range(len(g.layers) - 1, to, -1):
        at = _beam(g, layer, q, at, 2)[0][:, 0]
    return at


def search(g: Graph, q: np.ndarray, width: int, least: float) -> list[np.ndarray]:
    """For each query, the vectors found with a cosine of at least `least`. A beam whose every place is such a vector is widened until
    one is not, or it holds the shard."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    batch = max(16, min(BATCH, 4_000_000 // max(1, len(g.x))))
    waiting = [(np.arange(lo, min(len(q), lo + batch)), min(width, len(g.x))) for lo in range(0, len(q), batch)]
    while waiting:
        rows, w = waiting.pop()
        ids, sims = _beam(g, 0, q[rows], _descend(g, q[rows], 0), w)
        full = (sims[:, -1] >= least) & (w < len(g.x))
        for i in np.flatnonzero(~full):
            out[rows[i]] = ids[i][sims[i] >= least]
        wider = rows[full]
        for lo in range(0, len(wider), 64):
            waiting.append((wider[lo : lo + 64], min(4 * w, len(g.x))))
    return out


def _choose(g: Graph, base: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of candidates sorted by cosine to `base`, m links each: first those nearer to base than to any chosen one, then the
    nearest of the others."""
    n, k = ids.shape
    v = g.x[np.maximum(ids, 0)]
    between = np.einsum("qid,qjd->qij", v, v)
    chosen = np.zeros((n, k), bool)
    for j in range(k):
        closest = np.where(chosen[:, :j], between[:, j, :j], -np.inf).max(1) if j else np.full(n, -np.inf)
        chosen[:, j] = (ids[:, j] >= 0) & (sims[:, j] > closest) & (chosen.sum(1) < m)
    rank = np.where(ids < 0, 2 * k, np.where(chosen, 0, k) + np.arange(k))
    order = np.argsort(rank, 1, kind="stable")[:, :m]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)


def _link_back(g: Graph, layer: int, new: np.ndarray, links: np.ndarray, m: int) -> None:
    """Adds new -> link in the other direction, choosing anew where a vector has too many."""
    source, target = np.repeat(new, links.shape[1]), links.ravel()
    source, target = source[target >= 0], target[target >= 0]
    sim = np.einsum("pd,pd->p", g.x[source], g.x[target])
    order = np.lexsort((-sim, target))
    source, target = source[order], target[order]
    where, begin, size = np.unique(target, return_index=True, return_counts=True)
    slots = int(min(size.max(), 3 * m))
    extra = np.full((len(where), slots), -1, np.int64)
    place = np.arange(len(target)) - np.repeat(begin, size)
    fits = place < slots
    extra[np.repeat(np.arange(len(where)), size)[fits], place[fits]] = source[fits]
    ids = np.sort(np.concatenate([g.layers[layer][where], extra], 1), 1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
    sims = np.where(ids >= 0, np.einsum("qd,qkd->qk", g.x[where], g.x[np.maximum(ids, 0)]), -np.inf)
    order = np.argsort(-sims, 1, kind="stable")
    g.layers[layer][where] = _choose(g, where, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), m)


def build(x: np.ndarray, seed: int = 5) -> Graph:
    """x: unit vectors (at least one). Vectors enter in batches that grow with the graph."""
    n = len(x)
    rng = np.random.default_rng(seed)
    height = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(LINKS)).astype(int), 12)
    g = Graph(np.ascontiguousarray(x, np.float32))
    order = rng.permutation(n)
    g.entry, done = int(order[0]), 1
    g.layers = [np.full((n, 2 * LINKS if i == 0 else LINKS), -1, np.int64) for i in range(int(height[g.entry]) + 1)]
    while done < n:
        new = order[done : done + min(BATCH, max(1, done))]
        top = int(height[new].max())
        was = len(g.layers) - 1
        for layer in range(min(top, was), -1, -1):
            here = new[height[new] >= layer]
            ids, sims = _beam(g, layer, g.x[here], _descend(g, g.x[here], layer), BUILD_BEAM)
            # those that enter together know each other too
            own = g.x[here] @ g.x[here].T
            np.fill_diagonal(own, -np.inf)
            best = np.argsort(-own, 1)[:, : min(16, len(here) - 1)]
            ids = np.concatenate([ids, here[best]], 1)
            sims = np.concatenate([sims, np.take_along_axis(own, best, 1)], 1)
            by = np.argsort(-sims, 1, kind="stable")[:, :BUILD_BEAM]
            m = g.layers[layer].shape[1]
            ids, sims = np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)
            links = _choose(g, here, ids, sims, LINKS)
            g.layers[layer][here, :LINKS] = links
            _link_back(g, layer, here, links, m)
        if top > was:
            highest = new[np.argsort(-height[new], kind="stable")]
            for layer in range(was + 1, top + 1):
                here = highest[height[highest] >= layer]
                g.layers.append(np.full((n, LINKS), -1, np.int64))
                if len(here) > 1:  # a chain of the few that open the layer
                    sims = g.x[here] @ g.x[here].T
                    np.fill_diagonal(sims, -np.inf)
                    k = min(LINKS, len(here) - 1)
                    g.layers[layer][here, :k] = here[np.argsort(-sims, 1)[:, :k]]
            g.entry = int(highest[0])
        done += len(new)
    return g
