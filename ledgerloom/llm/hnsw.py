"""A hierarchical navigable small-world graph over unit vectors, built and searched for many queries at once in numpy.

Nodes are ordered by falling level, so the members of a layer are a prefix. Each layer is filled from the top down in batches that grow
with the layer: a batch is searched in what is there, compared with itself, and linked to diverse neighbours both ways.
"""

from __future__ import annotations

import io

import numpy as np

LINKS = 16
BEAM = 64
EXPAND = 4
BATCH = 128


class Graph:
    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]) -> None:
        self.vectors, self.layers = vectors, layers  # layers[0] has all nodes; -1 fills up

    @staticmethod
    def order(n: int, seed: int = 1) -> tuple[np.ndarray, list[int]]:
        """Order of nodes by falling level, and the number of nodes in each layer."""
        level = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        order = np.argsort(-level, kind="stable")
        return order, [int((level >= k).sum()) for k in range(int(level.max()) + 1)] if n else []

    @classmethod
    def build(cls, vectors: np.ndarray, sizes: list[int], beam: int = BEAM) -> Graph:
        """``vectors`` are unit float32 rows in the order of ``order``."""
        graph = cls(vectors, [np.zeros((0, 0), np.int32)] * len(sizes))
        for layer in reversed(range(len(sizes))):
            graph._fill(layer, sizes[layer], beam)
        return graph

    def _fill(self, layer: int, n: int, beam: int) -> None:
        width = 2 * LINKS if layer == 0 else LINKS
        links = self.layers[layer] = np.full((n, width), -1, np.int32)
        done = 0
        while done < n:
            to = min(n, done + max(32, min(BATCH, done)))
            new = np.arange(done, to)
            found = self.search(self.vectors[new], beam, bottom=layer, limit=done)[0] if done else np.zeros((len(new), 0), np.int64)
            among = self.vectors[new] @ self.vectors[new].T
            among[np.arange(len(new)), np.arange(len(new))] = -2
            near = min(len(new) - 1, beam // 2)
            inside = done + np.argsort(-among, axis=1)[:, :near] if near > 0 else np.zeros((len(new), 0), np.int64)
            links[new] = self._diverse(new, np.concatenate([found, inside], 1), width)
            # links back, pruned the same way where they are too many
            a, b = np.repeat(new, width), links[new].reshape(-1)
            a, b = a[b >= 0], b[b >= 0]
            order = np.argsort(b, kind="stable")
            a, b = a[order], b[order]
            target, first, count = np.unique(b, return_index=True, return_counts=True)
            for i in range(0, len(target), 1024):
                t, c = target[i : i + 1024], np.minimum(count[i : i + 1024], 4 * width)
                extra = np.full((len(t), int(c.max())), -1, np.int64)
                at = np.repeat(first[i : i + 1024], c) + _within(c)
                extra[np.repeat(np.arange(len(t)), c), _within(c)] = a[at]
                links[t] = self._diverse(t, np.concatenate([links[t], extra], 1), width)
            done = to

    def _diverse(self, nodes: np.ndarray, found: np.ndarray, width: int) -> np.ndarray:
        """Of each node's candidates (-1: none) the best that are nearer to it than to a better one chosen, filled up with the best others."""
        out = np.full((len(nodes), width), -1, np.int32)
        for i in range(0, len(nodes), 256):
            out[i : i + 256] = self._diverse_block(nodes[i : i + 256], found[i : i + 256], width)
        return out

    def _diverse_block(self, nodes: np.ndarray, found: np.ndarray, width: int) -> np.ndarray:
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        found[found == nodes[:, None]] = -1
        near = np.einsum("bd,bkd->bk", self.vectors[nodes], self.vectors[found])
        near[found < 0] = -2
        keep = min(found.shape[1], 2 * width)
        order = np.argsort(-near, axis=1)[:, :keep]
        found, near = np.take_along_axis(found, order, 1), np.take_along_axis(near, order, 1)
        v = self.vectors[found]
        between = np.matmul(v, v.transpose(0, 2, 1))
        chosen = np.zeros(found.shape, bool)
        for j in range(keep):
            blocked = (chosen[:, :j] & (between[:, j, :j] > near[:, j, None])).any(1)
            chosen[:, j] = ~blocked & (near[:, j] > -2) & (chosen[:, :j].sum(1) < width)
        rank = np.where(chosen, near + 4, near)
        order = np.argsort(-rank, axis=1)[:, :width]
        out = np.full((len(nodes), width), -1, np.int32)
        out[:, : order.shape[1]] = np.take_along_axis(found, order, 1)
        return out

    def search(self, queries: np.ndarray, beam: int, bottom: int = 0, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities), best first, of the ``beam`` nodes found for each query in layer ``bottom``; -1 and -2 fill up.

        ``limit``: only nodes before it are linked yet."""
        ids, near = [], []
        for i in range(0, len(queries), BATCH):
            q = queries[i : i + BATCH]
            entry = np.zeros((len(q), 1), np.int64)
            for layer in reversed(range(bottom, len(self.layers))):
                n = len(self.layers[layer]) if limit is None else min(limit, len(self.layers[layer]))
                if n:
                    a, b = self._beam(q, entry, beam if layer == bottom else 8, self.layers[layer], n)
                    entry = a[:, :4]
            ids.append(a)
            near.append(b)
        return np.concatenate(ids), np.concatenate(near)

    def _beam(self, q: np.ndarray, entry: np.ndarray, beam: int, links: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        b = len(q)
        ids, near, open_ = np.full((b, beam), -1, np.int64), np.full((b, beam), -2, np.float32), np.zeros((b, beam), bool)
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True  # stands for no node
        fresh = np.where((entry >= 0) & (entry < n), entry, n)
        active = np.arange(b)
        while len(active):
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
            fresh[seen[active[:, None], fresh]] = n
            seen[active[:, None], fresh] = True
            some = fresh < n
            s = np.einsum("bd,bkd->bk", q[active], self.vectors[np.where(some, fresh, 0)])
            s[~some] = -2
            all_ids = np.concatenate([ids[active], np.where(some, fresh, -1)], 1)
            all_near = np.concatenate([near[active], s], 1)
            all_open = np.concatenate([open_[active], some], 1)
            order = np.argsort(-all_near, axis=1)[:, :beam]
            ids[active], near[active] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_near, order, 1)
            o = np.take_along_axis(all_open, order, 1)
            open_[active] = o
            more = o.any(1)
            active, o = active[more], o[more]
            if not len(active):
                break
            take = o & (np.cumsum(o, axis=1) <= EXPAND)
            open_[active] = o & ~take
            at = np.argsort(~take, axis=1, kind="stable")[:, :EXPAND]
            chosen = np.where(np.take_along_axis(take, at, 1), np.take_along_axis(ids[active], at, 1), -1)
            fresh = np.where((chosen >= 0)[:, :, None], links[np.maximum(chosen, 0)], -1).reshape(len(active), -1).astype(np.int64)
            fresh = np.where((fresh >= 0) & (fresh < n), fresh, n)
        return ids, near

    def dump(self, exact: np.ndarray, **more: np.ndarray) -> bytes:
        """The layers and ``exact``, the double-precision vectors, from which ``load`` takes the graph's own."""
        out = io.BytesIO()
        np.savez(out, exact=exact, **{f"layer{k}": x for k, x in enumerate(self.layers)}, **more)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> tuple[Graph, dict[str, np.ndarray]]:
        with np.load(io.BytesIO(data)) as z:
            arrays = {k: z[k] for k in z.files}
        layers = [arrays.pop(f"layer{k}") for k in range(sum(k.startswith("layer") for k in arrays))]
        return cls(arrays["exact"].astype(np.float32), layers), arrays


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, end to end."""
    to = np.cumsum(count)
    return np.arange(to[-1] if len(to) else 0) - np.repeat(to - count, count)
