"""A hierarchical navigable small-world graph over unit vectors, searched for many queries at once."""

from __future__ import annotations

import numpy as np

DEGREE = 12  # links of a node in the upper layers; twice that in the lowest
BUILD_BEAM = 48
BATCH = 128


class Graph:
    """Layers of links over the rows of `vectors`; layer 0 holds every row."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors = vectors
        self.layers = layers  # (rows in the layer, links of each as row numbers, -1 for none), top layer last

    @classmethod
    def build(cls, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 3) -> Graph:
        """Insert rows in batches that double up to BATCH; a batch sees the graph so far and itself."""
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(rng.random(n)) / np.log(degree)).astype(np.int64)
        level[0] = max(level.max(initial=0), 0)
        graph = cls(vectors, [(np.flatnonzero(level >= 0), np.full((n, 2 * degree), -1, np.int32))])
        graph.layers += [(np.flatnonzero(level >= k), np.full((n, degree), -1, np.int32)) for k in range(1, int(level[0]) + 1)]
        at = 1
        while at < n:
            batch = np.arange(at, min(n, at + min(at, BATCH)))
            graph._insert(batch, level, beam)
            at = int(batch[-1]) + 1
        return graph

    def _insert(self, batch: np.ndarray, level: np.ndarray, beam: int) -> None:
        queries = self.vectors[batch]
        entry = np.zeros((len(batch), 1), np.int64)
        for k in range(len(self.layers) - 1, -1, -1):
            links = self.layers[k][1]
            here = level[batch] >= k
            found, sims = self._beam(links, queries, entry, beam if here.any() else 1)
            entry = np.maximum(found[:, : 4], 0)
            if not here.any():
                continue
            rows, own = batch[here], queries[here]
            among = own @ own.T
            np.fill_diagonal(among, -2)
            ids = np.concatenate([found[here], np.broadcast_to(rows, (len(rows), len(rows)))], axis=1)
            near = np.concatenate([sims[here], among], axis=1)
            order = np.argsort(-near, axis=1)[:, :beam]
            ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
            ids[near <= -2] = -1
            chosen = self._spread(ids, near, links.shape[1] if k else links.shape[1] // 2)
            links[rows, : chosen.shape[1]] = chosen
            self._link_back(links, rows, chosen)

    def _spread(self, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Of candidates by descending similarity, those nearer to the row than to any chosen before; then the nearest others."""
        r, c = ids.shape
        valid = ids >= 0
        v = self.vectors[np.maximum(ids, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        taken = np.zeros((r, c), bool)
        for j in range(c):
            closer = (taken & (between[:, :, j] >= near[:, j][:, None])).any(axis=1)
            taken[:, j] = valid[:, j] & ~closer & (taken.sum(axis=1) < most)
        # A place left free goes to the nearest not chosen, which keeps groups of near copies reachable.
        rank = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(ids, rank, 1), -1).astype(np.int32)

    def _link_back(self, links: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> None:
        source = np.repeat(rows, chosen.shape[1])
        target = chosen.ravel().astype(np.int64)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
        width = links.shape[1]
        for lo in range(0, len(nodes), 256):
            part = slice(lo, lo + 256)
            extra = np.full((len(nodes[part]), int(counts[part].max())), -1, np.int64)
            for i, (s, c) in enumerate(zip(starts[part], counts[part], strict=True)):
                extra[i, :c] = source[s: s + c]
            ids = np.concatenate([links[nodes[part]].astype(np.int64), extra], axis=1)
            near = np.einsum("rcd,rd->rc", self.vectors[np.maximum(ids, 0)], self.vectors[nodes[part]])
            near[ids < 0] = -3
            ids.sort(axis=1)  # a link from both sides stands twice
            near = np.einsum("rcd,rd->rc", self.vectors[np.maximum(ids, 0)], self.vectors[nodes[part]])
            near[ids < 0] = -3
            near[:, 1:][ids[:, 1:] == ids[:, :-1]] = -3
            order = np.argsort(-near, axis=1)[:, : 3 * width]
            ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
            ids[near <= -3] = -1
            over = (ids >= 0).sum(axis=1) > width
            out = np.where(ids[:, :width] >= 0, ids[:, :width], -1).astype(np.int32)
            if out.shape[1] < width:
                out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
            if over.any():
                out[over] = self._spread(ids[over], near[over], width)
            links[nodes[part]] = out

    def _beam(self, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query the `beam` best rows found and their similarities, descending, -1 and -3 where fewer.

        A search ends when every row in its beam has been opened.
        """
        q, n = len(queries), len(self.vectors)
        seen = np.zeros((q, n), bool)
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -3, np.float32)
        entry = entry.copy()
        entry.sort(axis=1)
        first = np.einsum("qed,qd->qe", self.vectors[entry], queries)
        first[:, 1:][entry[:, 1:] == entry[:, :-1]] = -3
        keep = min(beam, entry.shape[1])
        order = np.argsort(-first, axis=1)[:, :keep]
        ids[:, :keep] = np.take_along_axis(entry, order, 1)
        sims[:, :keep] = np.take_along_axis(first, order, 1)
        ids[sims <= -3] = -1
        np.put_along_axis(seen, entry, True, 1)
        open_rows = ids >= 0
        active = np.arange(q)
        while len(active):
            best = np.where(open_rows[active], sims[active], -4)
            at = best.argmax(axis=1)
            active = active[best[np.arange(len(active)), at] > -4]
            if not len(active):
                break
            at = np.where(open_rows[active], sims[active], -4).argmax(axis=1)
            open_rows[active, at] = False
            nodes = ids[active, at]
            around = links[nodes].astype(np.int64)
            fresh = (around >= 0) & ~np.take_along_axis(seen[active], np.maximum(around, 0), 1)
            near = np.einsum("qcd,qd->qc", self.vectors[np.maximum(around, 0)], queries[active])
            near[~fresh] = -3
            r, c = np.nonzero(fresh)
            seen[active[r], around[r, c]] = True
            all_ids = np.concatenate([ids[active], np.where(fresh, around, -1)], axis=1)
            all_sims = np.concatenate([sims[active], near], axis=1)
            all_open = np.concatenate([open_rows[active], fresh], axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, : ids.shape[1]]
            ids[active] = np.take_along_axis(all_ids, order, 1)
            sims[active] = np.take_along_axis(all_sims, order, 1)
            open_rows[active] = np.take_along_axis(all_open, order, 1)
        return ids, sims

    def search(self, queries: np.ndarray, beam: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) in the beam of each query. `start` gives each query a row to begin at as well."""
        beam = min(beam, len(self.vectors))
        rows, near = [np.zeros((0, beam), np.int64)], [np.zeros((0, beam), np.float32)]
        for lo in range(0, len(queries), BATCH):
            part = queries[lo: lo + BATCH]
            entry = np.zeros((len(part), 1), np.int64)
            for k in range(len(self.layers) - 1, 0, -1):
                found, _ = self._beam(self.layers[k][1], part, entry, 4)
                entry = np.where(found[:, :4] >= 0, found[:, :4], entry[:, :1])
            if start is not None:
                entry = np.concatenate([entry, start[lo: lo + BATCH, None]], axis=1)
            ids, sims = self._beam(self.layers[0][1], part, entry, beam)
            rows.append(ids)
            near.append(sims)
        return np.concatenate(rows), np.concatenate(near)
