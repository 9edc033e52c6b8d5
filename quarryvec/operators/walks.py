"""Walks of many queries through one shard at once.

``cooperate_all`` does what ``graph.cooperate`` does, step by step for all queries of a block: each step takes every walk's nearest open node, and looks
at all their neighbours by a few array operations, so that a step costs a query some microseconds instead of a turn of the interpreter's loop.
Where the descent begins is told by one matrix product with the nodes of the level above the lowest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from quarryvec.operators import blocks
from quarryvec.operators import graph as g

#: Queries of a block; steps after which what is open is packed anew.
WALKS_AT_ONCE, STEPS_KEPT = 128, 512
#: What a distance of a walk costs beside one of many that are computed at once: about 2 and 0.25 microseconds.
WALK_COST = 8
#: Neighbours of a node up to which lists are padded to one length.
MOST_NEIGHBOURS = 256


def usable(graph: "g.ShardGraph", o: "g.GraphOptions") -> bool:
    """Whether the block can be walked at once."""
    degree = np.diff(graph.levels[0].offsets)
    return o.how in ("plain", "two_hop") and o.pull != "only" and len(degree) > 0 and degree.max() <= MOST_NEIGHBOURS and bool((np.abs(graph.vectors) <= blocks.LARGEST).all())


def padded(level: "g.Level") -> np.ndarray:
    """The neighbours of each node, -1 behind them."""
    size = np.diff(level.offsets)
    out = np.full((len(size), max(1, size.max())), -1, np.int32)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = level.targets
    return out


def entries(graph: "g.ShardGraph", q: np.ndarray) -> list[list[int]]:
    """For each query where its walk begins: the nearest nodes of the second level."""
    if len(graph.levels) < 2:
        return [graph.entries(x) for x in q]
    nodes = graph.levels[1].nodes
    x = graph.vectors[nodes]
    d = (x * x).sum(1)[None, :] - 2 * (q @ x.T)
    few = min(g.ENTRY_WIDTH, len(nodes))
    return nodes[np.argpartition(d, few - 1, axis=1)[:, :few]].tolist()


class Walks:
    """The state of a block's walks.  What is open and what is found lies in columns of as many places as a node has neighbours, one for each step."""

    def __init__(self, graph: "g.ShardGraph", near: np.ndarray, q: np.ndarray, passing: np.ndarray, o: "g.GraphOptions", width: int):
        n, m = len(q), max(near.shape[1], width)
        self.graph, self.q, self.passing, self.o, self.near = graph, q, passing, o, near
        self.own = np.arange(n) if len(passing) > 1 else np.zeros(n, np.int64)  # the row of ``passing`` of each query
        self.seen = np.zeros((n, len(graph.ids)), bool)
        self.nodes = np.full((n, 64, m), -1, np.int32)
        self.open = np.full((n, 64, m), np.inf, np.float32)
        self.hit = np.full((n, 64, m), np.inf, np.float32)
        self.least = np.full((n, 64), np.inf, np.float32)  # of each column of ``open``
        self.steps = 0
        self.more_found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        self.ef = np.full(n, o.ef)
        self.best = np.full((n, o.ef), np.inf, np.float32)  # the least distances found, of which the ef-th stands at its place
        self.total = np.count_nonzero(passing, axis=1)[self.own]
        self.scanned = np.zeros(n, np.int64)
        self.few = np.zeros(n, bool)  # no more rows pass than a search gathers
        self.computed, self.found = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.around, self.around_passing = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.stopped = np.zeros(n, bool)  # at a node beyond the bound, which is open
        self.waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]  # what goes on the frontier with the next column
        self.waiting_least = np.full(n, np.inf, np.float32)
        self.dead_ends: list[list[tuple[float, int]]] = [[] for _ in range(n)]

    def _column(self) -> int:
        if self.steps == self.open.shape[1]:
            if self.steps >= STEPS_KEPT:
                self._pack()
            if 2 * self.steps > self.open.shape[1]:
                for name, empty in (("nodes", -1), ("open", np.inf), ("hit", np.inf), ("least", np.inf)):
                    old = getattr(self, name)
                    setattr(self, name, np.concatenate([old, np.full_like(old, empty)], axis=1))
        self.steps += 1
        return self.steps - 1

    def _pack(self) -> None:
        """Columns without what is no longer open; what is found goes to the lists."""
        m = self.open.shape[2]
        left = np.isfinite(self.open)
        kept = []
        for i in range(len(self.q)):
            hits = np.isfinite(self.hit[i])
            self.more_found[i].append((self.hit[i][hits], self.nodes[i][hits]))
            kept.append((self.open[i][left[i]], self.nodes[i][left[i]]))
        self.hit[:], self.open[:], self.least[:], self.nodes[:] = np.inf, np.inf, np.inf, -1
        self.steps = -(-max(len(d) for d, _ in kept) // m)
        for i, (d, nodes) in enumerate(kept):
            self.open[i].reshape(-1)[: len(d)], self.nodes[i].reshape(-1)[: len(d)] = d, nodes
        self.least[:] = self.open.min(2)

    def bound(self, rows: np.ndarray) -> np.ndarray:
        """Distance of the ef-th best row that is found."""
        return self.best[rows, self.ef[rows] - 1]

    def front(self, i: int, stopped: bool = True) -> float:
        """The least distance that is open; stopped: with the node at which the walk stopped."""
        if not self.steps:
            return float(self.waiting_least[i])
        if not stopped and self.stopped[i]:
            d = np.partition(self.open[i, : self.steps].ravel(), 1)[1]
        else:
            d = self.least[i, : self.steps].min()
        return float(min(d, self.waiting_least[i]))

    def ended(self, i: int) -> bool:
        return self.front(i) == np.inf or self.found[i] >= self.total[i]

    def narrowed(self, rows: np.ndarray, d: np.ndarray) -> None:
        """Takes the distances among the least ones."""
        width = self.best.shape[1]
        both = np.concatenate([self.best[rows], d], axis=1)
        self.best[rows] = np.partition(both, sorted({*(self.ef[rows] - 1).tolist(), width - 1}), axis=1)[:, :width]

    def begin(self, first: list[list[int]]) -> None:
        size = np.array([len(x) for x in first])
        around = np.full((len(first), max(1, size.max(initial=0))), -1, np.int64)
        for i, x in enumerate(first):
            around[i, : len(x)] = x
        self._look(np.arange(len(first)), around)

    def _look(self, rows: np.ndarray, around: np.ndarray) -> None:
        """Adds the nodes (-1: none) to what is open, and to what is found if they pass."""
        m = self.open.shape[2]
        for a in range(0, around.shape[1], m):
            some = around[:, a : a + m]
            new = (some >= 0) & ~self.seen[rows[:, None], some]
            r, c = np.nonzero(new)
            who, nodes = rows[r], some[r, c]
            self.seen[who, nodes] = True
            gap = self.graph.vectors.take(nodes, axis=0)
            gap -= self.q.take(who, axis=0)
            d = np.einsum("ij,ij->i", gap, gap)
            dist = np.full((len(rows), m), np.inf, np.float32)
            dist[r, c] = d
            hit = np.full((len(rows), m), np.inf, np.float32)
            passes = self.passing[self.own[who], nodes]
            hit[r[passes], c[passes]] = d[passes]
            at = self._column()
            self.nodes[rows, at, : some.shape[1]], self.open[rows, at], self.hit[rows, at], self.least[rows, at] = some, dist, hit, dist.min(1)
            self.computed[rows] += np.bincount(r, minlength=len(rows))
            self.found[rows] += np.bincount(r[passes], minlength=len(rows))
            better = np.flatnonzero(hit.min(1) < self.best[rows, -1])
            if len(better):
                self.narrowed(rows[better], hit[better])

    def add(self, i: int, nodes: np.ndarray, onward: int | None) -> None:
        """Nodes that pass and aren't seen: all are found, the nearest ``onward`` are open."""
        if not len(nodes):
            return
        self.seen[i, nodes] = True
        d = self.graph.near(self.q[i], nodes).astype(np.float32)
        self.more_found[i].append((d, nodes))
        self.found[i] += len(nodes)
        if len(near := d[d < self.best[i, -1]]):
            self.narrowed(np.array([i]), near[None])
        some = np.argpartition(d, onward)[:onward] if onward is not None and onward < len(d) else np.arange(len(d))
        if len(some):
            self.waiting[i].append((d[some], nodes[some]))
            self.waiting_least[i] = min(self.waiting_least[i], d[some].min())

    def go_on(self, rows: np.ndarray) -> None:
        """Puts on the frontier what waits."""
        m = self.open.shape[2]
        parts = [(i, d, nodes) for i in rows.tolist() for d, nodes in self.waiting[i]]
        while parts:
            at, room, left = self._column(), dict.fromkeys((i for i, _, _ in parts), 0), []
            for i, d, nodes in parts:
                a = room[i]
                b = min(m, a + len(d))
                self.open[i, at, a:b], self.nodes[i, at, a:b], room[i] = d[: b - a], nodes[: b - a], b
                if b - a < len(d):
                    left.append((i, d[b - a :], nodes[b - a :]))
            self.least[:, at] = self.open[:, at].min(1)
            parts = left
        for i in rows.tolist():
            self.waiting[i] = []
        self.waiting_least[rows] = np.inf

    def every(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances and nodes of what is found."""
        hit = np.isfinite(self.hit[i, : self.steps])
        parts = [(self.hit[i, : self.steps][hit], self.nodes[i, : self.steps][hit]), *self.more_found[i]]
        return np.concatenate([d for d, _ in parts]), np.concatenate([n for _, n in parts]).astype(np.int64)

    def widen(self, rows: np.ndarray) -> None:
        """Lets the walks go on to ``step`` rows more."""
        self.ef[rows] += self.o.step
        if self.ef.max() > self.best.shape[1]:
            self.best = np.concatenate([self.best, np.full((len(self.best), self.ef.max() - self.best.shape[1]), np.inf, np.float32)], axis=1)
        for i in rows.tolist():
            d, width = self.every(i)[0], self.best.shape[1]
            d = np.partition(d, width - 1)[:width] if width < len(d) else d
            self.best[i], self.best[i, : len(d)] = np.inf, np.sort(d)
        self.stopped[rows] = False

    def spent(self, rows: np.ndarray) -> np.ndarray:
        """Whether scoring all that passes costs no more than what was spent.

        Where walk and clusters take turns, what they have found already isn't scored again, and a distance of the walk counts for what it costs."""
        if self.o.pull == "always":
            return self.few[rows] | (WALK_COST * self.computed[rows] + self.scanned[rows] >= self.total[rows] - self.found[rows])
        return self.few[rows] | (self.computed[rows] >= self.total[rows])

    def walk(self, rows: np.ndarray) -> None:
        o = self.o
        self.around[rows], self.around_passing[rows] = 0, 0
        self.go_on(rows)
        while len(rows := rows[(self.found[rows] < self.total[rows]) & ~self.spent(rows)]):
            least = self.least[rows, : self.steps]
            at = least.argmin(1)
            d = least[np.arange(len(rows)), at]
            rows, at, d = rows[keep := np.isfinite(d)], at[keep], d[keep]
            far = d > self.bound(rows)
            self.stopped[rows[far]] = True
            rows, at, d = rows[~far], at[~far], d[~far]
            if not len(rows):
                return
            column = self.open[rows, at]
            place = column.argmin(1)
            node = self.nodes[rows, at, place]
            self.open[rows, at, place] = column[np.arange(len(rows)), place] = np.inf
            self.least[rows, at] = column.min(1)
            around = self.near[node]
            there = around >= 0
            passes = self.passing[self.own[rows][:, None], around] & there
            size, n_pass = there.sum(1), passes.sum(1)
            self.around[rows] += size
            self.around_passing[rows] += n_pass
            if o.how == "two_hop":
                around = self._over(rows, around, passes, np.flatnonzero((size > 0) & (n_pass <= o.dense * size)))
            before = self.found[rows]
            self._look(rows, around)
            if o.pull == "dead_end":
                for i in np.flatnonzero(self.found[rows] == before).tolist():
                    self.dead_ends[rows[i]].append((float(d[i]), int(node[i])))
            if o.pull in g.LEAN:  # hardly anything passes here: clusters tell more
                rows = rows[(self.around[rows] < 4 * o.step) | (self.around_passing[rows] > o.sparse * self.around[rows])]

    def _over(self, rows: np.ndarray, around: np.ndarray, passes: np.ndarray, few: np.ndarray) -> np.ndarray:
        """Neighbours, where few of them pass instead those that pass of theirs and of what these ones lead to."""
        if not len(few):
            return around
        one, own, n = around[few], self.own[rows[few]], len(self.near)
        two = np.where(((one >= 0) & ~passes[few])[:, :, None], self.near[one], -1).reshape(len(few), -1)
        some = (two >= 0) & self.passing[own[:, None], two]
        number = np.arange(len(few))[:, None] * n
        both = np.unique(np.concatenate([(number + two)[some], (number + one)[passes[few]]]))
        r, nodes = both // n, both % n
        size = np.bincount(r, minlength=len(few))
        around = np.pad(around, ((0, 0), (0, max(0, size.max() - around.shape[1]))), constant_values=-1)
        around[few[size > 0]] = -1
        around[few[r], np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)] = nodes
        return around


def cooperate_all(graph: "g.ShardGraph", near: np.ndarray, q: np.ndarray, passing: np.ndarray, k: int, o: "g.GraphOptions", ranked: Callable[[int], Iterator[tuple[float, int]]]) -> list[tuple[np.ndarray, "g.Effort"]]:
    """As graph.cooperate() for each query: the nearest 2 * k nodes that were found, and the effort.

    near: padded(graph.levels[0]); passing: one row for all queries or one for each."""
    inject = max(1, k // 2) if o.inject is None else o.inject
    efs, n = max(o.efs or o.ef, k), len(q)
    w = Walks(graph, near, q, passing, o, max(inject, g.ENTRY_WIDTH))
    efforts, taken = [g.Effort() for _ in range(n)], [set() for _ in range(n)]
    w.few = w.total <= efs
    upcoming = [ranked(i) if o.pull != "never" else iter(()) for i in range(n)]
    head = [next(u, None) for u in upcoming]

    def take(i: int, cluster: int) -> int:
        if cluster in taken[i]:
            return 0
        taken[i].add(cluster)
        rows = graph.rows_of(cluster)
        rows = rows[passing[w.own[i], rows] & ~w.seen[i, rows]]
        efforts[i].clusters += 1
        w.scanned[i] += len(rows)
        w.add(i, rows, inject)
        return len(rows)

    def take_next(i: int) -> None:
        got = 0
        while head[i] and got < o.nrel:
            got += take(i, head[i][1])
            head[i] = next(upcoming[i], None)

    first = entries(graph, q)
    w.begin([[] if few else x for x, few in zip(first, w.few)])
    live, number = np.arange(n), 0
    while len(live):
        number += 1
        for i in live.tolist():
            efforts[i].rounds += 1
        spent = w.spent(live)
        for i in live[spent].tolist():
            rest = np.flatnonzero(passing[w.own[i]] & ~w.seen[i])
            w.add(i, rest, 0)
            if w.computed[i]:
                w.scanned[i] += len(rest)
            else:
                w.computed[i] = len(rest)
        live = live[~spent]
        before = w.found.copy()
        ahead = {i for i in live.tolist() if o.pull == "race" and head[i] and head[i][0] < w.front(i, False)}
        going = np.array([i for i in live.tolist() if i not in ahead], np.int64)
        if number > 1:
            w.widen(going)
        w.walk(going)
        on = []
        for i in live.tolist():
            fresh = w.found[i] - before[i]
            share = w.around_passing[i] / w.around[i] if w.around[i] else 0.0
            if o.pull == "dead_end":
                for _, node in sorted(w.dead_ends[i])[:inject]:
                    take(i, int(graph.clusters[node]))
                w.dead_ends[i] = []
            if (
                i in ahead or o.pull in ("always", "tree") or o.pull == "sparse" and (share <= o.sparse or not fresh)
                or o.pull in ("late", "dead_end") and (w.ended(i) or w.found[i] < k and not fresh) or o.pull == "race" and w.ended(i)
            ):
                take_next(i)
            bound = w.best[i, w.ef[i] - 1]
            front = w.front(i)
            enough = front == np.inf or front > bound or o.pull in g.LEAN and share <= o.sparse
            if not (w.found[i] >= efs and enough or not head[i] and w.ended(i) or w.found[i] >= w.total[i]):
                on.append(i)
        live = np.array(on, np.int64)
    out = []
    for i in range(n):
        d, nodes = w.every(i)
        efforts[i].walked, efforts[i].scanned = int(w.computed[i]), int(w.scanned[i])
        if len(d) > 2 * k:
            near_by = d <= np.partition(d, 2 * k - 1)[2 * k - 1]
            d, nodes = d[near_by], nodes[near_by]
        out.append((nodes[np.lexsort((graph.ids[nodes], d))[: 2 * k]], efforts[i]))
    return out
