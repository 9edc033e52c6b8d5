"""Proximity graphs in shards, walked alone or together with clusters.

A shard is a hash bucket of the base, of as many rows as ``SHARD_BYTES`` of vectors hold, so that it fits in a task at any
size of the base.  Building makes, inside each shard, a layered graph: every node keeps its nearest neighbours
that no kept neighbour is nearer to, and gives back edges; higher layers hold every ``fanout``-th node by hash.  A shard is
one row of a table: ids, vectors, clusters and edges together, so that a search reads it as it lies, without a shuffle of
vectors.  What passes is worked out by Spark from the base's attributes, whatever the predicate; its ids, and no
vectors, are brought to the shards.  A window merges the shards' rows.

A row that is deleted is left out of the base that is searched: walks go through it and don't return it.  ``remove_rows`` takes it out of its shard and
mends the graph there; ``insert_rows`` adds rows on all levels.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryvec.functions.distances import folded_distance
from quarryvec.operators import blocks, walks
from quarryvec.operators.exact import query_blocks, top_k
from quarryvec.operators.predicates import Predicate, compared, shared_parts

SHARD_BYTES, SHARD_ROWS = 16 << 20, 1 << 15
#: Queries that a task holds with the rows that pass for each.
QUERIES_AT_ONCE = 256
#: Centroids of which a graph is made for ranking; more are ranked by all distances.
MOST_RANKED = 1 << 14
#: Rows up to which a build computes all distances; beyond it: trees, rows of a leaf, rounds over neighbours of so many neighbours.
EXACT_ROWS, TREES, LEAF_ROWS, DESCENTS, DESCENT_WIDTH = 1 << 12, 4, 128, 3, 12
#: Nodes of each upper level with which a descent goes on.
ENTRY_WIDTH = 8
#: Ways of taking clusters by which a walk ends for now where ``sparse`` or less passes of what it sees.
LEAN = ("sparse", "tree")
#: Rows that are inserted at a time.
INSERT_BLOCK = 256
#: Ranks of centroids that a task keeps from shard to shard; those of further queries are made again.
RANKS_KEPT = 1 << 22


@dataclass(frozen=True)
class GraphOptions:
    """How a walk goes on, and when clusters are taken.

    how: ``plain`` expands all neighbours and lets only passing ones into the result; ``two_hop`` looks at the
    share of neighbours that pass: above ``dense`` it expands as plain, below it steps over
    nodes that don't pass to theirs that do; ``directed`` chooses between a full and a directed second
    hop by their estimated cost; ``one_hop`` expands passing neighbours only, all of them where none passes; ``subgraph`` walks only
    through nodes that pass, up to ``degree`` of them by one or two hops; ``in_place`` is two_hop that looks no further than ``step``
    nodes; ``improving`` is plain that ends when ``step`` expansions in a row have not bettered the result.

    pull: ``never`` walks only; ``only`` takes clusters only; ``sparse`` takes clusters when ``sparse`` or less of what the last
    walk saw passes, or it found nothing (a walk then ends early, and a search that has its rows there too); ``always`` takes turns; ``race`` goes on where the next thing is nearer; ``late`` takes clusters when
    the walk has ended without k rows; ``dead_end`` takes the clusters of nodes from which the walk found nothing.  Clusters are taken, nearest
    first, until they give ``nrel`` passing rows (``tree``, where the rows' clusters are cells of a box layout: by turns with the walk); the nearest ``inject`` of these (half of k by default) go on the walk's frontier.
    A search ends with ``efs`` rows (``ef`` by default), when all that passes is found, or when both are exhausted.  Where no more rows pass than it would
    gather, or once a walk has computed as many distances as rows pass, it scores all that pass, and so computes twice as many at most.  Walks of a block (``walks``) that take turns with clusters do so
    once what is left to score costs no more than what was spent on walk and clusters.  rank: ``exact`` or by a ``graph`` over the centroids."""

    how: str = "two_hop"
    ef: int = 64
    step: int = 20
    dense: float = 0.3
    degree: int = 32
    pull: str = "never"
    efs: int = 0
    nrel: int = 50
    sparse: float = 0.05
    inject: int | None = None
    rank: str = "exact"


class Level:
    """Neighbours of the nodes of a layer, one list after the other."""

    def __init__(self, nodes: np.ndarray, offsets: np.ndarray, targets: np.ndarray):
        self.nodes, self.offsets, self.targets = nodes, offsets, targets

    @staticmethod
    def of(n: int, nodes: np.ndarray, lists: list[np.ndarray]) -> "Level":
        size = np.zeros(n, np.int64)
        size[nodes] = [len(x) for x in lists]
        return Level(nodes.astype(np.int32), np.append(0, np.cumsum(size)).astype(np.int32), np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int32))

    def near(self, node: int) -> np.ndarray:
        return self.targets[self.offsets[node] : self.offsets[node + 1]]

    def lists(self) -> list[np.ndarray]:
        return [self.near(n) for n in self.nodes.tolist()]


def nearest_of(x: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest other rows of each row and their squared distances, by all distances in blocks."""
    n, square = len(x), (x * x).sum(1)
    near, gap = np.zeros((n, ef), np.int64), np.zeros((n, ef))
    for first in range(0, n, 512):
        d = square[first : first + 512, None] + square[None, :] - 2 * x[first : first + 512] @ x.T
        rows = np.arange(len(d))
        d[rows, rows + first] = np.inf
        some = np.argpartition(d, ef - 1, axis=1)[:, :ef]
        by = np.argsort(d[rows[:, None], some], axis=1, kind="stable")
        near[first : first + 512] = some[rows[:, None], by]
        gap[first : first + 512] = d[rows[:, None], near[first : first + 512]]
    return near, gap


def _bettered(near: np.ndarray, gap: np.ndarray, more: np.ndarray, d: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of neighbours with further candidates: the least distances of both, each row once, no row itself."""
    every, dist = np.concatenate([near, more], axis=1), np.concatenate([gap, d], axis=1)
    by = np.lexsort((dist, every), axis=1)
    every, dist = np.take_along_axis(every, by, 1), np.take_along_axis(dist, by, 1)
    again = np.zeros(every.shape, bool)
    again[:, 1:] = every[:, 1:] == every[:, :-1]
    dist[again | (every == own[:, None]) | (every < 0)] = np.inf
    by = np.argsort(dist, axis=1, kind="stable")[:, : near.shape[1]]
    return np.take_along_axis(every, by, 1), np.take_along_axis(dist, by, 1)


def neighbours(x: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """As nearest_of(); of more than ``EXACT_ROWS`` rows nearly, in time that grows as the rows do.

    Trees split the rows at medians along random directions down to leaves, in which all distances are computed; then neighbours of neighbours,
    both ways, are looked at in ``DESCENTS`` rounds."""
    n = len(x)
    if n <= EXACT_ROWS:
        return nearest_of(x, ef)
    r = np.random.default_rng(n)
    near, gap = np.full((n, ef), -1), np.full((n, ef), np.inf)
    leaf = max(LEAF_ROWS, 2 * ef)
    for _ in range(TREES):
        todo = [np.arange(n)]
        while todo:
            rows = todo.pop()
            if len(rows) > leaf:
                a, b = x[r.choice(rows, 2, replace=False)]
                by = np.argsort(x[rows] @ (a - b if (a != b).any() else r.normal(size=x.shape[1])), kind="stable")
                todo += [rows[by[: len(rows) // 2]], rows[by[len(rows) // 2 :]]]
                continue
            k = min(ef, len(rows) - 1)
            own, d = nearest_of(x[rows], k)
            near[rows], gap[rows] = _bettered(near[rows], gap[rows], rows[own], d, rows)
    width = min(ef, DESCENT_WIDTH)
    for _ in range(DESCENTS):
        ahead = near[:, :width].copy()
        # the first rows that have each row among their neighbours
        to, of = ahead.ravel(), np.repeat(np.arange(n), width)
        by = np.argsort(to, kind="stable")
        to, of = to[by], of[by]
        at = np.arange(len(to)) - np.searchsorted(to, to)
        back = np.full((n, width), -1)
        use = (at < width) & (to >= 0)
        back[to[use], at[use]] = of[use]
        around = np.concatenate([ahead, back], axis=1)
        for first in range(0, n, 128):
            own = np.arange(first, min(n, first + 128))
            hops = around[ahead[own]].reshape(len(own), -1)
            more = np.concatenate([hops, back[own]], axis=1)
            gaps = x[more] - x[own][:, None, :]
            near[own], gap[own] = _bettered(near[own], gap[own], more, np.einsum("ijk,ijk->ij", gaps, gaps), own)
    return near, np.where(near < 0, np.inf, gap)


def diverse(x: np.ndarray, near: np.ndarray, gap: np.ndarray, most: int | None) -> np.ndarray:
    """Of each row's candidates (nearest first, with their distances) those that no chosen one is nearer to than the row is, ``most`` of them;
    None: those that no nearer candidate is nearer to."""
    there = np.isfinite(gap)
    points = x[near]
    square = np.einsum("ijk,ijk->ij", points, points)
    between = square[:, :, None] + square[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
    closer = between < gap[:, :, None] - 1e-12  # [row, a, b]: b is nearer to a than the row is
    c = near.shape[1]
    if most is None:
        return ~(closer & (np.arange(c)[None, :] < np.arange(c)[:, None])[None]).any(2) & there
    rows, chosen, alive = np.arange(len(near)), np.zeros(near.shape, bool), there.copy()
    for _ in range(most):
        a = alive.argmax(1)
        some = alive[rows, a]
        if not some.any():
            break
        chosen[rows[some], a[some]] = True
        alive[some] &= ~closer[rows[some], :, a[some]]
        alive[rows[some], a[some]] = False
    return chosen


def join_parts(x: np.ndarray, both: list[set[int]]) -> None:
    """Parts that no edge joins get one, to the nearest node of what is joined already."""
    square, part = (x * x).sum(1), np.full(len(x), -1)
    for first in range(len(x)):
        if part[first] >= 0:
            continue
        joined = np.flatnonzero(part >= 0)
        todo, part[first] = [first], first
        while todo:
            for j in both[todo.pop()]:
                if part[j] < 0:
                    part[j] = first
                    todo.append(j)
        if len(joined):
            j = int(joined[np.argmin(square[joined] - 2 * x[joined] @ x[first])])
            both[first].add(j)
            both[j].add(first)


class ShardGraph:
    """The rows of a shard in order of id, their clusters, and the neighbours of each on each level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: list[Level], clusters: np.ndarray | None = None):
        self.ids, self.vectors, self.levels = ids, vectors.astype(np.float32, copy=False), levels
        self.clusters = np.zeros(len(ids), np.int32) if clusters is None else clusters
        self.by_cluster = np.argsort(self.clusters, kind="stable")
        self.sorted_clusters = self.clusters[self.by_cluster]

    @staticmethod
    def build(ids: np.ndarray, vectors: np.ndarray, m: int = 16, ef: int = 64, fanout: int = 16, kind: str = "layered", gamma: int = 4, clusters: np.ndarray | None = None) -> "ShardGraph":
        """kind: ``layered``; ``relative``: one layer of edges that no third node is nearer to both ends of; ``dense``: ``m`` * ``gamma``
        candidates, of which those are left out, beyond the first m, that two hops reach."""
        n = len(ids)
        rank = np.argsort(((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        levels, count = [], n
        while True:
            nodes = np.flatnonzero(place < count)
            lists = ShardGraph._layer(vectors, nodes, m * (2 if not levels else 1), ef if kind != "dense" else max(ef, m * gamma), kind, m)
            levels.append(Level.of(n, nodes, lists))
            if kind == "relative" or count <= max(m, 2):
                break
            count = max(1, count // fanout)
        return ShardGraph(ids, vectors, levels, clusters)

    @staticmethod
    def _layer(vectors: np.ndarray, nodes: np.ndarray, most: int, ef: int, kind: str, m: int) -> list[np.ndarray]:
        x = vectors[nodes].astype(float)
        n = len(nodes)
        if n == 1:
            return [np.zeros(0, np.int64)]
        ef = min(ef, n - 1)
        near, gap = neighbours(x, ef)
        both: list[set[int]] = [set() for _ in range(n)]
        kept = []
        for first in range(0, n, 256):
            order, d = near[first : first + 256], gap[first : first + 256]
            if kind == "dense":
                for own in order:
                    chosen, covered = list(range(min(m, ef))), set()
                    for a in range(m, ef):
                        if int(own[a]) not in covered:
                            chosen.append(a)
                            covered.update(near[own[a], :m].tolist())
                    kept.append(own[chosen])
            else:
                chosen = diverse(x, order, d, None if kind == "relative" else max(1, most // 2))
                kept += [own[c] for own, c in zip(order, chosen)]
        for i, own in enumerate(kept):
            both[i].update(own.tolist())
        for i, own in enumerate(kept):
            for j in own.tolist():
                if kind != "layered" or len(both[j]) < most:
                    both[j].add(i)
        join_parts(x, both)
        return [nodes[sorted(b)] for b in both]

    def _level_of(self, ids: np.ndarray, fanout: int) -> np.ndarray:
        """The highest level of further rows, by the hash of the id: a level has one of ``fanout`` rows of the one below."""
        share = ((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)).astype(float) / 2.0**64
        top = np.floor(-np.log(np.maximum(share, 1e-300)) / np.log(fanout)).astype(int)
        return np.minimum(top, len(self.levels) - 1)

    def insert(self, ids: np.ndarray, vectors: np.ndarray, m: int = 16, ef: int = 64, clusters: np.ndarray | None = None, fanout: int = 16) -> "ShardGraph":
        """The graph with further rows; those whose id is there already are replaced.

        Rows go in by blocks.  On the lowest level a row is joined to diverse ones of the nearest that a walk finds and of its own block, on the
        levels above (as many as the hash of its id gives it) to those nearest of the level's nodes; a list that grows beyond its bound is
        thinned by the rule of the build."""
        out = self.remove(ids, m) if np.isin(ids, self.ids).any() else self
        vectors = vectors.astype(np.float32)
        own = np.zeros(len(ids), np.int32) if clusters is None else np.asarray(clusters, np.int32)
        for first in range(0, len(ids), INSERT_BLOCK):
            some = slice(first, first + INSERT_BLOCK)
            out = out._insert_block(ids[some].astype(np.int64), vectors[some], own[some], m, ef, fanout)
        return out

    def _insert_block(self, ids: np.ndarray, vectors: np.ndarray, clusters: np.ndarray, m: int, ef: int, fanout: int) -> "ShardGraph":
        n, k = len(self.ids), len(ids)
        if not n:
            return ShardGraph.build(ids, vectors, m, ef, clusters=clusters)
        every = np.concatenate([self.vectors, vectors])
        x, new = every.astype(float), np.arange(n, n + k)
        top = self._level_of(ids, fanout)
        levels = []
        for number, level in enumerate(self.levels):
            joining = new[top >= number]
            nodes = np.concatenate([level.nodes, joining])
            lists: dict[int, set[int]] = {int(a): set(level.near(int(a)).tolist()) for a in level.nodes}
            lists |= {int(a): set() for a in joining}
            most = m * (1 if number else 2)
            for a in joining.tolist():
                if number:
                    near = nodes[nodes != a]
                else:
                    cursor = Cursor(self, vectors[a - n], np.ones(n, bool), GraphOptions("plain", ef=ef)).open()
                    near = np.array([b for _, _, b in heapq.nsmallest(ef, cursor.found)] + [b for b in new.tolist() if b != a], np.int64)
                self._join(x, lists, a, near, max(1, most // 2), ef)
                for b in list(lists[a]):
                    lists[b].add(a)
                    if len(lists[b]) > most:
                        self._join(x, lists, b, np.array(sorted(lists[b]), np.int64), most, most + 1)
            levels.append((nodes, lists))
        total = n + k
        made = [Level.of(total, np.sort(nodes), [np.array(sorted(lists[int(a)]), np.int64) for a in np.sort(nodes)]) for nodes, lists in levels]
        return ShardGraph(np.concatenate([self.ids, ids]), every, made, np.concatenate([self.clusters, clusters]).astype(np.int32))

    @staticmethod
    def _join(x: np.ndarray, lists: dict[int, set[int]], a: int, near: np.ndarray, most: int, ef: int) -> None:
        """The neighbours of a: diverse ones of these."""
        if not len(near):
            return
        gap = ((x[near] - x[a]) ** 2).sum(1)
        by = np.lexsort((near, gap))[:ef]
        lists[a] = set(near[by][diverse(x, near[by][None], gap[by][None], most)[0]].tolist())

    def remove(self, ids: np.ndarray, m: int = 16) -> "ShardGraph":
        """The graph without these rows: what pointed to one is joined to the nearest and most diverse of what could be reached through it, and the rows' places are used again."""
        gone = np.isin(self.ids, ids)
        if not gone.any():
            return self
        place = np.cumsum(~gone) - 1
        x, total = self.vectors.astype(float), int((~gone).sum())
        levels: list[Level] = []
        for number, level in enumerate(self.levels):
            nodes = level.nodes[~gone[level.nodes]]
            if not len(nodes):
                break
            most, lists = m * (1 if number else 2), {}
            for a in nodes.tolist():
                near = level.near(a)
                lists[a] = set(near[~gone[near]].tolist())
                if len(lists[a]) < len(near):
                    reached, todo, passed = set(lists[a]), near[gone[near]].tolist(), set()
                    while todo and len(reached) < 4 * most:  # through removed rows only
                        c = todo.pop(0)
                        if c in passed:
                            continue
                        passed.add(c)
                        for b in level.near(c).tolist():
                            if gone[b]:
                                todo.append(b)
                            elif b != a:
                                reached.add(b)
                    self._join(x, lists, a, np.array(sorted(reached), np.int64), most, 4 * most)
            index = {a: i for i, a in enumerate(nodes.tolist())}
            both = [{index[b] for b in lists[a]} for a in nodes.tolist()]
            for i, near in enumerate(list(map(tuple, both))):
                for j in near:
                    if len(both[j]) < most:
                        both[j].add(i)
            join_parts(x[nodes], both)
            levels.append(Level.of(total, place[nodes], [place[nodes[sorted(b)]] for b in both]))
        if not levels:
            return ShardGraph(self.ids[:0], self.vectors[:0], [Level.of(0, np.zeros(0, np.int64), [])], self.clusters[:0])
        return ShardGraph(self.ids[~gone], self.vectors[~gone], levels, self.clusters[~gone])

    def near(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        gap = self.vectors[nodes] - q
        return np.einsum("ij,ij->i", gap, gap).astype(float)

    def entries(self, q: np.ndarray) -> list[int]:
        """Descent from the top level: on each the ``ENTRY_WIDTH`` nearest nodes that a walk finds, with which the next one begins."""
        if not len(self.levels[-1].nodes):
            return []
        at = [int(self.levels[-1].nodes[0])]
        for level in self.levels[:0:-1]:
            seen = set(at)
            frontier = list(zip(self.near(q, np.array(at)).tolist(), at))
            best = [(-d, n) for d, n in frontier]
            heapq.heapify(frontier)
            heapq.heapify(best)
            while frontier:
                d, node = heapq.heappop(frontier)
                if len(best) >= ENTRY_WIDTH and d > -best[0][0]:
                    break
                around = [n for n in level.near(node).tolist() if n not in seen]
                seen.update(around)
                for e, n in zip(self.near(q, np.array(around, np.int64)).tolist(), around):
                    if len(best) < ENTRY_WIDTH or e < -best[0][0]:
                        heapq.heappush(frontier, (e, n))
                        heapq.heappush(best, (-e, n))
                        if len(best) > ENTRY_WIDTH:
                            heapq.heappop(best)
            at = [n for _, n in best]
        return at

    def rows_of(self, cluster: int) -> np.ndarray:
        a, b = np.searchsorted(self.sorted_clusters, [cluster, cluster + 1])
        return self.by_cluster[a:b]


@dataclass
class Cursor:
    """A walk that can be taken up again: rows come out nearest first, in batches.

    ``open`` descends and walks once; ``more`` lets the bound on the frontier grow by ``step``
    and readmits what the smaller bound had turned away; ``next_batch`` and ``next`` hand rows out, None at the end.
    """

    graph: ShardGraph
    q: np.ndarray
    passing: np.ndarray
    options: GraphOptions
    ef: int = 0
    computed: int = 0
    frontier: list = field(default_factory=list)
    turned_away: list = field(default_factory=list)
    found: list = field(default_factory=list)
    dead_ends: list = field(default_factory=list)
    given: set = field(default_factory=set)

    def __post_init__(self) -> None:
        self.seen = np.zeros(len(self.graph.ids), bool)
        self.ef = self.options.ef
        self.best: list[float] = []  # the ef least distances found, the greatest first, negative
        self.total = int(np.count_nonzero(self.passing))
        self.most = np.inf  # distances after which a walk stops
        self.around = self.around_passing = 0  # neighbours of what the walk expanded, and how many of them pass

    def open(self) -> "Cursor":
        self.add(self.graph.entries(self.q))
        self.walk()
        return self

    def resume(self, nodes) -> "Cursor":
        """A walk that starts at given nodes instead of descending."""
        self.add(nodes)
        self.walk()
        return self

    def add(self, nodes, onward: int | None = None) -> int:
        """Puts the nearest ``onward`` of the nodes (all by default) on the frontier, and into the results all that pass; returns how many are new."""
        nodes = np.asarray(nodes, np.int64)
        nodes = np.unique(nodes[~self.seen[nodes]]) if len(nodes) else nodes
        if not len(nodes):
            return 0
        self.seen[nodes] = True
        self.computed += len(nodes)
        dist = self.graph.near(self.q, nodes)
        by = np.argsort(dist, kind="stable")  # of equal ones the least node first
        dist, order = dist[by].tolist(), nodes[by]
        for step in zip(dist[:onward], order[:onward].tolist()):
            heapq.heappush(self.frontier, step)
        for d, i, n, passes in zip(dist, self.graph.ids[order].tolist(), order.tolist(), self.passing[order].tolist()):
            if passes:
                self.found.append((d, i, n))
                if len(self.best) < self.ef:
                    heapq.heappush(self.best, -d)
                elif -d > self.best[0]:
                    heapq.heapreplace(self.best, -d)
        return len(nodes)

    def bound(self) -> float:
        """Distance of the ef-th best row that is found."""
        return -self.best[0] if len(self.best) >= self.ef else np.inf

    def reach(self, node: int) -> np.ndarray:
        """Nodes to look at from here."""
        level, how = self.graph.levels[0], self.options.how
        one = level.near(node)
        passes = self.passing[one]
        self.around += len(one)
        self.around_passing += int(np.count_nonzero(passes))
        if how in ("plain", "improving") or not len(one):
            return one
        share = passes.mean()
        if how == "one_hop":
            return one[passes] if passes.any() else one
        if how in ("two_hop", "directed", "in_place") and share > self.options.dense:
            return one
        over = one[~passes]
        if how == "directed" and len(over) and share * len(one) * len(one) > 4 * self.options.degree:
            # second hops under the nearest of those that don't pass are cheaper than under all
            over = over[np.argsort(self.graph.near(self.q, over))[: max(1, len(over) // 4)]]
            self.computed += len(over)
        two = [level.near(int(n)) for n in (one if how == "subgraph" else over)]
        two = np.unique(np.concatenate(two)) if two else one[:0]
        two = two[self.passing[two]]
        wanted = np.concatenate([one[passes], two])
        if how == "subgraph":
            return wanted[: 2 * self.options.degree] if len(wanted) else one
        if how == "in_place":
            wanted = wanted[: self.options.step]
        return wanted if len(wanted) else one  # nothing passes near: go on as plain

    def walk(self) -> None:
        self.around = self.around_passing = idle = 0
        while self.frontier and len(self.found) < self.total and self.computed < self.most:
            d, node = heapq.heappop(self.frontier)
            if d > self.bound():
                heapq.heappush(self.turned_away, (d, node))
                if not self.frontier or self.frontier[0][0] > self.bound():
                    break
                continue
            before, bound = len(self.found), self.bound()
            self.add(self.reach(node))
            if len(self.found) == before:
                self.dead_ends.append((d, node))
            idle = 0 if self.bound() < bound or bound == np.inf else idle + 1
            if self.options.how == "improving" and idle >= self.options.step:
                break
            if self.options.pull in LEAN and self.around >= 4 * self.options.step and self.share <= self.options.sparse:
                break  # hardly anything passes here: clusters tell more

    @property
    def share(self) -> float:
        """Of the neighbours of what the last walk expanded, those that pass."""
        return self.around_passing / self.around if self.around else 0.0

    @property
    def ended(self) -> bool:
        """Whether nothing is left to walk to, or all that passes is found."""
        return not self.frontier and not self.turned_away or len(self.found) >= self.total

    def more(self) -> None:
        self.ef += self.options.step
        self.best = [-d for d, *_ in heapq.nsmallest(self.ef, self.found)]
        heapq.heapify(self.best)
        for x in self.turned_away:
            heapq.heappush(self.frontier, x)
        self.turned_away = []
        self.walk()

    def next_batch(self) -> list[tuple[float, int]]:
        """The next ``step`` rows as (dist, id)."""
        while len(self.found) < len(self.given) + self.options.step and not self.ended:
            self.more()
        best = heapq.nsmallest(self.options.step, (f for f in self.found if f[2] not in self.given))
        self.given |= {n for _, _, n in best}
        return [(d, i) for d, i, _ in best]

    def __iter__(self) -> Iterator[tuple[float, int]]:
        while batch := self.next_batch():
            yield from batch

    def next(self) -> tuple[float, int] | None:
        self._rows = getattr(self, "_rows", None) or iter(self)
        return next(self._rows, None)

    def close(self) -> None:
        self.frontier, self.turned_away, self.found = [], [], []


@dataclass
class Effort:
    """Distances computed by the walk and for clusters' rows, clusters taken, rounds."""

    walked: int = 0
    scanned: int = 0
    clusters: int = 0
    rounds: int = 0


def cooperate(graph: ShardGraph, q: np.ndarray, passing: np.ndarray, k: int, o: GraphOptions, ranked: Iterator[tuple[float, int]]) -> tuple[list[tuple[float, int, int]], Effort]:
    """(dist, id, node) of passing rows, unordered, by the walk and by clusters (ranked: distance and number, nearest first), which exchange what they find."""
    effort, cursor = Effort(), Cursor(graph, q, passing, o)
    efs = max(o.efs or o.ef, k)
    inject = max(1, k // 2) if o.inject is None else o.inject
    cursor.most = 0 if cursor.total <= efs else cursor.total
    upcoming = next(ranked, None) if o.pull != "never" else None
    taken: set[int] = set()

    def take(cluster: int) -> int:
        if cluster in taken:
            return 0
        taken.add(cluster)
        rows = graph.rows_of(cluster)
        rows = rows[passing[rows] & ~cursor.seen[rows]]
        effort.clusters += 1
        effort.scanned += len(rows)
        before = cursor.computed
        cursor.add(rows, inject)
        cursor.computed = before
        return len(rows)

    def take_next() -> None:
        nonlocal upcoming
        got = 0
        while upcoming and got < o.nrel:
            got += take(upcoming[1])
            upcoming = next(ranked, None)

    if o.pull == "only" and cursor.most:
        return _of_clusters(graph, q, passing, efs, o.nrel, ranked)
    if o.pull != "only" and cursor.most:
        cursor.add(graph.entries(q))
    while True:
        effort.rounds += 1
        if cursor.computed >= cursor.most:  # scoring all that passes costs no more than what was spent
            rest = np.flatnonzero(passing & ~cursor.seen)
            before = cursor.computed
            cursor.add(rest)
            if o.pull == "only" or before:
                effort.scanned, cursor.computed = effort.scanned + len(rest), before
            break
        before = len(cursor.found)
        ahead = o.pull == "race" and upcoming and (not cursor.frontier or upcoming[0] < cursor.frontier[0][0])
        if o.pull != "only" and not ahead:
            cursor.walk() if effort.rounds == 1 else cursor.more()
        fresh, share = len(cursor.found) - before, cursor.share
        if o.pull == "dead_end":
            for _, node in sorted(cursor.dead_ends)[:inject]:
                take(int(graph.clusters[node]))
            cursor.dead_ends = []
        if ahead or o.pull in ("only", "always", "tree") or o.pull == "sparse" and (share <= o.sparse or not fresh) or o.pull in ("late", "dead_end") and (cursor.ended or len(cursor.found) < k and not fresh) or o.pull == "race" and cursor.ended:
            take_next()
        enough = o.pull == "only" or not cursor.frontier or cursor.frontier[0][0] > cursor.bound() or o.pull in LEAN and share <= o.sparse
        if len(cursor.found) >= efs and enough:
            break
        if not upcoming and (o.pull == "only" or cursor.ended) or len(cursor.found) >= cursor.total:
            break
    effort.walked = cursor.computed
    return cursor.found, effort


def _of_clusters(graph: ShardGraph, q: np.ndarray, passing: np.ndarray, efs: int, nrel: int, ranked: Iterator[tuple[float, int]]) -> tuple[list[tuple[float, int, int]], Effort]:
    """As cooperate() by clusters alone: what is taken doesn't turn on distances, so that these are computed at once."""
    effort, taken, parts, n = Effort(), set(), [], 0
    got = nrel
    for _, cluster in ranked:
        if got >= nrel:
            if n >= efs:
                break
            effort.rounds, got = effort.rounds + 1, 0
        if cluster not in taken:
            taken.add(cluster)
            rows = graph.rows_of(cluster)
            rows = rows[passing[rows]]
            parts.append(rows)
            n, got = n + len(rows), got + len(rows)
    rows = np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)
    effort.clusters, effort.scanned = len(taken), n
    return list(zip(graph.near(q, rows).tolist(), graph.ids[rows].tolist(), rows.tolist())), effort


def shards_for(base: DataFrame, shard_bytes: int = SHARD_BYTES) -> int:
    """As many shards as keep each at ``shard_bytes`` of vectors and ``SHARD_ROWS`` rows."""
    row = base.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    return max(1, -(-row["n"] * 4 * (row["dim"] or 1) // shard_bytes), -(-row["n"] // SHARD_ROWS))


def with_shards(base: DataFrame, shards: int) -> DataFrame:
    return base.where("embedding is not null").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))


def _floats(column: pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float32).reshape(n, -1)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Whole shards of rows that come sorted by the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shard = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and held[-1].column(0)[0].as_py() != int(shard[a]):
                yield held[-1].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[-1].column(0)[0].as_py(), pa.Table.from_batches(held)


def _packed(shard: int, shards: int, g: ShardGraph) -> pa.RecordBatch:
    parts = [g.ids.astype("<i8"), g.vectors.astype("<f4"), g.clusters.astype("<i4")]
    levels = [[np.ascontiguousarray(x, "<i4").tobytes() for x in (lv.nodes, lv.offsets, lv.targets)] for lv in g.levels]
    columns = [pa.array([shard], pa.int32()), pa.array([shards], pa.int32()), pa.array([len(g.ids)], pa.int32()), *[pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], pa.array([[x for lv in levels for x in lv]], pa.list_(pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, SHARD_NAMES)


SHARD_NAMES = ["shard", "shards", "n", "ids", "vectors", "clusters", "levels"]
SHARD_SCHEMA = "shard int, shards int, n int, ids binary, vectors binary, clusters binary, levels array<binary>"


def unpacked(n: int, ids: bytes, vectors: bytes, clusters: bytes, levels: list[bytes]) -> ShardGraph:
    x = [np.frombuffer(b, "<i4") for b in levels]
    return ShardGraph(np.frombuffer(ids, "<i8"), np.frombuffer(vectors, "<f4").reshape(n, -1), [Level(*x[i : i + 3]) for i in range(0, len(x), 3)], np.frombuffer(clusters, "<i4"))


def build_shards(base: DataFrame, shards: int | None = None, m: int = 16, ef: int = 64, kind: str = "layered", gamma: int = 4) -> DataFrame:
    """One row a shard: its graph, with the rows' clusters if the base has a column of that name.  shards: so many at least; a shard, which one task builds and
    walks, doesn't grow with the base."""
    shards = max(shards or 1, shards_for(base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            ids = np.asarray(rows.column("id"), np.int64)
            graph = ShardGraph.build(ids, _floats(rows.column("v"), len(ids)), m, ef, kind=kind, gamma=gamma, clusters=np.asarray(rows.column("cluster"), np.int32))
            yield _packed(shard, shards, graph)

    cluster = F.col("cluster").cast("int") if "cluster" in base.columns else F.lit(0)
    dealt = with_shards(base, shards).select("shard", "id", F.col("embedding").cast("array<float>").alias("v"), cluster.alias("cluster"))
    return dealt.repartition("shard").sortWithinPartitions("shard", "id").mapInArrow(run, SHARD_SCHEMA)


def insert_rows(shards: DataFrame, rows: DataFrame, m: int = 16, ef: int = 64) -> DataFrame:
    """The shards with further rows (id, embedding, and cluster if there is one), which replace those of the same id."""
    n = shards.select("shards").first()["shards"]
    cluster = F.col("cluster").cast("int") if "cluster" in rows.columns else F.lit(0)
    new = with_shards(rows, n).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("id", F.col("embedding").cast("array<float>").alias("v"), cluster.alias("cluster")))).alias("new"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                graph = unpacked(row["n"], row["ids"], row["vectors"], row["clusters"], row["levels"])
                if row["new"]:
                    graph = graph.insert(np.array([x["id"] for x in row["new"]]), np.array([x["v"] for x in row["new"]], np.float32), m, ef, np.array([x["cluster"] for x in row["new"]], np.int32))
                yield _packed(row["shard"], n, graph)

    return shards.join(new, "shard", "left").mapInArrow(run, SHARD_SCHEMA)


def remove_rows(shards: DataFrame, rows: DataFrame, m: int = 16) -> DataFrame:
    """The shards without the rows whose id is in ``rows``, their graphs mended; a shard without rows is dropped."""
    first = shards.select("shards").first()
    n = first["shards"] if first else 1
    shard = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("shard")
    old = rows.select(shard, "id").distinct().groupBy("shard").agg(F.collect_list("id").alias("old"))  # a shard's rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                graph = unpacked(row["n"], row["ids"], row["vectors"], row["clusters"], row["levels"])
                graph = graph.remove(np.array(row["old"], np.int64), m) if row["old"] else graph
                if len(graph.ids):
                    yield _packed(row["shard"], n, graph)

    # ids that the shards don't hold would make the lists longer than a shard
    return shards.join(old, "shard", "left").mapInArrow(run, SHARD_SCHEMA)


def edges_of(shards: DataFrame) -> DataFrame:
    """Edges (shard, level, id, neighbors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = unpacked(row["n"], row["ids"], row["vectors"], row["clusters"], row["levels"])
                for level, lv in enumerate(g.levels):
                    size = len(lv.nodes)
                    lists = [g.ids[x] for x in lv.lists()]
                    offsets = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
                    flat = pa.array(np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * size, pa.int32()), pa.array([level] * size, pa.int32()), pa.array(g.ids[lv.nodes]), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["shard", "level", "id", "neighbors"])

    return shards.mapInArrow(run, "shard int, level int, id long, neighbors array<long>")


def build_graph(base: DataFrame, shards: int | None = None, m: int = 16, ef: int = 64, kind: str = "layered") -> DataFrame:
    return edges_of(build_shards(base, shards, m, ef, kind))


def passing_ids(base: DataFrame, queries: DataFrame, predicate: Predicate | None, shards: int) -> DataFrame:
    """shard, passing (of each query, or of null for all queries: the ids of the base's rows that pass).

    Only ids are shuffled; a shard's row of the result holds at most a shard's ids for each query of a block."""
    rows = with_shards(base, shards)
    if predicate and predicate.per_query:
        met = rows.drop("embedding").join(F.broadcast(queries.drop("q")), predicate.column()).select("shard", "qid", "id")
    else:
        met = (rows.where(predicate.column()) if predicate else rows).select("shard", F.lit(None).cast("long").alias("qid"), "id")
    return met.groupBy("shard", "qid").agg(F.collect_list("id").alias("ids")).groupBy("shard").agg(F.collect_list(F.struct("qid", "ids")).alias("passing"))


def walk(base: DataFrame | None, shards: DataFrame, queries: DataFrame, k: int, predicate: Predicate | None = None, options: GraphOptions = GraphOptions(), centroids: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """qid, id, dist of k rows or more a query and shard, and a row a query and shard with the walk's effort (walked, scanned, clusters,
    rounds), whose id is null.  Squared L2 only.

    base: the attributes, from which the predicate is worked out, and the rows that there are (None: all rows of the shards, without a predicate);
    members: instead of a predicate, (qid, id) of what passes; centroids: (cluster, centroid) for options that take clusters."""
    n = shards.select("shards").first()
    parts = []
    for block in query_blocks(queries):
        size = block.count()
        lots = max(1, -(-size // QUERIES_AT_ONCE)) if predicate and predicate.per_query and not _by_attributes(base, block, predicate) or members is not None else 1
        for i in range(lots):
            some = block.where(F.pmod(F.xxhash64("qid"), F.lit(lots)) == i) if lots > 1 else block
            parts.append(_walk_block(base, shards, some, k, predicate, options, centroids, members, n["shards"] if n else 1))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _by_attributes(base: DataFrame | None, queries: DataFrame, predicate: Predicate | None) -> bool:
    """Whether a shard can tell from its rows' attributes what passes for each query."""
    return bool(base is not None and predicate and predicate.per_query and blocks.usable(base, queries, predicate))


def _reached(offsets: np.ndarray, targets: np.ndarray) -> bool:
    """Whether every node is reached from the first."""
    seen = np.zeros(len(offsets) - 1, bool)
    front = np.zeros(min(1, len(seen)), np.int64)
    while len(front):
        seen[front] = True
        size = offsets[front + 1] - offsets[front]
        at = np.repeat(offsets[front] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        front = np.unique(targets[at])
        front = front[~seen[front]]
    return bool(seen.all())


def finds_all(graph: ShardGraph, o: GraphOptions, clusters: np.ndarray) -> bool:
    """Whether a search without a bound ends with every row that passes, whatever the query: if clusters that it takes hold all rows, or each node is
    reached from each other one."""
    n = len(graph.ids)
    if o.how != "plain" or (o.efs or o.ef) < n or not (np.abs(graph.vectors) <= blocks.LARGEST).all():
        return False
    if o.pull != "never" and np.isin(graph.clusters, clusters).all():
        return True
    if o.pull == "only":
        return False
    offsets, targets = graph.levels[0].offsets.astype(np.int64), graph.levels[0].targets.astype(np.int64)
    into = np.repeat(np.arange(n), np.diff(offsets))[np.argsort(targets, kind="stable")]
    return _reached(offsets, targets) and _reached(np.append(0, np.cumsum(np.bincount(targets, minlength=n))), into)


def _walk_block(base, shards, block, k, predicate, options, centroids, members, n_shards) -> DataFrame:
    spark = shards.sparkSession
    tree, parts = shared_parts(predicate.tree) if _by_attributes(base, block, predicate) else (None, {})
    attributes, asked = sorted({a for a, _ in compared(tree)}), sorted({c for _, c in compared(tree)})
    held = block.where(F.col("q").isNotNull()).select("qid", F.col("q").cast("array<float>").alias("q"), *[blocks._number(block, c).alias(f"c_{c}") for c in asked]).toArrow()  # BROADCAST_BYTES at most
    own = blocks.Queries(held, tree, False)
    qid = np.asarray(held.column("qid"), np.int64)
    q = _floats(held.column("q"), len(qid)) if len(qid) else np.zeros((0, 1), np.float32)
    numbers, centres, over = np.zeros(0, np.int32), np.zeros((0, q.shape[1]), np.float32), None
    if options.pull != "never":
        table = centroids.select(F.col("cluster").cast("int").alias("cluster"), F.col("centroid").cast("array<float>").alias("v")).toArrow()  # MOST_CLUSTERS at most, by ivf.train
        numbers, centres = np.asarray(table.column("cluster"), np.int32), _floats(table.column("v"), table.num_rows)
        if options.rank == "graph" and 1 < len(numbers) <= MOST_RANKED:
            over = ShardGraph.build(numbers.astype(np.int64), centres, m=8, ef=32)
    shared = spark.sparkContext.broadcast((qid, q, numbers, centres, over, own))
    every = base is None and members is None
    # few shards are walked by several tasks each, which share the queries
    lots = min(-(-len(qid) // QUERIES_AT_ONCE), -(-2 * spark.sparkContext.defaultParallelism // n_shards)) if max(options.efs, options.ef) < SHARD_ROWS else 1
    share = max(1, -(-len(qid) // max(1, lots)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q, numbers, centres, over, own = shared.value
        orders: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def ranked(i: int) -> Iterator[tuple[float, int]]:
            """Clusters for query i, nearest first."""
            if over is not None:
                return iter(Cursor(over, q[i], np.ones(len(numbers), bool), GraphOptions("plain", ef=16)).open())
            if (order := orders.get(i)) is None:
                d = ((centres - q[i]) ** 2).sum(1)
                by = np.lexsort((numbers, d))
                order = d[by], numbers[by]
                if (len(orders) + 1) * len(numbers) <= RANKS_KEPT:
                    orders[i] = order
            return ((float(d), int(c)) for d, c in zip(*order))

        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(j)[at] for j, name in enumerate(batch.schema.names)}
                graph = unpacked(row["n"].as_py(), *(row[c].as_py() for c in ("ids", "vectors", "clusters", "levels")))
                masks: dict[int | None, np.ndarray] = {}
                if every:
                    masks[None] = graph.ids != np.iinfo(np.int64).min
                elif tree is not None:
                    told, there = _told(graph, row["passing"].values, [*attributes, *parts])
                elif row["passing"].is_valid:
                    for p in row["passing"].values:
                        masks[p["qid"].as_py()] = np.isin(graph.ids, np.asarray(p["ids"].values, np.int64))
                found: list[tuple[np.ndarray, ...]] = []
                efforts: list[tuple] = []
                whole = finds_all(graph, options, numbers)
                few = None in masks and 0 < np.count_nonzero(masks[None]) <= max(options.efs or options.ef, k) and bool((np.abs(graph.vectors) <= blocks.LARGEST).all())
                n_scored = len(graph.ids) if whole or not few else np.count_nonzero(masks[None])
                effort = Effort(*((0, n_scored) if options.pull == "only" else (n_scored, 0)), 0, 1)  # of a search that scores the whole shard, or all that passes
                lot = row["lot"].as_py()
                near = walks.padded(graph.levels[0]) if not whole and walks.usable(graph, options) else None
                waiting: list[tuple[int, np.ndarray]] = []

                def walk_all() -> None:
                    """The searches that wait, all at once."""
                    at = np.array([i for i, _ in waiting])
                    passing = waiting[0][1][None] if tree is None and None in masks else np.stack([m for _, m in waiting])
                    done = walks.cooperate_all(graph, near, q[at], passing, k, options, lambda j: ranked(int(at[j])))
                    size = [len(nodes) for nodes, _ in done]
                    best, who = np.concatenate([nodes for nodes, _ in done]), np.repeat(at, size)
                    efforts.extend((int(qid[i]), e.walked, e.scanned, e.clusters, e.rounds) for i, (_, e) in zip(at, done))
                    found.append((qid[who], graph.ids[best], folded_distance("l2sq", graph.vectors[best], q[who])))
                    waiting.clear()

                if own.count and not len(own.odd) and ((tree is not None or None in masks) and whole or few):
                    if lot:
                        continue
                    at = np.flatnonzero(there if tree is not None else masks[None])
                    best = blocks.Best(own, k, "l2sq")
                    if len(at):
                        best.search(blocks.Rows(graph.ids[at], graph.vectors[at].astype(float), {} if tree is None else {n: a[at] for n, a in told.items()}, True), tree, None)
                        who, which, dist = best.found()
                        found.append((qid[who], which, dist))
                        efforts += [(name, effort.walked, effort.scanned, effort.clusters, effort.rounds) for name in qid.tolist()]
                first = lot * share
                for i, name in enumerate(qid[first : first + share].tolist() if not efforts else [], first):
                    if tree is not None:
                        if (i - first) % QUERIES_AT_ONCE == 0:
                            tile = blocks.mask_of(tree, told, own.numbers, np.arange(i, min(i + QUERIES_AT_ONCE, len(qid)))) & there[None, :]
                        masks = {None: tile[(i - first) % QUERIES_AT_ONCE]}
                    mask = masks.get(name, masks.get(None))
                    if mask is None or not mask.any():
                        continue
                    if near is not None and (np.abs(q[i]) <= blocks.LARGEST).all():
                        waiting.append((i, mask))
                        if len(waiting) == walks.WALKS_AT_ONCE:
                            walk_all()
                        continue
                    if whole and np.isfinite(q[i]).all():
                        e, at = effort, np.flatnonzero(mask)
                        best = at[np.lexsort((graph.ids[at], graph.near(q[i], at)))[: 2 * k]]
                    else:
                        rows, e = cooperate(graph, q[i], mask, k, options, ranked(i))
                        best = np.array([x for _, _, x in heapq.nsmallest(2 * k, rows)], np.int64)
                    efforts.append((name, e.walked, e.scanned, e.clusters, e.rounds))
                    found.append((np.full(len(best), name), graph.ids[best], folded_distance("l2sq", graph.vectors[best], np.repeat(q[i : i + 1], len(best), 0))))
                if waiting:
                    walk_all()
                if efforts:
                    whos, which, dist = (np.concatenate(c) for c in zip(*found))
                    e = list(zip(*efforts))
                    gap = len(whos)
                    cols = [pa.array(np.append(whos, e[0])), pa.array([*which.tolist(), *[None] * len(efforts)], pa.int64()), pa.array([*dist.tolist(), *[None] * len(efforts)], pa.float64())]
                    cols += [pa.array([*[None] * gap, *c], pa.int64()) for c in e[1:]]
                    yield pa.RecordBatch.from_arrays(cols, ["qid", "id", "dist", "walked", "scanned", "clusters", "rounds"])

    if members is not None:
        inside = members.select(F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int").alias("shard"), "qid", "id").join(F.broadcast(block.select("qid")), "qid", "left_semi").distinct()
        passing = inside.groupBy("shard", "qid").agg(F.collect_list("id").alias("ids")).groupBy("shard").agg(F.collect_list(F.struct("qid", "ids")).alias("passing"))
    elif tree is not None:
        known = with_shards(base, n_shards).select("shard", F.struct("id", *[blocks._number(base, a).alias(f"a_{a}") for a in attributes], *[p.column().alias(f"a_{n}") for n, p in parts.items()]).alias("row"))
        passing = known.groupBy("shard").agg(F.collect_list("row").alias("passing"))  # a shard's rows at most
    elif not every:
        passing = passing_ids(base, block, predicate, n_shards)
    rows = shards.select("shard", "n", "ids", "vectors", "clusters", "levels")
    rows = rows if every else rows.join(passing, "shard")
    rows = rows.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).repartition(n_shards * lots, "shard", "lot") if lots > 1 else rows.withColumn("lot", F.lit(0))
    return rows.mapInArrow(run, "qid long, id long, dist double, walked long, scanned long, clusters long, rounds long")


def _told(graph: ShardGraph, rows: pa.StructArray, names: list[str]) -> tuple[dict[str, blocks.Numbers], np.ndarray]:
    """Attributes of the shard's rows, in its order, and which of its rows there are."""
    ids = rows.field("id").to_numpy(zero_copy_only=False)
    by = np.argsort(ids)
    at = by[np.minimum(np.searchsorted(ids[by], graph.ids), len(ids) - 1)]
    return {n: blocks.Numbers.of(rows.field(f"a_{n}"))[at] for n in names}, ids[at] == graph.ids


def nearest(walked: DataFrame, k: int) -> DataFrame:
    """qid, rank, id, dist of what walk() returned."""
    return top_k(walked.where("id is not null").select("qid", "id", "dist").distinct(), k)


def comparisons(walked: DataFrame) -> DataFrame:
    """qid, walked, scanned (distances computed by walks and for clusters' rows), clusters, rounds, shards."""
    return walked.where("id is null").groupBy("qid").agg(*[F.sum(c).alias(c) for c in ("walked", "scanned", "clusters", "rounds")], F.count("*").alias("shards"))


def search(base: DataFrame | None, shards: DataFrame, queries: DataFrame, k: int, predicate: Predicate | None = None, options: GraphOptions = GraphOptions(), centroids: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """k nearest passing rows of each query (qid, rank, id, dist), by the shards' graphs; for the rest see walk()."""
    return nearest(walk(base, shards, queries, k, predicate, options, centroids, members), k)


def inbound_degree(edges: DataFrame) -> DataFrame:
    """level, id, n_in of every node, 0 included."""
    into = edges.select("level", F.explode("neighbors").alias("id")).groupBy("level", "id").agg(F.count("*").alias("n_in"))
    return edges.select("level", "id").join(into, ["level", "id"], "left").select("level", "id", F.coalesce("n_in", F.lit(0)).alias("n_in"))


def degree_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("level", F.size("neighbors").alias("degree")).agg(F.count("*").alias("n"))
