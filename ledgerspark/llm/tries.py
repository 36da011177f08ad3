"""Prefix trees of ordered sets, and the search for sets of a least overlap in them."""

from __future__ import annotations

import numpy as np

from .kernels import ranges


class Trie:
    """Sets whose members stand in one global order; equal beginnings share a path.

    Nodes stand level by level. A node has the range of sets below it (in path
    order), the run of members on the edge that leads to it, the least full size
    of its sets and the most members that are still to come below it.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        length = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        self.members, ids = np.unique(flat, return_inverse=True)
        begin = np.cumsum(length) - length
        path = ids.astype(">u4")
        order = sorted(range(len(sets)), key=lambda i: path[begin[i] : begin[i] + length[i]].tobytes())
        self.order = np.array(order)
        begin, length, sizes = begin[order], length[order], sizes[order]
        common = np.zeros(len(order), np.int64)
        for i in range(1, len(order)):
            n = int(min(length[i - 1], length[i]))
            differ = np.flatnonzero(ids[begin[i - 1] : begin[i - 1] + n] != ids[begin[i] : begin[i] + n])
            common[i] = differ[0] if len(differ) else n
        nodes, first, count = [(0, len(order), 0)], [], []
        depth = []
        for lo, hi, _ in nodes:  # grows while it is gone through: level by level
            end = int(length[lo]) if hi - lo == 1 else int(common[lo + 1 : hi].min())
            depth.append(end)
            first.append(len(nodes))
            if hi - lo > 1:
                cuts = [lo, *(lo + 1 + np.flatnonzero(common[lo + 1 : hi] == end)).tolist(), hi]
                nodes += [(a, b, end) for a, b in zip(cuts, cuts[1:])]
            count.append(len(nodes) - first[-1])
        self.lo, self.hi, start = np.array(nodes).T
        self.first, self.count = np.array(first), np.array(count)
        self.edge, self.span = begin[self.lo] + start, np.array(depth) - start
        self.ids = ids
        self.least = np.array([sizes[a:b].min() for a, b in zip(self.lo, self.hi)])
        self.rest = np.array([length[a:b].max() for a, b in zip(self.lo, self.hi)]) - depth

    def similar(self, members: np.ndarray, size: int, percent: int, skip: np.ndarray) -> np.ndarray:
        """Sets that have percent of the union in common with the given one, which has size members of
        which these can be shared; without those that skip marks.

        Goes down level by level with the overlap that a path has so far; a
        subtree is left where what remains on both sides cannot reach the need.
        """
        mine = np.zeros(len(self.members), bool)
        at = np.searchsorted(self.members, members)
        at[at == len(self.members)] = 0
        mine[at[self.members[at] == members]] = True
        wanted = np.concatenate(([0], np.cumsum(~skip[self.order])))
        found = []
        node, shared = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(node):
            on = wanted[self.hi[node]] > wanted[self.lo[node]]
            node, shared = node[on], shared[on]
            span = self.span[node]
            steps = np.concatenate(([0], np.cumsum(mine[self.ids[ranges(self.edge[node], span)]])))
            ends = np.cumsum(span)
            shared = shared + steps[ends] - steps[ends - span]
            need = -(-percent * (self.least[node] + size) // (100 + percent))
            on = shared + np.minimum(self.rest[node], len(members) - shared) >= need
            node, shared = node[on], shared[on]
            count = self.count[node]
            leaf = count == 0
            found.append(self.lo[node[leaf]])
            node, shared = ranges(self.first[node], count), np.repeat(shared, count)
        found = self.order[np.concatenate(found)]
        return found[~skip[found]]


def link(stored: list[tuple], probes, percent: int, both: bool) -> list[tuple]:
    """(name, name) of similar sets that join classes not yet joined. stored and probes hold tuples
    (name, class, size, members); both: the stored sets are the probes.

    A class that a set is in already is skipped, so groups of near copies are not
    expanded into pairs; classes that a similar pair joins are one from then on.
    """
    trie = Trie([s[3] for s in stored], np.array([s[2] for s in stored]))
    number: dict = {}
    own = np.array([number.setdefault(s[1], len(number)) for s in stored])
    out = []
    for at in trie.order.tolist() if both else range(len(probes)):
        name, kind, size, members = stored[at] if both else probes[at]
        root = int(own[at]) if both else number.get(kind, -1)
        if root == -1:
            root = number[kind] = len(number) + len(stored)
        for i in trie.similar(members, size, percent, own == root).tolist():
            if own[i] != root:
                out.append((name, stored[i][0]))
                old = own[i]
                own[own == old] = root
                if not both:
                    for k, v in number.items():
                        if v == old:
                            number[k] = root
    return out
