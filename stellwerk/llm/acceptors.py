"""Words one edit apart, by composing a minimised acceptor, a one-edit transducer and the acceptor again.

Words are Latin-1 bytes, sorted and distinct. The tree of their prefixes is the acceptor before minimisation; nodes with
the same right language form one state. The transducer copies letters, replaces, inserts or deletes one, and copies
again. Before the edit both acceptors are in the same node; after it the composition is in a pair of states from which
both must read the same rest. Pairs of states that cannot are found once, on the minimised acceptor, and never entered when
the accepted pairs of words are enumerated. All steps are array operations over whole levels.

The edit of a pair is taken at the first letter in which the words differ, so each pair is accepted once.
"""

from __future__ import annotations

import numpy as np


class Acceptor:
    """The tree of sorted distinct words, level by level, and the state (right language) of each node.

    parent, char: of each node; children of u are first[u] to first[u + 1]; word: the word that ends in a node, or -1;
    below: the first word below a node; depth, state; head: one node of each state.
    """

    def __init__(self, words: list[bytes]):
        flat = np.frombuffer(b"".join(words), np.uint8)
        length = np.array([len(w) for w in words], np.int64)
        start = np.cumsum(length) - length
        node = np.zeros(len(words), np.int64)
        parents, chars, belows, depths, nodes = [np.array([-1])], [np.array([0])], [np.array([0])], [0], 1
        self.levels = [0, 1]
        active = np.flatnonzero(length > 0)
        while len(active):
            up, letter = node[active], flat[start[active] + len(depths) - 1].astype(np.int64)
            new = np.ones(len(active), bool)
            new[1:] = (up[1:] != up[:-1]) | (letter[1:] != letter[:-1])
            node[active] = nodes + np.cumsum(new) - 1
            parents.append(up[new])
            chars.append(letter[new])
            belows.append(active[new])
            depths.append(len(depths))
            nodes += int(new.sum())
            self.levels.append(nodes)
            active = active[length[active] > len(depths) - 1]
        self.parent, self.char, self.below = np.concatenate(parents), np.concatenate(chars), np.concatenate(belows)
        self.depth = np.repeat(np.arange(len(depths)), np.diff(self.levels))
        self.first = np.searchsorted(self.parent, np.arange(nodes + 1))
        self.arc = self.parent * 256 + self.char
        self.word = np.full(nodes, -1)
        self.word[node] = np.arange(len(words))
        self._minimise()

    def _minimise(self) -> None:
        """States by height: nodes are alike if both are final or not and have equal arcs to equal states."""
        height = np.zeros(len(self.parent), np.int64)
        self.nearest = np.where(self.word >= 0, 0, 1 << 40)
        for lo, hi in reversed(list(zip(self.levels[1:-1], self.levels[2:], strict=True))):
            np.maximum.at(height, self.parent[lo:hi], height[lo:hi] + 1)
            np.minimum.at(self.nearest, self.parent[lo:hi], self.nearest[lo:hi] + 1)
        degree = np.diff(self.first)
        self.state = np.zeros(len(self.parent), np.int64)
        order = np.lexsort((degree, height))
        cuts = np.flatnonzero(np.diff(height[order]) | np.diff(degree[order])) + 1
        self.states = 0
        for own in np.split(order, cuts):
            key = (self.word[own] >= 0).astype(np.int64)
            for k in range(degree[own[0]]):
                child = self.first[own] + k
                key = np.unique((key * 256 + self.char[child]) * (self.states + 1) + self.state[child], return_inverse=True)[1]
            _, key = np.unique(key, return_inverse=True)
            self.state[own] = self.states + key
            self.states += int(key.max(initial=-1)) + 1
        self.head = np.zeros(self.states, np.int64)
        self.head[self.state] = np.arange(len(self.state))

    def child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child by that letter, or -1."""
        wanted = node * 256 + char
        at = np.minimum(np.searchsorted(self.arc, wanted), len(self.arc) - 1)
        return np.where((self.arc[at] == wanted) & (node >= 0), at, -1)

    def together(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All children of u and v by the same letter, with the place of the pair that they come from."""
        n = self.first[u + 1] - self.first[u]
        origin = np.repeat(np.arange(len(u)), n)
        x = np.repeat(self.first[u], n) + np.arange(len(origin)) - np.repeat(np.cumsum(n) - n, n)
        y = self.child(v[origin], self.char[x])
        both = y >= 0
        return x[both], y[both], origin[both]


def _edited(a: Acceptor, least_depth: np.ndarray, rest: int | None) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Pairs of nodes right after an edit, and the pairs of words that end there already.

    least_depth: for each word, the depth from which it may be edited; rest: the most letters after the edit.
    """
    allowed = a.depth >= least_depth[a.below]
    near = a.nearest <= (1 << 39 if rest is None else rest)
    #: Replaced: two children of one node.
    kids = np.flatnonzero(allowed[a.parent] & near & (a.parent >= 0))
    later = np.searchsorted(a.parent[kids], a.parent[kids], side="right") - np.arange(len(kids)) - 1
    u = np.repeat(np.arange(len(kids)), later)
    v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(later) - later, later)
    pairs_u, pairs_v = [kids[u]], [kids[v]]
    #: Deleted: what follows the letter, beside the same letter of the node itself, which is not the deleted one.
    w = np.flatnonzero(a.depth >= 2)
    up = a.parent[w]
    q = a.parent[up]
    w = w[allowed[q] & (a.nearest[w] <= (1 << 39 if rest is None else rest - 1)) & (a.char[w] != a.char[up])]
    v = a.child(a.parent[a.parent[w]], a.char[w])
    pairs_u.append(w[v >= 0])
    pairs_v.append(v[v >= 0])
    ends = np.flatnonzero((a.word >= 0) & (a.parent >= 0))
    ends = ends[allowed[a.parent[ends]] & (a.word[a.parent[ends]] >= 0)]
    return np.concatenate(pairs_u), np.concatenate(pairs_v), [(a.word[ends], a.word[a.parent[ends]])]


def _alive(a: Acceptor, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Sorted keys of the pairs of different states, met from the pairs of nodes, that have a word in common."""
    wide = a.states + 1

    def keys(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        s, t = a.state[u], a.state[v]
        return np.minimum(s, t) * wide + np.maximum(s, t)

    new = np.unique(keys(u, v))
    seen, sources, targets = new, [], []
    while len(new):
        new = new[new // wide != new % wide]
        x, y, origin = a.together(a.head[new // wide], a.head[new % wide])
        found = keys(x, y)
        sources.append(new[origin])
        targets.append(found)
        new = np.setdiff1d(found, seen)
        seen = np.union1d(seen, new)
    final = a.word[a.head] >= 0
    s, t = seen // wide, seen % wide
    alive = (s == t) | (final[s] & final[t])
    if sources:
        source, target = np.searchsorted(seen, np.concatenate(sources)), np.searchsorted(seen, np.concatenate(targets))
        while True:
            more = source[alive[target] & ~alive[source]]
            if not len(more):
                break
            alive[more] = True
    return seen[alive]


def near_pairs(words: list[bytes], least_depth: np.ndarray, rest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that differ by one edit, each pair once; edits from least_depth on, with at most `rest` letters after them."""
    if len(words) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = Acceptor(words)
    u, v, found = _edited(a, least_depth, rest)
    alive, wide = _alive(a, u, v), a.states + 1

    def going(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        s, t = a.state[u], a.state[v]
        key = np.minimum(s, t) * wide + np.maximum(s, t)
        at = np.minimum(np.searchsorted(alive, key), max(len(alive) - 1, 0))
        return (s == t) | (alive[at] == key) if len(alive) else s == t

    while len(u):
        on = going(u, v)
        u, v = u[on], v[on]
        both = (a.word[u] >= 0) & (a.word[v] >= 0)
        found.append((a.word[u[both]], a.word[v[both]]))
        u, v, _ = a.together(u, v)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
