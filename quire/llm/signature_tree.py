"""Signature trees: which pairs of sets can be similar, by token bitmaps and size ranges.

Sets are sorted by size; a leaf has up to LEAF neighbours and a node above it up to FANOUT
nodes, each with the OR of its sets' bitmaps, its range of sizes and its largest
slack (a set's size minus the bits of its bitmap). Two sets x and y have at most
slack(x) + |bits(x) AND bits(y)| members in common, so two nodes whose largest
possible overlap is too small for their smallest sizes hold no similar pair, and
a traversal of the tree against itself leaves them out. It leaves out two nodes
as well that lie in one class already: what is asked for are the classes that links make.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

LEAF = 32
FANOUT = 8
#: 64-bit words of the smallest bitmap, and bits for each token.
LEAST_WORDS, BITS = 4, 2


def bitmap_words(n: int) -> int:
    """64-bit words of a bitmap for n tokens: at least BITS for each, a power of two."""
    return max(LEAST_WORDS, 1 << max(0, (BITS * n - 1).bit_length() - 6))


def bitmap(tokens: np.ndarray) -> np.ndarray:
    words = np.zeros(bitmap_words(len(tokens)), np.uint64)
    at = tokens & np.uint64(64 * len(words) - 1)
    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return words


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of words) as narrower ones: a token's bit is its hash modulo the width."""
    if words.shape[1] == width:
        return words
    return np.bitwise_or.reduce(words.reshape(len(words), -1, width), axis=1)


def possible(percent: int, a: np.ndarray, b: np.ndarray, overlap: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b may have a Jaccard similarity of `percent` with at most `overlap` members in common."""
    return (100 + percent) * np.minimum(overlap, np.minimum(a, b)) >= percent * (a + b)


class Sets:
    """Sets as a tree sees them. `last` is the place in the order of tokens up to which a bitmap shows a set's tokens; whole sets have the largest."""

    def __init__(self, n: np.ndarray, last: np.ndarray, bits: list[np.ndarray]):
        self.n, self.last, self.bits = n.astype(np.int64), last, bits

    def take(self, rows: np.ndarray) -> Sets:
        return Sets(self.n[rows], self.last[rows], [self.bits[k] for k in rows.tolist()])

    def leaf(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        own = self.bits[low:high]
        width = min(len(x) for x in own)
        words = np.vstack([folded(x[None, :], width) for x in own])
        return self.n[low:high], self.last[low:high], words, self.n[low:high] - np.bitwise_count(words).sum(axis=1, dtype=np.int64)


def pairs_possible(percent: int, a: tuple, b: tuple) -> np.ndarray:
    """A matrix: which of the sets of leaf a may be similar to which of leaf b."""
    (n_a, last_a, words_a, slack_a), (n_b, last_b, words_b, slack_b) = a, b
    width = min(words_a.shape[1], words_b.shape[1])
    if words_a.shape[1] != width:
        words_a = folded(words_a, width)
        slack_a = n_a - np.bitwise_count(words_a).sum(axis=1, dtype=np.int64)
    if words_b.shape[1] != width:
        words_b = folded(words_b, width)
        slack_b = n_b - np.bitwise_count(words_b).sum(axis=1, dtype=np.int64)
    both = np.bitwise_count(words_a[:, None, :] & words_b[None, :, :]).sum(axis=2, dtype=np.int64)
    # The set whose bitmap ends first: the other's shows all that it can share.
    slack = np.where(last_a[:, None] <= last_b[None, :], slack_a[:, None], slack_b[None, :])
    return possible(percent, n_a[:, None], n_b[None, :], both + slack)


class SignatureTree:
    def __init__(self, sets: Sets):
        """`sets` are in ascending order of size."""
        self.sets, total = sets, len(sets.n)
        # Bitmaps widen with the sets; a leaf has those of one width, so that none is folded for a smaller neighbour.
        widths = np.array([len(x) for x in sets.bits])
        bounds = [0, *(np.flatnonzero(np.diff(widths)) + 1).tolist(), total]
        spans = [(k, min(k + LEAF, high)) for low, high in zip(bounds, bounds[1:], strict=False) for k in range(low, high, LEAF)]
        self.leaves = [sets.leaf(low, high) for low, high in spans]
        nodes = [(low, high, np.bitwise_or.reduce(x[2], axis=0), int(x[3].max())) for (low, high), x in zip(spans, self.leaves, strict=True)]
        self.levels = [nodes]
        while len(nodes) > 1:
            nodes = [self.above(nodes[k : k + FANOUT]) for k in range(0, len(nodes), FANOUT)]
            self.levels.append(nodes)

    @staticmethod
    def above(nodes: list[tuple]) -> tuple:
        """From nodes of one width their OR and largest slack; nodes of several widths have no bitmap."""
        same = all(x[2] is not None and len(x[2]) == len(nodes[0][2]) for x in nodes) if nodes[0][2] is not None else False
        words = np.bitwise_or.reduce(np.vstack([x[2] for x in nodes]), axis=0) if same else None
        return nodes[0][0], nodes[-1][1], words, max(x[3] for x in nodes)

    def may_meet(self, percent: int, a: tuple, b: tuple) -> bool:
        """Whether a set of node a may be similar to one of node b, which is not before a."""
        n = self.sets.n
        least_a, most_a, least_b, most_b = n[a[0]], n[a[1] - 1], n[b[0]], n[b[1] - 1]
        if (100 + percent) * most_a < percent * (most_a + max(least_b, most_a)):
            return False
        if a[2] is None or b[2] is None or len(a[2]) != len(b[2]):
            return True
        overlap = max(a[3], b[3]) + int(np.bitwise_count(a[2] & b[2]).sum())
        return (100 + percent) * min(overlap, most_a, most_b) >= percent * (least_a + least_b)

    def links(self, percent: int, check: Callable[[int, int], bool], side: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """Links that connect all classes: pairs that may be similar, for which `check` holds and whose classes no earlier link has joined.

        With `side` (0 or 1 for each set) only pairs of different sides count.
        """
        label = np.arange(len(self.sets.n))
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            a, b = self.levels[level][i], self.levels[level][j]
            mine, other = label[a[0] : a[1]], label[b[0] : b[1]]
            if (len(mine) > 1 or i != j) and (mine == mine[0]).all() and (other == mine[0]).all():
                continue
            if i != j and not self.may_meet(percent, a, b):
                continue
            if level:
                below = len(self.levels[level - 1])
                inner, outer = (range(x * FANOUT, min(below, (x + 1) * FANOUT)) for x in (i, j))
                pairs = [(level - 1, x, y) for x in inner for y in outer if x <= y]
                stack += sorted(pairs, key=lambda p: p[1] - p[2])  # a node against itself comes first
                continue
            near = pairs_possible(percent, self.leaves[i], self.leaves[j])
            if i == j:
                near = np.triu(near, 1)
            if side is not None:
                near &= side[a[0] : a[1], None] != side[None, b[0] : b[1]]
            near &= label[a[0] : a[1], None] != label[None, b[0] : b[1]]
            for x, y in zip(*(k.tolist() for k in np.nonzero(near)), strict=True):
                x, y = x + a[0], y + b[0]
                if label[x] != label[y] and check(x, y):
                    label[label == label[y]] = label[x]
                    yield x, y
