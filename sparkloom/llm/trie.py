"""A prefix tree of ascending n-gram sets that counts the overlap of a set with all stored ones on one way down."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class _Node:
    """A stretch of n-grams that all sets below begin with, after those of the nodes above."""

    __slots__ = ("grams", "children", "keys", "least", "most")

    def __init__(self, grams: np.ndarray, size: int):
        self.grams, self.children, self.keys = grams, {}, []
        self.least = self.most = size  # sizes of the sets that pass here


class NgramTrie:
    def __init__(self) -> None:
        self.root = _Node(np.array([], np.uint64), 0)
        self.root.least = 1 << 60

    def insert(self, grams: np.ndarray, key: int) -> None:
        node, size, rest = self.root, len(grams), grams
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            if not len(rest):
                node.keys.append(key)
                return
            child = node.children.get(int(rest[0]))
            if child is None:
                node.children[int(rest[0])] = leaf = _Node(rest, size)
                leaf.keys.append(key)
                return
            n = min(len(rest), len(child.grams))
            differ = np.flatnonzero(rest[:n] != child.grams[:n])
            same = int(differ[0]) if len(differ) else n
            if same < len(child.grams):
                upper = _Node(child.grams[:same], child.least)
                upper.most = child.most
                child.grams = child.grams[same:]
                upper.children[int(child.grams[0])] = child
                node.children[int(rest[0])] = child = upper
            node, rest = child, rest[same:]

    def similar(self, grams: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
        """(key, overlap) of the stored sets with 100 * overlap >= percent * union."""
        n = len(grams)
        ask = lambda size: -(-percent * (n + size) // (100 + percent))
        stack = [(self.root, 0, 0)]
        while stack:
            node, depth, overlap = stack.pop()
            if len(node.grams):
                at = np.searchsorted(grams, node.grams)
                overlap += int(np.count_nonzero(grams[np.minimum(at, n - 1)] == node.grams)) if n else 0
                depth += len(node.grams)
                left = n - int(np.searchsorted(grams, node.grams[-1], side="right"))
            else:
                left = n
            # A set below has at most `most` n-grams; larger ones ask for more, so the best case is where the rests meet.
            size = max(node.least, min(node.most, depth + left))
            if overlap + min(left, size - depth) < ask(size):
                continue
            if node.keys and overlap >= ask(depth):
                yield from ((key, overlap) for key in node.keys)
            stack += [(child, depth, overlap) for child in node.children.values()]
