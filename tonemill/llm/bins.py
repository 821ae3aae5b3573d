"""Best-fit-decreasing bin packing, shared by sharding and sequence packing."""

from __future__ import annotations

from collections import defaultdict

import numpy as np


class CapacityTree:
    """Open bins by remaining capacity, in a balanced binary tree over the capacities.

    A node of level k stands for the capacities that share all but their lowest k
    bits and counts the bins below it, so that insertion, removal and the search
    for the tightest bin each touch one node a level.
    """

    def __init__(self, capacity: int):
        self.levels = max(1, int(capacity).bit_length())
        self.count = [defaultdict(int) for _ in range(self.levels + 1)]
        self.bins: dict[int, list[int]] = defaultdict(list)

    def add(self, remaining: int, number: int) -> None:
        self.bins[remaining].append(number)
        for level in range(self.levels + 1):
            self.count[level][remaining >> level] += 1

    def pop(self, remaining: int) -> int:
        for level in range(self.levels + 1):
            node = remaining >> level
            self.count[level][node] -= 1
            if not self.count[level][node]:
                del self.count[level][node]
        number = self.bins[remaining].pop()
        if not self.bins[remaining]:
            del self.bins[remaining]
        return number

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity that is ``size`` or more."""
        if size in self.bins:
            return size
        for level in range(self.levels + 1):
            node = size >> level
            if not node & 1 and node + 1 in self.count[level]:
                node += 1
                for below in range(level - 1, -1, -1):
                    node = 2 * node if 2 * node in self.count[below] else 2 * node + 1
                return node
        return None

    def widest(self) -> int | None:
        if not self.bins:
            return None
        node = max(self.count[self.levels])
        for below in range(self.levels - 1, -1, -1):
            node = 2 * node + 1 if 2 * node + 1 in self.count[below] else 2 * node
        return node


def best_fit_decreasing(sizes: np.ndarray, capacity: int, fixed_bins: int | None = None) -> np.ndarray:
    """The bin of each size: largest first, each into the tightest bin it fits.

    Without ``fixed_bins`` a bin is opened when none fits; a size above the
    capacity gets a bin of its own. With ``fixed_bins`` all bins are open from
    the start, and a size that fits none enters the one with most room, which
    may then overflow. Equal sizes go in the order given.
    """
    tree, out = CapacityTree(max(capacity, 1)), np.zeros(len(sizes), dtype=np.int64)
    load: list[int] = [0] * (fixed_bins or 0)
    for number in range(fixed_bins or 0):
        tree.add(capacity, number)
    for i in np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable"):
        size = int(sizes[i])
        room = tree.tightest(size)
        if room is not None:
            number = tree.pop(room)
        elif fixed_bins is None:
            number = len(load)
            load.append(0)
        else:
            room = tree.widest()
            number = tree.pop(room) if room is not None else min(range(fixed_bins), key=load.__getitem__)
        load[number] += size
        out[i] = number
        if load[number] < capacity:
            tree.add(capacity - load[number], number)
    return out


def level_fill(sizes: np.ndarray, n_bins: int, slack: int = 0) -> np.ndarray:
    """The bin of each size: best-fit-decreasing into ``n_bins`` of near equal load.

    The capacity is an equal share. Bins that end more than ``slack`` above it are closed with what they
    hold, and the rest is packed anew into the others by their equal share, until no bin is.
    """
    sizes = np.asarray(sizes, dtype=np.int64)
    out, left, bins = np.zeros(len(sizes), dtype=np.int64), np.arange(len(sizes)), np.arange(n_bins)
    while len(left):
        capacity = max(1, -(-int(sizes[left].sum()) // len(bins)))
        number = best_fit_decreasing(sizes[left], capacity, len(bins))
        out[left] = bins[number]
        load = np.zeros(len(bins), dtype=np.int64)
        np.add.at(load, number, sizes[left])
        over = load > capacity + slack
        if not over.any():
            break
        left, bins = left[~over[number]], bins[~over]
    return out
