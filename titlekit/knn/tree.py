"""The pivot tree that cuts space into cells (KNN3-KNN6).

The tree is grown on a bounded sample on the driver and is only a routing table: rows are routed in batches by the
tasks that read them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from titlekit.knn.vectors import squared_to

# Margins of points and cells that are put in order at a time.
ORDERED_AT_ONCE = 4_000_000
# Neighbouring cells that look for their surroundings together.
GROUP_CELLS = 32
NEAR_GROUPS = 4


@dataclass
class PivotTree:
    """``children`` holds node numbers, or ``-(cell + 1)`` for a cell; node 0 is the root unless there is no node."""

    left_pivot: list = field(default_factory=list)
    right_pivot: list = field(default_factory=list)
    children: list = field(default_factory=list)
    overlapping: list = field(default_factory=list)
    centres: list = field(default_factory=list)

    @property
    def cells(self) -> int:
        return len(self.centres)

    def new_cell(self, low: np.ndarray, high: np.ndarray) -> int:
        """The child number of a new cell between these corners."""
        self.centres.append((low + high) / 2.0)
        return -len(self.centres)

    def new_node(self, left: np.ndarray, right: np.ndarray) -> int:
        for column, value in ((self.left_pivot, left), (self.right_pivot, right), (self.children, None), (self.overlapping, False)):
            column.append(value)
        return len(self.children) - 1

    def _new_cell(self, points: np.ndarray) -> int:
        return self.new_cell(points.min(axis=0), points.max(axis=0))

    def grow(self, points: np.ndarray, leaf_size: int, tau: float = 0.0, balance: float = 0.0, depth: float = math.inf) -> int:
        """Split ``points``, given in random order, until ``leaf_size`` is reached; returns the subtree's child number.

        A node overlaps (both children keep the points within ``tau`` of its boundary) only where neither child then
        has more than ``balance`` of the points. No cell has more than ``depth`` nodes above it.
        """
        if len(points) <= leaf_size or depth < 1:
            return self._new_cell(points)
        away = squared_to(points, points[0])
        left = points[away.argmax()]
        if away.max() == 0.0:
            return self._new_cell(points)
        to_left = squared_to(points, left)
        right = points[to_left.argmax()]
        to_right = squared_to(points, right)
        node = self.new_node(left, right)
        in_left = to_left < to_right
        in_right = ~in_left
        if balance > 0.0:
            gap = np.sqrt(to_left) - np.sqrt(to_right)
            wide_left, wide_right = gap <= tau, -gap <= tau
            if max(wide_left.sum(), wide_right.sum()) <= balance * len(points):
                self.overlapping[node] = True
                in_left, in_right = wide_left, wide_right
        self.children[node] = (
            self.grow(points[in_left], leaf_size, tau, balance, depth - 1),
            self.grow(points[in_right], leaf_size, tau, balance, depth - 1),
        )
        return node

    def split_cell(self, cell: int, points: np.ndarray, leaf_size: int) -> bool:
        """Grow a subtree in place of a cell; False if its points cannot be told apart."""
        before = self.cells
        subtree = self.grow(points, leaf_size)
        if subtree < 0:
            del self.centres[before:]
            return False
        leaf = -(cell + 1)
        for node in range(subtree):
            left, right = self.children[node]
            if leaf in (left, right):
                self.children[node] = (subtree if left == leaf else left, subtree if right == leaf else right)
        return True

    def _check(self, points: np.ndarray) -> None:
        if len(points) and self.centres and points.shape[1] != len(self.centres[0]):
            raise ValueError("queries and training vectors differ in length")

    def route(self, points: np.ndarray, tau: float = 0.0, side: str = "nearest"):
        """(row, cell) pairs for a batch.

        ``nearest``: the one cell on the side of the nearer pivot. ``query``: also the other side where the two pivots
        are within ``tau``, except at overlapping nodes. ``train``: the reverse, two sides at overlapping nodes only.
        """
        self._check(points)
        rows, cells = [], []
        everyone = np.arange(len(points))
        stack = [(0 if self.children else -1, everyone)]
        while stack:
            node, members = stack.pop()
            if not len(members):
                continue
            if node < 0:
                rows.append(members)
                cells.append(np.full(len(members), -node - 1))
                continue
            to_left = squared_to(points[members], self.left_pivot[node])
            to_right = squared_to(points[members], self.right_pivot[node])
            wide = side != "nearest" and (side == "train") == self.overlapping[node]
            if wide:
                gap = np.sqrt(to_left) - np.sqrt(to_right)
                go_left, go_right = gap <= tau, -gap <= tau
            else:
                go_left = to_left < to_right
                go_right = ~go_left
            left, right = self.children[node]
            stack.append((left, members[go_left]))
            stack.append((right, members[go_right]))
        if not rows:
            return np.empty(0, int), np.empty(0, int)
        return np.concatenate(rows), np.concatenate(cells)

    def route_within(self, points: np.ndarray, bound: np.ndarray):
        """(row, cell) pairs of all cells that the splitting planes leave within each row's ``bound``.

        Training rows lie on the side of their nearer pivot, so a row on the other side of the plane half-way between
        the pivots is at least as far as the plane.
        """
        self._check(points)
        rows, cells = [], []
        stack = [(0 if self.children else -1, np.arange(len(points)))]
        while stack:
            node, members = stack.pop()
            if not len(members):
                continue
            if node < 0:
                rows.append(members)
                cells.append(np.full(len(members), -node - 1))
                continue
            gap = np.sqrt(((self.left_pivot[node] - self.right_pivot[node]) ** 2).sum())
            to_left = squared_to(points[members], self.left_pivot[node])
            to_right = squared_to(points[members], self.right_pivot[node])
            beyond = (to_left - to_right) / (2.0 * gap)
            slack = bound[members] + 1e-9 * (to_left + to_right) / gap
            left, right = self.children[node]
            stack.append((left, members[beyond <= slack]))
            stack.append((right, members[-beyond <= slack]))
        if not rows:
            return np.empty(0, int), np.empty(0, int)
        return np.concatenate(rows), np.concatenate(cells)

    def margins(self, points: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """For each point and cell, how far the cell is beyond splitting planes: the sum over the nodes above it of the
        squared distance to the plane where the point is on the other side, from ``start`` on. The point's own cell has 0
        more than ``start``, and no cell has less than a node above it."""
        self._check(points)
        out = np.empty((len(points), self.cells))
        stack = [(0 if self.children else -1, np.zeros(len(points)) if start is None else start)]
        while stack:
            node, margin = stack.pop()
            if node < 0:
                out[:, -node - 1] = margin
                continue
            gap = np.sqrt(((self.left_pivot[node] - self.right_pivot[node]) ** 2).sum())
            beyond = (squared_to(points, self.left_pivot[node]) - squared_to(points, self.right_pivot[node])) / (2.0 * gap)
            left, right = self.children[node]
            stack.append((left, margin + np.maximum(beyond, 0.0) ** 2))
            stack.append((right, margin + np.minimum(beyond, 0.0) ** 2))
        return out

    def nearest_cells(self, points: np.ndarray, count: int, start: np.ndarray | None = None):
        """(row, cell, margin): the ``count`` cells of least margin for each point, the best first."""
        found = []
        step = max(1, ORDERED_AT_ONCE // max(1, self.cells))
        for lo in range(0, len(points), step):
            part = self.margins(points[lo : lo + step], None if start is None else start[lo : lo + step])
            best = np.argsort(part, axis=1, kind="stable")[:, :count]
            rows = np.repeat(np.arange(lo, lo + len(part)), best.shape[1])
            found.append((rows, best.ravel(), np.take_along_axis(part, best, axis=1).ravel()))
        if not found:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        return tuple(np.concatenate(x) for x in zip(*found))

    def leaf_order(self) -> np.ndarray:
        """The cells from left to right, so that cells of one subtree stand together."""
        out, stack = [], [0 if self.children else -1]
        while stack:
            node = stack.pop()
            if node < 0:
                out.append(-node - 1)
            else:
                left, right = self.children[node]
                stack += [right, left]
        return np.array(out, dtype=int)

    def neighbourhoods(self, sizes: dict[int, int], enough: int) -> list[np.ndarray]:
        """For each cell itself or, where it has fewer than ``enough`` rows, the cells of nearest centre that have them.

        Cells are taken in groups that stand together in the tree. The groups around a cell first give it a distance
        within which there are enough rows; then only groups whose balls come within that distance are looked at.
        """
        centres, rows = np.array(self.centres), np.array([sizes.get(c, 0) for c in range(self.cells)])
        found = [np.array([c]) for c in range(self.cells)]
        groups = np.array_split(self.leaf_order(), max(1, self.cells // GROUP_CELLS))
        middles = np.array([centres[g].mean(axis=0) for g in groups])
        radius = np.array([np.sqrt(squared_to(centres[g], m).max()) for g, m in zip(groups, middles)]) * (1.0 + 1e-9)
        everyone = np.arange(self.cells)
        for group, middle in zip(groups, middles):
            own = group[rows[group] < enough]
            if not len(own):
                continue
            some = np.argsort(squared_to(middles, middle), kind="stable")[:NEAR_GROUPS]
            first = np.sort(np.concatenate([groups[g] for g in some]))
            apart = np.sqrt(((centres[own][:, None, :] - middles[None]) ** 2).sum(axis=2)) - radius
            for cell, gaps in zip(own, apart):
                far, _ = self._nearest_until(centres, rows, cell, first, enough)
                reached = np.flatnonzero(gaps <= np.sqrt(far) * (1.0 + 1e-9))
                near = np.sort(np.concatenate([groups[g] for g in reached])) if len(reached) < len(groups) else everyone
                found[cell] = self._nearest_until(centres, rows, cell, near, enough)[1]
        return found

    @staticmethod
    def _nearest_until(centres: np.ndarray, rows: np.ndarray, cell: int, near: np.ndarray, enough: int) -> tuple[float, np.ndarray]:
        """(squared distance, cells): those of ``near``, in order of distance, that first have ``enough`` rows together."""
        away = squared_to(centres[near], centres[cell])
        order = np.argsort(away, kind="stable")
        count = int(np.searchsorted(np.cumsum(rows[near[order]]), enough)) + 1
        far = away[order[count - 1]] if count <= len(order) else np.inf
        return far, np.sort(near[order[:count]])
