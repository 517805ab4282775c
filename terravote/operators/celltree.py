"""A tree of cells on unit vectors, to find for points what is nearest, exactly.

Places are points of the unit sphere in three dimensions, where neither the poles nor the date line are special, and the
straight distance grows with the great-circle one.  A cell is a cube; one that holds anything is cut into eight, level by level.  A
search goes down the levels with all points of a batch at once.  For each point it keeps the cells that could hold the nearest
item: those whose box is not farther off than the nearest item known so far, as each cell names one of its own.
"""

from __future__ import annotations

#: Levels below the whole cube: the lowest cells are about 6 km wide.
DEPTH = 11
#: By how much two distances may differ by rounding: a few thousandths of a millimetre, and in proportion.
SLACK = 1e-12


def unit_vectors(lat, lon):
    import numpy as np

    a, b = np.radians(np.asarray(lat, np.float64)), np.radians(np.asarray(lon, np.float64))
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


class CellTree:
    """Items with a box (lo, hi) and one point in it (at), named by small numbers."""

    def __init__(self, at, lo=None, hi=None, names=None):
        import numpy as np

        cell = np.minimum(((at + 1) / 2 * (1 << DEPTH)).astype(np.int64), (1 << DEPTH) - 1)
        code = np.zeros(len(at), np.int64)
        for bit in reversed(range(DEPTH)):
            for axis in range(3):
                code = code << 1 | (cell[:, axis] >> bit & 1)
        self.items = np.argsort(code, kind="stable")
        code, self.at = code[self.items], at[self.items]
        self.names = None if names is None else np.asarray(names)[self.items]
        lo, hi = (self.at if x is None else x[self.items] for x in (lo, hi))
        # Each level's cells are ranges of the items in the order of their codes; the items are the lowest level.
        self.levels = []
        for level in range(DEPTH + 1):
            key = code >> 3 * (DEPTH - level)
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            self.levels.append((start, np.minimum.reduceat(lo, start), np.maximum.reduceat(hi, start)))
        self.levels.append((np.arange(len(at)), lo, hi))

    def nearest(self, points, without=None, boxes: bool = False):
        """(point, item) of all items whose box may hold what is nearest to a point; ``without``: a name each to leave out.

        ``boxes``: items hold more than their own point, so an item of that name stays, though its point doesn't count.
        """
        import numpy as np

        who, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        best = np.full(len(points), np.inf)
        for (start, _, _), (below, lo, hi) in zip(self.levels, self.levels[1:]):
            first = np.searchsorted(below, start)
            many = np.diff(np.append(first, len(below)))
            n = many[node]
            who = np.repeat(who, n)
            node = np.repeat(first[node], n) + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            p = points[who]
            far = np.sqrt(((self.at[below[node]] - p) ** 2).sum(axis=1))
            if without is not None:
                far[self.names[below[node]] == without[who]] = np.inf
            np.minimum.at(best, who, far)
            near = np.sqrt((np.maximum(0, np.maximum(lo[node] - p, p - hi[node])) ** 2).sum(axis=1))
            keep = near <= best[who] * (1 + SLACK) + SLACK
            who, node = who[keep], node[keep]
        if without is not None and not boxes:
            other = self.names[node] != without[who]
            who, node = who[other], node[other]
        return who, self.items[node]
