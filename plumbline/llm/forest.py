"""Spanning forests of links found inside one task."""

from __future__ import annotations

import numpy as np
import pandas as pd


class Forest:
    """Joins nodes by arrays of links and keeps no more than one link per node."""

    def __init__(self, ids: np.ndarray) -> None:
        """``node`` has the place of every given id among the distinct ones."""
        self.ids, self.node = np.unique(ids, return_inverse=True)
        self.parent = np.arange(len(self.ids))

    def _roots(self, nodes: np.ndarray) -> np.ndarray:
        root = self.parent[nodes]
        while True:
            above = self.parent[root]
            if (above == root).all():
                self.parent[nodes] = root
                return root
            root = above

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self._roots(a), self._roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            # Of several links from one root the last one written counts; the next round has the rest.
            self.parent[np.maximum(a, b)] = np.minimum(a, b)

    def links(self) -> pd.DataFrame:
        """(a, b): every node that isn't the lowest of its tree, and the lowest."""
        root = self._roots(np.arange(len(self.ids)))
        below = np.flatnonzero(root != np.arange(len(self.ids)))
        return pd.DataFrame({"a": self.ids[below], "b": self.ids[root[below]]})
