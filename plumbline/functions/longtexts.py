"""Scores of one pair of long texts in memory that grows with their length only.

``lcs_length`` keeps one integer whose bits are the rows of the usual table. ``Braid`` has the
common subsequence of one text with every window of the other from a single sweep (Tiskin's
semi-local comparison): every cell of the table is passed by a strand from the left and one from
above, which cross at most once and turn away from each other at equal characters. A window then
has one common character less than its length for every strand that enters at its top and leaves
at its bottom. Cells of an anti-diagonal don't depend on each other and are one array step.
"""

from __future__ import annotations

import numpy as np

# Bits that the integers of ``lcs_length`` may take together, one integer per character.
_MASK_BITS = 1 << 29


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Braid:
    """Where the strands of a pair of texts end.

    ``from_top[j]`` is the column at whose top the strand entered that leaves below column j,
    ``from_left[i]`` the row at which the one entered that leaves to the right of row i; negative
    if it entered on the other side.
    """

    def __init__(self, a: str, b: str):
        rows, columns = len(a), len(b)
        # Strands are numbered from the lowest row up, then along the top: a larger number on the
        # left than from above has crossed before. Rows are kept upside down for the same order.
        left = np.arange(rows, dtype=np.int32)
        top = np.arange(rows, rows + columns, dtype=np.int32)
        up, along = code_points(a)[::-1].copy(), code_points(b)
        width = min(rows, columns)
        turn, crossed, held = np.empty(width, bool), np.empty(width, bool), np.empty(width, np.int32)
        for d in range(rows + columns - 1):
            low, high = max(0, d - rows + 1), min(columns, d + 1)
            shift, n = rows - 1 - d, high - low
            x, y = left[low + shift : high + shift], top[low:high]
            np.equal(up[low + shift : high + shift], along[low:high], out=turn[:n])
            np.greater(x, y, out=crossed[:n])
            np.logical_or(turn[:n], crossed[:n], out=turn[:n])
            np.copyto(held[:n], x)
            np.copyto(x, y, where=turn[:n])
            np.copyto(y, held[:n], where=turn[:n])
        self.from_top = top.astype(np.int64) - rows
        self.from_left = rows - 1 - left[::-1].astype(np.int64)

    def whole(self) -> int:
        """Common characters of the two texts."""
        return int((self.from_top < 0).sum())


def _prefixes(entered: np.ndarray) -> np.ndarray:
    """Common characters of every prefix, from one character on."""
    return np.cumsum(entered < 0)


def _suffixes(entered: np.ndarray) -> np.ndarray:
    """Common characters of every suffix, the whole text first."""
    n = len(entered)
    inside = np.bincount(entered[entered >= 0], minlength=n)[::-1].cumsum()[::-1]
    return n - np.arange(n) - inside


def _windows(entered: np.ndarray, size: int) -> np.ndarray:
    """Common characters of every window of ``size``: a strand is inside a run of windows."""
    n = len(entered)
    leaves = np.flatnonzero(entered >= 0)
    first, last = np.maximum(leaves - size + 1, 0), np.minimum(entered[leaves], n - size)
    some = first <= last
    change = np.bincount(first[some], minlength=n + 2) - np.bincount(last[some] + 1, minlength=n + 2)
    return size - np.cumsum(change)[: n - size + 1]


def _best_end(entered: np.ndarray, size: int) -> float:
    """Best ratio of a text of ``size`` with a shorter prefix or suffix."""
    lengths = np.arange(1, min(size, len(entered) + 1))
    if not len(lengths):
        return 0.0
    found = np.maximum(_prefixes(entered)[lengths - 1], _suffixes(entered)[len(entered) - lengths])
    return float((200.0 * found / (size + lengths)).max())


def partial_ratio(needle: str, hay: str) -> float:
    """Best ratio of ``needle`` with a window, or shorter end, of a ``hay`` that is no shorter;
    of equally long texts also of ``hay`` with the ends of ``needle``. 100 for two empty texts."""
    size = len(needle)
    if not size:
        return 0.0 if hay else 100.0
    braid = Braid(needle, hay)
    best = max(100.0 * _windows(braid.from_top, size).max() / size, _best_end(braid.from_top, size))
    return max(best, _best_end(braid.from_left, size)) if len(hay) == size else best


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) > len(b):
        a, b = b, a
    kinds = set(a) & set(b)
    if len(kinds) * len(a) > _MASK_BITS:
        return Braid(a, b).whole()
    places: dict[str, bytearray] = {c: bytearray(len(a) // 8 + 1) for c in kinds}
    for i, c in enumerate(a):
        if c in places:
            places[c][i >> 3] |= 1 << (i & 7)
    masks = {c: int.from_bytes(bits, "little") for c, bits in places.items()}
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & masks.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()
