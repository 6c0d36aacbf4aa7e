"""String similarity for batches of pairs, vectorised with numpy.

All three scores rest on the longest common subsequence (LCS), computed bit-parallel
(Hyyro 2004) over many pairs at once. ``ratio`` is 100 * 2 * LCS / (|a| + |b|).
``token_set_ratio`` compares the sorted token sets, ``partial_ratio`` the shorter text
with every window of the longer one. The score of a pair of names is the larger of both.
"""

from __future__ import annotations

from functools import cached_property
from zlib import crc32

import numpy as np

from plumbline.functions import longtexts

_BUCKETS = 128
_GRAM_BUCKETS = 256
_UNARY_COLUMNS = 512
_NEEDLE_PAD = np.uint32(0xFFFFFFFF)
_HAY_PAD = np.uint32(0xFFFFFFFE)
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
MOST_TOKENS = 10  # tokens of texts whose tokens are compared pair by pair
_CELLS = 100_000  # array cells that one step may allocate; a pair that needs more is done alone


class Texts:
    """Texts of one batch with what the scores need per text rather than per pair."""

    def __init__(self, texts: list[str]):
        self.texts = np.array(texts, dtype=object)
        self.tokens = [frozenset(t.split()) for t in texts]
        self.sorted = [sorted(t) for t in self.tokens]
        self.joined = np.array([" ".join(t) for t in self.sorted], dtype=object)
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.token_count = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.joined_length = np.array([len(t) for t in self.joined], dtype=np.int64)
        # Shortest form of the text that any score looks at.
        self.least = np.minimum(self.length, self.joined_length)
        self.histogram = _histograms(texts)

    def __len__(self) -> int:
        return len(self.texts)

    @cached_property
    def unary(self) -> np.ndarray | None:
        """The histogram with a column per character and count, so that products of rows count
        common characters; None where that takes too many columns."""
        most = self.histogram.max(axis=0, initial=0)
        if most.sum() > _UNARY_COLUMNS:
            return None
        columns = [self.histogram[:, k] >= j for k in np.flatnonzero(most) for j in range(1, most[k] + 1)]
        return np.array(columns, dtype=np.float32).reshape(len(columns), len(self)).T.copy()

    @cached_property
    def sketch(self) -> tuple[np.ndarray, np.ndarray]:
        """64 bits per text for its characters and how often it has them, and how many of these
        have no bit of their own: two texts have no more common characters than common bits and
        the lesser of these numbers."""
        counts = np.ascontiguousarray(self.histogram.T)
        held = [(k, j) for k in np.flatnonzero(counts.any(axis=1)) for j in range(1, min(int(counts[k].max()), 8) + 1)]
        often = np.array([np.count_nonzero(counts[k] >= j) for k, j in held], dtype=np.int64)
        bits = np.zeros(len(self), dtype=np.uint64)
        for rank, at in enumerate(np.argsort(-often, kind="stable").tolist()):
            k, j = held[at]
            # The rare ones share the bits of those that are least often set.
            bit = rank if rank < 64 else 63 - (rank - 64) % 32
            bits[counts[k] >= j] |= np.uint64(1 << bit)
        return bits, counts.sum(axis=0, dtype=np.int64) - np.bitwise_count(bits)

    @cached_property
    def distinct(self) -> np.ndarray:
        """Texts of up to 64 characters whose hashed characters differ wherever the characters do."""
        return (self.length <= 64) & np.array([t.isascii() and "\x7f" not in t for t in self.texts], dtype=bool)

    @cached_property
    def kinds(self) -> np.ndarray:
        """Hashed characters of texts of up to 64, a row per place, 0 past the end."""
        return self._kinds(self.texts, self.length, False)

    @cached_property
    def kinds_back(self) -> np.ndarray:
        """``kinds`` of the texts read backwards."""
        return self._kinds(self.texts, self.length, True)

    @staticmethod
    def _kinds(texts: np.ndarray, length: np.ndarray, reverse: bool) -> np.ndarray:
        held = np.where(length <= 64, texts, "")
        codes = _codes(held, _NEEDLE_PAD, reverse).T
        return np.where(codes == _NEEDLE_PAD, 0, codes % (_BUCKETS - 1) + 1).astype(np.int64)

    @cached_property
    def places(self) -> np.ndarray:
        """For every hashed character, where each text of up to 64 characters has it, as bits."""
        return _places(self.kinds)

    @cached_property
    def places_back(self) -> np.ndarray:
        """``places`` of the texts read backwards."""
        return _places(self.kinds_back)

    @cached_property
    def joined_kinds(self) -> np.ndarray:
        """``kinds`` of the joined tokens."""
        return self._kinds(self.joined, self.joined_length, False)

    @cached_property
    def joined_places(self) -> np.ndarray:
        """``places`` of the joined tokens."""
        return _places(self.joined_kinds)

    @cached_property
    def token_spots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts of few tokens: numbers of the sorted tokens (-1 past the end), their lengths, and their
        places among the first 64 of the joined tokens, with the blank behind, as bits."""
        few = self.token_count <= MOST_TOKENS
        shape = (int(self.token_count[few].max(initial=0)), len(self))
        codes, sizes, spots = np.full(shape, -1), np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.uint64)
        known: dict[str, int] = {}
        for row in np.flatnonzero(few).tolist():
            at = 0
            for k, t in enumerate(self.sorted[row]):
                codes[k, row] = known.setdefault(t, len(known))
                sizes[k, row] = len(t)
                spots[k, row] = (((1 << len(t) + 1) - 1) << at) & 0xFFFFFFFFFFFFFFFF if at < 64 else 0
                at += len(t) + 1
        return codes, sizes, spots

    @cached_property
    def holders(self) -> dict[str, np.ndarray]:
        """Which texts have a token, for tokens of two texts or more."""
        found: dict[str, list[int]] = {}
        for row, tokens in enumerate(self.tokens):
            for t in tokens:
                found.setdefault(t, []).append(row)
        return {t: np.array(rows) for t, rows in found.items() if len(rows) > 1}

    @cached_property
    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Counts of adjacent character pairs, hashed, of the texts and of the joined tokens."""
        return _gram_counts(self.texts), _gram_counts(self.joined)

    @cached_property
    def token_sizes(self) -> np.ndarray:
        """Length of each hashed token plus one for a space."""
        out = np.zeros((len(self), _GRAM_BUCKETS), dtype=np.float32)
        for row, tokens in enumerate(self.tokens):
            for t in tokens:
                out[row, crc32(t.encode()) % _GRAM_BUCKETS] += len(t) + 1
        return out


def _places(kinds: np.ndarray) -> np.ndarray:
    width = np.uint16 if len(kinds) <= 16 else np.uint32 if len(kinds) <= 32 else np.uint64
    out = np.zeros((_BUCKETS, kinds.shape[1]), dtype=width)
    for i, row in enumerate(kinds):
        has = np.flatnonzero(row)
        out[row[has], has] |= width(1 << i)
    return out


def _gram_counts(texts) -> np.ndarray:
    out = np.zeros((len(texts), _GRAM_BUCKETS), dtype=np.float32)
    for row, text in enumerate(texts):
        if len(text) > 1:
            codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
            hashed = (codes[:-1] * 31 + codes[1:]) % _GRAM_BUCKETS
            out[row] = np.bincount(hashed, minlength=_GRAM_BUCKETS)
    return out


def _histograms(texts: list[str]) -> np.ndarray:
    """Character counts per text, hashed into buckets, white space in bucket 0."""
    out = np.zeros((len(texts), _BUCKETS), dtype=np.int32)
    plain = np.array([len(t) <= 256 and t.isascii() and t.isprintable() for t in texts], dtype=bool)
    rows = np.flatnonzero(plain)
    for start in range(0, len(rows), 4096):
        some = rows[start : start + 4096]
        codes = _codes([texts[r] for r in some], _NEEDLE_PAD)
        place = np.where(codes == 32, 0, codes % (_BUCKETS - 1) + 1) + np.arange(len(some))[:, None] * _BUCKETS
        counts = np.bincount(place[codes != _NEEDLE_PAD].astype(np.int64), minlength=len(some) * _BUCKETS)
        out[some] = counts.reshape(len(some), _BUCKETS)
    for row in np.flatnonzero(~plain):
        text = texts[row]
        if text:
            spaced = " ".join(text.split())
            codes = np.frombuffer(spaced.encode("utf-32-le"), dtype=np.uint32)
            out[row] = np.bincount(codes % (_BUCKETS - 1) + 1, minlength=_BUCKETS)
            out[row, 32 + 1] -= spaced.count(" ")
            out[row, 0] = len(text) - len(spaced.replace(" ", ""))
    return out.astype(np.int16) if out.size and out.max() < 30_000 else out


def common_grid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common characters (as multisets) of every row of ``a`` with every row of ``b``."""
    used = np.flatnonzero(a.any(axis=0) & b.any(axis=0))
    total = np.zeros((len(a), len(b)), dtype=np.int32)
    for k in used:
        total += np.minimum(a[:, k, None], b[None, :, k])
    return total


def common_pairs(histogram: np.ndarray, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Common characters of the pairs ``ia[k]``, ``ib[k]`` of one batch."""
    out = np.empty(len(ia), dtype=np.int64)
    for start in range(0, len(ia), 20_000):
        part = slice(start, start + 20_000)
        out[part] = np.minimum(histogram[ia[part]], histogram[ib[part]]).sum(axis=1)
    return out


def upper_bound(common: np.ndarray, least: np.ndarray) -> np.ndarray:
    """No score of a pair exceeds this.

    A window of the longer text, a token intersection or a whole text has at most
    ``common`` characters in common with the other side, and the side it is measured
    against is at least ``least`` long; 200 * c / (least + c) then bounds every case.
    """
    c = np.minimum(common, least)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(least > 0, 200.0 * c / (least + c), 100.0)


class Bounds:
    """Bounds on the scores of a few texts ``left`` of a batch with many others, ``right``.

    Of the tokens of two texts, those they share have ``s`` characters and are no more than c of
    all that are common, so a token set scores 200 * c / (a + b) at most, or 200 * s / (s + a) by
    the shared tokens alone, a and b being the lengths of the joined tokens. A window holds no
    longer common subsequence than its whole text. In single precision, so leave a little room.
    """

    def __init__(self, texts: Texts, left: np.ndarray, right: np.ndarray):
        self.texts, self.left, self.right = texts, left, right
        if texts.unary is None:
            self.common = common_grid(texts.histogram[left], texts.histogram[right]).astype(np.float32)
        else:
            self.common = texts.unary[left] @ texts.unary[right].T
        self.column = np.full(len(texts), -1)
        self.column[right] = np.arange(len(right))
        self.length, self.joined = (x[right].astype(np.float32) for x in (texts.length, texts.joined_length))
        self.empty = np.flatnonzero((self.length == 0) | (self.joined == 0))
        self.shares: dict[int, np.ndarray] = {}
        self.columns: dict[str, np.ndarray] = {}

    @cached_property
    def places(self) -> np.ndarray:
        return self.texts.places.take(self.right, axis=1)

    def token_sets(self, k: int) -> np.ndarray:
        """Bound on the token set scores of text ``left[k]``."""
        texts, own = self.texts, int(self.texts.joined_length[self.left[k]])
        if own not in self.shares:
            self.shares[own] = np.float32(200) / np.maximum(self.joined + own, 1)
        out = self.shares[own] * self.common[k]
        held = [t for t in texts.tokens[self.left[k]] if t in texts.holders]
        if held:
            s = np.full(len(self.right), -1, np.float32)
            for t in held:
                if t not in self.columns:
                    at = self.column[texts.holders[t]]
                    self.columns[t] = at[at >= 0]
                s[self.columns[t]] += len(t) + 1
            on = self.columns[held[0]] if len(held) == 1 else np.flatnonzero(s > 0)
            s = s[on]
            out[on] = np.maximum(out[on], 200 * s / np.maximum(s + np.minimum(self.joined[on], own), 1))
        out[slice(None) if not own else self.empty] = 100
        return out

    def characters(self, k: int) -> np.ndarray:
        """Bound on the window scores of text ``left[k]`` without a look at the order of characters."""
        own = int(self.texts.length[self.left[k]])
        least = np.minimum(self.length, own)
        common = np.minimum(least, self.common[k])
        least += common
        out = np.divide(common, np.maximum(least, 1, out=least), out=common)
        out *= 200
        out[slice(None) if not own else self.empty] = 100
        return out

    def windows(self, k: int, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds on the scores of text ``left[k]`` with windows of texts ``right[on]``: of all, and
        of those as long as the shorter text."""
        text = self.texts.texts[self.left[k]]
        common = self.common[k][on]
        if len(text) <= 64:
            places, few = self.places, len(on) < len(self.right) // 3
            state = np.full(len(on) if few else len(self.right), ~places.dtype.type(0), dtype=places.dtype)
            for code in self.texts.kinds[: len(text), self.left[k]]:
                state = _advance_one(state, places[code].take(on, mode="clip") if few else places[code])
            found = np.bitwise_count(~(state if few else state[on]))
            common = np.where(self.length[on] <= 64, np.minimum(common, found), common)
        least = np.minimum(self.length[on], len(text))
        return upper_bound(common, least), 100.0 * np.minimum(common, least) / np.maximum(least, 1)


def window_bounds(texts: Texts, ia: np.ndarray, ib: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``Bounds.windows`` of pairs of texts, given their common characters."""
    la, lb = texts.length[ia], texts.length[ib]
    found, flat = np.zeros(len(ia), dtype=np.int64), texts.places.ravel()
    for start in range(0, len(ia), 16_384):
        a, b = ia[start : start + 16_384], ib[start : start + 16_384]
        state = np.full(len(a), ~flat.dtype.type(0), dtype=flat.dtype)
        for t in range(min(int(la[start : start + len(a)].max()), len(texts.kinds))):
            state = _advance_one(state, flat.take(texts.kinds[t, a] * len(texts) + b))
        found[start : start + len(a)] = np.bitwise_count(~state)
    common = np.where((la <= 64) & (lb <= 64), np.minimum(common, found), common).astype(np.float64)
    least = np.minimum(la, lb)
    return upper_bound(common, least), 100.0 * np.minimum(common, least) / np.maximum(least, 1)


def shared_tokens(texts: Texts, ia: np.ndarray, ib: np.ndarray):
    """Of pairs of texts of few tokens: how long the tokens are that they share, with a blank each, how many
    these are, and where they stand in either text as bits."""
    codes, sizes, spots = texts.token_spots
    long, equal = np.zeros(len(ia), dtype=np.int64), np.zeros(len(ia), dtype=np.int64)
    mine, other = np.zeros(len(ia), dtype=np.uint64), np.zeros(len(ia), dtype=np.uint64)
    right = [codes[q].take(ib) for q in range(int(texts.token_count[ib].max(initial=0)))]
    for p in range(int(texts.token_count[ia].max(initial=0))):
        left = codes[p].take(ia)
        for q, code in enumerate(right):
            at = np.flatnonzero((left == code) & (left >= 0))
            if len(at):
                long[at] += sizes[p, ia[at]] + 1
                equal[at] += 1
                mine[at] |= spots[p, ia[at]]
                other[at] |= spots[q, ib[at]]
    return long, equal, mine, other


def end_bound(texts: Texts, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Bound on the scores of the shorter text of each pair with shorter prefixes and suffixes of the
    longer one; 100 where a text has more than 64 characters."""
    out = np.full(len(ia), 100.0)
    fits = np.flatnonzero((texts.length[ia] <= 64) & (texts.length[ib] <= 64))
    for start in range(0, len(fits), 8192):
        rows = fits[start : start + 8192]
        out[rows] = _ends(texts, ia[rows], ib[rows])
    return out


def _ends(texts: Texts, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    p, q = texts.length[ia], texts.length[ib]
    best = np.zeros(len(ia))
    for places, kinds in ((texts.places, texts.kinds), (texts.places_back, texts.kinds_back)):
        state = np.full(len(ia), ~places.dtype.type(0), dtype=places.dtype)
        kind, flat = kinds[:, ia], places.ravel()
        for t in range(1, int(p.max()) + 1):
            state = _advance_one(state, flat.take(kind[t - 1] * len(texts) + ib))
            found = 200.0 * np.bitwise_count(~state) / (q + t)
            np.maximum(best, found, out=best, where=(t < q) & (q <= p))
        left = ~state
        for t in range(1, int(np.minimum(p, q).max())):
            found = 200.0 * np.bitwise_count(left & places.dtype.type((1 << t) - 1)) / (p + t)
            np.maximum(best, found, out=best, where=(t < p) & (p <= q))
    return best


def set_bound(texts: Texts, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Bound on the token set scores of pairs, from the longest common subsequence of what they don't
    share; 100 where a text has many tokens or more than 64 characters."""
    out = np.full(len(ia), 100.0)
    count, joined = texts.token_count, texts.joined_length
    short = (count > 0) & (count <= MOST_TOKENS) & (joined <= 64)
    fits = np.flatnonzero(short[ia] & short[ib])
    for start in range(0, len(fits), 8192):
        rows = fits[start : start + 8192]
        out[rows] = _sets(texts, ia[rows], ib[rows])
    return out


def _sets(texts: Texts, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    shared, equal, mine, other = shared_tokens(texts, ia, ib)
    la, lb = texts.joined_length[ia], texts.joined_length[ib]
    kinds, flat, free = texts.joined_kinds, texts.joined_places.ravel(), ~other
    state = np.full(len(ia), _ONES, dtype=np.uint64)
    for t in range(int(la.max())):
        mask = flat.take(kinds[t, ia] * len(texts) + ib).astype(np.uint64) & free
        mask[(mine >> np.uint64(t)) & np.uint64(1) > 0] = 0
        state = _advance_one(state, mask)
    s = np.maximum(shared - 1, 0)  # the shared tokens with blanks between
    nx, ny = la - shared, lb - shared
    common = np.minimum(np.bitwise_count(~state), np.minimum(nx, ny))
    score = 1 - (nx + ny - 2 * common) / (la + lb)
    gap = s > 0
    inter = np.maximum(1 - (gap + nx) / np.maximum(s + la, 1), 1 - (gap + ny) / np.maximum(s + lb, 1))
    score = np.where(gap, np.maximum(score, inter), score)
    whole = (equal == texts.token_count[ia]) | (equal == texts.token_count[ib])
    return np.where(whole, 100.0, 100 * score)


def near_pairs(texts: Texts, left: np.ndarray, right: np.ndarray, need: float, names: bool):
    """(ia, ib, windows, sure) of the pairs of a grid whose score may reach ``need``.

    For names ``windows`` tells whether their windows may reach it, and ``sure`` whether they do:
    the one window of two texts of one length is the whole text.
    """
    bounds, room = Bounds(texts, left, right), 1e-3
    out, row, col, inner = np.zeros((len(left), len(right)), dtype=np.uint8), [], [], []
    for k in range(len(left)):
        sets = bounds.token_sets(k)
        out[k] = sets >= need - room
        if names:
            on = np.flatnonzero(bounds.characters(k) >= need - room)
            windows, whole = bounds.windows(k, on)
            at = np.flatnonzero(windows >= need - room)
            row.append(np.full(len(at), k))
            col.append(on[at])
            inner.append(whole[at])
    if row:
        x, y, z = (np.concatenate(parts) for parts in (row, col, inner))
        a, b = left[x], right[y]
        sure = (z >= need + room) & (texts.length[a] == texts.length[b]) & texts.distinct[a] & texts.distinct[b]
        out[x[sure], y[sure]] = 3
        x, y, z = x[~sure], y[~sure], z[~sure]
        may = np.maximum(z, end_bound(texts, left[x], right[y])) >= need - room
        out[x[may], y[may]] = 2
    x, y = np.nonzero(out)
    return left[x], right[y], out[x, y] > 1, out[x, y] > 2


def gram_bound(texts: Texts, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A second bound on the score of every pair of a grid, from adjacent characters.

    Turning a text of n characters into one with L of them in common takes n - L deletions,
    which break at most two of its n - 1 adjacent pairs each, and insertions that break one
    each. If b pairs survive, L <= (n + m + 1 + b) / 3 for a window of m characters, and with
    L <= m the score of any window is at most 200 * (n + 1 + b) / (3 * n + 1 + b). Hashing can
    only raise b. For token sets the same holds of the joined tokens, where putting the
    shared tokens first changes two pairs per token boundary; shared tokens of s characters
    alone give at most 200 * s / (s + n).
    """
    whole, joined = texts.grams
    n, m = texts.length[left][:, None], texts.length[right][None, :]
    own = whole[left] @ (whole[right] > 0).T.astype(np.float32)
    other = (whole[left] > 0).astype(np.float32) @ whole[right].T
    pairs = np.where(n < m, own, np.where(n > m, other, np.maximum(own, other)))
    short = np.minimum(n, m)
    windows = 200.0 * (short + 1 + pairs) / (3 * short + 1 + pairs)

    la, lb = texts.joined_length[left][:, None], texts.joined_length[right][None, :]
    shared = texts.token_sizes[left] @ (texts.token_sizes[right] > 0).T.astype(np.float32)
    least = np.minimum(la, lb)
    s = np.clip(shared - 1, 0, least)
    kept = joined[left] @ (joined[right] > 0).T.astype(np.float32)
    moved = np.where(shared > 0, 2.0 * texts.token_count[left][:, None], 0.0)
    tokens = 200.0 / 3 * (1 + (1 + kept + moved) / np.maximum(la + lb, 1))
    tokens = np.maximum(tokens, 200.0 * s / np.maximum(s + least, 1))
    bound = np.minimum(np.maximum(windows, tokens), 100.0)
    return np.where((short == 0) | (least == 0), 100.0, bound)


# --- LCS ---------------------------------------------------------------------------------


def _codes(texts, pad: np.uint32, reverse: bool = False) -> np.ndarray:
    """Code points, one row per text, filled up with ``pad``."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    width = max(int(lengths.max(initial=0)), 1)
    packed = np.array(list(texts), dtype=f"<U{width}")
    codes = packed.view(np.uint32).reshape(len(texts), width)
    place = np.arange(width)[None, :]
    if reverse:
        codes = np.take_along_axis(codes, np.maximum(lengths[:, None] - 1 - place, 0), axis=1)
    return np.where(place < lengths[:, None], codes, pad)


def _masks(needle: np.ndarray, hay: np.ndarray) -> np.ndarray:
    """For each pair and hay position, the needle positions with that character, as bits."""
    words = (needle.shape[1] + 63) // 64
    out = np.zeros((words, *hay.shape), dtype=np.uint64)
    for i in range(needle.shape[1]):
        hit = (needle[:, i, None] == hay).astype(np.uint64)
        out[i >> 6] |= hit << np.uint64(i & 63)
    return out


def _advance(state: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """One LCS step: zero bits of ``state`` count matched needle positions."""
    hit = state & mask
    if len(state) == 1:
        return (state + hit) | (state & ~mask)
    total = np.empty_like(state)
    carry = np.zeros(state.shape[1:], dtype=np.uint64)
    for w in range(len(state)):
        part = state[w] + hit[w]
        over = part < state[w]
        total[w] = part + carry
        carry = (over | (total[w] < part)).astype(np.uint64)
    return total | (state & ~mask)


def _advance_one(state: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The same for texts of one word."""
    hit = state & mask
    return (state + hit) | (state - hit)


def _zeros(state: np.ndarray) -> np.ndarray:
    return np.bitwise_count(~state).sum(axis=0, dtype=np.int64)


def lcs_lengths(a, b) -> np.ndarray:
    """LCS length of each pair of texts ``a[i]``, ``b[i]``."""
    out = np.zeros(len(a), dtype=np.int64)
    swap = np.array([len(x) > len(y) for x, y in zip(a, b)], dtype=bool)
    short = np.where(swap, b, a)
    long = np.where(swap, a, b)
    sizes = np.array([len(t) for t in short], dtype=np.int64)
    lengths = np.array([len(t) for t in long], dtype=np.int64)
    alone = _alone(sizes, lengths)
    for row in np.flatnonzero(alone):
        out[row] = longtexts.lcs_length(short[row], long[row])
    order = np.lexsort((lengths, sizes))
    for rows in _chunks(order[~alone[order]], sizes, lengths):
        masks = _masks(_codes(short[rows], _NEEDLE_PAD), _codes(long[rows], _HAY_PAD))
        state = np.full(masks.shape[:2], _ONES, dtype=np.uint64)
        for j in range(masks.shape[2]):
            state = _advance(state, masks[:, :, j])
        out[rows] = _zeros(state)
    return out


def _alone(sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pairs too long for a step of many."""
    return np.maximum((sizes + 63) // 64, 1) * (lengths + 1) > _CELLS


def _chunks(order: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, same_size: bool = False):
    """Cut ``order`` (sorted by size) into runs whose arrays stay small."""
    start = 0
    while start < len(order):
        stop, widest = start, 0
        while stop < len(order):
            if same_size and sizes[order[stop]] != sizes[order[start]]:
                break
            words = (sizes[order[stop]] + 63) // 64 or 1
            widest = max(widest, words * (lengths[order[stop]] + 1))
            if stop > start and widest * (stop - start + 1) > _CELLS:
                break
            stop += 1
        yield order[start:stop]
        start = stop


# --- scores ------------------------------------------------------------------------------


def token_set_ratio(a: Texts, ia: np.ndarray, b: Texts, ib: np.ndarray) -> np.ndarray:
    """Score of texts ``a[ia[k]]`` and ``b[ib[k]]``."""
    size = len(ia)
    left, right = a.joined[ia].copy(), b.joined[ib].copy()
    common = np.zeros(size, dtype=np.int64)
    out = np.zeros(size)
    todo = np.ones(size, dtype=bool)
    for k, (i, j) in enumerate(zip(ia, ib)):
        x, y = a.tokens[i], b.tokens[j]
        if not x or not y:
            todo[k] = False
        elif not x.isdisjoint(y):
            both = x & y
            if len(both) == len(x) or len(both) == len(y):
                out[k], todo[k] = 100.0, False
            else:
                common[k] = sum(map(len, both)) + len(both) - 1
                left[k] = " ".join([t for t in a.sorted[i] if t not in both])
                right[k] = " ".join([t for t in b.sorted[j] if t not in both])
    rows = np.flatnonzero(todo)
    x, y, s = left[rows], right[rows], common[rows]
    nx = np.array([len(t) for t in x], dtype=np.int64)
    ny = np.array([len(t) for t in y], dtype=np.int64)
    gap = (s > 0).astype(np.int64)
    la, lb = s + gap + nx, s + gap + ny
    score = 100.0 * (1 - (nx + ny - 2 * lcs_lengths(x, y)) / np.maximum(la + lb, 1))
    with np.errstate(invalid="ignore"):
        inter = np.maximum(100.0 * (1 - (gap + nx) / (s + la)), 100.0 * (1 - (gap + ny) / (s + lb)))
    out[rows] = np.where(s > 0, np.maximum(score, inter), score)
    return out


def partial_ratio(a, b) -> np.ndarray:
    """Best ratio of the shorter text with any window of the longer one, per pair.

    Windows are the full-length ones and the shorter prefixes and suffixes.
    """
    swap = np.array([len(x) > len(y) for x, y in zip(a, b)], dtype=bool)
    needle, hay = np.where(swap, b, a), np.where(swap, a, b)
    sizes = np.array([len(t) for t in needle], dtype=np.int64)
    lengths = np.array([len(t) for t in hay], dtype=np.int64)
    out = np.where((sizes == 0) & (lengths == 0), 100.0, 0.0)
    alone = _alone(sizes, lengths) & (sizes > 0)
    for row in np.flatnonzero(alone):
        out[row] = longtexts.partial_ratio(needle[row], hay[row])
    live = np.flatnonzero((sizes > 0) & ~alone)
    order = live[np.lexsort((lengths[live], sizes[live]))]
    for rows in _chunks(order, sizes, lengths, same_size=True):
        out[rows] = _window_ratios(needle[rows], hay[rows], int(sizes[rows[0]]))
    even = np.flatnonzero((sizes == lengths) & (sizes > 0) & (out < 100.0) & ~alone)
    for rows in _chunks(even[np.argsort(sizes[even])], sizes, lengths, same_size=True):
        turned = _window_ratios(hay[rows], needle[rows], int(sizes[rows[0]]))
        out[rows] = np.maximum(out[rows], turned)
    return out


def _window_ratios(needle, hay, size: int) -> np.ndarray:
    codes = _codes(needle, _NEEDLE_PAD)
    masks = _masks(codes, _codes(hay, _HAY_PAD))
    starts = masks.shape[2] - size + 1
    state = np.full((masks.shape[0], masks.shape[1], starts), _ONES, dtype=np.uint64)
    best = np.zeros(len(needle))
    for t in range(size):
        state = _advance(state, masks[:, :, t : t + starts])
        if t + 1 < size:  # prefix of t + 1 characters
            best = np.maximum(best, 200.0 * _zeros(state[:, :, 0]) / (size + t + 1))
    # Windows that run past a shorter hay are its suffixes at a longer nominal length,
    # so they never exceed the suffix scores below.
    best = np.maximum(best, 200.0 * _zeros(state).max(axis=1) / (2 * size))
    tail = _masks(
        _codes(needle, _NEEDLE_PAD, reverse=True),
        _codes(hay, _HAY_PAD, reverse=True)[:, : size - 1],
    )
    state = np.full(tail.shape[:2], _ONES, dtype=np.uint64)
    for t in range(size - 1):
        state = _advance(state, tail[:, :, t])
        best = np.maximum(best, 200.0 * _zeros(state) / (size + t + 1))
    return best


def name_score(
    a: Texts, ia: np.ndarray, b: Texts, ib: np.ndarray, bound: np.ndarray
) -> np.ndarray:
    """max(token_set_ratio, partial_ratio); windows only where their ``bound`` can still win."""
    score = token_set_ratio(a, ia, b, ib)
    rows = np.flatnonzero(bound > score)
    score[rows] = np.maximum(score[rows], partial_ratio(a.texts[ia[rows]], b.texts[ib[rows]]))
    return score
