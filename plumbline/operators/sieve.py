"""A first look at all pairs of a tile, a few machine instructions a pair.

Each text is drawn as 64 bits, for its characters and how often it has them, so that common bits
bound common characters, and those the scores. A sum in 16-bit numbers tells which pairs may reach the
threshold at all; only these few meet tighter bounds. Nothing that could link is lost: sums are
rounded up, what they have to reach is rounded down.
"""

from __future__ import annotations

import numpy as np

from plumbline.functions import similarity

# Steps of a sum of 16 bits that make a full score.
SCALE = 8192
# A token that so few of the texts have is looked up; others count as shared by all at first.
RARE = 64
# Records whose texts the sum can't hold, or that many bits fall together for, are left to others.
MOST_LOST, LEAST, MOST_LENGTH = 8, 4, 1000
# Pairs that are looked at together.
HELD = 100_000
# Records that a record is held against at once: as many as stay near a core.
STEP = 65_536


def tame(texts: similarity.Texts, present: np.ndarray) -> np.ndarray:
    """Texts that the sieve can judge."""
    lost = texts.sketch[1]
    plain = (texts.least >= LEAST) & (texts.length <= MOST_LENGTH) & (texts.length <= 2 * texts.joined_length)
    return ~present | (plain & (lost <= MOST_LOST) & (texts.token_count <= similarity.MOST_TOKENS))


class _Tokens:
    """Which of the texts ``right`` have a token."""

    def __init__(self, texts: similarity.Texts, right: np.ndarray):
        column = np.full(len(texts), -1)
        column[right] = np.arange(len(right))
        self.texts, self.rare, self.common = texts, {}, set()
        for token, rows in texts.holders.items():
            at = column[rows]
            at = np.sort(at[at >= 0])
            if len(at) * RARE > len(right):
                self.common.add(token)
            elif len(at):
                self.rare[token] = at

    def usual(self, i: int) -> int:
        """Length of the common tokens of text ``i`` with blanks between."""
        return max(sum(len(t) + 1 for t in self.texts.tokens[i] if t in self.common) - 1, 0)

    def holding(self, i: int) -> list[np.ndarray]:
        return [self.rare[t] for t in self.texts.tokens[i] if t in self.rare]


class Sieve:
    """The records ``right`` of a batch, for records to be held against them one by one."""

    def __init__(self, batch, right: np.ndarray, reach: float, exact: tuple[str, ...]):
        self.batch, self.right, self.reach = batch, right, reach
        whole = sum(batch.weights.values())
        self.weight = {s: w / whole for s, w in batch.weights.items()}
        self.exact = [s for s in self.weight if s in exact]
        self.has = {s: batch.present[s][right] for s in self.weight}
        self.fuzzy = [s for s in ("name", "address") if s in batch.texts]
        self.bits = {s: batch.texts[s].sketch[0][right] for s in self.fuzzy}
        self.tokens = {s: _Tokens(batch.texts[s], right) for s in self.fuzzy}
        self.least = {s: batch.texts[s].least[right].astype(np.float32) for s in self.fuzzy}
        self.joined = {"address": batch.texts["address"].joined_length[right]} if "address" in self.fuzzy else {}
        self.same = {s: self._groups(batch.codes[s][right]) for s in self.exact}
        self.sorted_by = self.sorter(batch, exact)
        size = len(right)
        self.word, self.sum, self.part = np.empty(size, np.uint64), np.empty(size, np.uint16), np.empty(size, np.uint16)
        self.common = {s: np.empty(size, np.uint8) for s in self.fuzzy}
        self.plans: dict[tuple, tuple] = {}
        names = batch.texts["name"]
        self.places = [(x.take(right, axis=1), k) for x, k in ((names.places, names.kinds), (names.joined_places, names.joined_kinds))]
        self.short = np.maximum(names.length, names.joined_length)[right] <= 64
        self.all_short = bool(self.short.all())

    @staticmethod
    def sorter(batch, exact: tuple[str, ...]) -> str | None:
        """The exact signal of most weight that some records have; ``right`` is sorted by its codes."""
        return max((s for s in batch.weights if s in exact and batch.present[s].any()), key=lambda s: batch.weights[s], default=None)

    @staticmethod
    def _groups(codes: np.ndarray) -> dict[int, np.ndarray]:
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.diff(codes[order])) + 1
        return {int(codes[rows[0]]): rows for rows in np.split(order, cuts) if len(rows)}

    def _plan(self, own: tuple, least: int, joined: int, usual: int) -> tuple:
        """What a common bit of names and of addresses counts, what shared tokens make at once, and
        what the sum has to reach, for every record of ``right``; and the score to reach."""
        known = (own, least, joined, usual)
        if known in self.plans:
            return self.plans[known]
        if len(self.plans) >= 8:
            self.plans.pop(next(iter(self.plans)))
        size, w = len(self.right), self.weight
        weight = sum((w[s] * self.has[s] for s in own), np.zeros(size))
        need = np.where(weight > 0, (self.reach - 1e-5) * weight, np.inf)
        reach, a, b, floor = need.copy(), np.zeros(size), np.zeros(size), np.zeros(size)
        if "address" in own and "address" in self.fuzzy:
            share = w["address"] * self.has["address"]
            b = share * 2 / np.maximum(self.joined["address"] + joined, 1)
            floor = share * 2 * usual / np.maximum(usual + np.minimum(self.joined["address"], joined), 1)
            usually = 0.65 * share
        else:
            usually = 0.0
        if "name" in own and w["name"] > 0:
            # A tangent to 2 c / (least + c), which bends down, near the c that matter.
            short = np.maximum(np.minimum(self.least["name"], least), 1)
            with np.errstate(invalid="ignore"):
                y = np.clip(np.where(weight > 0, (need - usually) / w["name"], 1), 0.05, 1)
            at = short * y / (2 - y)
            slope = 2 * short / (short + at) ** 2
            a = w["name"] * self.has["name"] * slope
            reach = reach - w["name"] * self.has["name"] * (2 * at / (short + at) - slope * at)
        up = [np.ceil(x * SCALE).astype(np.uint16) for x in (a, b, floor)]
        level = np.where(np.isinf(reach), 65535, np.clip(np.floor(reach * SCALE), 0, 65534)).astype(np.uint16)
        self.plans[known] = out = (*up, level, need)
        return out

    def row(self, i: int, start: int = 0) -> tuple[np.ndarray, ...]:
        """(at, need, names, addresses): records ``right[at]``, ``at`` from ``start`` on, that record ``i`` may
        link with; the score to reach and bounds on their common characters."""
        batch, w, size = self.batch, self.weight, len(self.right) - start
        own = tuple(s for s in w if batch.present[s][i])
        both = {s: s in own for s in self.fuzzy}
        texts = batch.texts
        usual = self.tokens["address"].usual(i) if both.get("address") else 0
        joined = int(texts["address"].joined_length[i]) if both.get("address") else 0
        a, b, floor, level, need = self._plan(own, int(texts["name"].least[i]) if both["name"] else 0, joined, usual)
        word, total, part = self.word[:size], self.sum[:size], self.part[:size]
        for s, step in (("name", a), ("address", b)):
            if not both.get(s):
                continue
            bits, lost = texts[s].sketch
            common = self.common[s][:size]
            np.bitwise_and(self.bits[s][start:], bits[i], out=word)
            np.bitwise_count(word, out=common)
            if lost[i]:
                common += np.uint8(lost[i])
            if s == "name":
                self._order(i, own, start, common)
                np.multiply(common, step[start:], out=total)
            else:
                np.multiply(common, step[start:], out=part)
                np.maximum(part, floor[start:], out=part)
                if both["name"]:
                    np.add(total, part, out=total)
                else:
                    total[:] = part
        if not any(both.values()):
            total[:] = 0
        self._add_equal(i, own, start, total)
        at = np.flatnonzero(total >= level[start:])
        chars = [self.common[s][:size][at] if both.get(s) else np.zeros(len(at), dtype=np.uint8) for s in ("name", "address")]
        at += start
        return at, need[at], *chars

    def _order(self, i: int, own: tuple, start: int, common: np.ndarray) -> None:
        """Where records agree on the signal by which they are sorted, less is asked of names, and far
        more pass; there common characters have to be in the same order, in the texts or among the
        tokens. Names that share a token are left out."""
        if self.sorted_by not in own or self.tokens["name"].usual(i):
            return
        rows = self.same[self.sorted_by].get(int(self.batch.codes[self.sorted_by][i]))
        lengths = self.batch.texts["name"].length[i], self.batch.texts["name"].joined_length[i]
        if rows is None or rows[-1] < start or max(lengths) > 64:
            return
        first, last = max(int(rows[0]), start), int(rows[-1]) + 1
        best = None
        for (places, kinds), length in zip(self.places, lengths, strict=True):
            state = np.full(last - first, ~places.dtype.type(0), dtype=places.dtype)
            hit = np.empty_like(state)
            rest = np.empty_like(state)
            for code in kinds[:length, i].tolist():
                np.bitwise_and(state, places[code][first:last], out=hit)
                np.subtract(state, hit, out=rest)
                np.add(state, hit, out=state)
                np.bitwise_or(state, rest, out=state)
            found = np.bitwise_count(~state)
            best = found if best is None else np.maximum(best, found)
        zone = common[first - start : last - start]
        closer = np.minimum(zone, best)
        if not self.all_short:
            closer = np.where(self.short[first:last], closer, zone)
        for held in self.tokens["name"].holding(i):
            held = held[(held >= first) & (held < last)] - first
            closer[held] = zone[held]
        zone[:] = closer

    def _add_equal(self, i: int, own: tuple, start: int, total: np.ndarray) -> None:
        """What equal signals and looked up tokens add."""
        lists = []
        for s in own:
            if s in self.exact:
                rows = self.same[s].get(int(self.batch.codes[s][i]))
                if rows is not None:
                    lists.append((rows, self.weight[s]))
        if "address" in own and "address" in self.fuzzy:
            rows = self.tokens["address"].holding(i)
            if rows:
                lists.append((rows[0] if len(rows) == 1 else np.unique(np.concatenate(rows)), self.weight["address"]))
        for rows, weight in lists:
            more = np.uint16(np.ceil(weight * SCALE))
            if len(rows) * 4 > len(self.right):
                total += more
                continue
            if int(rows[-1]) - int(rows[0]) + 1 == len(rows):
                total[max(int(rows[0]) - start, 0) : max(int(rows[-1]) + 1 - start, 0)] += more
                continue
            if start:
                rows = rows[np.searchsorted(rows, start) :] - start
            total[rows] += more


def sifted(batch, left: np.ndarray, right: np.ndarray, triangular: bool, reach: float, exact: tuple[str, ...]):
    """(ia, ib, windows) of the pairs of a grid that may reach the threshold, each once, with whether
    windows of names could take them there; all of them tame. In a triangular grid both sides are
    the same, and a record meets those behind it."""
    by = Sieve.sorter(batch, exact)
    if by is not None:
        right = right[np.argsort(batch.codes[by][right], kind="stable")]
    if triangular:
        left = right
    held: list[tuple] = []
    size = 0
    for first in range(0, len(right), STEP):
        sieve = Sieve(batch, right[first : first + STEP], reach, exact)
        # Records with one plan go together.
        keys = [batch.present[s][left] for s in sieve.weight] + [batch.texts[s].joined_length[left] for s in sieve.fuzzy]
        for k in np.lexsort(keys).tolist():
            start = max(k + 1 - first, 0) if triangular else 0
            if start >= len(sieve.right):
                continue
            i = int(left[k])
            at, *known = sieve.row(i, start)
            if len(at):
                held.append((np.full(len(at), i), sieve.right[at], *known))
                size += len(at)
            if size > HELD:
                yield from _settled(sieve, held, triangular)
                held, size = [], 0
    if size:
        yield from _settled(sieve, held, triangular)


def _settled(sieve: Sieve, held: list[tuple], triangular: bool):
    """Tighter and tighter bounds for what the sieve let through."""
    batch, room = sieve.batch, 1e-5
    ia, ib, need, names, addresses = (np.concatenate(x) for x in zip(*held, strict=True))
    both = {s: batch.present[s][ia] & batch.present[s][ib] for s in sieve.weight}
    for s in sieve.exact:
        need = need - sieve.weight[s] * (both[s] & (batch.codes[s][ia] == batch.codes[s][ib]))
    share = {s: sieve.weight[s] * both[s] for s in sieve.fuzzy}
    rest = need - share["address"] * _sets(batch.texts["address"], ia, ib, addresses) if "address" in share else need
    texts = batch.texts["name"]
    least = np.minimum(texts.least[ia], texts.least[ib])
    most = similarity.upper_bound(names, least) / 100 + room
    on = np.flatnonzero(share["name"] * most >= rest)
    if not len(on):
        return
    part = share.get("address", np.zeros(len(ia)))
    ia, ib, need, rest, names, point, part = (x[on] for x in (ia, ib, need, rest, names, share["name"], part))
    windows, inner = similarity.window_bounds(texts, ia, ib, names)
    may = (point > 0) & (point * (windows / 100 + room) >= rest)
    plain = point * (_sets(texts, ia, ib, names) + room) >= rest
    on = np.flatnonzero(may | plain)
    ia, ib, need, rest, point, part, inner, may, plain = (x[on] for x in (ia, ib, need, rest, point, part, inner, may, plain))
    if "address" in share:  # by the order of characters
        rest = np.maximum(rest, need - part * (similarity.set_bound(batch.texts["address"], ia, ib) / 100 + room))
    at = np.flatnonzero(plain & (point > 0))
    plain[at] = point[at] * (similarity.set_bound(texts, ia[at], ib[at]) / 100 + room) >= rest[at]
    at = np.flatnonzero(may)
    ends = similarity.end_bound(texts, ia[at], ib[at])
    may[at] = point[at] * (np.maximum(inner[at], ends) / 100 + room) >= rest[at]
    on = np.flatnonzero(may | plain)
    if len(on):
        ia, ib = ia[on], ib[on]
        if triangular:
            ia, ib = np.minimum(ia, ib), np.maximum(ia, ib)
        yield ia, ib, may[on]


def _sets(texts: similarity.Texts, ia: np.ndarray, ib: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Bound on token set scores, of 1, as ``Bounds.token_sets``."""
    a, b = texts.joined_length[ia], texts.joined_length[ib]
    shared = np.maximum(similarity.shared_tokens(texts, ia, ib)[0] - 1, 0)
    sets = np.maximum(2.0 * common / np.maximum(a + b, 1), 2 * shared / np.maximum(shared + np.minimum(a, b), 1))
    return sets + 1e-5
