"""Language-model scores from a probabilistic suffix tree over words.

A state of the tree is a context of one to ``DEPTH`` words that training texts hold often enough
and whose next-word distribution differs enough from that of its longest shorter state. A state's
distribution is its discounted counts, the mass left over going to the next shorter state, and at
the root to the add-one distribution over single words. A token is scored in the longest state
that ends before it.

Counts of words and contexts cover all training texts. Contexts, and words in contexts, need
``LEAST_COUNT`` occurrences, however large the corpus; beyond that the divergence test alone prunes.
The tree is never in one place: buckets of contexts test their own, ask the buckets of the shorter
contexts for what those give, and tell every chunk of documents about the contexts it holds.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chunks import NO_ID, pack, packed_chunks, steps, unpack, with_null_ids
from plumbline.llm.common import written_alone
from plumbline.llm.hashing import END, mixed, tokens

DEPTH = 3
LEAST_COUNT = 2
DISCOUNT = 0.75
# What chunks are told has the bucket that tells them; it goes down from PAIRS for pairs, and down
# from FIRST_TOLD for contexts.
PAIRS, FIRST_TOLD = -1, -(1 << 40)
# Nats that a state must gain for each of its entries, and for itself.
ENTRY_COST, STATE_COST = 2.0, 5.0
FOLDS, HELD_OUT = 7, 2

_TOP, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
# A bucket has about a million pairs, so one in some 60 that are seen once passes, to be counted exactly later.
_PAIR = np.uint64((1 << 26) - 1)


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(b"" if doc_id == NO_ID else str(doc_id).encode()) % FOLDS == HELD_OUT


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> _TOP) * np.uint64(buckets)) >> _TOP).astype("i8")


def _cuts(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of every run of equal values."""
    if not len(sorted_values):
        return []
    new = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))
    return list(zip(new.tolist(), [*new[1:].tolist(), len(sorted_values)], strict=True))


def _planes(values: np.ndarray) -> np.ndarray:
    """Whole numbers as rows of bytes of equal weight, without those that are zero everywhere; they pack better."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return np.ascontiguousarray(values.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T)


def _from_planes(planes: np.ndarray) -> np.ndarray:
    width = 4 if len(planes) <= 4 else 8
    whole = np.zeros((planes.shape[1], width), "u1")
    whole[:, : len(planes)] = planes.T
    return whole.view(f"<u{width}")[:, 0]


def _pack(*numbers: np.ndarray) -> bytes:
    return pack(*map(_planes, numbers))


def _unpack(blob: bytes) -> list[np.ndarray]:
    return [_from_planes(x) if x.ndim == 2 else x for x in unpack(blob)]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, "u8"), *parts])


def _sorted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes in order, where each of them was); sorts both as one number where they fit, which is several times as fast."""
    shift = np.uint64(len(codes).bit_length())
    if int(codes.max(initial=0)).bit_length() + int(shift) > 64:
        order = np.argsort(codes)
        return codes[order], order
    both = np.sort((codes << shift) | np.arange(len(codes), dtype="u8"))
    return both >> shift, (both & ((np.uint64(1) << shift) - np.uint64(1))).astype("i8")


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct codes in order, place of each code among them)."""
    ordered, order = _sorted(codes)
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(codes)]
    at = np.empty(len(codes), "u4")
    at[order] = np.cumsum(new, dtype="u4") - np.uint32(1)
    return ordered[new], at


def _tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, sorted; word and text of every token)."""
    hashes, owner = tokens(texts)
    words, at = np.unique(hashes, return_inverse=True)
    return words, at, owner


def _pack_chunk(rows: pd.DataFrame) -> bytes:
    """Ids, numbers of tokens, words and tokens of a chunk. Frequent words come first, so that tokens are small numbers."""
    words, at, owner = _tokens_of(list(rows["text"]))
    rare = -np.frexp(np.bincount(at, minlength=len(words)))[1]
    order = np.argsort(rare, kind="stable")
    rank = np.empty(len(words), "u8")
    rank[order] = np.arange(len(words), dtype="u8")
    lengths = np.bincount(owner, minlength=len(rows)).astype("u8")
    return _pack(rows["doc_id"].to_numpy("i8").view("u8"), lengths, steps(words[order]), rank[at])


def _chunk_tokens(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Ids of texts, hashes of words in order, word and text of every token, and which texts train.

    ``rows`` are a chunk's packed row, or its texts.
    """
    if "text" in rows:
        rows = rows.sort_values("row", ignore_index=True)
        doc_ids = rows["doc_id"].to_numpy("i8")
        words, at, owner = _tokens_of(list(rows["text"]))
    else:
        doc_ids, lengths, words, at = _unpack(rows["data"].iloc[0])
        words, order = _sorted(np.cumsum(words, dtype="u8"))
        rank = np.empty(len(words), "u4")
        rank[order] = np.arange(len(words))
        doc_ids, owner, at = doc_ids.astype("u8").view("i8"), np.repeat(np.arange(len(lengths), dtype="u4"), lengths.astype("i8")), rank[at]
    return doc_ids, words, at, owner, ~np.array([is_held_out(d) for d in doc_ids.tolist()], bool)


def _ask_words(buckets: int):
    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        """The distinct words of a chunk and how often its training texts hold them."""
        _, words, at, owner, training = _chunk_tokens(rows)
        counts = np.bincount(at, weights=training[owner], minlength=len(words)).astype("u4")
        bucket, chunk = _bucket(words, buckets), rows["chunk"].iloc[0]
        out = [(bucket[a], chunk, _pack(steps(words[a:b]), counts[a:b])) for a, b in _cuts(bucket)]
        return pd.DataFrame(out, columns=["bucket", "chunk", "data"])

    return ask


def _count_words(buckets: int, least: int):
    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Corpus counts of the words a chunk asked for, and numbers as names of those that are frequent.

        The more frequent, the smaller the number. A further row has the bucket's totals.
        """
        asked = [_unpack(d) for d in rows["data"]]
        words = [np.cumsum(a[0], dtype="u8") for a in asked]
        known, at = _distinct(np.concatenate(words))
        total = np.bincount(at, weights=np.concatenate([a[1] for a in asked])).astype("u8")
        names = np.empty(len(known), "u8")
        names[np.argsort(total)[::-1]] = np.arange(len(known), dtype="u8") * np.uint64(buckets) + np.uint64(key[0])
        out, low = [(key[0], -1, int(total.sum(dtype="u8")), int((total > 0).sum()), None)], 0
        for chunk, own in zip(rows["chunk"], words, strict=True):
            own = at[low : low + len(own)]
            low += len(own)
            out.append((key[0], chunk, None, None, _pack(total[own], names[own][total[own] >= least])))
        found = pd.DataFrame(out, columns=["bucket", "chunk", "tokens", "types", "data"])
        return found.astype({"tokens": "Int64", "types": "Int64"})

    return count


def _follows(owner: np.ndarray) -> np.ndarray:
    """Whether a token follows another of its text."""
    return np.concatenate([[False], owner[1:] == owner[:-1]])[: len(owner)]


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first) ^ second)


def _bits(n: int) -> np.uint64:
    return np.uint64(int(n).bit_length())


def _halves(codes: np.ndarray, bits: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return codes >> bits, codes & ((np.uint64(1) << bits) - np.uint64(1))


@dataclass
class _Pairs:
    """Tokens of a chunk, and its distinct pairs of frequent words that follow each other.

    ``word`` numbers the chunk's words in the order of their names. ``names`` of frequent words are
    numbers, the same in every chunk; a word that was told without a number is named by its hash.
    """

    doc_ids: np.ndarray
    owner: np.ndarray
    training: np.ndarray
    counts: np.ndarray  # of every token in the corpus
    word: np.ndarray  # of every token
    words: np.ndarray  # hash, name and corpus count by word
    names: np.ndarray
    totals: np.ndarray
    place: np.ndarray | None  # second tokens of pairs
    of: np.ndarray | None  # the pair at each of these places
    first: np.ndarray  # words of the pairs, which are sorted by them
    second: np.ndarray
    number: np.ndarray  # of times that training texts of the chunk hold the pair
    hash: np.ndarray | None  # in the order of asking
    order: np.ndarray | None


def _pairs(rows: pd.DataFrame, told: pd.DataFrame, buckets: int, least: int) -> _Pairs:
    doc_ids, words, at, owner, training = _chunk_tokens(rows)
    # Answers come per bucket, in the order of the words.
    told = [_unpack(d) for d in told[told["bucket"] >= 0].sort_values("bucket")["data"]]
    totals = _joined([a[0] for a in told])
    names, low = words.copy(), 0
    for answer in told:
        own = low + np.flatnonzero(answer[0] >= least)
        low += len(answer[0])
        if len(answer) > 1:
            names[own] = answer[1]
    names[totals < least] = 0  # never used
    names, order = _sorted(names)
    rank = np.empty(len(words), "u4")
    rank[order] = np.arange(len(words), dtype="u4")
    word, words, totals = rank[at], words[order], totals[order]
    counts = totals[word]
    often = counts >= least
    place = np.flatnonzero(often & np.concatenate([[False], often[:-1]])[: len(often)] & _follows(owner))
    bits = _bits(len(words))
    codes, of = _distinct((word[place - 1] << bits) | word[place])
    first, second = _halves(codes, bits)
    number = np.bincount(of, weights=training[owner[place]], minlength=len(codes)).astype("u8")
    code = _pair_code(_pair_hash(words[first], words[second]), buckets)
    return _Pairs(doc_ids, owner, training, counts, word, words, names, totals, place, of, first, second, number, *_sorted(code))


def _pair_code(pairs: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (upper half) and a short hash (lower half) of pairs."""
    return (_bucket(pairs, buckets).astype("u8") << _TOP) | (pairs & _PAIR)


def _ask_pairs(buckets: int, least: int):
    def ask(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """Pairs of frequent words in a chunk, with counts in its training texts."""
        out = []
        if len(rows):
            pairs = _pairs(rows, told, buckets, least)
            codes, counts = pairs.hash, pairs.number[pairs.order]
            bucket = (codes >> _TOP).astype("i8")
            for a, b in _cuts(bucket):
                out.append((bucket[a], key[0], _pack(steps(codes[a:b] & _LOW), counts[a:b])))
        return pd.DataFrame(out, columns=["bucket", "chunk", "data"])

    return ask


def _count_pairs(least: int):
    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Tells each chunk which of its pairs the whole corpus has often enough, in its order.

        Two pairs with one hash in a bucket may pass together; what passes is counted exactly later.
        """
        asked = [_unpack(d) for d in rows["data"]]
        codes = [np.cumsum(a[0], dtype="u8") for a in asked]
        known, at = _distinct(np.concatenate(codes))
        good = np.bincount(at, weights=np.concatenate([a[1] for a in asked])) >= least
        out, low = [], 0
        for chunk, own in zip(rows["chunk"], codes, strict=True):
            out.append((PAIRS - key[0], chunk, pack(np.array([len(own)]), np.packbits(good[at[low : low + len(own)]]))))
            low += len(own)
        return pd.DataFrame(out, columns=["bucket", "chunk", "data"])

    return count


@dataclass
class _Level:
    """Contexts of one length in a chunk, and the frequent words that follow them, by bucket.

    ``upper`` and ``last`` say what a context consists of: for one word only the word (``last``), for
    two both words, for three the context without its first word, and that word. At a place
    in ``place``, ``at`` is the context before it and ``entry`` the entry of the token there or -1.
    """

    upper: np.ndarray
    last: np.ndarray
    total: np.ndarray
    of: np.ndarray  # context and word of entries, which are sorted by them
    following: np.ndarray
    number: np.ndarray
    place: np.ndarray
    at: np.ndarray
    entry: np.ndarray
    starts: np.ndarray  # where a bucket's contexts begin, and the last one ends
    entry_starts: np.ndarray


def _entries(at: np.ndarray, place: np.ndarray, listed: np.ndarray, word: np.ndarray, trained: np.ndarray):
    """(context, word, number) of what follows contexts, and the entry at every place."""
    bits = _bits(word.max(initial=0))
    codes, of = _distinct((at[listed] << bits) | word[place[listed]])
    entry = np.full(len(place), -1, "i4")
    entry[listed] = of
    return *_halves(codes, bits), np.bincount(of, weights=trained[place[listed]], minlength=len(codes)).astype("u8"), entry


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by bucket that keeps the order inside, where buckets begin in it)."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _own_contexts(rows: pd.DataFrame, told: pd.DataFrame, buckets: int, least: int) -> tuple[_Pairs, list[_Level]]:
    """A chunk's pairs, and its contexts of every length with what follows, all of linked pairs only.

    Longer contexts are in the bucket of their last two words. Sorted, so a chunk finds the same order again.
    """
    pairs = _pairs(rows, told, buckets, least)
    masks = told[(told["bucket"] <= PAIRS) & (told["bucket"] > FIRST_TOLD)].sort_values("bucket", ascending=False)
    masks = [np.unpackbits(m, count=int(n[0])) for n, m in map(unpack, masks["data"])]
    linked = np.zeros(len(pairs.first), bool)
    linked[pairs.order] = np.concatenate([np.zeros(0, "u1"), *masks]).astype(bool)
    first, second, number = pairs.first[linked], pairs.second[linked], pairs.number[linked]
    # The linked pair that ends at a token, or -1.
    pair_at = np.full(len(pairs.word), -1, "i4")
    pair_at[pairs.place] = np.where(linked, np.cumsum(linked) - 1, -1)[pairs.of]
    pairs.place = pairs.of = pairs.hash = pairs.order = None
    trained, follows = pairs.training[pairs.owner], _follows(pairs.owner)

    # A context that other chunks know what follows takes its share here, whatever follows it.
    words = np.flatnonzero((pairs.totals >= least) & (pairs.words != END))
    order, starts = _by_bucket(_bucket(mixed(pairs.names[words]), buckets), buckets)
    rank = np.empty(len(words), "u8")
    rank[order] = np.arange(len(words), dtype="u8")
    state_of = np.full(len(pairs.words), -1, "i4")
    state_of[words] = rank
    entry_order = np.argsort(state_of[first], kind="stable")
    entry_rank = np.empty(len(first) + 1, "i4")
    entry_rank[entry_order], entry_rank[-1] = np.arange(len(first)), -1
    of = state_of[first[entry_order]].astype("u8")
    place = np.flatnonzero(follows)
    at = state_of[pairs.word[place - 1]]
    place, at = place[at >= 0], at[at >= 0]
    levels = [_Level(words[order], words[order], pairs.totals[words[order]], of, second[entry_order], number[entry_order], place, at, entry_rank[pair_at[place]], starts, np.searchsorted(of, starts))]

    # Nothing follows the end of a text; any other pair is the context of a token.
    states = np.flatnonzero(pairs.words[second] != END)
    order, starts = _by_bucket(_bucket(_pair_hash(pairs.names[first[states]], pairs.names[second[states]]), buckets), buckets)
    states = states[order]
    rank = np.zeros(len(first), "u4")
    rank[states] = np.arange(len(states), dtype="u8")
    place = np.flatnonzero(follows & np.concatenate([[False], pair_at[:-1] >= 0])[: len(follows)])
    at, listed = rank[pair_at[place - 1]], pair_at[place] >= 0
    of, following, often, entry = _entries(at, place, listed, pairs.word, trained)
    levels.append(_Level(first[states], second[states], number[states], of, following, often, place, at, entry, starts, np.searchsorted(of, starts)))

    longer = pair_at[place - 2] >= 0  # the first token of a text ends no pair, and place is 2 or more
    place, at, listed = place[longer], at[longer], listed[longer]
    bits = _bits(len(pairs.words))
    codes, at = _distinct((at << bits) | pairs.word[place - 3])
    upper, last = _halves(codes, bits)
    total = np.bincount(at, weights=trained[place], minlength=len(codes)).astype("u8")
    starts = np.searchsorted(upper, starts)
    of, following, often, entry = _entries(at, place, listed, pairs.word, trained)
    levels.append(_Level(upper, last, total, of, following, often, place, at, entry, starts, np.searchsorted(of, starts)))
    return pairs, levels


def _jumps(values: np.ndarray) -> np.ndarray:
    """Differences of whole numbers that hardly vary, as numbers from zero."""
    jumps = np.diff(values.astype("i8"), prepend=0)
    return ((jumps << 1) ^ (jumps >> 63)).astype("u8")


def _after_jumps(jumps: np.ndarray) -> np.ndarray:
    jumps = jumps.astype("i8")
    return np.cumsum((jumps >> 1) ^ -(jumps & 1))


def _ask_contexts(buckets: int, least: int):
    def ask(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """Contexts in a chunk, with the frequent words that follow them."""
        out = []
        if len(rows):
            pairs, levels = _own_contexts(rows, told, buckets, least)
            names = pairs.names
            for b in range(buckets):
                parts, above = [], 0
                for k, x in enumerate(levels, 1):
                    s, t = x.starts[b : b + 2]
                    e, f = x.entry_starts[b : b + 2]
                    upper = names[x.upper[s:t]] if k < 3 else x.upper[s:t] - np.uint64(above)
                    of, following = x.of[e:f] - np.uint64(s), names[x.following[e:f]]
                    # The chunk tells the counts of single words, each once; by name they are nearly in order.
                    more = [_jumps(pairs.totals[_distinct(x.following[e:f])[0]])] if k == 1 else [names[x.last[s:t]]]
                    parts += [steps(upper), x.total[s:t], steps(of), following, x.number[e:f], *more]
                    above = s
                if any(map(len, parts)):
                    out.append((b, key[0], _pack(*parts)))
        return pd.DataFrame(out, columns=["bucket", "chunk", "data"])

    return ask


def _places(slots: np.ndarray) -> tuple[np.ndarray, ...]:
    """A packable form of numbers with -1 between them, the others ascending for the most part."""
    has = slots >= 0
    return np.array([len(slots)]), np.packbits(has), _planes(_jumps(slots[has]))


def _at_places(values: np.ndarray, n: np.ndarray, has: np.ndarray, jumps: np.ndarray) -> np.ndarray:
    """The values at such numbers, and zero for -1."""
    out = np.zeros(int(n[0]), values.dtype)
    out[np.unpackbits(has, count=len(out)).astype(bool)] = values[_after_jumps(jumps)]
    return out


def _numbered(names: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Names as numbers of 32 bits in the same order, and what they stand for if not for themselves."""
    if int(names.max(initial=0)) < 1 << 32:
        return names, None
    known, at = np.unique(names, return_inverse=True)
    return at.astype("u8"), known


def _summed(codes: np.ndarray, *numbers: np.ndarray):
    """(distinct codes, place of each among them, one occurrence of each, sums of the numbers)."""
    known, at = _distinct(codes)
    one = np.empty(len(known), "i8")
    one[at] = np.arange(len(codes))
    return known, at, one, *(np.bincount(at, weights=x, minlength=len(known)).astype("u8") for x in numbers)


def _slots(n: int, good: np.ndarray) -> np.ndarray:
    out = np.full(n, -1)
    out[good] = np.arange(len(good))
    return out


def _count_contexts(least: int):
    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Contexts of a bucket and what follows them, as far as the whole corpus has them often.

        Rows with -1 for ``k`` say which of these each chunk asked for, in its order.
        """
        parts = [_unpack(d) for d in rows["data"]]
        for p in parts:
            p[5] = _after_jumps(p[5]).astype("u8")[_distinct(p[3])[1]]
        of_chunks, out = [], []
        names = _joined([x for p in parts for x in (np.cumsum(p[0], dtype="u8"), p[3], np.cumsum(p[6], dtype="u8"), p[9], p[11], p[15], p[17])])
        numbers, back = _numbered(names)
        name, low, taken = (lambda x: x) if back is None else (lambda x: back[x]), 0, [[] for _ in range(7)]
        for p in parts:
            for i, j in enumerate((0, 3, 6, 9, 11, 15, 17)):
                taken[i].append(numbers[low : low + len(p[j])])
                low += len(p[j])
        bits = _bits(numbers.max(initial=0))
        low_bits = (np.uint64(1) << bits) - np.uint64(1)
        word, next1, first, next2, second, next3, third = map(_joined, taken)
        del names, numbers, taken

        def together(i: int, sizes: int) -> np.ndarray:
            """References of all chunks to what they list, the lists being one after another."""
            shift = np.cumsum([0] + [len(p[sizes]) for p in parts], dtype="u8")
            return _joined([np.cumsum(p[i], dtype="u8") + s for p, s in zip(parts, shift, strict=False)])

        def all_of(i: int) -> np.ndarray:
            return _joined([p[i] for p in parts])

        # One word.
        known, states_at, one = _summed(word)
        codes, entries_at, listed, number = _summed((states_at.astype("u8")[together(2, 0)] << bits) | next1, all_of(4))
        good = np.flatnonzero(number >= least)
        of = (codes[good] >> bits).astype("i8")
        used = np.unique(of)
        of_chunks.append((states_at, _slots(len(known), used), entries_at, _slots(len(codes), good), 0, 2))
        if len(used):
            out.append((key[0], 1, -1, _pack(steps(name(known[used])), all_of(1)[one[used]], steps(np.searchsorted(used, of).astype("u8")), name(codes[good] & low_bits), number[good], all_of(5)[listed[good]])))
        # Two words, by the first.
        known, states_at, _, total = _summed((first << bits) | second, all_of(7))
        codes, entries_at, _, number = _summed((states_at.astype("u8")[together(8, 6)] << bits) | next2, all_of(10))
        good = np.flatnonzero(number >= least)
        of = (codes[good] >> bits).astype("i8")
        used = np.unique(of)
        of_chunks.append((states_at, _slots(len(known), used), entries_at, _slots(len(codes), good), 6, 8))
        if len(used):
            out.append((key[0], 2, -1, _pack(steps(name(known[used] >> bits)), total[used], steps(np.searchsorted(used, of).astype("u8")), name(codes[good] & low_bits), number[good], name(known[used] & low_bits))))
        above, above_used, above_codes = states_at.astype("u8"), used, codes[good]
        # Three words, by the last two; what follows three words follows the last two.
        known, states_at, _, total = _summed((above[together(12, 6)] << bits) | third, all_of(13))
        codes, entries_at, _, number = _summed((states_at.astype("u8")[together(14, 12)] << bits) | next3, all_of(16))
        good = np.flatnonzero(number >= least)
        of = (codes[good] >> bits).astype("i8")
        used = np.unique(of)
        of_chunks.append((states_at, _slots(len(known), used), entries_at, _slots(len(codes), good), 12, 14))
        if len(used):
            parent = known[used] >> bits
            under = np.searchsorted(above_codes, (known[of] >> bits << bits) | (codes[good] & low_bits)).astype("u8")
            out.append((key[0], 3, -1, _pack(steps(np.searchsorted(above_used, parent).astype("u8")), total[used], steps(np.searchsorted(used, of).astype("u8")), name(codes[good] & low_bits), number[good], name(known[used] & low_bits), under)))
        ends = [0] * 2 * DEPTH
        for chunk, p in zip(rows["chunk"], parts, strict=True):
            told = []
            for i, (states_at, state_slots, entries_at, entry_slots, states, entries) in enumerate(of_chunks):
                for j, at, slots, n in ((2 * i, states_at, state_slots, len(p[states])), (2 * i + 1, entries_at, entry_slots, len(p[entries]))):
                    told += _places(slots[at[ends[j] : ends[j] + n]])
                    ends[j] += n
            out.append((key[0], -1, chunk, pack(*told)))
        return pd.DataFrame(out, columns=["bucket", "k", "chunk", "data"])

    return count


def _divergence(total: np.ndarray, of: np.ndarray, number: np.ndarray, below: np.ndarray):
    """(kept, mass left over, own probability of entries, what contexts give their entries).

    A context's listed next words are compared with what its longest kept shorter state gives
    them; the gain over all its occurrences has to exceed what state and entries cost. A context
    that is not kept gives what is below.
    """
    own = np.maximum(number - DISCOUNT, 0) / total[of]
    left = 1 - np.bincount(of, weights=own, minlength=len(total))
    inside = own + left[of] * below
    gain = np.bincount(of, weights=number * np.log(inside / below), minlength=len(total))
    rest = total - np.bincount(of, weights=number, minlength=len(total))
    gain += rest * np.log(np.maximum(left, 1e-12))
    gain -= STATE_COST + ENTRY_COST * np.bincount(of, minlength=len(total))
    keep = gain > 0
    return keep, left, own, np.where(keep[of], inside, below)


def _wanted(last: np.ndarray, of: np.ndarray, following: np.ndarray, buckets: int):
    """Entries of one word that a bucket's of two words need: (buckets, hashes, place of each entry's)."""
    parent = mixed(last)
    bucket, entry = _bucket(parent[of], buckets), mixed(parent[of] ^ following)
    order = np.lexsort((entry, bucket))
    new = np.concatenate([[True], (np.diff(entry[order]) != 0) | (np.diff(bucket[order]) != 0)])[: len(order)]
    at = np.empty(len(order), "i8")
    at[order] = np.cumsum(new) - 1
    return bucket[order][new], entry[order][new], at


def _counted(data: bytes) -> tuple[np.ndarray, ...]:
    """(first word or longer context's shorter one, total, context of entries, next word, number, further columns)."""
    upper, total, of, following, number, *more = _unpack(data)
    return np.cumsum(upper, dtype="u8"), total.astype("i8"), np.cumsum(of, dtype="i8"), following, number.astype("i8"), *more


def _ask_shorter(buckets: int):
    def ask(batches):
        """What a bucket's contexts of two words need from the buckets of their last words."""
        for rows in batches:
            out = []
            for own, data in zip(rows["bucket"], rows["data"], strict=True):
                _, _, of, following, _, last = _counted(data)
                bucket, entry, _ = _wanted(last, of, following, buckets)
                out += [(bucket[a], own, _pack(steps(entry[a:b]))) for a, b in _cuts(bucket)]
            yield pd.DataFrame(out, columns=["bucket", "part", "data"])

    return ask


def _kept(total: np.ndarray, of: np.ndarray, number: np.ndarray, keep: np.ndarray) -> bytes:
    """Of contexts: total, numbers and entries in all; of entries: number. Zero where not kept."""
    listed = np.bincount(of, weights=number, minlength=len(total)), np.bincount(of, minlength=len(total))
    return _pack(*(np.where(keep, x, 0).astype("u8") for x in (total, *listed)), np.where(keep[of], number, 0).astype("u8"))


def _test_words(n: int, v: int):
    def test(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Tests the contexts of one word of a bucket and answers the buckets of those of two."""
        out = []
        for data in rows["data"]:
            word, total, of, following, number, single = _counted(data)
            keep, _, _, given = _divergence(total, of, number, (single + 1.0) / (n + v + 1))
            out.append((key[0], -1, _kept(total, of, number, keep)))
            entry = mixed(mixed(word)[of] ^ following)
            order = np.argsort(entry)
            for part, data in zip(asked["part"], asked["data"], strict=True):
                at = np.searchsorted(entry, np.cumsum(_unpack(data)[0], dtype="u8"), sorter=order)
                out.append((part, key[0], pack(given[order[at]])))
        return pd.DataFrame(out, columns=["bucket", "part", "data"])

    return test


def _test_longer(buckets: int):
    def test(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        """Tests the contexts of two words of a bucket, then those of three, which lie in the same one."""
        found = {k: _counted(d) for k, d in zip(rows["k"], rows["data"], strict=True)}
        out = []
        if 2 in found:
            _, total, of, following, number, last = found[2]
            given = np.concatenate([unpack(d)[0] for d in answers.sort_values("part")["data"]])
            keep, _, _, given = _divergence(total, of, number, given[_wanted(last, of, following, buckets)[2]])
            out.append((key[0], 2, _kept(total, of, number, keep)))
        if 3 in found:
            _, total, of, _, number, _, under = found[3]
            keep = _divergence(total, of, number, given[under])[0]
            out.append((key[0], 3, _kept(total, of, number, keep)))
        return pd.DataFrame(out, columns=["bucket", "k", "data"])

    return test


def _sparse(has: np.ndarray, *numbers: np.ndarray) -> list[np.ndarray]:
    """A packable form of numbers that are zero together."""
    return [np.array([len(has)]), np.packbits(has), *(_planes(x[has]) for x in numbers)]


def _whole(n: np.ndarray, has: np.ndarray, *numbers: np.ndarray) -> list[np.ndarray]:
    out = []
    for x in numbers:
        out.append(np.zeros(int(n[0])))
        out[-1][np.unpackbits(has, count=int(n[0])).astype(bool)] = x
    return out


def _tell_contexts(key: tuple, tested: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """For each chunk, in its order, what ``_kept`` says of its contexts and of what follows them."""
    values = {k: _unpack(d) for k, d in zip(tested["k"], tested["data"], strict=True)}
    nothing, out = [np.zeros(0, "u8")] * 4, []
    for chunk, data in zip(asked["chunk"], asked["data"], strict=True):
        places, told = _unpack(data), []
        for k in range(DEPTH):
            *states, entries = values.get(k + 1, nothing)
            total, listed, many = (_at_places(x, *places[6 * k : 6 * k + 3]) for x in states)
            # A chunk knows the total of one word.
            told += _sparse(total > 0, total - listed, many, *([listed - many] if k else []))
            number = _at_places(entries, *places[6 * k + 3 : 6 * k + 6])
            told += _sparse(number > 0, number)
        out.append((FIRST_TOLD - key[0], chunk, pack(*told)))
    return pd.DataFrame(out, columns=["bucket", "chunk", "data"])


def _contexts(hashes: np.ndarray, owner: np.ndarray, often: np.ndarray):
    """For every length k: (k, places that follow a context of k words of one text, its hash)."""
    place = np.flatnonzero(_follows(owner) & np.concatenate([[False], often[:-1]])[: len(often)])
    context = mixed(hashes[place - 1])
    for k in range(1, DEPTH + 1):
        yield k, place, context
        place, context = place[place > k], context[place > k]
        same = owner[place - k - 1] == owner[place]
        place, context = place[same], context[same]
        context = mixed(context ^ hashes[place - k - 1])


@dataclass(frozen=True)
class Tree:
    """States and entries by length of context; hashes sorted."""

    tokens: int
    types: int
    least: int
    states: tuple[np.ndarray, ...]
    spare: tuple[np.ndarray, ...]  # mass that goes to the shorter state
    entries: tuple[np.ndarray, ...]
    gains: tuple[np.ndarray, ...]  # an entry's own probability

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1.0) / (self.tokens + self.types + 1)

    def probabilities(self, hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> np.ndarray:
        p = self.root(counts.astype("f8"))
        walk = _contexts(hashes, owner, counts >= self.least)
        for k, place, context in walk:
            states, entries = self.states[k - 1], self.entries[k - 1]
            if not len(states):
                continue
            at = np.minimum(np.searchsorted(states, context), len(states) - 1)
            inside = states[at] == context
            place, context, at = place[inside], context[inside], at[inside]
            own = np.zeros(len(place))
            if len(entries):
                entry = mixed(context ^ hashes[place])
                e = np.minimum(np.searchsorted(entries, entry), len(entries) - 1)
                own = np.where(entries[e] == entry, self.gains[k - 1][e], 0.0)
            p[place] = own + self.spare[k - 1][at] * p[place]
        return p


def _tree(levels: list[tuple], n: int, v: int, least: int) -> Tree:
    """A tree of (states, spare, states of entries, next words, gains) per length, states sorted."""
    columns: tuple[list, ...] = ([], [], [], [])
    for states, spare, of, following, gains in levels:
        entry = mixed(of ^ following)
        order = np.argsort(entry)
        for column, x in zip(columns, (states, spare, entry[order], gains[order]), strict=True):
            column.append(x)
    return Tree(n, v, least, *map(tuple, columns))


def build_tree(found: list[tuple[int, bytes]], n: int, v: int, least: int) -> Tree:
    """The tree of a single bucket whose words are named by their hashes; ``score`` spreads the same tests over buckets."""
    levels, below, states = [], np.zeros(0), np.zeros(0, "u8")
    given, entries = np.zeros(0), np.zeros(0, "u8")
    for k, data in sorted((k, d) for k, d in found if 1 <= k <= DEPTH):
        upper, total, of, following, number, *more = _counted(data)
        if k == 1:
            states, below = mixed(upper), (more[0] + 1.0) / (n + v + 1)
        elif k == 2:
            parent = mixed(more[0])
            order = np.argsort(entries)
            below = given[order[np.searchsorted(entries, mixed(parent[of] ^ following), sorter=order)]]
            states = mixed(parent ^ upper)
        else:
            states, below = mixed(states[upper] ^ more[0]), given[more[1]]
        keep, left, own, given = _divergence(total, of, number, below)
        entries, use = mixed(states[of] ^ following), keep[of]
        kept = np.flatnonzero(keep)[np.argsort(states[keep])]
        levels.append((states[kept], left[kept], states[of][use], following[use], own[use]))
    nothing = (np.zeros(0, "u8"), np.zeros(0), np.zeros(0, "u8"), np.zeros(0, "u8"), np.zeros(0))
    return _tree(levels + [nothing] * (DEPTH - len(levels)), n, v, least)


def _score(buckets: int, least: int, n: int, v: int):
    def score(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        pairs, levels = _own_contexts(rows, told, buckets, least)
        # Buckets are in the order of the chunk's contexts, so their answers together are too.
        answers = told[told["bucket"] <= FIRST_TOLD].sort_values("bucket", ascending=False)
        answers = [_unpack(d) for d in answers["data"]]
        base = (pairs.counts + 1.0) / (n + v + 1)
        p = base.copy()
        for k in range(DEPTH):
            level = levels.pop(0)
            i, j = (0, 4) if k == 0 else (8 * k - 1, 8 * k + 4)
            told = [_whole(*a[i:j]) + _whole(*a[j : j + 3]) for a in answers]
            rest, entries, *more, number = (np.concatenate([np.zeros(0), *x]) for x in (zip(*told, strict=True) if told else [[]] * (3 + (k > 0))))
            total = rest + entries + more[0] if k else level.total
            listed = total - rest
            kept = entries[level.at] > 0
            place, at, entry = level.place[kept], level.at[kept], level.entry[kept]
            left = 1 - (listed[at] - DISCOUNT * entries[at]) / total[at]
            own = np.where(entry >= 0, np.maximum(np.append(number, 0)[entry] - DISCOUNT, 0), 0) / total[at]
            p[place] = own + left * p[place]
        m = len(pairs.doc_ids)
        return pd.DataFrame({
            "doc_id": pairs.doc_ids,
            "held_out": ~pairs.training,
            "n_tokens": np.bincount(pairs.owner, minlength=m),
            "n_known": np.bincount(pairs.owner, weights=pairs.counts > 0, minlength=m).astype("i8"),
            "train_tokens": n,
            "base_score": np.bincount(pairs.owner, weights=np.log10(base), minlength=m),
            "score": np.bincount(pairs.owner, weights=np.log10(p), minlength=m),
        })

    return score


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Null and empty texts are the end token alone. Rows without a doc_id train like those whose
    id is the empty text. Repeated rows train and are scored as often as they occur. Where no row
    trains, all words are unknown.
    """
    table, buckets = packed_chunks(documents, _pack_chunk)
    chunks = table.groupBy("chunk")
    message, least = "bucket long, chunk long, data binary", LEAST_COUNT
    asked = chunks.applyInPandas(_ask_words(buckets), message)
    answers = written_alone(
        asked.groupBy("bucket").applyInPandas(
            _count_words(buckets, least), "bucket long, chunk long, tokens long, types long, data binary"
        ),
        "word-counts",
    )
    sums = answers.where("chunk < 0").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n, v = sums.n or 0, sums.v or 0
    words = answers.where("chunk >= 0").select("bucket", "chunk", "data")
    pairs = chunks.cogroup(words.groupBy("chunk")).applyInPandas(_ask_pairs(buckets, least), message)
    often = written_alone(pairs.groupBy("bucket").applyInPandas(_count_pairs(least), message), "pairs")
    told = words.unionByName(often)
    contexts = chunks.cogroup(told.groupBy("chunk")).applyInPandas(_ask_contexts(buckets, least), message)
    found = contexts.groupBy("bucket").applyInPandas(_count_contexts(least), "bucket long, k int, chunk long, data binary")
    # Later jobs meet it by bucket, so it is not shuffled again.
    found = written_alone(found, "contexts", buckets, "bucket")
    between, levels = "bucket long, part long, data binary", "bucket long, k int, data binary"
    asked = found.where("k = 2").mapInPandas(_ask_shorter(buckets), between)
    single = found.where("k = 1").groupBy("bucket").cogroup(asked.groupBy("bucket"))
    single = written_alone(single.applyInPandas(_test_words(n, v), between), "tested")
    longer = found.where("k > 1").groupBy("bucket").cogroup(single.where("part >= 0").groupBy("bucket"))
    longer = written_alone(longer.applyInPandas(_test_longer(buckets), levels), "tested")
    kept = single.where("part < 0").select("bucket", F.lit(1).alias("k"), "data").unionByName(longer)
    told = told.unionByName(
        kept.groupBy("bucket").cogroup(found.where("k < 0").groupBy("bucket")).applyInPandas(_tell_contexts, message)
    )
    return with_null_ids(chunks.cogroup(told.groupBy("chunk")).applyInPandas(_score(buckets, least, n, v), RESULT))
