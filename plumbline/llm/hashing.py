"""Array hashes of words and word sequences."""

from __future__ import annotations

import numpy as np

# Bytes that are hashed together; a slice ends at white space.
SLICE = 1 << 20
# The token that ends every text.
END = np.uint64(0x9D39247E33776D41)
SPACE = 32

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], "u8")
_S29, _S32 = np.uint64(29), np.uint64(32)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else SPACE if 9 <= b <= 13 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD[0]
    x ^= x >> _S29
    x *= _ODD[1]
    x ^= x >> _S32
    return x


_BYTE = mixed(np.arange(1, 257, dtype="u8") * np.uint64(0x165667B19E3779F9))
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every run without white space in ``data``, which ends with white space.

    A polynomial over random numbers of the bytes; prefix sums give it for all words at once.
    """
    blank = data == SPACE
    before = np.concatenate([[True], blank[:-1]])
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    powers = np.full(len(data), _BASE, "u8")
    powers[0] = 1
    prefix = np.concatenate([np.zeros(1, "u8"), np.cumsum(_BYTE[data] * np.cumprod(powers))])
    powers[1:] = _INVERSE
    back = np.cumprod(powers)
    found = (prefix[ends] - prefix[starts]) * back[starts]
    return starts, mixed(found + (ends - starts).astype("u8"))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every token of ``texts``, in order: words with A-Z lower-cased, then END."""
    data = b"".join(t.translate(_LOWER) + b" " for t in texts)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    hashes, owners, at = [np.zeros(0, "u8")], [np.zeros(0, "i8")], 0
    while at < len(data):
        to = data.find(b" ", min(at + SLICE, len(data) - 1)) + 1
        starts, found = _word_hashes(np.frombuffer(data, "u1", to - at, at))
        hashes.append(found)
        owners.append(np.searchsorted(first, starts + at, side="right") - 1)
        at = to
    owner = np.concatenate([*owners, np.arange(len(texts))])
    order = np.argsort(owner, kind="stable")
    ends = np.full(len(texts), END, "u8")
    return np.concatenate([*hashes, ends])[order], owner[order]
