"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(nodes, linked):
    """node -> smallest node reachable."""
    nodes = sorted(set(nodes))
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def removed(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha256, kept) of every (doc_id, text)."""
    least = {}
    for doc, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            if doc is not None and least.get(data[p : p + length], math.inf) > doc:
                least[data[p : p + length]] = doc
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            if doc is not None and least[data[p : p + length]] < doc:
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, size=10):
    """doc_id -> (n_words, n_hit, items)."""
    windows = []
    for item, text in items:
        w = plain_words(text)
        windows += [(item, w[i : i + size]) for i in range(max(len(w) - size + 1, 1)) if w]
    out = {}
    for doc, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(str(item))
        out[doc] = (len(w), len(hit), sorted(found))
    return out


def fingerprint(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def base_scores(rows):
    """(doc_id, held out, n_tokens, n_known, N, score) of every (doc_id, text)."""
    texts = [(d, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]) for d, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in texts]
    count = Counter(w for (_, t), h in zip(texts, held, strict=True) if not h for w in t)
    n, v = sum(count.values()), len(count)
    return [
        (d, h, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
        for (d, t), h in zip(texts, held, strict=True)
    ]


def cosine_links(rows, threshold):
    """vec_id -> ids linked directly, for (vec_id, embedding, label) with distinct ids."""

    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, "f8"), label) for i, v, label in rows if usable(v) and label is not None]
    out = {i: set() for i, _, _ in rows}
    for i, v, a in good:
        for j, w, b in good:
            if i != j and a == b and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                out[i].add(j)
    return out
