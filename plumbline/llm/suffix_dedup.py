"""Removal of long passages that repeat across documents, with a family of suffix arrays.

Every string of ``LENGTH`` bytes is filed under the smallest hash of the 24-byte strings in it, so
that only the suffixes at those places are indexed: about one in fifteen. New batches of
documents get arrays of their suffixes, sorted by hash within buckets of the hash range; a batch
is merge-scanned against every level of the index, which tells both sides what they share, and
levels of equal size are merged, so that a family of n batches has at most log2(n) + 1 levels.

What is shared is then settled exactly. Each chunk sends the text around its shared suffixes to
the suffix's bucket; there all strings of ``LENGTH`` bytes are sorted, and each learns whether a
document with a smaller doc_id has it. Copies inside a chunk are settled inside it. Suffixes that
very many documents share are dealt by the strings around them instead, which spreads them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chunks import NO_ID, chunked, pack, steps, unpack, with_null_ids
from plumbline.llm.common import written

LENGTH = 50
SEED = 24
BATCHES = 4
# Strings under one record: fewer than LENGTH, so that those found cover one run of bytes.
RECORD_STRINGS = 32
# A suffix in so many documents is dealt by its strings.
HOT_DOCUMENTS = 2000
# Starts whose hashes are in memory at once.
SLICE = 1 << 19

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], "u8")
_S29, _S32 = np.uint64(29), np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD[0]
    x ^= x >> _S29
    x *= _ODD[1]
    x ^= x >> _S32
    return x


def _words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number."""
    n = len(data) - 7
    out = data[:n].astype("u8")
    for k in range(1, 8):
        out |= data[k : k + n].astype("u8") << np.uint64(8 * k)
    return out


def string_hashes(words8: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each start."""
    total = np.zeros(len(starts), "u8")
    for offset in [*range(0, length - 7, 8), length - 8]:
        total = _mixed(total + words8[starts + offset] + _ODD[2])
    return total


class ChunkText:
    """The texts of a chunk in one buffer."""

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(t) for t in texts], "i8")
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.data = np.frombuffer(b"".join(texts) + b"\0" * 64, "u1")

    def records(self, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
        """(first start, number of strings, document, hash of the seed) of runs of strings that are filed
        under one seed, slice by slice. No string crosses documents. The smallest hash is mixed
        again, as smallest ones crowd together."""
        end, seeds = int(self.starts[-1]), length - SEED + 1
        for low in range(0, max(end - length + 1, 0), SLICE):
            high = min(low + SLICE, end - length + 1)
            words8 = _words8(self.data[low : high + length + 7])
            h = _mixed(words8[: high - low + seeds - 1])
            for offset in range(8, SEED, 8):
                h = _mixed(h + words8[offset : high - low + seeds - 1 + offset])
            span = 1
            while span * 2 <= seeds:
                h = np.minimum(h[:-span], h[span:])
                span *= 2
            if span < seeds:
                h = np.minimum(h[: len(h) - (seeds - span)], h[seeds - span :])
            start = np.arange(low, high)
            new = np.concatenate([[True], h[1:] != h[:-1]])
            edges = self.starts[(self.starts >= low) & (self.starts < high)] - low
            new[edges] = True
            # The last length - 1 bytes of a document start no string.
            document = np.searchsorted(self.starts, start[new], side="right") - 1
            first = start[new]
            last = np.append(first[1:], high)  # exclusive
            last = np.minimum(last, self.starts[document + 1] - length + 1)
            some = last > first
            first, last, document, key = first[some], last[some], document[some], h[new][some]
            pieces = -(-(last - first) // RECORD_STRINGS)
            which = np.repeat(np.arange(len(first)), pieces)
            step = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = first[which] + step * RECORD_STRINGS
            yield begin, np.minimum(last[which] - begin, RECORD_STRINGS), document[which], _mixed(key[which])


def _code(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper half, the rest of the hash in the lower half."""
    bucket = ((keys >> _S32) * np.uint64(buckets)) >> _S32
    return (bucket << _S32) | (keys & np.uint64(0xFFFFFFFF))


def _suffixes(buckets: int):
    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        """The suffixes of a chunk, sorted: one array of hashes and document counts per bucket."""
        rows = rows[rows["doc_id"] != NO_ID]
        order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
        text = ChunkText([rows["text"].iloc[i] for i in order])
        ids = np.unique(rows["doc_id"].to_numpy()[order], return_inverse=True)[1]
        found = [(_code(k, buckets), ids[d]) for _, _, d, k in text.records()]
        codes = np.concatenate([f[0] for f in found]) if found else np.zeros(0, "u8")
        owner = np.concatenate([f[1] for f in found]) if found else np.zeros(0, "i8")
        order = np.lexsort((owner, codes))
        codes, owner = codes[order], owner[order]
        once = np.concatenate([[True], (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])])[: len(codes)]
        codes, counts = np.unique(codes[once], return_counts=True)
        bucket = (codes >> _S32).astype("i8")
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        out = []
        for low, high in zip(cuts, np.append(cuts[1:], len(codes)), strict=False):
            keys = (codes[low:high] & np.uint64(0xFFFFFFFF)).astype("u4")
            out.append((bucket[low], rows["chunk"].iloc[0], pack(steps(keys), counts[low:high].astype("u2"))))
        return pd.DataFrame(out, columns=["bucket", "chunk", "data"])

    return ask


ASKS = "bucket long, chunk long, data binary"


def _merge(keep: bool, hot_from: int | None, merged: frozenset[int]):
    """Merge-scan a batch's arrays of one bucket with the levels of the index.

    A level row has (hashes, document counts, owner): the chunk that has the suffix, or -1 once
    the suffix is shared and its owners know. Tells every new sharer; if ``keep``, returns the
    level that unites the batch with the ``merged`` levels. The last scan has seen all documents
    and says which suffixes at least ``hot_from`` of them share.
    """

    def scan(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for level, chunk, data in zip(rows["level"], rows["chunk"], rows["data"], strict=True):
            got = unpack(data)
            keys = np.cumsum(got[0], dtype="u4")
            owner = got[2] if level >= 0 else np.full(len(keys), chunk, "i8")
            stays = level < 0 or int(level) in merged
            parts.append((keys, got[1].astype("i8"), owner, np.full(len(keys), stays)))
        keys, counts, owner, stays = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")  # merges sorted runs
        keys, counts, owner, stays = keys[order], counts[order], owner[order], stays[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(counts, new)
        shared = np.repeat(total > 1, np.diff(np.append(new, len(keys))))
        out = []
        told = np.flatnonzero(shared & (owner >= 0))
        told = told[np.argsort(owner[told], kind="stable")]
        cuts = np.flatnonzero(np.diff(owner[told], prepend=-2))
        for low, high in zip(cuts, np.append(cuts[1:], len(told)), strict=False):
            out.append(("tell", key[0], owner[told[low]], pack(steps(np.sort(keys[told[low:high]])))))
        if hot_from is not None:
            hot = keys[new[total >= hot_from]]
            if len(hot):
                out.append(("hot", key[0], -1, pack(steps(hot))))
        if keep:
            keys, counts, owner, shared = keys[stays], counts[stays], owner[stays], shared[stays]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
            if len(new):
                known = np.where(shared[new], -1, owner[new])
                sums = np.minimum(np.add.reduceat(counts, new), 1 << 30).astype("u4")
                out.append(("level", key[0], -1, pack(steps(keys[new]), sums, known)))
        return pd.DataFrame(out, columns=["kind", "bucket", "chunk", "data"])

    return scan


def _answers(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What a bucket tells each chunk: its shared suffixes and which of them are hot."""
    top, out = np.uint64(key[0]) << _S32, []
    hot = [np.cumsum(unpack(d)[0], dtype="u4") for d in rows["data"][rows["kind"] == "hot"]]
    hot = np.concatenate(hot) if hot else np.zeros(0, "u4")
    for chunk, data in zip(rows["chunk"], rows["data"], strict=True):
        if chunk >= 0:
            keys = np.cumsum(unpack(data)[0], dtype="u4")
            out.append((chunk, pack(keys | top, np.isin(keys, hot))))
    return pd.DataFrame(out, columns=["chunk", "data"])


def _surroundings(buckets: int):
    def ask(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """Runs of bytes settled inside the chunk (bucket -1), and the text around shared suffixes."""
        empty = pd.DataFrame({"bucket": [], "chunk": [], "data": []})
        rows = rows[rows["doc_id"] != NO_ID]
        if not len(rows) or not len(told):
            return empty
        codes, hot = (np.concatenate(x) for x in zip(*map(unpack, told["data"]), strict=True))
        order = np.argsort(codes)
        codes, hot = codes[order], hot[order]
        text = ChunkText(list(rows["text"]))
        ids, numbers = rows["doc_id"].to_numpy().astype("i8"), rows["row"].to_numpy()
        kept = []
        for begin, strings, document, k in text.records():
            code = _code(k, buckets)
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            mine = codes[at] == code
            begin, strings, document, code, spread = (x[mine] for x in (begin, strings, document, code, hot[at]))
            # Hot suffixes: every string is a record of its own.
            times = np.where(spread, strings, 1)
            which = np.repeat(np.arange(len(begin)), times)
            step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            spread = spread[which]
            begin, strings = begin[which] + step, np.where(spread, 1, strings[which])
            if not len(begin):
                continue
            low = int(begin.min())
            words8 = _words8(text.data[low : int(begin.max()) + RECORD_STRINGS + LENGTH + 8])
            first = string_hashes(words8, begin - low, LENGTH)
            last = string_hashes(words8, begin - low + strings - 1, LENGTH)
            same = _mixed(first + _mixed(last + strings.astype("u8")))
            bucket = np.where(spread, _code(first, buckets), code[which]) >> _S32
            kept.append((begin, strings, document[which], same, bucket.astype("i8")))
        if not kept:
            return empty
        begin, strings, document, same, bucket = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((ids[document], same))
        begin, strings, document, same, bucket = (x[order] for x in (begin, strings, document, same, bucket))
        new = np.concatenate([[True], same[1:] != same[:-1]])
        smallest = ids[document][np.flatnonzero(new)][np.cumsum(new) - 1]
        again = ids[document] > smallest
        place = begin - text.starts[document]
        out = []
        if again.any():
            runs = (numbers[document], place, place + strings + LENGTH - 1)
            out.append((-1, key[0], pack(*(x[again] for x in runs))))
        rest = np.flatnonzero(~again)
        rest = rest[np.argsort(bucket[rest], kind="stable")]
        cuts = np.flatnonzero(np.diff(bucket[rest], prepend=-1))
        for low, high in zip(cuts, np.append(cuts[1:], len(rest)), strict=False):
            r = rest[low:high]
            r = r[np.argsort(begin[r])]
            size = strings[r] + LENGTH - 1
            take = np.repeat(begin[r] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            data = pack(ids[document[r]], numbers[document[r]], place[r].astype("u4"), strings[r].astype("u1"), text.data[take])
            out.append((bucket[r[0]], key[0], data))
        return pd.DataFrame(out, columns=["bucket", "chunk", "data"])

    return ask


def _settle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For every run of strings, the bytes of those that a smaller doc_id has as well."""
    if key[0] < 0:
        return rows[["chunk", "data"]]
    parts = [unpack(d) for d in rows["data"]]
    chunk = np.repeat(rows["chunk"].to_numpy(), [len(p[0]) for p in parts])
    ids, number, place, strings, data = (np.concatenate(x) for x in zip(*parts, strict=True))
    strings = strings.astype("i8")
    size = strings + LENGTH - 1
    record = np.repeat(np.arange(len(ids)), strings)
    inside = np.arange(len(record)) - np.repeat(np.cumsum(strings) - strings, strings)
    starts = np.repeat(np.cumsum(size) - size, strings) + inside
    hashes = string_hashes(_words8(np.concatenate([data, np.zeros(8, "u1")])), starts, LENGTH)
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    least = np.minimum.reduceat(ids[record[order]], np.flatnonzero(new))
    found = np.zeros(len(order), bool)
    found[order] = least[np.cumsum(new) - 1] < ids[record[order]]
    record, inside = record[found], inside[found]
    if not len(record):
        return pd.DataFrame({"chunk": [], "data": []})
    edge = np.flatnonzero(np.diff(record, prepend=-1))
    hit = record[edge]
    begin = place[hit] + inside[edge]
    end = place[hit] + inside[np.append(edge[1:], len(record)) - 1] + LENGTH
    out, order = [], np.argsort(chunk[hit], kind="stable")
    cuts = np.flatnonzero(np.diff(chunk[hit][order], prepend=-1))
    for low, high in zip(cuts, np.append(cuts[1:], len(order)), strict=False):
        o = order[low:high]
        out.append((chunk[hit[o[0]]], pack(number[hit[o]], begin[o].astype("i8"), end[o].astype("i8"))))
    return pd.DataFrame(out, columns=["chunk", "data"])


def _cut(keep_text: bool):
    def cut(key: tuple, rows: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        """Each document of a chunk without the bytes of its runs."""
        number = begin = end = np.zeros(0, "i8")
        if len(runs):
            number, begin, end = (np.concatenate(x) for x in zip(*map(unpack, runs["data"]), strict=True))
            order = np.lexsort((begin, number))
            number, begin, end = number[order], begin[order], end[order]
        out = []
        for row, doc, text in zip(rows["row"], rows["doc_id"], rows["text"], strict=True):
            low, high = np.searchsorted(number, [row, row + 1])
            at = removed = spans = 0
            reached, kept = -1, []
            for b, e in zip(begin[low:high].tolist(), end[low:high].tolist(), strict=True):
                if b > reached:
                    spans += 1
                    if b > at:
                        kept.append(text[at:b])
                b = max(b, at)
                removed += max(e - b, 0)
                at = reached = max(at, e)
            kept = b"".join([*kept, text[at:]]) if spans else text
            out.append((row, doc, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if keep_text else None))
        columns = ["row", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        found = pd.DataFrame(out, columns=columns)
        return found if keep_text else found.drop(columns="kept")

    return cut


def remove_repeats(
    documents: DataFrame, batches: int = BATCHES, keep_text: bool = False, hot_documents: int = HOT_DOCUMENTS
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``documents``.

    Removed is each byte covered by a string of 50 bytes that also starts in a row with a smaller
    doc_id. Null texts are empty, texts under 50 bytes keep everything. Rows that share a doc_id
    don't count as repeats of each other; rows without one are neither searched nor searched in.
    With ``keep_text`` the remaining text is returned as ``kept``. Suffixes in ``hot_documents``
    documents or more are dealt by the strings around them.
    """
    return _removed(documents, batches, keep_text, hot_documents)[0].drop("row")


def _removed(
    documents: DataFrame, batches: int, keep_text: bool, hot_documents: int = HOT_DOCUMENTS, also: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    table, buckets = chunked(documents, batches, also=also)
    texts = table.select("batch", "chunk", "row", "doc_id", "text")
    levels: list[tuple[int, DataFrame]] = []  # (batches in it, arrays)
    tells, hot = [], []
    for batch in range(batches):
        fresh = texts.where(F.col("batch") == batch).groupBy("chunk").applyInPandas(_suffixes(buckets), ASKS)
        rows = fresh.withColumn("level", F.lit(-1).cast("long"))
        for i, (_, level) in enumerate(levels):
            rows = rows.unionByName(level.withColumn("level", F.lit(i).cast("long")))
        size, merged = 1, []
        while levels and len(merged) < len(levels) and levels[-1 - len(merged)][0] == size:
            merged.append(len(levels) - 1 - len(merged))
            size *= 2
        final = batch == batches - 1
        scan = _merge(not final, hot_documents if final else None, frozenset(merged))
        out = written(rows.groupBy("bucket").applyInPandas(scan, "kind string, " + ASKS), "suffix-level")
        tells.append(out.where("kind = 'tell'"))
        hot.append(out.where("kind = 'hot'"))
        levels = levels[: len(levels) - len(merged)]
        levels.append((size, out.where("kind = 'level'").select("bucket", "chunk", "data")))
    said = tells[0]
    for more in [*tells[1:], hot[-1]]:
        said = said.unionByName(more)
    told = said.groupBy("bucket").applyInPandas(_answers, "chunk long, data binary")
    by_chunk = texts.drop("batch").groupBy("chunk")
    around = by_chunk.cogroup(told.groupBy("chunk")).applyInPandas(_surroundings(buckets), ASKS)
    # What is settled already passes through, spread over the chunks.
    target = F.when(F.col("bucket") < 0, -1 - F.pmod(F.xxhash64("chunk"), F.lit(buckets))).otherwise(F.col("bucket"))
    runs = around.withColumn("bucket", target).groupBy("bucket").applyInPandas(_settle, "chunk long, data binary")
    shape = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    done = by_chunk.cogroup(runs.groupBy("chunk")).applyInPandas(
        _cut(keep_text), shape + (", kept string" if keep_text else "")
    )
    return with_null_ids(done), with_null_ids(table)


def without_repeats(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``documents`` with each text less its repeated bytes. All rows and columns stay; n_chars,
    where there is such a column, follows the text.

    A cut may leave part of a character, whose bytes go as well. Null texts stay null.
    """
    others = [c for c in documents.columns if c not in ("doc_id", "text", "n_chars")]
    rest = F.struct(F.col("text").isNull().alias("null"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    kept, table = _removed(documents.withColumn("__rest", rest), batches, keep_text=True, also=["__rest"])
    text = F.when(~F.col("__rest.null"), F.col("kept")).alias("text")
    columns = {"doc_id": F.col("doc_id").cast(documents.schema["doc_id"].dataType), "text": text}
    columns |= {c: F.col(f"__rest.c{i}").alias(c) for i, c in enumerate(others)}
    if "n_chars" in documents.columns:
        columns["n_chars"] = F.char_length(text).cast(documents.schema["n_chars"].dataType).alias("n_chars")
    joined = table.select("row", "doc_id", "__rest").join(kept.select("row", "kept"), "row")
    return joined.select(*[columns[c].alias(c) for c in documents.columns])
