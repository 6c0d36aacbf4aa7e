"""Best-fit packing of tokenised documents, certified by lower bounds.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to partitions, each
packed by best-fit decreasing. Dual-feasible functions give a lower bound on the number of
sequences of a partition; where the packing needs more, or leaves room, the partition hands its
unfilled sequences over, several partitions' leftovers meet, and best-fit decreasing runs again.
Text never meets a shuffle: only ids, lengths and checksums of pieces do.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chunks import NO_ID, with_null_ids
from plumbline.llm.common import written

CAPACITY = 1024
END_ID = 2
# Pieces that one task packs at a time.
GROUP_PIECES = 4096
ROUNDS = 4
# Leftovers of so many groups meet.
FAN_IN = 8
# Words whose ids a task remembers before it starts anew: some 240 MB.
CACHE_WORDS = 1_200_000


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()
BLANK = BYTE_LETTERS[ord(" ")]

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, group long, sequence_id long, offset long, loose boolean, bound long"


# How byte-level vocabularies cut printable ASCII without white space inside.
ASCII_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 ]+")


class WordIds(dict):
    """Ids, as little-endian bytes, of a word together with the blank before it.

    The tokenizer cuts text before a blank that stands between two other characters, whatever
    surrounds it, so words separated by single blanks can be encoded one by one and remembered,
    and printable ASCII words piece by piece. Texts with any other white space next to a blank are
    encoded whole; None marks the words that show it. So are texts that hold an added token such
    as an end marker, which the tokenizer finds before it cuts anything.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}
        # Ids of words right after a line break.
        self.starts: dict[bytes, bytes | None] = {}
        self.line_break = self._whole("\n")

    def __missing__(self, word: bytes) -> bytes | None:
        if len(self) + len(self.starts) > CACHE_WORDS:
            self.clear()
            self.starts.clear()
            self.pieces.clear()
        if b"\n" in word:
            ids = self._lines(word)
        else:
            text = word.decode()
            ids = None if not text or text[0].isspace() or text[-1].isspace() else self._part(text, " ")
        self[word] = ids
        return ids

    def _lines(self, word: bytes) -> bytes | None:
        """A line break between two other characters is a piece of its own."""
        first, *rest = word.split(b"\n")
        out = [self[first]]
        for line in rest:
            ids = self.starts.get(line, b"")
            if not ids and ids is not None:
                text = line.decode()
                ids = None if not text or text[0].isspace() or text[-1].isspace() else self._part(text, "")
                self.starts[line] = ids
            out += [self.line_break, ids]
        return None if None in out else b"".join(out)

    def _part(self, text: str, before: str) -> bytes:
        """Ids of a text without white space at its ends, and of what is ``before`` it."""
        if text.isascii():
            if text.isalpha():  # one piece, and its letters are its bytes
                return self._model((BLANK if before else "") + text)
            if text.isprintable():
                return self._pieces(before + text)
        if text.isalpha():
            return self._model((before + text).encode().decode("latin-1").translate(BYTE_LETTERS))
        letters = text.rstrip(string.punctuation)
        if letters.isalpha():  # what follows the letters is one piece or more of ASCII
            whole = self[letters.encode()] if before else self._part(letters, "")
            return whole + self._pieces(text[len(letters) :])
        return self._whole(before + text)

    def _pieces(self, text: str) -> bytes:
        return b"".join([self.pieces.get(x) or self._piece(x) for x in ASCII_PIECES.findall(text)])

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces[piece] = self._model(piece.replace(" ", BLANK))
        return ids

    def _model(self, letters: str) -> bytes:
        """The model alone, on one piece written in the letters of the vocabulary, is quicker."""
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: bytes) -> bytes:
        """Ids of one text."""
        if not any(t in text for t in self.added):
            first, *words = text.split(b" ")
            start = first.decode()
            if start and not start[-1].isspace():
                try:
                    return self._whole(start) + b"".join(map(self.__getitem__, words))
                except TypeError:  # a None among the words
                    pass
        return self._whole(text.decode())


_encoders: dict[str, WordIds] = {}


def tokenised_pieces(
    documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and, if wanted, the ids) of every piece.

    Ids are the tokenizer's, then ``end_id``; a null or empty text is ``end_id`` alone. Longer
    documents are cut into pieces of ``capacity``, what remains being the first piece.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    columns = [f.split()[0] for f in PIECES.split(", ")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(tokenizer, WordIds(tokenizer))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for low in range(0, batch.num_rows, 500):
                rows = []
                for doc, text in zip(ids[low : low + 500], texts[low : low + 500], strict=True):
                    got = encoder.encode(text.as_py() or b"") + end
                    n = len(got) // 4
                    at, size = 0, (n - 1) % capacity + 1
                    for piece in range(-(-n // capacity)):
                        own = got[4 * at : 4 * (at + size)]
                        rows.append((doc, piece, at, size, zlib.crc32(own), own))
                        at, size = at + size, capacity
                out = list(zip(*rows, strict=True))
                arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
                names = list(columns)
                if keep_ids:
                    arrays.append(pa.array(np.frombuffer(x, "<u4").astype("i8").tolist() for x in out[5]))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return texts.mapInArrow(pieces, PIECES + (", ids array<long>" if keep_ids else ""))


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best bound of two families of dual-feasible functions on the number of sequences."""
    count = np.bincount(lengths, minlength=capacity + 1).astype("i8")
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    # f(x) = capacity above capacity - e, nothing below e, x between.
    for e in range(1, capacity // 2 + 1):
        total = (count[e : capacity - e + 1] * size[e : capacity - e + 1]).sum() + capacity * count[capacity - e + 1 :].sum()
        best = max(best, -(-int(total) // capacity))
    # f(x) = x where (k + 1) x is a multiple of the capacity, else floor((k + 1) x / capacity) / k.
    for k in range(1, 32):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of every piece, and the tokens in every sequence.

    Longest first, each into the fullest sequence that still has room. Sequences with the same
    room share a list, and a bit set of the rooms finds the smallest sufficient one.
    """
    sequence, offset = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    present, filled = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = present >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            own = rooms[room].pop()
            if not rooms[room]:
                present ^= 1 << room
        else:
            own, room = len(filled), capacity
            filled.append(0)
        sequence[i], offset[i] = own, capacity - room
        filled[own] += size
        if room > size:
            rooms[room - size].append(own)
            present |= 1 << (room - size)
    return sequence, offset, np.array(filled, "i8")


def _packer(number: int, capacity: int):
    columns = [f.split()[0] for f in PACKED.split(", ")]

    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=False, ignore_index=True)
        lengths = rows["length"].to_numpy()
        sequence, offset, filled = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        group = int(rows["group"].iloc[0])
        # The emptiest sequences go on: all that are not full, where the bound leaves a gap or room.
        loose = filled < capacity
        if len(filled) == bound and (~loose).sum() + 1 >= bound:
            loose &= filled == filled.min()
        out = rows.assign(
            sequence_id=(number << 58) | (group << 22) | sequence, offset=offset, loose=loose[sequence], bound=bound
        )
        return out[columns]

    return pack_group


def pack(
    documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """Every piece of ``documents`` with its sequence and its place there.

    As ``tokenised_pieces``, with sequence_id (any number) and offset, gapless from 0. Repeated
    rows are packed as often as they occur; rows without a doc_id are packed too. No documents
    give no sequences. A group of leftovers that gets no better is still a valid packing.
    """
    pieces = tokenised_pieces(documents, tokenizer, capacity, end_id)
    pieces = written(pieces.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), "pieces")
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))
    left, done = pieces.withColumn("group", spread), []
    for number in range(ROUNDS):
        packed = written(left.groupBy("group").applyInPandas(_packer(number, capacity), PACKED), "packed")
        loose = packed.where("loose").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group").alias("g"), F.countDistinct("sequence_id").alias("s"), F.sum("length").alias("tokens")).first()
        final = number == ROUNDS - 1 or loose.s <= -(-(loose.tokens or 0) // capacity)
        done.append(packed if final else packed.where("not loose"))
        if final:
            break
        groups = max(1, -(-groups // FAN_IN), -(-loose.n // group_pieces))
        left = packed.where("loose").select(
            *[f.split()[0] for f in PIECES.split(", ")],
            F.pmod(F.xxhash64("sequence_id"), F.lit(groups)).alias("group"),
        )
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return with_null_ids(result).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
