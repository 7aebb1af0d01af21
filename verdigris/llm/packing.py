"""Best-fit-decreasing packing of token windows.

Every document becomes its token ids and one end id. Documents longer than a window are first cut into full windows;
what is left of them and the short documents are packed by best fit decreasing: a segment tree over remaining
capacities finds the tightest window that still takes a piece. Each task packs what it has read and gives its windows
numbers of its own; a task keeps piece lengths only, never ids, and closes its windows after ``MAX_PIECES`` pieces, which
bounds its memory. Windows that stay with more than ``SLACK`` tokens of room are taken apart, and the pieces in them, few
whatever the number of tasks, are dealt out in lots of ``MAX_PIECES`` and packed once more.

Null and empty texts have the end id alone. Repeated rows are packed each. No rows give no pieces.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_of_char, cut, key_and_text, tokenizer_path

WINDOW = 2048
MAX_PIECES = 1_000_000
SLACK = 16
CACHE_WORDS = 1_000_000

OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
OUT_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PACKED = OUT.append(pa.field("loose", pa.bool_()))
PACKED_DDL = OUT_DDL + ", loose boolean"


class CapacityTree:
    """Counts of open windows by remaining capacity; ``tightest`` walks to the smallest capacity that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(remaining capacity, window) of the tightest open window with room for ``need``; it is taken out."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, self.open[room].pop()


def pack_lengths(lengths: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of each piece, and the number of windows. All lengths are from 1 to ``capacity``."""
    tree = CapacityTree(capacity)
    window = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    n = 0
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = sizes[i]
        found = tree.tightest(need) if need < capacity else None
        if found is None:
            room, w = capacity, n
            n += 1
        else:
            room, w = found
        window[i], offset[i] = w, capacity - room
        if room > need:
            tree.add(room - need, w)
    return window, offset, n


#: The word pattern of the tokenizer file's pre-tokenizer.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: For characters beyond these the library itself splits the text.
UNUSUAL = re.compile(r"[^\x00-\u024f]")
#: What may be a special token, and separators that only some libraries take for white space.
ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Follows a word's bytes in the rank table; no UTF-8 text has it.
WORD_END = b"\xff"


class WordIds:
    """Ids of a text as little-endian 32-bit bytes; what stands between white space is encoded once and remembered.

    Merges of this vocabulary rank as their ids do, and a word's last byte joins the word-end mark before any other
    merge, so a rank table with the mark as one more byte gives the library's ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, special = spec["model"], {t["content"] for t in spec["added_tokens"]}
        mark, chars, ranks = model["end_of_word_suffix"], byte_of_char(), {}
        for token, i in model["vocab"].items():
            if token not in special:
                ends = token.endswith(mark)
                ranks[bytes(chars[c] for c in (token[: -len(mark)] if ends else token)) + WORD_END * ends] = i
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(b != a + 1 for a, b in zip(merged, merged[1:], strict=False)):
            raise ValueError("this vocabulary's merges don't rank as its ids")
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.known: dict[str, bytes] = {}

    @staticmethod
    def packed(ids) -> bytes:
        return array("I", ids).tobytes()

    def piece(self, lowered: str) -> bytes:
        """Ids of what stands between white space: mostly a word, or a word and a mark."""
        one = self.core.encode_single_piece
        if lowered.isalpha():
            return self.packed(one(lowered.encode() + WORD_END))
        if lowered[-1] in ".," and (word := lowered[:-1]).isalpha():
            return (self.known.get(word) or self.packed(one(word.encode() + WORD_END))) + self.packed(one(lowered[-1].encode() + WORD_END))
        return self.packed([i for w in WORDS.findall(lowered) for i in one(w.encode() + WORD_END)])

    @staticmethod
    def usual(text: str) -> bool:
        """Only characters whose lower case, class and normal form are the same in every library; no special token."""
        if any(x in text for x in ODD):
            return False
        try:
            text.encode("latin-1")
            return True
        except UnicodeEncodeError:
            return not UNUSUAL.search(text) and unicodedata.is_normalized("NFC", text)

    def __call__(self, text: str) -> bytes:
        if not self.usual(text):
            return self.packed(self.tok.encode(text, add_special_tokens=False).ids)
        words = text.lower().split()
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.piece(w)
            return b"".join(map(known.__getitem__, words))


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces_of(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of the full windows of a document and of what is left."""
    n = len(ids) // 4
    for start in range(0, n, capacity):
        stop = min(n, start + capacity)
        yield start, stop - start, zlib.crc32(memoryview(ids)[4 * start : 4 * stop])


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in which window, at which offset."""
    path = tokenizer_path(vocabulary)
    end = WordIds.packed([end_id])

    def packed(pieces: Iterator[tuple], again: bool) -> Iterator[pa.RecordBatch]:
        part, closed = TaskContext.get().partitionId() + (again << 29), 0
        rows: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal closed
            if not rows:
                return
            doc, start, length, crc, total = (list(c) for c in zip(*rows, strict=True))
            rows.clear()
            n = np.array(length, np.int64)
            window, offset, count = pack_lengths(n, capacity)
            room = capacity - np.bincount(window, n, count)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(window + ((part << 33) + closed)), pa.array(offset), pa.array(room[window] > SLACK)], schema=PACKED)
            closed += count

        for piece in pieces:
            rows.append(piece)
            if len(rows) >= MAX_PIECES:
                yield from close()
        yield from close()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)

        def pieces() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = encode(text.as_py()) + end
                    for p in pieces_of(ids, capacity):
                        yield (doc, *p, len(ids) // 4)

        return packed(pieces(), False)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True)), True)

    once = cut(key_and_text(docs, id_col, text_col).mapInArrow(first, PACKED_DDL), "packed")
    loose = once.where("loose")
    lots = max(1, -(-loose.count() // MAX_PIECES))
    # a piece's place decides its lot, so a task that is run again gets the same ones
    twice = loose.repartition(lots, F.xxhash64("doc_id", "start", "ids_crc32")).mapInArrow(second, PACKED_DDL)
    return once.where("NOT loose").union(twice).drop("loose")
