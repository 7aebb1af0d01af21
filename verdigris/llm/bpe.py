"""Byte-pair encoding by speculation, and decoding.

A greedy longest match over the vocabulary proposes the tokens of every new word at once. A proposal is right if and
only if every adjacent pair of its tokens stays as it is when the two are merged alone, so all pairs are tested with
one vectorised lookup; pairs not met before are decided once by merging them. Only words with a failing pair go
through the exact merge loop. What lies between single spaces is remembered with its ids. A batch's ids are one array,
and the texts that are hashed are gathered from arrays too.

Null and empty texts have no ids and decode to the empty text. Repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import byte_of_char, key_and_text, per_batch, rows_of, tokenizer_path

#: Remembered units; those met again since the last trimming survive it.
CACHE_UNITS = 800_000
CACHE_PAIRS = 4_000_000
#: Longer units are encoded without being remembered.
LONGEST_KEPT = 256
#: Items that are gathered at once.
STEP = 1 << 20
#: The byte-level pre-tokenizer's own pattern.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space beside white space, or at an end: there a single space is no word boundary.
WIDE = re.compile(r"\s(?:\s|\Z)")
#: Characters whose class is the same in every library; for others the library's own pre-tokenizer splits.
UNUSUAL = re.compile(r"[^\x00-\x1b\x20-ɏͰ-ͳΈ-ϿЀ-ҁ‐-‧€ぁ-ゖァ-ヺ一-龥가-힣]")
#: A full stop or comma before white space that doesn't follow a letter or digit, so may be part of a longer word.
LOOSE_MARK = re.compile(r"[.,](?<![^\W_].)(?:\s|\Z)")
#: No token holds it: it keeps words apart in the batch that the longest match walks.
APART = "￿"
#: Keys of units. A plain key is a unit less the space in front of it, or with the line feed in front of it. MARK and a mark are that
#: mark alone, WHOLE and a text are that text as it stands, SPECIAL and a number are that id.
MARK, WHOLE, SPECIAL = "\0", "\0\0", "\0\1"


def gathered(items: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``items`` of runs that begin at ``first`` and have ``n`` items, one run after the other."""
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(ends) else 0, items.dtype)
    shift = first - (ends - n)
    at = 0
    while at < len(out):
        stop = min(len(out), at + STEP)
        a, b = int(np.searchsorted(ends, at, side="right")), int(np.searchsorted(ends, stop)) + 1
        inside = np.minimum(ends[a:b], stop) - np.maximum(ends[a:b] - n[a:b], at)
        out[at:stop] = items[np.arange(at, stop) + np.repeat(shift[a:b], inside)]
        at = stop
    return out


class Units:
    """Ids of units that have been met: a unit's number, and where its ids lie in one array."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.first, self.n, self.met = (np.zeros(1 << 14, np.int64) for _ in range(3))
        self.used = 0

    def add(self, keys: list[str], ids: np.ndarray, n: np.ndarray) -> None:
        count, first = len(self.number), self.used
        while first + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while count + len(keys) > len(self.n):
            self.first, self.n, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.n, self.met))
        self.ids[first : first + len(ids)] = ids
        self.used = first + len(ids)
        here = slice(count, count + len(keys))
        self.first[here], self.n[here], self.met[here] = first + np.cumsum(n) - n, n, 0
        self.number.update(zip(keys, range(count, count + len(keys)), strict=True))

    def trim(self, most: int) -> None:
        """Forget units over ``LONGEST_KEPT``, and where there are too many, those that haven't been met again."""
        if len(self.number) <= most:
            return
        again = self.met[: len(self.number)] > 1
        if 2 * int(again.sum()) > most:
            again[:] = False
        keys = [k for k, i in self.number.items() if again[i] and len(k) <= LONGEST_KEPT]
        old = np.array([self.number[k] for k in keys], np.int64)
        ids, n = gathered(self.ids, self.first[old], self.n[old]), self.n[old]
        self.number.clear()
        self.used = 0
        self.add(keys, ids, n)


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, chars = spec["model"], byte_of_char()
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.is_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes_of: dict[int, bytes] = {i: bytes(chars[c] for c in t) for t, i in model["vocab"].items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items() if i not in self.special.values()}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(b != a + 1 for a, b in zip(merged, merged[1:], strict=False)):
            raise ValueError("this vocabulary's merges don't rank as its ids")
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=self.id_of, special_tokens={})._core_bpe
        self.longest = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.longest.add_word(b.decode("latin-1"), i)
        self.longest.make_automaton()
        most = max(self.bytes_of) + 1
        self.text, self.data = self.table([b",%d" % i for i in range(most)]), self.table([self.bytes_of.get(i, b"") for i in range(most)])
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)  # sorted pairs that have been decided
        self.units = Units()
        self.failed = self.proposed = 0

    @staticmethod
    def table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all bytes, first byte and number of bytes of each id)."""
        n = np.array(list(map(len, values)), np.int64)
        return np.frombuffer(b"".join(values), np.uint8), np.cumsum(n) - n, n

    def merge(self, data: bytes) -> list[int]:
        """Exact merging of one word: always the pair of least rank, the leftmost of equals."""
        return self.core.encode_single_piece(data)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For every adjacent pair, whether merging its bytes alone gives it back: one lookup in the sorted pairs."""
        codes, inverse = np.unique((left << 32) | right, return_inverse=True)
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs, self.fits = self.pairs[:0], self.fits[:0]
        at = np.searchsorted(self.pairs, codes)
        new = codes[(at == len(self.pairs)) | (self.pairs[np.minimum(at, len(self.pairs) - 1)] != codes)] if len(self.pairs) else codes
        if len(new):
            of, merge = self.bytes_of, self.merge
            fits = np.fromiter((merge(of[a] + of[b]) == [a, b] for a, b in zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist(), strict=True)), bool, len(new))
            place = np.searchsorted(self.pairs, new)
            self.pairs, self.fits = np.insert(self.pairs, place, new), np.insert(self.fits, place, fits)
        return self.fits[np.searchsorted(self.pairs, codes)][inverse]

    def propose(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first of each word among them and their number, whether a word's proposal fails): longest match, all pairs tested at once."""
        found = list(self.longest.iter_long(APART.join([d.decode("latin-1") for d in data])))
        ends, ids = np.fromiter(chain.from_iterable(found), np.int64, 2 * len(found)).reshape(-1, 2).T
        stops = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1) - 1
        word = np.searchsorted(stops, ends, side="right")
        inside = np.flatnonzero(word[:-1] == word[1:])
        bad = np.zeros(len(data), bool)
        bad[word[inside[~self.compatible(ids[inside], ids[inside + 1])]]] = True
        self.proposed += len(data)
        self.failed += int(bad.sum())
        return ids, np.searchsorted(word, np.arange(len(data) + 1)), bad

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id and number of ids of each word): proposed, verified, and failing words merged exactly."""
        data = [w.encode() for w in words]
        if not data:
            return (np.zeros(0, np.int64),) * 3
        ids, first, bad = self.propose(data)
        start, n = first[:-1].copy(), np.diff(first)
        merged = [self.merge(data[k]) for k in np.flatnonzero(bad).tolist()]
        n[bad] = np.fromiter(map(len, merged), np.int64, len(merged))
        start[bad] = len(ids) + np.cumsum(n[bad]) - n[bad]
        return np.concatenate([ids, np.fromiter(chain.from_iterable(merged), np.int64, int(n[bad].sum()))]), start, n

    def split(self, unit: str) -> list[str]:
        if UNUSUAL.search(unit):
            return [unit[a:b] for _, (a, b) in self.library().pre_tokenizer.pre_tokenize_str(unit)]
        return WORDS.findall(unit)

    @lru_cache(1)  # noqa: B019
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def learn(self, keys: list[str]) -> None:
        """Encode units that haven't been met."""
        texts = [k if k[:1] == "\n" else k[2:] if k[:2] == WHOLE else k[1:] if k[:1] == MARK else " " + k for k in keys]
        odd = UNUSUAL.search("".join(texts))
        parts = [[u] if (u[1:] if u[:1] == " " else u).isalpha() and not odd else self.split(u) for u in texts]
        words = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(parts)))}
        ids, first, n = self.encode_words(list(words))
        of = np.fromiter(map(words.__getitem__, chain.from_iterable(parts)), np.int64)
        ends = np.concatenate(([0], np.cumsum(n[of])))[np.concatenate(([0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))]
        self.units.add(keys, gathered(ids, first[of], n[of]), np.diff(ends))

    def numbers(self, keys: list[str]) -> np.ndarray:
        """Numbers of units; new ones are learnt."""
        number = self.units.number
        out = np.fromiter(map(number.get, keys, repeat(-1)), np.int64, len(keys))
        lost = np.flatnonzero(out < 0)
        if len(lost):
            new = [keys[i] for i in lost.tolist()]
            different = list(dict.fromkeys(new))
            special = [k for k in different if k[:2] == SPECIAL]
            self.units.add(special, np.array([int(k[2:]) for k in special], np.int64), np.ones(len(special), np.int64))
            self.learn([k for k in different if k[:2] != SPECIAL])
            out[lost] = np.fromiter(map(number.__getitem__, new), np.int64, len(new))
        np.add.at(self.units.met, out, 1)
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    @staticmethod
    def units_of(text: str) -> list[str]:
        """Parts that are tokenized alone: cut before a space that stands between two other characters."""
        return [u for u in regex.split(r"(?<=\S)(?=\x20\S)", text) if u]

    def parts(self, text: str) -> list[str | int]:
        """Texts between special tokens, and the special tokens' ids."""
        if self.is_special is None or "<|" not in text:
            return [text]
        out, at = [], 0
        for m in self.is_special.finditer(text):
            out += [text[at : m.start()], self.special[m[0]]]
            at = m.end()
        return [*out, text[at:]]

    def keys_of(self, text: str) -> list[str]:
        """Keys of a text's units. Marks before white space are units of their own, and so is what follows a line feed."""
        if "<|" in text or MARK in text or WIDE.search(text) or UNUSUAL.search(text) or LOOSE_MARK.search(text):
            return [k for p in self.parts(text) for k in ([f"{SPECIAL}{p}"] if isinstance(p, int) else [WHOLE + u for u in self.units_of(p)])]
        for m in ".,":
            text = text.replace(f"{m} ", f" {MARK}{m} ").replace(f"{m}\n", f" {MARK}{m}\n")
        if text[-1:] in (".", ","):
            text = f"{text[:-1]} {MARK}{text[-1]}"
        first, *rest = text.replace("\n", " \n").split(" ")
        return [WHOLE + first, *rest] if first else rest

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin, and the end)."""
        keys = list(map(self.keys_of, texts))
        unit = self.numbers(list(chain.from_iterable(keys)))
        n = self.units.n[unit]
        ids = gathered(self.units.ids, self.units.first[unit], n)
        ends = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(np.fromiter(map(len, keys), np.int64, len(keys)))))]
        self.units.trim(CACHE_UNITS)
        return ids, ends

    def digest(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the text decoded from them) of each text."""
        ids, ends = self.encode_all(texts)
        spans = []
        for items, first, n in (self.text, self.data):
            size = n[ids]
            spans.append((gathered(items, first[ids], size).tobytes(), np.concatenate(([0], np.cumsum(size)))[ends].tolist()))
        out = []
        (text, t), (data, d) = spans
        for k, n in enumerate(np.diff(ends).tolist()):
            decoded = data[d[k] : d[k + 1]]
            if not decoded.isascii():
                decoded = decoded.decode("utf-8", "replace").encode()
            out.append((n, hashlib.sha256(text[t[k] + 1 : t[k + 1]]).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
OUT_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: number of ids, a digest of the ids, and one of the text decoded from them."""
    path = tokenizer_path(vocabulary)

    def run(batch: pa.RecordBatch):
        c = codec(path)
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            n, ids, back = zip(*c.digest(part.column(1).to_pylist()), strict=True)
            yield rows_of(OUT, {"doc_id": part.column(0), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": back})

    return key_and_text(docs, id_col, text_col).mapInArrow(per_batch(run), OUT_DDL)
