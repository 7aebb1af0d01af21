"""Token counts by a compiled finite-state transducer.

The tokenizer merges adjacent symbols, always the pair of best score. A text's tokens are the one way of cutting it into
pieces whose adjacent pairs stay apart when the two are merged alone. So the last token of each prefix follows from
what is known at earlier places: it is the piece that ends here and goes with the last token at its start. A state of the
transducer is what later characters can depend on: the longest end of the text that begins a piece, and for every place
in it the last token there and the tokens up to it, relative to now. Transitions read one character; each is annotated
with the tokens that it emits, which are fewer than none where pieces join. States and transitions are compiled from the
vocabulary and its scores when they are first reached, as a table of all of them would be unbounded; a worker that
holds too many starts anew.

No piece has a space mark after another character, so a space that follows another character, and a line feed, which
no piece holds, put the transducer back into its start state whatever came before.

Texts are cut into chunks. A chunk is a map of states: the characters up to its first reset act on the state in which
it is entered; from there on the tokens emitted and the state it is left in are known. Maps compose associatively, and
a parallel prefix scan over them gives a text's count. A text without such places is one deferred map until its start
is known.

Null and empty texts have no tokens. Repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import key_and_text, per_batch, rows_of, tokenizer_path

CHUNK = 1 << 16
#: Units between two resets whose emitted tokens are remembered, and states; over so many, all are forgotten.
CACHE_UNITS = 700_000
MOST_STATES = 500_000
#: Longer units are counted without being remembered.
LONGEST_KEPT = 256
UNITS = re.compile(r"\n| *[^ \n]+| +")
#: A space that isn't a single one between two words.
ODD_SPACE = re.compile(r"  | \n| \Z")
SPACE = "▁"
#: In front of keys that are units as they stand; plain keys go without the space in front of them.
WHOLE = "\0"
#: A transition is its next state and, in the low bits, its emitted tokens plus this.
BITS, ZERO = 8, 128
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
OUT_DDL = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class StateMap(NamedTuple):
    """What a chunk does. ``head`` acts on the state it is entered in; then it emits ``count`` and is left in state ``exit``.

    ``whole``: the chunk has no reset, so ``head`` is all of it and the rest is unused.
    """

    whole: bool
    head: str
    count: int
    exit: int


class CountTransducer:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        if any("\n" in p or re.search("[^▁]▁", p) for p in self.score):
            raise ValueError("this vocabulary has pieces that span a space or a line feed")
        if len(sp.encode("\n")) != 2 or len(sp.encode("é\n")) != len(sp.encode("é")) + 1:
            raise ValueError("this vocabulary has no token of its own for a line feed")
        self.begins = {p[:k] for p in self.score for k in range(1, len(p))}
        self.apart: dict[tuple[str, str], bool] = {}
        self.emits: dict[str, int] = {}
        self.forget_states()

    # --- compilation

    def forget_states(self) -> None:
        self.transitions: list[dict[str, int]] = []
        self.known: list[tuple[str, tuple]] = []
        self.numbers: dict[tuple[str, tuple], int] = {}
        self.start = self.state("", (("", 0),))

    def state(self, end: str, places: tuple) -> int:
        key = (end, places)
        s = self.numbers.get(key)
        if s is None:
            s = self.numbers[key] = len(self.known)
            self.known.append(key)
            self.transitions.append({})
        return s

    def merged(self, text: str) -> list[str]:
        """The tokenizer's merging of one text: the adjacent pair of best score, the leftmost of equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether two adjacent tokens stay as they are; "" is the place after a reset."""
        key = (left, right)
        x = self.apart.get(key)
        if x is None:
            if len(self.apart) > 4 * MOST_STATES:
                self.apart.clear()
            x = self.apart[key] = self.merged(left + right) == ([left, right] if left else [right])
        return x

    def compile(self, s: int, c: str) -> int:
        """The transition from state ``s`` on character ``c``."""
        end, places = self.known[s]
        c_ = SPACE if c == " " else c
        text = end + c_
        token = emitted = None
        for n in range(min(len(text), len(places)), 0, -1):
            piece, (last, before) = text[-n:], places[n - 1]
            if piece in self.score and self.stay_apart(last, piece):
                token, emitted = piece, before + 1
                break
        if token is None:  # a character that no piece can stand for is spelled in bytes, and nothing joins it
            to, emitted = self.start, len(c.encode("utf-8", "surrogatepass"))
            if c_ in self.score:
                raise ValueError("this vocabulary's merges don't give one way of cutting a text")
        else:
            k = next((k for k in range(len(text)) if text[k:] in self.begins), len(text))
            end = text[k:]
            if c_ == SPACE and not end.strip(SPACE) and len(end) < len(text):  # after another character: a reset
                return self.put(s, c, self.transitions[self.start].get(c) or self.compile(self.start, c), emitted)
            to = self.state(end, ((token, 0), *((t, n - emitted) for t, n in places[: len(end)])))
        return self.put(s, c, to << BITS, emitted)

    def put(self, s: int, c: str, to: int, emitted: int) -> int:
        x = self.transitions[s][c] = (to >> BITS << BITS) | (emitted + ZERO)
        return x

    # --- running

    def run(self, s: int, text: str) -> tuple[int, int]:
        """(state after ``text``, tokens that it emits) from state ``s``."""
        transitions, n = self.transitions, 0
        low = (1 << BITS) - 1
        for c in text:
            x = transitions[s].get(c)
            if x is None:
                x = self.compile(s, c)
            n += x & low
            s = x >> BITS
        return s, n - ZERO * len(text)

    @staticmethod
    def unit(key: str) -> str:
        return key if key[:1] == "\n" else key[1:] if key[:1] == WHOLE else " " + key

    def emitted(self, keys: list[str]) -> np.ndarray:
        """Tokens that each unit emits from the start state; paths that have been run are remembered."""
        emits = self.emits
        out = np.fromiter(map(emits.get, keys, repeat(-1)), np.int64, len(keys))
        lost = np.flatnonzero(out < 0)
        if len(lost):
            new = [keys[i] for i in lost.tolist()]
            run, start = self.run, self.start
            fresh = {k: run(start, self.unit(k))[1] for k in dict.fromkeys(new)}
            out[lost] = np.fromiter(map(fresh.__getitem__, new), np.int64, len(new))
            if len(emits) > CACHE_UNITS:
                emits.clear()
            emits.update((k, n) for k, n in fresh.items() if len(k) <= LONGEST_KEPT)
        return out

    def keys_of(self, chunk: str) -> list[str]:
        """A chunk's units; it is cut where a space follows another character, and at line feeds."""
        if WHOLE in chunk or ODD_SPACE.search(chunk):
            return [WHOLE + u for u in UNITS.findall(chunk)]
        first, *rest = chunk.replace("\n", " \n").split(" ")
        return [WHOLE + first, *rest] if first else rest

    def chunk_maps(self, chunks: list[str]) -> list[StateMap]:
        """The first unit may continue what came before and the last may go on, so those are run apart."""
        units = list(map(self.keys_of, chunks))
        inner = self.emitted(list(chain.from_iterable(u[1:-1] for u in units)))
        ends = np.concatenate(([0], np.cumsum(inner)))[np.concatenate(([0], np.cumsum(np.fromiter((max(0, len(u) - 2) for u in units), np.int64, len(units)))))]
        out = []
        for u, n in zip(units, np.diff(ends).tolist(), strict=True):
            if len(u) < 2:
                out.append(StateMap(True, self.unit(u[0]) if u else "", 0, self.start))
            else:
                left, last = self.run(self.start, self.unit(u[-1]))
                out.append(StateMap(False, self.unit(u[0]), n + last, left))
        return out

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if a.whole:
            return b._replace(head=a.head + b.head)
        left, n = self.run(a.exit, b.head)
        return StateMap(False, a.head, a.count + n, left) if b.whole else StateMap(False, a.head, a.count + n + b.count, b.exit)

    def finish(self, m: StateMap) -> int:
        return self.run(self.start, m.head)[1] + m.count

    def counts(self, texts: list[str], chunk: int = CHUNK) -> list[int]:
        """Tokens of each text, by its chunks' maps."""
        if len(self.known) > MOST_STATES:
            self.forget_states()
        # the library's own space in front; its mark is a space
        texts = [" " + t.replace(SPACE, " ") if t else "" for t in texts]
        cut = [[t[i : i + chunk] for i in range(0, len(t), chunk)] for t in texts]
        maps = iter(self.chunk_maps(list(chain.from_iterable(cut))))
        out = []
        for chunks in cut:
            scan = [next(maps) for _ in chunks]
            while len(scan) > 1:  # each round of the scan halves the maps
                scan = [self.compose(*scan[i : i + 2]) if i + 1 < len(scan) else scan[i] for i in range(0, len(scan), 2)]
            out.append(self.finish(scan[0]) if scan else 0)
        return out


@lru_cache(2)
def transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


def count_tokens(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether it has over ``limit`` tokens."""
    path = tokenizer_path(vocabulary)

    def run(batch: pa.RecordBatch):
        t = transducer(path)
        n = []
        for at in range(0, batch.num_rows, 512):
            n += t.counts(batch.column(1).slice(at, 512).to_pylist())
        yield rows_of(OUT, {"doc_id": batch.column(0), "n_bytes": pc.binary_length(batch.column(1)).cast(pa.int64()), "n_tokens": n, "over_limit": [x > limit for x in n]})

    return key_and_text(docs, id_col, text_col).mapInArrow(per_batch(run), OUT_DDL)
