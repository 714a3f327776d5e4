"""Token counts by a compiled finite-state transducer.

The byte-level BPE vocabulary cuts texts by
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
A right-to-left pass resolves the pattern's look-ahead into the character's class
(an apostrophe before s, t, m, d or re, ve, ll; the last space of a run before
other text). Over those classes an eight-state deterministic transducer reads
left to right and marks where a word begins. The stream of many texts is cut into
equal chunks; each chunk yields its state map (from every state to the state at
its end), and maps compose by a parallel prefix scan, so every chunk knows its
entry state without waiting for those before it; a second pass emits the marks.

A second transducer reads the bytes of a word. It follows from the vocabulary's
merges: the last token of each prefix's encoding is the one suffix that is a token
and compatible with the last token before it, where two tokens are compatible if
their bytes together encode to just these two. A state is what later bytes can
still depend on: the longest suffix that begins a token, and over it the last token
and the token count of each prefix, relative to the present one. Each transition
carries the tokens that it adds (or takes back, where a merge grows). States and
transitions are compiled when first met; a full table is cleared but for the states
in use. Every word begins in the start state, so behind a mark the state map of a
stretch is constant, all words of a stream run in step, and counts add up.
Character classes come from the library's own splitter.

Special strings inside texts count as one token each, as is the library's default.
Null text counts as empty. Repeated rows each get a result; extra columns are
ignored.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .tokens import vocabulary

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
LETTER, NUMBER, OTHER, WHITE, SPACE, QUOTE = range(6)  # of characters
UNKNOWN = 255
# classes after look-ahead is resolved; RESET ends a text
L, N, O, Q1, Q2, S_LAST, W_LAST, W_IN, RESET = range(9)
OPEN, IN_L, IN_N, IN_O, IN_W, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)
STATES, KINDS = 8, 16


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, 1 where the character begins a word), both flat over state * KINDS + class."""
    to, out = np.zeros((STATES, KINDS), np.uint8), np.zeros((STATES, KINDS), bool)
    first = {L: IN_L, N: IN_N, O: IN_O, Q1: ONE_MORE, Q2: TWO_MORE, S_LAST: AFTER_SPACE, W_LAST: OPEN, W_IN: IN_W, RESET: OPEN}
    for state in range(STATES):
        for kind, target in first.items():
            to[state, kind], out[state, kind] = target, kind != RESET
    for state, kinds in {IN_L: (L,), IN_N: (N,), IN_O: (O, Q1, Q2), IN_W: (W_IN,)}.items():
        for kind in kinds:
            to[state, kind], out[state, kind] = state, False
    for kind, target in {L: IN_L, N: IN_N, O: IN_O, Q1: IN_O, Q2: IN_O}.items():
        to[AFTER_SPACE, kind], out[AFTER_SPACE, kind] = target, False
    for state, target in {ONE_MORE: OPEN, TWO_MORE: ONE_MORE}.items():
        to[state, L], out[state, L] = target, False
    return to.ravel(), out.ravel()


TO, OUT = transducer()


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (chunks, STATES): row i maps the first state to the one after chunk i."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    return maps


def marks(kinds: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """Where words begin, for a stream of classes that starts in OPEN."""
    n = len(kinds)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, RESET, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    state = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], rows, 1)
    for line in grid:
        state = TO[(state << 4) | line]
    entry = np.zeros(rows, np.uint8)
    entry[1:] = compose(state.T)[:-1, OPEN]
    out = np.empty((chunk, rows), bool)
    for i, line in enumerate(grid):
        at = (entry << 4) | line
        out[i] = OUT[at]
        entry = TO[at]
    return out.T.ravel()[:n]


def byte_symbols() -> dict[str, int]:
    """Characters by which the vocabulary writes bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Transducer of byte-pair merges over the bytes of a word.

    Transitions are kept under state << 8 | byte in a hash table of four slots a state, at most half full.
    """

    def __init__(self, name: str, most_states: int = 1 << 18) -> None:
        with open(vocabulary(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbols = byte_symbols()
        self.ids = {bytes(symbols[c] for c in t): i for t, i in model["vocab"].items() if all(c in symbols for c in t)}
        self.bytes = {i: t for t, i in self.ids.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for n, (x, y) in enumerate(model["merges"]):
            i, j = model["vocab"][x], model["vocab"][y]
            self.rank[i, j] = n, model["vocab"][x + y]
        self.begins = {t[:k] for t in self.ids for k in range(1, len(t) + 1)}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.most = most_states
        self._clear()

    def _clear(self) -> None:
        self.states: dict[bytes, int] = {}
        self.keys: list[bytes] = []
        self.slots, self.to, self.out, self.used = np.full(4 * self.most, -1, np.int32), np.zeros(4 * self.most, np.int32), np.zeros(4 * self.most, np.int8), 0
        self._state(b"", [-1], [0])

    def _state(self, suffix: bytes, lasts: list[int], counts: list[int]) -> int:
        return self._known(bytes([len(suffix)]) + suffix + array("i", lasts).tobytes() + array("b", counts).tobytes())

    def _known(self, key: bytes) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
        return self.states[key]

    def _slot(self, x: np.ndarray) -> np.ndarray:
        """Where each transition is, or the free slot in which it would be."""
        n = len(self.slots)
        at = (x * np.int64(0x9E3779B1) >> 7) % n
        todo = np.flatnonzero((self.slots[at] != x) & (self.slots[at] >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) % n
            held = self.slots[at[todo]]
            todo = todo[(held != x[todo]) & (held >= 0)]
        return at

    def encode(self, word: bytes) -> list[int]:
        """Merges by rank; for the few short strings that compiling asks for."""
        got = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(got) > 1:
            n, new = min((self.rank.get(p, (1 << 30, -1)) for p in zip(got, got[1:], strict=False)), default=(1 << 30, -1))
            if new < 0:
                break
            out, i = [], 0
            while i < len(got):
                if i + 1 < len(got) and self.rank.get((got[i], got[i + 1]), (-1, -1))[0] == n:
                    out.append(new)
                    i += 2
                else:
                    out.append(got[i])
                    i += 1
            got = out
        return got

    def compatible(self, last: int, token: int) -> bool:
        ok = self.pairs.get((last, token))
        if ok is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            ok = self.pairs[last, token] = self.encode(self.bytes.get(last, b"") + self.bytes[token]) == ([token] if last < 0 else [last, token])
        return ok

    def _place(self, x: int) -> int:
        n = len(self.slots)
        at = (x * 0x9E3779B1 >> 7) % n
        while self.slots[at] != x and self.slots[at] >= 0:
            at = (at + 1) % n
        return at

    def compile(self, x: int) -> None:
        key = self.keys[x >> 8]
        n = key[0]
        suffix = key[1 : n + 1] + bytes([x & 255])
        lasts, counts = array("i", key[n + 1 : 5 * n + 5]).tolist(), array("b", key[5 * n + 5 :]).tolist()
        while suffix not in self.begins:
            suffix = suffix[1:]
        for n in range(len(suffix), 0, -1):
            token = self.ids.get(suffix[-n:])
            if token is not None and self.compatible(lasts[n - 1], token):
                break
        else:
            raise ValueError("no token ends here")
        adds = 1 - counts[n - 1]
        d = len(suffix)
        at = self._place(x)
        self.slots[at], self.to[at], self.out[at] = x, self._state(suffix, [token, *lasts[:d]], [0, *(adds + c for c in counts[:d])]), adds
        self.used += 1

    def _step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and what the transitions emit."""
        x = state.astype(np.int64) << 8 | byte
        at = self._slot(x)
        new = np.unique(x[self.slots[at] < 0])
        if len(new):
            if len(self.keys) + len(new) > self.most or self.used + len(new) > 2 * self.most:
                own, back = np.unique(state, return_inverse=True)
                keys = [self.keys[s] for s in own.tolist()]
                self._clear()
                x = np.array([self._known(k) for k in keys], np.int64)[back] << 8 | byte
                new = np.unique(x)
            for y in new.tolist():
                self.compile(y)
            at = self._slot(x)
        return self.to[at], self.out[at]

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word data[start:end]: the sums of what its transitions emit."""
        total = np.zeros(len(starts), np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first: words still running are the first ones
        lanes = self.most // 4
        for i in range(0, len(order), lanes):
            pick = order[i : i + lanes]
            total[pick] = self._run(data, starts[pick], (ends - starts)[pick])
        return total

    def _run(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total, state = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int32)
        step, running = 0, len(starts)
        while running > 4:
            state[:running], out = self._step(state[:running], data[starts[:running] + step])
            total[:running] += out
            step += 1
            running = int(np.searchsorted(-sizes[:running], -step))
        # the few longest words, byte by byte; a cleared table renumbers states, so they go by key
        for i, key in enumerate([self.keys[k] for k in state[:running].tolist()]):
            now, n = self._known(key), 0
            for b in data[starts[i] + step : starts[i] + sizes[i]].tolist():
                at = self._place(now << 8 | b)
                if self.slots[at] < 0:
                    to, out = self._step(np.array([now], np.int32), np.array([b], np.uint8))
                    now, n = int(to[0]), n + int(out[0])
                else:
                    now, n = int(self.to[at]), n + int(self.out[at])
            total[i] += n
        return total


class Counter:
    """The compiled transducers of one vocabulary in one worker."""

    _own: dict[str, Counter] = C.CACHES.setdefault("transducers", {})

    def __init__(self, name: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.classes[[ord("'"), ord(" ")]] = QUOTE, SPACE
        self.merges = Merges(name)

    @classmethod
    def of(cls, name: str) -> Counter:
        if name not in cls._own:
            cls._own[name] = cls(name)
        return cls._own[name]

    def _class(self, code: int) -> int:
        """The class by which the library's splitter joins the character to neighbours."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for kind, near in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(split(near + chr(code))) == 1:
                return kind
        return WHITE

    def kinds(self, codes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Classes with look-ahead resolved; ``last`` marks each text's last character."""
        c = self.classes[codes]
        if (c == UNKNOWN).any():
            for code in np.unique(codes[c == UNKNOWN]).tolist():
                self.classes[code] = self._class(code)
            c = self.classes[codes]
        after = np.empty_like(codes)
        after[:-1], after[-1:] = codes[1:], 0
        after[last] = 0
        white = (c == WHITE) | (c == SPACE)
        next_white = np.zeros(len(c), bool)
        next_white[:-1] = white[1:]
        inside = last | next_white  # the run goes on, or the text ends in it
        out = np.array([L, N, O, W_LAST, S_LAST, O], np.uint8)[c]
        # a run that reaches the text's end has no last space
        out[white & inside] = W_IN
        at = np.flatnonzero(c == QUOTE)
        if len(at):
            x = after[at]
            y = np.where(last[at], 0, after[np.minimum(at + 1, len(codes) - 1)])
            one = np.isin(x, [ord(k) for k in "stmd"])
            two = np.zeros(len(at), bool)
            for a, b in ("re", "ve", "ll"):
                two |= (x == ord(a)) & (y == ord(b))
            out[at[one]], out[at[two]] = Q1, Q2
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text (specials aside), all at once."""
        n = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.zeros(len(texts), np.int64)
        stop = np.cumsum(n)
        last = np.zeros(len(codes), bool)
        last[stop[n > 0] - 1] = True
        kinds = self.kinds(codes, last)
        # a RESET between texts sends every state to OPEN
        at = np.arange(len(codes)) + np.repeat(np.arange(len(texts)), n)
        stream = np.full(len(codes) + len(texts), RESET, np.uint8)
        stream[at] = kinds
        starts = np.flatnonzero(marks(stream)[at])
        width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        place = np.r_[0, np.cumsum(width)]  # of each character's bytes
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        got = self.merges.counts(data, place[starts], place[np.r_[starts[1:], len(codes)]])
        total = np.r_[0, np.cumsum(got)]
        upto = np.searchsorted(starts, np.r_[0, stop])
        return total[upto[1:]] - total[upto[:-1]]

    def texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, special strings included."""
        out = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, t in enumerate(texts):
            parts = [t]
            for s in self.specials:
                if s in t:
                    cut = [p.split(s) for p in parts]
                    out[i] += sum(len(c) - 1 for c in cut)
                    parts = [x for c in cut for x in c]
            pieces += parts
            owner += [i] * len(parts)
        np.add.at(out, np.array(owner, np.int64), self.count(pieces))
        return out


def count_tokens(docs: DataFrame, *, vocabulary: str = VOCABULARY, limit: int = LIMIT, chars: int = 1 << 19) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(vocabulary)
        for rows, _, off in C.slices(batches, chars):
            n = counter.texts([t or "" for t in rows.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(C.lean(run, "transducers"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(C.documents(spark, sf_dir))
