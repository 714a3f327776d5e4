"""Best-fit packing of token sequences by bin completion.

The problem depends on the pieces' lengths alone, so it is solved on their
histogram (at most ``size`` numbers, however large the corpus): patterns of
lengths with multiplicities. Best-fit decreasing gives the incumbent; bin
completion fills bins around the largest remaining length with undominated
fillings, least waste first, and prunes by the waste that an improvement still
allows. Pieces then find their places by their rank among pieces of their length.

Null text counts as empty: one piece, the end id alone. Repeated rows and rows
with a null doc_id are packed like any other. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .tokens import WordEncoder

SIZE, END, VOCABULARY, NODES = 2048, 0, "word_bpe_49k.json", 10_000
Pattern = tuple[int, tuple[int, ...]]  # how many bins, lengths in each

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def cut(docs: DataFrame, size: int = SIZE, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of at most ``size`` ids; place: the piece's number among those of its length in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = WordEncoder.of(vocabulary)
        seen: Counter = Counter()
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                rows = []
                for doc, text in zip(b.column(0).slice(i, 2048).to_pylist(), b.column(1).slice(i, 2048), strict=True):
                    ids = np.append(enc.encode(text.as_py()).astype("<u4"), np.uint32(end))
                    for k, s in enumerate(range(0, len(ids), size)):
                        x = ids[s : s + size]
                        rows.append((doc, k, s, len(x), zlib.crc32(x.tobytes()), part, seen[len(x)]))
                        seen[len(x)] += 1
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    return docs.select("doc_id", "text").mapInArrow(C.lean(run, "words"), PIECES)


# ------------------------------------------------------------------- solver


def best_fit(counts: dict[int, int], size: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: equal bins are kept as one pattern with a count."""
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    done: list[Pattern] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        gap = size - sum(lengths)
        if gap and n:
            gaps.setdefault(gap, []).append((lengths, n))
        elif n:
            done.append((n, lengths))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fit = min((g for g in gaps if g >= length), default=None)
            if fit is None:
                each = min(size // length, left)
                put((length,) * each, left // each)
                left -= left // each * each
                continue
            lengths, n = gaps[fit].pop()
            if not gaps[fit]:
                del gaps[fit]
            each = min(fit // length, left)
            used = min(n, left // each)
            put(lengths, n - used)
            put(lengths + (length,) * each, used)
            left -= used * each
    return done + [(n, lengths) for held in gaps.values() for lengths, n in held]


def lower_bound(left: np.ndarray, size: int) -> int:
    """Fewest bins that lengths (counts by length, 0..size) need at least.

    For each k up to half a bin: lengths over size - k stand alone, other lengths over a half share a bin with none of
    their kind, and of the rest those of at least k fill the gaps of the latter and then whole bins.
    """
    count, total = np.cumsum(left), np.cumsum(left * np.arange(size + 1))
    k = np.arange(1, size // 2 + 1)
    alone = count[size] - count[size - k]
    halves, used = count[size - k] - count[size // 2], total[size - k] - total[size // 2]
    rest = total[size // 2] - total[k - 1] - (halves * size - used)
    return int(max(-(-total[size] // size), (alone + halves + np.maximum(0, -(-rest // size))).max(initial=0)))


def _dominates(a: tuple[int, ...], b: tuple[int, ...], steps: int = 64) -> bool:
    """Filling b's lengths fit into a's as bins: a leaves the easier rest. Exact but for more than ``steps`` tries."""
    items, rooms, tries = sorted(b, reverse=True), list(a), [steps]

    def go(i: int) -> bool:
        if i == len(items):
            return True
        for r in sorted({x for x in rooms if x >= items[i]}):
            tries[0] -= 1
            if tries[0] < 0:
                return False
            at = rooms.index(r)
            rooms[at] = r - items[i]
            if go(i + 1):
                return True
            rooms[at] = r
        return False

    return sum(items) <= sum(a) and go(0)


def fillings(gap: int, counts: np.ndarray, wide: int = 8, nodes: int = 256) -> list[tuple[int, ...]]:
    """Undominated fillings of a gap from the lengths that are left, least waste first.

    A length is followed by shorter ones alone; of a filling's last length the longest that fits counts, since it
    dominates the others. A filling without waste ends the search: none is better by waste. ``wide`` lengths a level
    and ``nodes`` partial fillings bound the enumeration.
    """
    found: list[tuple[int, ...]] = []
    have = np.flatnonzero(counts[: gap + 1])[::-1].tolist()
    if not have:
        return [()]
    budget, least = [nodes], have[-1]

    def go(room: int, at: int, got: tuple[int, ...]) -> bool:
        budget[0] -= 1
        tried, closed = 0, False
        for i in range(at, len(have)):
            x = have[i]
            if x > room or counts[x] <= got.count(x):
                continue
            if budget[0] <= 0 or tried >= wide:
                break
            tried += 1
            if x == room:
                found.append((*got, x))
                return True
            if room - x < least:
                if not closed:  # nothing fits behind it; a shorter one with nothing behind wastes more
                    found.append((*got, x))
                closed = True
            elif go(room - x, i, (*got, x)):
                return True
        if not tried and got:
            found.append(got)
        return False

    go(gap, 0, ())
    found.sort(key=lambda f: (gap - sum(f), len(f)))
    kept: list[tuple[int, ...]] = []
    for f in found[: 4 * wide]:
        if not any(_dominates(k, f) for k in kept):
            kept.append(f)
        if len(kept) == wide:
            break
    return kept or [()]


def bin_completion(counts: dict[int, int], size: int, incumbent: list[Pattern], nodes: int = NODES) -> list[Pattern]:
    """The incumbent, or a better packing found by depth-first search within ``nodes`` steps.

    A step fills bins around the largest length that is left; a filling is tried as often as its lengths last, half as
    often and once. A branch ends where its waste, or the bound of what is left, no longer allows an improvement; the
    search ends with a packing that meets the lower bound.
    """
    best, bins = incumbent, sum(n for n, _ in incumbent)
    total = sum(k * n for k, n in counts.items())
    left = np.zeros(size + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    least = lower_bound(left, size)
    stack: list[list] = []  # [choices, next choice, applied]
    waste = used = 0

    def put(n: int, lengths: tuple[int, ...]) -> None:
        """Fill n bins; empty them again if n is negative."""
        nonlocal waste, used
        for x in lengths:
            left[x] -= n
        waste += n * (size - sum(lengths))
        used += n

    def choices() -> list[Pattern]:
        big = int(np.flatnonzero(left)[-1])
        left[big] -= 1
        found = [(big, *f) for f in fillings(size - big, left)]
        left[big] += 1
        most = {f: min(int(left[x]) // c for x, c in Counter(f).items()) for f in found}
        got = [(k, f) for f in found for k in dict.fromkeys((most[f], most[f] // 2, 1)) if k]
        return sorted(got, key=lambda c: -c[0] * sum(c[1]))  # whole runs first, then shares of them

    while nodes > 0 and bins > least:
        nodes -= 1
        if not left.any():
            if used < bins:
                best, bins = [tuple(t[2]) for t in stack], used
        elif waste <= (bins - 1) * size - total and used + lower_bound(left, size) < bins:
            stack.append([choices(), 0, None])
        while stack:
            top = stack[-1]
            if top[2] is not None:
                put(-top[2][0], top[2][1])
                top[2] = None
            if top[1] == len(top[0]):
                stack.pop()
                continue
            n, lengths = top[0][top[1]]
            top[1] += 1
            gap = size - sum(lengths)
            if gap:
                n = min(n, max(0, ((bins - 1) * size - total - waste) // gap))
            if n:
                put(n, lengths)
                top[2] = (n, lengths)
                break
        else:
            break
    return best


def solve(counts: dict[int, int], size: int = SIZE) -> list[Pattern]:
    """Patterns that hold every length as often as it is counted."""
    return bin_completion(counts, size, best_fit(counts, size))


# ------------------------------------------------------------------- places


def slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, each, first sequence, offset): pieces of ranks lo..hi-1 of a length go ``each`` to a sequence, from offset on."""
    out, rank, seq = [], Counter(), 0
    for n, lengths in patterns:
        at = 0
        for x, each in sorted(Counter(lengths).items(), reverse=True):
            lo = rank[x]
            rank[x] += n * each
            out.append((x, lo, rank[x], each, seq, at))
            at += x * each
        seq += n
    return out


def pack(docs: DataFrame, *, size: int = SIZE, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document's pieces with sequence_id and offset."""
    spark = docs.sparkSession
    pieces = C.materialize(cut(docs, size, end, vocabulary), "pieces")
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_task = C.materialize(by_task, "lengths")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select(F.col("part").alias("p"), F.col("length").alias("l"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, (pieces.part == base.p) & (pieces.length == base.l)).withColumn("rank", F.col("base") + F.col("place"))
    # every step of best fit uses up a length or a pattern, so patterns are at most four a length, however many pieces there are
    rows = slots(solve(counts, size))
    places = spark.createDataFrame(rows, "slot_length long, lo long, hi long, each long, first_sequence long, at long")
    got = ranked.join(F.broadcast(places) if len(rows) <= 500_000 else places, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(C.documents(spark, sf_dir))
