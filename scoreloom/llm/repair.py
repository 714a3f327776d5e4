"""Token-id files with Re-Pair grammar compression.

A shard is the ids of consecutive documents. Frequent id pairs are replaced by
nonterminals round after round: each round counts all pairs, takes the most
frequent ones that share no symbol in a way that lets occurrences overlap, and
replaces them everywhere, until no pair pays for its rule or symbols run out.
The end id stays alone, so no pair crosses a document's end. A shard stores the rules (left, right), their
expansion lengths, the compressed ids and, per document, its compressed offset and
number of ids; so one document, or any range of its ids, decodes without the rest.

Shard bytes, little-endian: six uint32 (magic, first nonterminal, rules,
documents, compressed ids, ids), rules as uint16 pairs, expansion lengths as
uint32, document ids as int64, document null flags as uint8, id counts as uint32,
compressed offsets as uint32, compressed ids as uint16. Symbols fit 16 bits, so a
shard has at most 65536 - 49408 rules.

Null text counts as empty: the end id alone. Files go to a table in the shared
folder, in ascending doc_id order (null first; repeated ids in the order of their
texts). Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C
from .tokens import WordEncoder

END, VOCABULARY, FIRST, MAGIC = 1, "word_bpe_49k.json", 49408, 0x52504131
SHARD_IDS = 1 << 20
LEAST = 5  # a rule and its length take eight bytes, each use of it saves two


def compress(ids: np.ndarray, end: int = END, first: int = FIRST, least: int = LEAST, wide: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(compressed ids, rules as rows left, right); rules may name earlier ones. Ends when no pair occurs ``least`` times or symbols run out."""
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    n_rules, limit = 0, 65536 - first
    while len(seq) > 1 and n_rules < limit:
        key = seq[:-1] << np.uint32(16) | seq[1:]
        sortable = np.sort(key)
        # first places of runs of ``least`` or more equal keys
        often = sortable[least - 1 :] == sortable[: max(len(key) - least + 1, 0)]
        often[1:] &= sortable[1 : len(often)] != sortable[: max(len(often) - 1, 0)]
        at = np.flatnonzero(often)
        # the end id stands alone, so no pair crosses a document's end
        at = at[(sortable[at] >> np.uint32(16) != end) & (sortable[at] & np.uint32(0xFFFF) != end)]
        pairs = sortable[at]
        count = np.searchsorted(sortable, pairs, "right") - at
        if len(pairs) > wide:
            most = np.argpartition(-count, wide)[:wide]
            pairs, count = pairs[most], count[most]
        pairs = pairs[np.lexsort((pairs, -count))]
        lefts, rights, taken = set(), set(), []
        for p in pairs.tolist():
            a, b = p >> 16, p & 0xFFFF
            if a in rights or b in lefts:
                continue
            lefts.add(a)
            rights.add(b)
            taken.append(p)
            if n_rules + len(taken) >= limit:
                break
        if not taken:
            break
        taken = np.sort(np.array(taken, np.uint32))
        # a slot tells which taken pair may be at a place; where it is another one, the pair is looked up
        slot = np.zeros(1 << 20, np.uint16)
        slot[(taken * np.uint32(2654435761)) >> np.uint32(12)] = np.arange(1, len(taken) + 1)
        slots = slot.take((key * np.uint32(2654435761)) >> np.uint32(12))
        at = np.flatnonzero(slots)
        pos, here = slots[at].astype(np.int64) - 1, key[at]
        other = np.flatnonzero(taken[pos] != here)
        pos[other] = np.minimum(np.searchsorted(taken, here[other]), len(taken) - 1)
        hit = taken[pos] == here
        at, pos = at[hit], pos[hit]
        # occurrences overlap only in runs of one id: every second stays
        run = np.r_[True, np.diff(at) != 1]
        start = np.maximum.accumulate(np.where(run, at, 0)) if len(at) else at
        even = (at - start) % 2 == 0
        at, pos = at[even], pos[even]
        seq[at] = (first + n_rules + pos).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(np.stack([taken >> np.uint32(16), taken & np.uint32(0xFFFF)], 1))
        n_rules += len(taken)
    return seq.astype(np.uint16), (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)).astype(np.uint16)


def expansion(rules: np.ndarray, first: int = FIRST) -> np.ndarray:
    """Number of ids under each rule. A rule names earlier ones alone, so one walk in their order does for any nesting."""
    length: list[int] = []
    for a, b in rules.tolist():
        length.append((length[a - first] if a >= first else 1) + (length[b - first] if b >= first else 1))
    return np.array(length, np.uint32)


def expand(seq: np.ndarray, rules: np.ndarray, first: int = FIRST) -> np.ndarray:
    """Ids that compressed ids stand for."""
    seq = seq.astype(np.uint32)
    while len(seq) and seq.max() >= first:
        rule = seq >= first
        n = np.where(rule, 2, 1)
        at = np.cumsum(n) - n
        out = np.empty(int(n.sum()), np.uint32)
        out[at[~rule]] = seq[~rule]
        r = rules[seq[rule] - first]
        out[at[rule]], out[at[rule] + 1] = r[:, 0], r[:, 1]
        seq = out
    return seq


def write_shard(docs: list[int | None], ids: list[np.ndarray], end: int = END, first: int = FIRST) -> bytes:
    flat = np.concatenate(ids)
    seq, rules = compress(flat, end, first)
    length = expansion(rules, first)
    size = np.where(seq < first, 1, length[np.maximum(seq.astype(np.int64) - first, 0)] if len(rules) else 1)
    counts = np.array([len(x) for x in ids], np.uint32)
    offset = np.searchsorted(np.cumsum(size) - size, np.cumsum(counts) - counts).astype(np.uint32)
    head = np.array([MAGIC, first, len(rules), len(docs), len(seq), len(flat)], "<u4")
    null = np.array([d is None for d in docs], np.uint8)
    return b"".join(x.tobytes() for x in (head, rules.astype("<u2"), length.astype("<u4"), np.array([d or 0 for d in docs], "<i8"), null, counts.astype("<u4"), offset.astype("<u4"), seq.astype("<u2")))


@dataclass
class Shard:
    """A shard's bytes, opened; documents decode one at a time."""

    first: int
    rules: np.ndarray
    lengths: np.ndarray
    docs: np.ndarray
    null: np.ndarray
    counts: np.ndarray
    offsets: np.ndarray
    seq: np.ndarray

    @classmethod
    def open(cls, data: bytes) -> Shard:
        magic, first, r, d, s, _ = np.frombuffer(data, "<u4", 6).tolist()
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at, got = 24, []
        for kind, n in (("<u2", 2 * r), ("<u4", r), ("<i8", d), ("u1", d), ("<u4", d), ("<u4", d), ("<u2", s)):
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            got.append(x)
        return cls(first, got[0].reshape(-1, 2), *got[1:])

    def ids(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start..stop-1 of the i-th document: only the symbols that cover them are expanded."""
        a = int(self.offsets[i])
        z = int(self.offsets[i + 1]) if i + 1 < len(self.offsets) else len(self.seq)
        seq = self.seq[a:z]
        stop = int(self.counts[i]) if stop is None else min(stop, int(self.counts[i]))
        if start or stop < self.counts[i]:
            ends = np.cumsum(np.where(seq < self.first, 1, self.lengths[np.maximum(seq.astype(np.int64) - self.first, 0)] if len(self.rules) else 1))
            lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop)) + 1
            skip = start - (int(ends[lo - 1]) if lo else 0)
            return expand(seq[lo:hi], self.rules, self.first)[skip : skip + max(0, stop - start)]
        return expand(seq, self.rules, self.first)

    def all(self) -> np.ndarray:
        """Every id: the rules are expanded once, and their expansions are copied to their places."""
        table = np.r_[np.arange(self.first, dtype=np.uint32), expand(np.arange(len(self.rules)) + self.first, self.rules, self.first)]
        size = np.r_[np.ones(self.first, np.int64), self.lengths.astype(np.int64)]
        start = np.cumsum(size) - size
        n = size[self.seq]
        stop = np.cumsum(n)
        return table[np.repeat(start[self.seq] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]


def write(docs: DataFrame, *, end: int = END, vocabulary: str = VOCABULARY, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards in ascending doc_id order, written to the shared folder: (part, shard, n_docs, n_ids, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        enc = WordEncoder.of(vocabulary)
        ids: list[np.ndarray] = []
        who: list[int | None] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, who, size, shard
            row = (part, shard, len(who), size, write_shard(who, ids, end))
            ids, who, size, shard = [], [], 0, shard + 1
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["part", "shard", "n_docs", "n_ids", "payload"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.append(enc.encode(text.as_py()), np.uint16(end))
                ids.append(x)
                who.append(doc)
                size += len(x)
                if size >= shard_ids:
                    yield flush()
        if who:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange(C.parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return C.materialize(ordered.mapInArrow(C.lean(run, "words"), "part int, shard int, n_docs long, n_ids long, payload binary"), "shards")


def read(shards: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = Shard.open(payload.as_py())
                flat = s.all().astype("<u4")
                stop = np.cumsum(s.counts.astype(np.int64))
                start = stop - s.counts
                crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(start, stop, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.docs, pa.int64(), mask=s.null.astype(bool)), pa.array(start + base), pa.array(s.counts.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_part = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before.alias("before"))  # a row a task
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = shards.select("part", "shard", "n_ids").withColumn("within", within).join(by_part, "part").select("part", "shard", (F.col("before") + F.col("within")).alias("base"))
    return shards.select("part", "shard", "payload").join(base, ["part", "shard"]).select("base", "payload").mapInArrow(C.lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(C.table(spark, sf_dir, "documents")))
