"""Shared pieces: shared-folder tables, vectorised word hashing, connected components.

Text is read as UTF-8 bytes from Arrow buffers; words are hashed with a
polynomial over the bytes (prefix sums modulo 2**64), so no Python object is
made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, materialize

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for work that is heavy per row: a scan of fewer partitions than cores is dealt out, a larger one stays as it is."""
    docs = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


# ------------------------------------------------------------ shared tables


#: What workers keep between tasks, by the name of its user.
CACHES: dict[str, dict] = {}


def forget(keep: str | None) -> None:
    """Drop what a worker kept for other stages than the user ``keep``."""
    for name, cache in CACHES.items():
        if name != keep:
            cache.clear()


def give_back() -> None:
    """Return freed memory to the system; workers live on for later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one
    if trim:
        trim(0)


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` for workers that should hold no more than its own cache ``keep`` before it, and nothing else after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keep)
        yield from fn(batches)
        give_back()

    return run


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: str = "rows", share: int = 500, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (unique ``key``; ``rows`` tells how many rows of left have it) without a hot key in one task.

    Keys that hold more than a ``share``-th of all rows are fewer than ``share``, so their side is broadcast;
    no other key holds more than that.
    """
    most = right.agg((F.sum(rows) / share).cast("long")).first()[0] or 0
    keys = [r[0] for r in right.where(F.col(rows) > most).select(key).collect()]  # fewer than ``share``
    if not keys:
        return left.join(right.drop(rows), key, how)
    hot, mine = right.where(F.col(rows) > most).drop(rows), F.coalesce(F.col(key).isin(keys), F.lit(False))
    return left.where(mine).join(F.broadcast(hot), key).unionByName(left.where(~mine).join(right.drop(rows), key, how))


def bloom(keys: DataFrame, bits: int = 26) -> np.ndarray:
    """A Bloom filter of 2**bits bits, whatever the size of ``keys`` (one column of 64-bit hashes): two bits a key, gathered as bitmaps of 4 KiB."""
    h, mask = F.col(keys.columns[0]), (1 << bits) - 1
    place = F.explode(F.array(*[x.bitwiseAND(mask) + 1 for x in (h, F.shiftrightunsigned(h, bits))]))  # the functions number bits from 1
    rows = keys.select(place.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for b, m in rows:
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(bytes(m), np.uint8)
    return out


def in_bloom(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """False where a hash (int64) is surely none of the filter's keys."""
    bits = len(filter_).bit_length() + 2
    ok = np.ones(len(h), bool)
    for x in (h.view(U64) & U64((1 << bits) - 1), (h.view(U64) >> U64(bits)) & U64((1 << bits) - 1)):
        ok &= (filter_[(x >> U64(3)).astype(np.int64)] >> (x & U64(7)).astype(np.uint8)) & 1 > 0
    return ok


def rows_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, th): each row of ``docs`` whole, so that no column of it clashes with others; th is its text's hash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("th"))


def columns_of(docs: DataFrame, **new) -> list:
    """The columns of ``docs`` out of ``rows_of``, some of them new."""
    return [new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns]


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- word hash

_pow = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n, modulo 2**64; kept up to a Mi entries."""
    if len(_pow[0]) >= n:
        return _pow[0], _pow[1]
    got = []
    for base in (_P, _PINV):
        a = np.full(n, base, U64)
        a[0] = 1
        got.append(np.multiply.accumulate(a))
    if n <= 1 << 20:
        _pow[:] = got
    return got[0], got[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of codes[start:end] for each span."""
    n = len(codes)
    pw, ipw = _powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * pw[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * ipw[starts] + (ends - starts).astype(U64))


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def slices(batches: Iterable[pa.RecordBatch], most: int = 1 << 19, name: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) in runs of whole rows of about ``most`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, off = text_column(batch, name)
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of each row's first word (length rows + 1)."""
    n = len(data)
    inside = ~space[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each k-word window, its row and first word; rows of 1..k-1 words have one window of all words."""
    n = len(hashes)
    count = np.diff(at)
    row = np.repeat(np.arange(len(count)), count)
    left = at[1:][row] - np.arange(n)
    acc = np.zeros(n, U64)
    for i in range(k):
        part = np.zeros(n, U64)
        part[: max(n - i, 0)] = hashes[i:]
        part[left <= i] = U64(0)
        acc = acc * U64(0xD6E8FEB86659FD93) + part
    whole = (left >= k) | ((count[row] < k) & (np.arange(n) == at[:-1][row]))
    pos = np.flatnonzero(whole)
    return mix(acc[pos] + np.minimum(left[pos], k).astype(U64)), row[pos], pos


# --------------------------------------------------------------- group runs


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of equal keys from batches that come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(c[a] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0..n-1; roots are the smallest members."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def local_forest(edges: DataFrame) -> DataFrame:
    """Spanning forest of each partition's edges: same components, at most nodes - 1 edges a partition.

    A task takes its edges in blocks of a quarter million, so memory is bounded.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            e = np.concatenate(held)
            nodes, idx = np.unique(e, return_inverse=True)
            f = Forest(len(nodes))
            keep = np.fromiter((f.join(a, b) for a, b in idx.reshape(-1, 2).tolist()), bool, len(e))
            return pa.RecordBatch.from_arrays([pa.array(e[keep, 0]), pa.array(e[keep, 1])], ["a", "b"])

        held, n = [], 0
        for x in batches:
            if x.num_rows:
                held.append(np.stack([x.column(0).to_numpy(), x.column(1).to_numpy()], 1))
                n += x.num_rows
            if n >= 250_000:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return edges.select("a", "b").mapInArrow(lean(fold), "a long, b long")


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node of the component.

    Alternates large-star and small-star steps over written tables until the
    edges are stars; the rounds grow with the logarithm of the nodes. Edges are
    reduced to per-partition spanning forests first. No edges: no rows.
    """
    now = materialize(local_forest(edges.where("a <> b")), f"{label}-0")
    for i in range(1, 60):
        # stars: every node has one edge down, or edges up alone
        ends = now.select(F.col("a").alias("n"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionAll(now.select("b", F.lit(0), F.lit(1)))
        odd = ends.groupBy("n").agg(F.sum("x").alias("x"), F.max("y").alias("y")).where("x + y > 1 and x > 0")
        if i > 1 and odd.isEmpty():
            break
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        mins = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(mins, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        old, now = now, materialize(small.where("a <> b").distinct(), f"{label}-{i}")
        discard(old)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
