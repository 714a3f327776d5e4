"""Line deduplication by a segment-partition edit join.

Lines are what line feeds separate, if they hold a word; equal lines are one
class from the start. Two lines of at least ``least`` characters also belong
together within an edit distance of ``tau``.

1. A line of length l is cut into tau + 1 even segments; two lines within tau
   edits share one of them unchanged. Index entries are (l, segment number,
   segment); probes are the substrings at which a segment of a line up to tau
   shorter may stand, with the multi-match-aware start bounds.
2. Entries meet in buckets of their keys. Lines that meet, directly or over
   others, form a block.
3. Within a block candidate pairs come from the same index again, and a banded
   bit-parallel edit distance verifies many pairs at once: of each pair the common
   ends go, and a word of 2 tau + 1 bits slides along the diagonal. Blocks over
   ``block`` lines are cut; each pair of cuts is a unit of work of its own.

In each class of lines the first occurrence (smallest doc_id, then line number)
stays. Null and empty texts have no lines. Rows that repeat doc_id and text are
treated alike, as one occurrence. Extra columns are kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .common import U64

TAU, LEAST, BLOCK = 2, 20, 2000
LOW48 = U64((1 << 48) - 1)


class Spans:
    """Hashes of spans of one array of code points."""

    def __init__(self, codes: np.ndarray) -> None:
        self.ipw = C._powers(len(codes) + 1)[1]
        self.total = np.zeros(len(codes) + 1, U64)
        np.cumsum((codes.astype(U64) + U64(1)) * C._powers(len(codes) + 1)[0][: len(codes)], out=self.total[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return C.mix((self.total[ends] - self.total[starts]) * self.ipw[starts] + (ends - starts).astype(U64))


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or "") for t in texts], out=off[1:])
    return np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32), off


def lines(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and line numbers (from 0, counting all) of lines with a word (more than U+0009..U+000D and spaces)."""
    feeds = np.flatnonzero(codes == 10)
    feed_row = np.searchsorted(off, feeds, "right") - 1
    starts = np.concatenate([off[:-1], feeds + 1])
    ends = np.concatenate([off[1:], feeds])
    rows = np.concatenate([np.arange(len(off) - 1), feed_row])
    # a line ends at its row's next feed or the row's end
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    nxt = np.r_[starts[1:], len(codes) + 1] - 1
    last = np.r_[rows[1:] != rows[:-1], True]
    ends = np.where(last, off[1:][rows], nxt)
    number = np.arange(len(rows)) - np.searchsorted(rows, rows)
    inked = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(((codes < 9) | (codes > 13)) & (codes != 32), out=inked[1:])
    ok = inked[ends] > inked[starts]
    return starts[ok], ends[ok], rows[ok], number[ok]


def segments(length: np.ndarray, tau: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(offset, size) of each of tau + 1 even segments; the last ones take the remainder."""
    parts = tau + 1
    base, rest = length // parts, length % parts
    out, at = [], np.zeros_like(length)
    for i in range(parts):
        size = base + (i >= parts - rest)
        out.append((at, size))
        at = at + size
    return out


def entries(spans: Spans, starts: np.ndarray, ends: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(48-bit keys, lines, whether they are probes): every index entry and probe of the lines."""
    length = ends - starts
    every = np.arange(len(starts))

    def key(at: np.ndarray, size: np.ndarray, l: np.ndarray, i: int) -> np.ndarray:
        return C.mix(spans.hash(at, at + size) ^ C.mix((l * 64 + i).astype(U64))) & LOW48

    for i, (at, size) in enumerate(segments(length, tau)):
        yield key(starts + at, size, length, i), every, False
    for delta in range(tau + 1):
        l = length - delta
        for i, (at, size) in enumerate(segments(np.maximum(l, 0), tau)):
            lo = np.maximum(at - i, at + delta - (tau - i))
            hi = np.minimum(at + i, at + delta + (tau - i))
            for shift in range(-2 * tau, 2 * tau + 1):
                p = at + shift
                ok = (p >= lo) & (p <= hi) & (p >= 0) & (p + size <= length) & (l > tau)
                if ok.any():
                    yield key((starts + p)[ok], size[ok], l[ok], i), every[ok], True


def edit_within(codes: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray, tau: int) -> np.ndarray:
    """Whether each pair of spans is within tau edits: banded, bit-parallel, all pairs in step.

    The common prefix and suffix go first. Then, per pair, a band of 2 tau + 1
    diagonals runs along the longer span. Bit d of ``reach[e]`` says that e edits
    reach diagonal d - tau at the current row; a row advances all diagonals with a
    few word operations.
    """
    a, a_end, b, b_end = (x.astype(np.int64).copy() for x in (a, a_end, b, b_end))
    codes = np.concatenate([codes, np.array([0xFFFFFFFF], np.uint32)])
    out = np.abs((a_end - a) - (b_end - b)) <= tau
    some = np.arange(16)
    for back in (False, True):
        live = np.flatnonzero(out & (a < a_end) & (b < b_end))
        while len(live):
            x, y, room = a[live], b[live], np.minimum(a_end[live] - a[live], b_end[live] - b[live])
            left, right = (a_end[live, None] - 1 - some, b_end[live, None] - 1 - some) if back else (x[:, None] + some, y[:, None] + some)
            same = (codes[np.maximum(left, 0)] == codes[np.maximum(right, 0)]) if back else (codes[np.minimum(left, len(codes) - 1)] == codes[np.minimum(right, len(codes) - 1)])
            same &= some < room[:, None]
            n = np.where(same.all(1), 16, np.argmin(same, 1))
            if back:
                a_end[live] -= n
                b_end[live] -= n
            else:
                a[live] += n
                b[live] += n
            live = live[(n == 16) & (room > 16)]
    m, n = a_end - a, b_end - b
    out &= (np.minimum(m, n) > 0) | (np.maximum(m, n) <= tau)
    todo = np.flatnonzero(out & (np.minimum(m, n) > 0))
    out[todo] = False
    width = 2 * tau + 1
    full = (1 << width) - 1
    for i in range(0, len(todo), 8192):
        part = todo[i : i + 8192]
        m_, n_, a_, b_ = m[part], n[part], a[part], b[part]
        # row i of b against column i + d - tau of a; before the first row, e insertions reach diagonals tau..tau+e
        reach = [np.full(len(part), ((1 << (e + 1)) - 1) << tau & full, np.int64) for e in range(tau + 1)]
        row = 0
        while len(part):
            eq = np.zeros(len(part), np.int64)
            ch = codes[b_ + row]
            for d in range(width):
                col = row + d - tau
                inside = (col < m_) if col >= 0 else np.zeros(len(part), bool)
                eq |= (inside & (codes[np.where(inside, a_ + col, len(codes) - 1)] == ch)).astype(np.int64) << d
            old, reach = reach, []
            for e in range(tau + 1):
                r = old[e] & eq
                if e:
                    # substitute; delete from b: the diagonal falls; insert from a: the diagonal rises
                    r |= old[e - 1] | (old[e - 1] >> 1) & full | (reach[e - 1] << 1) & full
                reach.append(r)
            row += 1
            done = n_ == row
            if done.any():
                goal = tau + (m_ - n_)[done]
                out[part[done]] = sum((r[done] >> goal) & 1 for r in reach) > 0
            on = ~done & (sum(reach) > 0)
            if on.sum() < 0.8 * len(part) or done.any():
                part, m_, n_, a_, b_ = part[on], m_[on], n_[on], a_[on], b_[on]
                reach = [r[on] for r in reach]
    return out


# -------------------------------------------------------------------- stages


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line, h) of every line with a word; line numbers count all lines from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in C.slices(batches):
            codes, off = code_points(rows.column(2).to_pylist())
            s, e, row, number = lines(codes, off)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), rows.column(1).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(Spans(codes).hash(s, e).view(np.int64))], ["doc_id", "th", "line", "h"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(C.lean(run), "doc_id long, th long, line int, h long")


def line_texts(docs: DataFrame, keys: DataFrame, least: int) -> DataFrame:
    """(h, text) of the lines of at least ``least`` characters with h in ``keys``.

    A Bloom filter of fixed size keeps other lines from the shuffle; the join is exact.
    """
    filter_ = docs.sparkSession.sparkContext.broadcast(C.bloom(keys.select("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in C.slices(batches):
            texts = rows.column(0).to_pylist()
            codes, off = code_points(texts)
            s, e, row, _ = lines(codes, off)
            long = e - s >= least
            s, e, row = s[long], e[long], row[long]
            h = Spans(codes).hash(s, e).view(np.int64)
            pick = np.unique(h, return_index=True)[1]
            pick = pick[C.in_bloom(filter_.value, h[pick])]
            x = [texts[r][i:j] for r, i, j in zip(row[pick], s[pick] - off[row[pick]], e[pick] - off[row[pick]], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h[pick]), pa.array(x, pa.string())], ["h", "text"])

    return docs.select("text").mapInArrow(C.lean(run), "h long, text string").groupBy("h").agg(F.first("text").alias("text")).join(keys, "h")


def _post(tau: int, least: int, buckets: int):
    """Lines to bucketed runs of entries: (bucket, lines, sorted keys, line and probe flag of each)."""

    def flush(keys: list, who: list, hashes: list) -> Iterator[pa.RecordBatch]:
        k, w, h = np.concatenate(keys), np.concatenate(who), np.concatenate(hashes)
        order = np.argsort(k)
        k, w = k[order], w[order]
        cut = np.searchsorted(k, (np.arange(buckets + 1, dtype=object) * (1 << 48) // buckets).astype(U64))
        out = []
        for b in range(buckets):
            x, y = k[cut[b] : cut[b + 1]], w[cut[b] : cut[b + 1]]
            if len(x):
                gap = np.diff(x, prepend=x[:1])
                wide = bool(gap.max() >> U64(32))
                own, at = np.unique(h[y >> 1], return_inverse=True)
                out.append((b, own.tobytes(), wide, x.tobytes() if wide else x[:1].tobytes() + gap.astype(np.uint32).tobytes(), (at.astype(np.uint32) * np.uint32(2) + (y & 1).astype(np.uint32)).tobytes()))
        for i in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 64], strict=True), (pa.int32(), pa.binary(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["bucket", "lines", "wide", "keys", "who"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, who, hashes, n, size = [], [], [], 0, 0
        for rows, _, _ in C.slices(batches):
            codes, off = code_points(rows.column(0).to_pylist())
            s, e, _, _ = lines(codes, off)
            long = e - s >= least
            s, e = s[long], e[long]
            if not len(s):
                continue
            spans = Spans(codes)
            h = spans.hash(s, e).view(np.int64)
            h, pick = np.unique(h, return_index=True)
            for k, w, probe in entries(spans, s[pick], e[pick], tau):
                keys.append(k)
                who.append((w + n) * 2 + probe)
                size += len(k)
            hashes.append(h)
            n += len(h)
            if size >= 1_500_000:
                yield from flush(keys, who, hashes)
                keys, who, hashes, n, size = [], [], [], 0, 0
        if keys:
            yield from flush(keys, who, hashes)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) between lines that meet in a bucket's lists: each line with the smallest of its list."""
    held: dict[int, list] = {}
    for b in batches:
        for x in b.to_pylist():
            held.setdefault(x["bucket"], []).append(x)
    for bucket in list(held):
        got = []
        for x in held.pop(bucket):
            k = np.frombuffer(x["keys"], U64) if x["wide"] else np.frombuffer(x["keys"], U64, 1) + np.cumsum(np.frombuffer(x["keys"], np.uint32, -1, 8), dtype=U64)
            w = np.frombuffer(x["who"], np.uint32)
            got.append((k, np.frombuffer(x["lines"], np.int64)[w >> 1], w & 1))
        key, line, probe = (np.concatenate([g[i] for g in got]) for i in range(3))
        order = np.argsort(key, kind="stable")
        key, line, probe = key[order], line[order], probe[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[start, len(key)])
        low, high = np.minimum.reduceat(line, start), np.maximum.reduceat(line, start)
        probes = np.add.reduceat(probe.astype(np.int64), start)
        # two lines at least, an index entry and a probe among them
        ok = np.repeat((low < high) & (probes > 0) & (probes < n), n)
        a, b = line[ok], np.repeat(low, n)[ok]
        e = np.unique(np.stack([a, b], 1)[a != b], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])


def near_pairs(texts: list[str], side: np.ndarray, tau: int, unit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of different texts of one unit of work within tau edits; across sides only, where a unit has both.

    ``unit`` numbers the texts' units from 0 in ascending order; without it there is one.
    """
    n = len(texts)
    unit = np.zeros(n, np.int64) if unit is None else unit
    size = np.bincount(unit) if n else np.zeros(0, np.int64)
    base, cell = np.cumsum(size) - size, np.cumsum(size * size) - size * size
    codes, off = code_points(texts)
    keys, who, probe = [], [], []
    for k, w, p in entries(Spans(codes), off[:-1], off[1:], tau):
        keys.append(C.mix(k ^ unit[w].astype(U64) << U64(48)))
        who.append(w)
        probe.append(np.full(len(k), p))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, w, p = np.concatenate(keys), np.concatenate(who), np.concatenate(probe)
    order = np.lexsort((p, key))
    key, w, p = key[order], w[order], p[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.r_[start[1:], len(key)]
    split = start + np.add.reduceat((~p).astype(np.int64), start)
    able = (split > start) & (split < end) & (np.maximum.reduceat(w, start) > np.minimum.reduceat(w, start))
    seen = np.zeros(int((size * size).sum()), bool)
    for s, m, e in zip(start[able].tolist(), split[able].tolist(), end[able].tolist(), strict=True):
        u = unit[w[s]]
        own = seen[cell[u] : cell[u] + size[u] * size[u]].reshape(size[u], size[u])
        own[np.ix_(np.unique(w[m:e]) - base[u], np.unique(w[s:m]) - base[u])] = True
    hit = np.flatnonzero(seen)
    u = np.searchsorted(cell, hit, "right") - 1
    i, j = (hit - cell[u]) // size[u], (hit - cell[u]) % size[u]
    fresh = (i < j) | ~seen[cell[u] + j * size[u] + i]  # a pair met both ways counts once
    u, i, j = u[fresh], i[fresh], j[fresh]
    i, j = base[u] + np.minimum(i, j), base[u] + np.maximum(i, j)
    two = np.maximum.reduceat(side, base) > np.minimum.reduceat(side, base)
    keep = (i < j) & ((side[i] != side[j]) | ~two[u])
    i, j = i[keep], j[keep]
    near = np.zeros(len(i), bool)
    for x in range(0, len(i), 1 << 16):
        v, z = i[x : x + (1 << 16)], j[x : x + (1 << 16)]
        near[x : x + (1 << 16)] = edit_within(codes, off[v], off[v + 1], off[z], off[z + 1], tau)
    return i[near], j[near]


def _verify(tau: int, cells: int = 1 << 22, chars: int = 1 << 20):
    """Per unit of work: a spanning forest of its links (n null), and the links of each line (b null). Small units are searched together."""

    def search(units: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        g = pa.concat_tables(units)
        h, part, i, j = (g.column(c).to_numpy() for c in ("h", "part", "i", "j"))
        side = np.where(i != j, part == j, False).astype(int)
        unit = np.repeat(np.arange(len(units)), [u.num_rows for u in units])
        x, y = near_pairs(g.column("text").to_pylist(), side, tau, unit)
        if not len(x):
            return
        f = C.Forest(len(h))
        keep = np.fromiter((f.join(p, q) for p, q in zip(x.tolist(), y.tolist(), strict=True)), bool, len(x))
        degree = np.bincount(np.r_[x, y], minlength=len(h))
        who = np.flatnonzero(degree)
        k = int(keep.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[h[x[keep]], h[who]]), pa.array([*h[y[keep]].tolist(), *[None] * len(who)], pa.int64()), pa.array([*[None] * k, *degree[who].tolist()], pa.int64())], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        pairs = size = 0
        for g in C.runs(batches, ["root", "i", "j"]):
            if g.num_rows < 2:
                continue
            if held and (pairs + g.num_rows**2 > cells or size > chars):
                yield from search(held)
                held, pairs, size = [], 0, 0
            held.append(g)
            pairs, size = pairs + g.num_rows**2, size + g.column("text").nbytes
        if held:
            yield from search(held)

    return run


def line_links(docs: DataFrame, *, tau: int = TAU, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(h, root, links) of lines with links: smallest line of the class, and number of other lines within tau."""
    buckets = max(64, C.parts(docs.sparkSession))
    met = docs.select("text").mapInArrow(C.lean(_post(tau, least, buckets)), "bucket int, lines binary, wide boolean, keys binary, who binary").repartition(buckets, "bucket").mapInArrow(C.lean(_meet), "a long, b long")
    blocks = C.components(met, "line-blocks")
    cuts = C.materialize(blocks.groupBy("root").agg(F.count("*").alias("rows")).withColumn("cuts", F.ceil(F.col("rows") / block).cast("int")), "line-cuts")
    placed = C.hot_join(blocks, cuts, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    placed = C.materialize(placed.select(F.col("node").alias("h"), "root", "part", "cuts"), "line-parts")
    texts = line_texts(docs, placed, least)
    work = texts.select("h", "text", "root", "part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other")).select("h", "text", "root", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    work = work.repartition(buckets, "root", "i", "j").sortWithinPartitions("root", "i", "j", "h")
    found = C.materialize(work.select("root", "i", "j", "part", "h", "text").mapInArrow(C.lean(_verify(tau)), "a long, b long, n long"), "line-links")
    classes = C.components(found.where("b is not null").select("a", "b"), "line-classes").withColumnRenamed("node", "h")
    return classes.join(found.where("n is not null").groupBy(F.col("a").alias("h")).agg(F.sum("n").alias("links")), "h")


def judged_lines(docs: DataFrame, **kw) -> DataFrame:
    """(doc_id, th, line, links, first): every line with a word; ``first`` marks the occurrence of its class that stays."""
    table = C.materialize(line_table(docs), "lines").dropDuplicates(["doc_id", "th", "line"])
    here = F.struct("doc_id", "th", "line")
    own = C.materialize(table.groupBy("h").agg(F.min(here).alias("first"), F.count("*").alias("rows")), "line-firsts")
    linked = C.materialize(line_links(docs, **kw).join(own, "h"), "linked-lines")
    least = C.materialize(linked.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("rows")), "class-firsts")
    linked = C.hot_join(linked.select("h", "root", "links"), least, "root").select("h", "links", "least")
    # lines that occur once and link with none need no look-up
    told = own.join(linked, "h", "left").where("rows > 1 or links is not null")
    told = C.materialize(told.select("h", "rows", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("least", "first").alias("first")), "told-lines")
    keyed = C.hot_join(table, told, "h", how="left")
    return keyed.select("doc_id", "th", "line", F.coalesce("links", F.lit(0)).cast("long").alias("links"), (F.col("first").isNull() | here.eqNullSafe(F.col("first"))).alias("first"))


def dedup_report(docs: DataFrame, **kw) -> DataFrame:
    """Per document (rows that repeat doc_id and text give one): doc_id, n_lines, n_dropped, n_links, dropped (line numbers)."""
    per = judged_lines(docs, **kw).groupBy("doc_id", "th").agg(F.count("*").alias("n_lines"), F.count_if(~F.col("first")).alias("n_dropped"), F.sum("links").alias("n_links"), F.array_sort(F.collect_list(F.when(~F.col("first"), F.col("line")))).alias("dropped"))
    ids = docs.select("doc_id", F.xxhash64("text").alias("th")).distinct()
    zero = F.lit(0).cast("long")
    got = ids.join(per, ids.doc_id.eqNullSafe(per.doc_id) & (ids.th == per.th), "left")
    return got.select(ids.doc_id, *[F.coalesce(c, zero).alias(c) for c in ("n_lines", "n_dropped", "n_links")], F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def drop_lines(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` without repeated lines; a document that loses every line with a word goes, n_chars follows the text."""
    per = judged_lines(docs, **kw).groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.count("*").alias("n"), F.collect_list(F.when(~F.col("first"), F.col("line"))).alias("gone"))
    per = per.where("size(gone) > 0")
    got = C.rows_of(docs).join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").where("gone is null or size(gone) < n")
    text = F.col("row.text")
    text = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return got.select(*C.columns_of(docs, **new))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(C.documents(spark, sf_dir))
