"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Documents are sets of five-word shingles (48-bit hashes); two link when
100 * |A and B| >= 75 * |A or B|. Equal sets are one class from the start.

1. Every document posts its shingles to token buckets. A bucket merges its
   inverted lists and tells each set which of its shingles other sets hold, and
   how many do. Sharing fewer than T = ceil(0.75 n) rules a set out.
2. Of the rest, sorted by list length, the T - 1 longest lists are the "long"
   ones; every partner must occur in one of the others, the short lists. Sets
   that meet in short lists, directly or over others, form a block.
3. In a block each set searches the local index: short lists are merged to
   counts; where candidates under the size bound are left that can still reach
   the overlap, the long lists are counted too. Every candidate is verified, so
   all links are found. Blocks over ``block`` sets are cut, and each pair of
   cuts is searched by a task of its own.

n_links of a row is the number of other texts that its text links with; texts of
equal sets link too, copies of one text count once.

Null or empty text, or text without words: no shingles, linked with nothing.
Rows that repeat a doc_id are kept, each with its own result. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .common import U64

K, NUM, DEN = 5, 75, 100
LOW48 = U64((1 << 48) - 1)
OUT = "kind int, doc_id long, th long, n long, fp long, tokens binary, lists binary"


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingles with their rows, packed as token << 16 | row, sorted; and set sizes by row (rows < 65536)."""
    data = C.LOWER[data]
    s, e, at = C.words(data, off)
    h, row, _ = C.shingles(C.span_hash(data, s, e), at, k)
    packed = np.unique((h & LOW48) << U64(16) | row.astype(U64))
    return packed, np.bincount((packed & U64(0xFFFF)).astype(np.int64), minlength=len(off) - 1)


def _post(k: int, buckets: int, most: int = 1_500_000):
    """Documents to (bucket, ...) rows: kind 0 a document, kind 1 a run of postings."""

    def flush(held: list, docs: list) -> Iterator[pa.RecordBatch]:
        ids, hashes = (pa.concat_arrays([d[i] for d in docs]) for i in (0, 1))
        sizes = np.concatenate([d[2] for d in docs])
        packed = np.sort(np.concatenate(held))
        row = (packed & U64(0xFFFF)).astype(np.int64)
        tok = packed >> U64(16)
        total, mixed = np.zeros(len(ids), U64), np.zeros(len(ids), U64)
        np.add.at(total, row, C.mix(tok))
        np.add.at(mixed, row, C.mix(tok ^ U64(0xA5A5A5A5A5A5)))
        fp = C.mix(total ^ C.mix(mixed + sizes.astype(U64))).view(np.int64)
        n = len(ids)
        # any bucket will do for the documents themselves: they go round, so that copies do not pile up
        yield _rows((np.arange(n) % buckets).astype(np.int32), np.zeros(n, np.int32), ids, hashes, sizes, fp, [b""] * n, [b""] * n)
        # one run of postings a bucket; equal sets of this flush post once
        _, first = np.unique(fp, return_index=True)
        own = np.zeros(n, bool)
        own[first] = True
        keep = own[row]
        tok, row = tok[keep], row[keep]
        cut = np.searchsorted(tok, (np.arange(buckets + 1, dtype=object) * (1 << 48) // buckets).astype(U64))
        out: list[tuple] = []
        for b in range(buckets):
            t, r = tok[cut[b] : cut[b + 1]], row[cut[b] : cut[b + 1]]
            if not len(t):
                continue
            who, at = np.unique(r, return_inverse=True)
            gap = np.diff(t, prepend=t[:1])
            wide = bool(gap.max() >> U64(32))
            body = t.tobytes() if wide else gap.astype(np.uint32).tobytes()
            marks = np.searchsorted(t, _bounds(b, buckets, _marks(len(t))))  # where each range begins, and its first token
            head = np.array([len(who), len(t), wide], np.int64).tobytes() + t[np.minimum(marks, len(t) - 1)].tobytes() + marks.astype(np.int64).tobytes()
            out.append((b, head + fp[who].tobytes() + sizes[who].astype(np.int32).tobytes() + at.astype(np.uint16).tobytes(), body))
            if len(out) >= 256:
                yield _blobs(out)
                out = []
        if out:
            yield _blobs(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, rows, size = [], [], 0, 0
        for batch, data, off in C.slices(batches):
            for i in range(0, batch.num_rows, 32768):
                part = batch.slice(i, 32768)
                o = off[i : i + part.num_rows + 1]
                if rows + part.num_rows > 65536:
                    yield from flush(held, docs)
                    held, docs, rows, size = [], [], 0, 0
                packed, sizes = shingle_sets(data[o[0] : o[-1]], o - o[0], k)
                held.append(packed + U64(rows))
                docs.append((part.column(0), part.column(1), sizes))
                rows, size = rows + part.num_rows, size + len(packed)
            if size >= most:
                yield from flush(held, docs)
                held, docs, rows, size = [], [], 0, 0
        if docs:
            yield from flush(held, docs)

    return run


def _rows(bucket, kind, doc_id, th, n, fp, tokens, lists) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), doc_id, th, pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(tokens, pa.binary()), pa.array(lists, pa.binary())],
        ["bucket", "kind", "doc_id", "th", "n", "fp", "tokens", "lists"],
    )


def _blobs(out: list[tuple]) -> pa.RecordBatch:
    z = [0] * len(out)
    none = pa.nulls(len(out), pa.int64())
    return _rows([x[0] for x in out], [1] * len(out), none, none, z, z, [x[1] for x in out], [x[2] for x in out])


#: Ranges of tokens that a long run of postings can be read by; shorter runs have a fourth, or one.
RANGES = 64


def _marks(n: int) -> int:
    return RANGES if n >= 4096 else RANGES // 4 if n >= 1024 else 1


def _bounds(bucket: int, buckets: int, ranges: int) -> np.ndarray:
    """First token of each range of a bucket."""
    lo, hi = ((bucket + i) * (1 << 48) // buckets for i in (0, 1))
    return np.array([lo + (hi - lo) * i // ranges for i in range(ranges)], U64)


class _Run:
    """A packed run of postings, sorted by token, read by ranges: only the range at hand is unpacked."""

    def __init__(self, head: bytes, body: bytes) -> None:
        who, self.n, self.wide = np.frombuffer(head, np.int64, 3).tolist()
        k = _marks(self.n)
        self.first = np.frombuffer(head, U64, k, 24)
        self.at = np.append(np.frombuffer(head, np.int64, k, 24 + 8 * k), self.n)
        o = 24 + 16 * k
        self.fp, self.size = np.frombuffer(head, np.int64, who, o), np.frombuffer(head, np.int32, who, o + 8 * who)
        self.who = np.frombuffer(head, np.uint16, self.n, o + 12 * who)
        self.body = body

    def counts(self) -> np.ndarray:
        """Postings of each of RANGES ranges; those of a run with fewer ranges stand at the first of each."""
        out = np.zeros(RANGES, np.int64)
        out[:: RANGES // (len(self.at) - 1)] = np.diff(self.at)
        return out

    def read(self, lo: int, hi: int, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, set, set's size) in the ranges lo .. hi - 1 of RANGES; ``bounds`` are their first tokens."""
        step = RANGES // (len(self.at) - 1)
        i, j = lo // step, -(-hi // step)
        a, z = int(self.at[i]), int(self.at[j])
        if self.wide:
            tok = np.frombuffer(self.body, U64, z - a, 8 * a)
        elif a == z:
            tok = np.zeros(0, U64)
        else:
            gap = np.frombuffer(self.body, np.uint32, z - a, 4 * a).astype(U64)
            gap[0] = self.first[i]
            tok = np.cumsum(gap, dtype=U64)
        x = int(np.searchsorted(tok, bounds[lo])) if lo % step else 0
        y = int(np.searchsorted(tok, bounds[hi])) if hi % step else len(tok)
        who = self.who[a + x : a + y]
        return tok[x:y], self.fp[who], self.size[who]


def _repeated(packed: list[tuple[bytes, bytes]], bucket: int, buckets: int, most: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(token, set, set's size, list's length) of lists of two or more sets, by ranges of tokens that hold about ``most`` postings (or a RANGES-th of the bucket)."""
    runs = [_Run(*r) for r in packed]
    held, bounds = sum(r.counts() for r in runs), _bounds(bucket, buckets, RANGES)
    lo = 0
    while lo < RANGES:
        hi, n = lo + 1, held[lo]
        while hi < RANGES and n + held[hi] <= most:
            n += held[hi]
            hi += 1
        got = [r.read(lo, hi, bounds) for r in runs]
        lo = hi
        tok, fp, n = (np.concatenate([g[i] for g in got]) for i in range(3))
        del got
        order = np.lexsort((fp, tok))
        tok, fp, n = tok[order], fp[order], n[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (fp[1:] != fp[:-1])
        tok, fp, n = tok[new], fp[new], n[new]
        start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, np.int64)
        length = np.diff(np.r_[start, len(tok)])
        df = np.repeat(length, length).astype(np.uint32)
        keep = df > 1
        yield tok[keep], fp[keep], n[keep], df[keep]


def _merge(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A bucket's inverted lists: each set gets, per range of tokens, its shingles with lists of two or more sets, and the lists' lengths."""

    names = ["kind", "doc_id", "th", "n", "fp", "tokens", "lists"]

    def out(n, fp, tokens, lists):
        none = pa.nulls(len(n), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([1] * len(n), pa.int32()), none, none, pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(tokens, pa.binary()), pa.array(lists, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            kind = b.column(1).to_numpy()
            docs = b.filter(pa.array(kind == 0))
            if docs.num_rows:
                yield pa.RecordBatch.from_arrays(docs.columns[1:], names)
            for x in b.filter(pa.array(kind == 1)).to_pylist():
                held.setdefault(x["bucket"], []).append((x["tokens"], x["lists"]))
        for bucket in list(held):
            for tok, fp, n, df in _repeated(held.pop(bucket), bucket, buckets):
                order = np.argsort(fp, kind="stable")
                tok, fp, n, df = tok[order], fp[order], n[order], df[order]
                cut = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]]) if len(fp) else np.zeros(0, np.int64)
                end = np.r_[cut[1:], len(fp)] if len(cut) else cut
                for i in range(0, len(cut), 8192):
                    a, z = cut[i : i + 8192], end[i : i + 8192]
                    yield out(n[a], fp[a], [tok[x:y].tobytes() for x, y in zip(a, z, strict=True)], [df[x:y].tobytes() for x, y in zip(a, z, strict=True)])

    return run


def _survivors(num: int, den: int):
    """Sets that share at least T shingles: tokens in the order of their lists, shortest first, and the number of short lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for x in b.to_pylist():
                tok = np.frombuffer(b"".join(x["tokens"]), U64)
                need = -(-num * x["n"] // den)
                if len(tok) < need:
                    continue
                df = np.frombuffer(b"".join(x["lists"]), np.uint32)
                got.append((x["fp"], x["n"], len(tok) - need + 1, tok[np.lexsort((tok, df))].tobytes()))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["fp", "n", "short", "tokens"])

    return run


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp, short, tokens = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
        for i in range(0, b.num_rows, 512):
            part = [np.frombuffer(t.as_py(), U64)[:s].view(np.int64) for t, s in zip(tokens.slice(i, 512), short[i : i + 512], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)), pa.array(np.repeat(fp[i : i + 512], short[i : i + 512]))], ["token", "fp"])


def _bits(rows: np.ndarray, cols: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bit matrix (words of 64 columns, rows), built in strips of 8192 columns; ``cols`` sorted."""
    out = np.zeros((-(-width // 64), height), U64)
    for x in range(0, width, 8192):
        a, z = np.searchsorted(cols, (x, x + 8192))
        strip = np.zeros((height, min(8192, 64 * len(out) - x)), bool)
        strip[rows[a:z], cols[a:z] - x] = True
        out[x // 64 : x // 64 + strip.shape[1] // 64] = np.packbits(strip, axis=1).view(U64).T
    return out


def t_occurrence(sets: list[np.ndarray], short: np.ndarray, size: np.ndarray, side: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """All links, rows (query, partner), between sets given in list order; ``side`` 1 against 0, or all against all where it is constant.

    The index holds the sets of side 0 (all, if constant). A query counts its
    partners in its short lists, bounds them by size, and counts the long lists
    where any is left. Lists of over 1/32 of the index are columns of bits.
    """
    both = bool((side != side[0]).any())
    index = np.flatnonzero(side == 0) if both else np.arange(len(sets))
    query = np.flatnonzero(side == 1) if both else np.arange(len(sets))
    tok = np.concatenate([sets[i] for i in index])
    who = np.repeat(np.arange(len(index)), [len(sets[i]) for i in index])
    order = np.argsort(tok, kind="stable")
    who = who[order]
    vocab, start, length = np.unique(tok[order], return_index=True, return_counts=True)
    heavy = length * 32 > len(index)
    slot = np.cumsum(heavy) - 1
    dense = np.repeat(heavy, length)
    bits = _bits(who[dense], np.repeat(slot, length)[dense], int(heavy.sum()), len(index))

    def holders(tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set of the index holds."""
        p = np.searchsorted(vocab, tokens)
        p[p == len(vocab)] = 0
        p = p[vocab[p] == tokens]
        light, few = p[~heavy[p]], length[p[~heavy[p]]]
        got = np.bincount(who[np.repeat(start[light] - np.r_[0, np.cumsum(few)[:-1]], few) + np.arange(few.sum())], minlength=len(index)) if len(light) else np.zeros(len(index), np.int64)
        if len(light) < len(p):
            mask = np.zeros(64 * len(bits), bool)
            mask[slot[p[heavy[p]]]] = True
            mask = np.packbits(mask).view(U64)
            used = np.flatnonzero(mask)
            got = got + np.bitwise_count(bits[used] & mask[used, None]).sum(0, dtype=np.int64)
        return got

    links = [np.zeros((0, 2), np.int64)]
    sizes = size[index].astype(np.int64)
    for q in query.tolist():
        count = holders(sets[q][: short[q]])
        mine = int(size[q])
        able = (count > 0) & (den * sizes >= num * mine) & (den * mine >= num * sizes)
        if not both:
            able[q:] = False
        need = -(-num * (mine + sizes) // (num + den))
        rest = sets[q][short[q] :]
        able &= count + len(rest) >= need
        if not able.any():
            continue
        found = index[able & (count + holders(rest) >= need)]
        links.append(np.stack([np.full(len(found), q), found], 1))
    return np.concatenate(links)


def spanning(links: np.ndarray, n: int) -> np.ndarray:
    """Those of the links, sorted by query, that join components not joined before."""
    root, keep = np.arange(n), [np.zeros(0, np.int64)]
    first = np.flatnonzero(np.diff(links[:, 0], prepend=-1))
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(links)], strict=True) if len(links) else ():
        own = root[links[a, 0]]
        met, at = np.unique(root[links[a:z, 1]], return_index=True)
        at = at[met != own]
        if len(at):
            keep.append(a + at)
            root[np.isin(root, np.r_[met, own])] = min(met[0], own)
    return links[np.concatenate(keep)]


def _search(num: int, den: int):
    """Per unit of work: a spanning forest of its links (n null), and the linked texts of each set (b null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in C.runs(batches, ["root", "i", "j"]):
            if g.num_rows < 2:
                continue
            fp, part, i, j, texts = (g.column(c).to_numpy() for c in ("fp", "part", "i", "j", "texts"))
            sets = [np.frombuffer(x.as_py(), U64) for x in g.column("tokens")]
            side = (part == j[0]).astype(int) if i[0] != j[0] else np.zeros(len(fp), int)
            links = t_occurrence(sets, g.column("short").to_numpy(), g.column("n").to_numpy(), side, num, den)
            if not len(links):
                continue
            x, y = links.T
            degree = (np.bincount(x, texts[y], len(fp)) + np.bincount(y, texts[x], len(fp))).astype(np.int64)
            who = np.flatnonzero(degree)
            x, y = spanning(links, len(fp)).T
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[fp[x], fp[who]]), pa.array([*fp[y].tolist(), *[None] * len(who)], pa.int64()), pa.array([*[None] * len(x), *degree[who].tolist()], pa.int64())], ["a", "b", "n"])

    return run


def near_duplicates(docs: DataFrame, *, k: int = K, num: int = NUM, den: int = DEN, block: int = 2000) -> DataFrame:
    """Rows (doc_id, th, n_shingles, component_id, n_links), one a row of ``docs``; th is the text's hash. See the module's text."""
    spark = docs.sparkSession
    buckets = max(64, C.parts(spark))
    posted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(C.lean(_post(k, buckets)), "bucket int, " + OUT)
    merged = C.materialize(posted.repartition(buckets, "bucket").mapInArrow(C.lean(_merge(buckets)), OUT), "lists")
    sets = merged.where("kind = 0").select("doc_id", "th", "n", "fp")
    # both lists are collected in one aggregate, so their orders agree
    shared = merged.where("kind = 1").groupBy("fp").agg(F.first("n").alias("n"), F.collect_list(F.struct("tokens", "lists")).alias("x"))
    shared = shared.select("fp", "n", F.col("x.tokens").alias("tokens"), F.col("x.lists").alias("lists"))
    alive = C.materialize(shared.mapInArrow(C.lean(_survivors(num, den)), "fp long, n long, short int, tokens binary"), "alive")
    met = alive.select("fp", "short", "tokens").mapInArrow(C.lean(_short), "token long, fp long")
    hub = met.groupBy("token").agg(F.min("fp").alias("b"))
    near = met.join(hub, "token").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    blocks = C.components(near, "blocks")
    cuts = C.materialize(blocks.groupBy("root").agg(F.count("*").alias("rows")).withColumn("cuts", F.ceil(F.col("rows") / block).cast("int")), "cuts")
    placed = C.hot_join(blocks, cuts, "root").withColumn("part", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    placed = placed.select(F.col("node").alias("fp"), "root", "part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    placed = placed.select("fp", "root", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    # sets that several texts share, as by case or spacing: a link to one is a link to each of its texts
    texts = sets.where("n > 0").groupBy("fp").agg(F.countDistinct("th").alias("texts")).where("texts > 1")
    work = placed.join(alive, "fp").join(texts, "fp", "left").withColumn("texts", F.coalesce("texts", F.lit(1))).repartition(buckets, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    found = C.materialize(work.select("root", "i", "j", "part", "fp", "n", "short", "texts", "tokens").mapInArrow(C.lean(_search(num, den)), "a long, b long, n long"), "found")
    linked = C.components(found.where("b is not null").select("a", "b"), "links").withColumnRenamed("node", "fp")
    links = found.where("b is null").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("links"))
    # one row a set: rows of documents, component, links
    each = sets.where("n > 0").groupBy("fp").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first"), F.countDistinct("th").alias("texts"))
    each = each.join(linked, "fp", "left").join(links, "fp", "left").withColumn("n_links", (F.coalesce("links", F.lit(0)) + F.col("texts") - 1).cast("long"))
    each = C.materialize(each.select("fp", "rows", "first", "n_links", F.coalesce("root", "fp").alias("key")), "sets")
    least = C.materialize(each.where("key <> fp or n_links > 0").groupBy("key").agg(F.min("first").alias("least"), F.count("*").alias("sets")), "components")
    told = C.hot_join(each, least, "key", "sets", how="left").select("fp", "rows", "n_links", F.least("first", "least").alias("component_id"))
    told = C.materialize(told, "told")
    got = C.hot_join(sets.where("n > 0"), told, "fp").select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return got.unionByName(sets.where("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, **kw) -> DataFrame:
    """Documents without their near duplicates: of each component the rows of the smallest doc_id stay, and rows without a doc_id."""
    found = near_duplicates(docs.where("doc_id is not null"), **kw)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct()
    return C.rows_of(docs).join(gone, (F.col("doc_id") == F.col("d")) & (F.col("th") == F.col("t")), "left_anti").select(*C.columns_of(docs))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir)).drop("th")
