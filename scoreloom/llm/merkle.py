"""A dataset manifest as Merkle trees over ranks: exact ranks from digit histograms, nodes keyed by rank digits.

A row's leaf is the SHA-256 of doc_id, source, lang, n_chars and text, each ``-`` if null and else its UTF-8 byte
count, ``:`` and its value. A language's leaves stand in order of doc_id; every ``FANOUT`` consecutive nodes (the last
run may be shorter) become the SHA-256 of their hex digests until one is left, the language's subroot. Subroots, by
language, become the root in the same way.

1. One pass over the texts writes leaves; nothing later sees a text.
2. Ranks need no sort of a language: leaves are counted by (language, doc_id without its last bits), those counts are
   summed over ever shorter digit prefixes, and starts come back down, sorting no more than the ``2**DIGIT`` children
   of one prefix at a time. A leaf's rank is its bucket's start and its place in the bucket of ``2**LAST`` ids. A bucket
   that holds more rows than ids, as many rows repeat an id or have none, is counted again by digits of the leaf.
3. Base-``FANOUT`` digits of the rank key the trie. Nodes with a common prefix of all but the last ``DEPTH`` digits, at
   most ``FANOUT**DEPTH`` of them, meet in one group and are reduced over ``DEPTH`` levels at once, longest prefix
   first; the groups' tops are the nodes of the next round.
4. Paths (what stands left and right of a node at each level above) come down from the root, one row a group, and each
   group proves its own leaves.

Nulls: a null doc_id stands before all others, a null lang is a language before all others and not the empty one. Rows
that repeat a doc_id stand in order of their leaves; each is a leaf of its own. No rows: no result. Other columns are
ignored, whatever their names. Languages are few: their list, a row a language, is ordered in one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from . import common as C

FANOUT, DEPTH = 8, 4
#: Bits of doc_id in a bucket, bits of a digit above it.
LAST, DIGIT = 10, 14
#: Rows of a bucket beyond which it is counted by the leaf's digits too.
MOST = 4 << LAST

_LOWER = bytes(C.LOWER)


def _hex(x: bytes) -> bytes:
    return hashlib.sha256(x).hexdigest().encode()


def _field(value: bytes | None) -> bytes:
    return b"-" if value is None else b"%d:%s" % (len(value), value)


def _utf8(value: str | None) -> bytes | None:
    return None if value is None else value.encode()


def _number(value: int | None) -> bytes | None:
    return None if value is None else b"%d" % value


def lower_cased(doc_id: int | None, text: bytes) -> bytes | None:
    """The contract's tampering: A-Z lower-cased where 3 divides the CRC-32 of the decimal doc_id; else None."""
    return text.translate(_LOWER) if doc_id is not None and zlib.crc32(b"%d" % doc_id) % 3 == 0 else None


def leaves(docs: DataFrame, *, tamper: Callable[[int | None, bytes], bytes | None] = lower_cased) -> DataFrame:
    """(g, doc_id, leaf, other): digests as 32 bytes; g is the language (``0``, or ``1`` and its name), other the leaf of what ``tamper`` makes of the text, null where it is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, off in C.slices(batches):
            ids, source, lang, chars, text = (batch.column(i) for i in range(5))
            there = text.is_valid().to_pylist()
            view = memoryview(data)
            out = []
            for i, (d, s, g, n) in enumerate(zip(ids.to_pylist(), source.to_pylist(), lang.to_pylist(), chars.to_pylist(), strict=True)):
                head = hashlib.sha256(b"".join([_field(_number(d)), _field(_utf8(s)), _field(_utf8(g)), _field(_number(n))]))
                whole = bytes(view[off[i] : off[i + 1]]) if there[i] else None
                changed = None if whole is None else tamper(d, whole)  # a null text stays
                second = head.copy()
                head.update(_field(whole))
                second.update(_field(changed))
                out.append(("0" if g is None else "1" + g, head.digest(), None if changed is None else second.digest()))
            g, leaf, other = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), ids, pa.array(leaf, pa.binary()), pa.array(other, pa.binary())], ["g", "doc_id", "leaf", "other"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    return own.mapInArrow(C.lean(run), "g string, doc_id long, leaf binary, other binary")


# --------------------------------------------------------------------- ranks


def _before(counts: DataFrame, within: list[str], order: str | list[str]) -> DataFrame:
    """``counts`` with start: the sum of n over the siblings that stand before."""
    w = Window.partitionBy(*within).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))


def bucket_starts(counts: DataFrame) -> DataFrame:
    """(g, b, n, start) for counts (g, b, n) of buckets: the rows of g in the buckets before b, by histograms of ever shorter prefixes of b."""
    levels, bits = [counts], 64 - LAST
    while bits > DIGIT:
        bits -= DIGIT
        levels.append(levels[-1].groupBy("g", F.shiftright("b", DIGIT).alias("b")).agg(F.sum("n").alias("n")))
    starts = _before(levels.pop(), ["g"], "b")
    while levels:
        up = starts.select("g", F.col("b").alias("up"), F.col("start").alias("above"))
        here = _before(levels.pop().withColumn("up", F.shiftright("b", DIGIT)), ["g", "up"], "b")
        starts = here.join(up, ["g", "up"]).select("g", "b", "n", (F.col("start") + F.col("above")).alias("start"))
    return starts


def ranks(rows: DataFrame, *, most: int = MOST) -> DataFrame:
    """``rows`` (g, doc_id, leaf, ...) with idx, the rank in g by (doc_id, leaf) from 0, and size, the rows of g."""
    put = rows.withColumn("b", F.shiftright(F.coalesce("doc_id", F.lit(-(1 << 63))), LAST))
    counts = materialize(put.groupBy("g", "b").agg(F.count("*").alias("n")), "histogram")
    starts = bucket_starts(counts).join(counts.groupBy("g").agg(F.sum("n").alias("size")), "g")
    place = lambda *by: F.row_number().over(Window.partitionBy("g", *by).orderBy("doc_id", "leaf")) - 1 + F.col("start")
    kept = [*rows.columns, "size"]
    large = counts.where(F.col("n") > most)
    if large.isEmpty():
        return put.join(starts.drop("n"), ["g", "b"]).withColumn("idx", place("b")).select(*kept, "idx")
    met = put.join(starts, ["g", "b"])
    small = met.where(F.col("n") <= most).withColumn("idx", place("b")).select(*kept, "idx")
    rest = met.where(F.col("n") > most).withColumn("t", F.substring("leaf", 1, 2)).withColumnRenamed("start", "base")
    rest = rest.withColumn("id", F.struct("doc_id", "t"))  # also where doc_id is null
    inner = _before(rest.groupBy("g", "b", "id").agg(F.count("*").alias("n")), ["g", "b"], "id").drop("n")
    rest = rest.join(inner, ["g", "b", "id"]).withColumn("start", F.col("base") + F.col("start"))
    return small.unionByName(rest.withColumn("idx", place("b", "id")).select(*kept, "idx"))


# ---------------------------------------------------------------------- trie


def _levels(size: Column) -> Column:
    """How often ``size`` nodes are reduced until one is left."""
    powers = F.array(*[F.lit(FANOUT**k).cast("decimal(20,0)") for k in range(21)])
    return F.size(F.filter(powers, lambda p: p < size))


def _reduced(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """Nodes of each level, from ``nodes`` up over ``levels`` levels."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([_hex(b"".join(last[i : i + FANOUT])) for i in range(0, len(last), FANOUT)])
    return out


def _group(t: pa.Table, done: int) -> tuple[pa.Table, list[list[bytes]]]:
    """(a group's rows by idx, its nodes of each level)."""
    t = t.sort_by("idx")
    return t, _reduced([x.hex().encode() for x in t.column("leaf").to_pylist()], max(0, min(DEPTH, t.column("levels")[0].as_py() - done)))


def tops(nodes: DataFrame, done: int) -> DataFrame:
    """(g, idx, levels, leaf): the nodes (g, idx, levels, leaf) ``DEPTH`` levels up; ``done`` levels lie below them."""

    def reduce(t: pa.Table) -> pa.Table:
        t, levels = _group(t, done)
        return pa.table({"g": [t.column("g")[0].as_py()], "idx": [t.column("block")[0].as_py()], "levels": t.column("levels")[:1].cast(pa.int32()), "leaf": pa.array([bytes.fromhex(levels[-1][0].decode())], pa.binary())})

    return _blocks(nodes.select("g", "idx", "levels", "leaf")).groupBy("g", "block").applyInArrow(reduce, "g string, idx long, levels int, leaf binary")


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("idx") / FANOUT**DEPTH).cast("long"))


def _sides(levels: list[list[bytes]], i: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of node i in its run, at each level of its group."""
    out = []
    for nodes in levels[:-1]:
        o = i % FANOUT
        out.append((b"".join(nodes[i - o : i]), b"".join(nodes[i + 1 : i - o + FANOUT])))
        i //= FANOUT
    return out


_PATH = "path array<struct<left: string, right: string>>, subroot string, root string"


def _above(t: pa.Table) -> tuple[list[tuple[bytes, bytes]], str, str]:
    return [(x["left"].encode(), x["right"].encode()) for x in t.column("path")[0].as_py()], t.column("subroot")[0].as_py(), t.column("root")[0].as_py()


def paths(nodes: DataFrame, done: int, above: DataFrame) -> DataFrame:
    """(g, idx, path, subroot, root) of each node, from those of the groups' tops (g, idx, ...)."""

    def down(t: pa.Table, up: pa.Table) -> pa.Table:
        t, levels = _group(t, done)
        rest, subroot, root = _above(up)
        way = [[{"left": a.decode(), "right": b.decode()} for a, b in _sides(levels, i) + rest] for i in range(t.num_rows)]
        return pa.table({"g": t.column("g"), "idx": t.column("idx"), "path": pa.array(way, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))), "subroot": [subroot] * t.num_rows, "root": [root] * t.num_rows})

    own = _blocks(nodes.select("g", "idx", "levels", "leaf")).groupBy("g", "block")
    return own.cogroup(above.groupBy("g", "idx")).applyInArrow(down, f"g string, idx long, {_PATH}")


def proofs(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """A row a leaf: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; the fold starts from ``other`` where it is not null."""

    def prove(t: pa.Table, up: pa.Table) -> pa.Table:
        t, levels = _group(t, 0)
        rest, subroot, root = _above(up)
        tail, out = b"".join(a + b for a, b in rest), []
        for i, other in enumerate(t.column("other").to_pylist()):
            sides, proof = _sides(levels, i), hashlib.sha256()
            now = levels[0][i] if other is None else other.hex().encode()
            for a, b in sides:
                proof.update(a + b)
                now = _hex(a + now + b)
            proof.update(tail)
            for a, b in rest:
                now = _hex(a + now + b)
            out.append((proof.hexdigest(), now.decode()))
        proof, folded = zip(*out, strict=True)
        n = t.num_rows
        return pa.table({"doc_id": t.column("doc_id"), "leaf": [x.decode() for x in levels[0]], "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proof, "folded_root": folded, "verified": [x == root for x in folded]})

    own = _blocks(nodes).groupBy("g", "block")
    return own.cogroup(above.groupBy("g", "idx")).applyInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _climb(nodes: DataFrame, label: str) -> list[DataFrame]:
    """Tables of nodes (g, idx, levels, leaf), a round of ``DEPTH`` levels each, up to one node a g."""
    out, deepest = [nodes], nodes.agg(F.max("levels")).first()[0] or 0
    for done in range(0, max(deepest, 1), DEPTH):
        out.append(materialize(tops(out[-1], done), f"{label}-{done}"))
    return out


def manifest(docs: DataFrame, *, tamper: Callable[[int | None, bytes], bytes | None] = lower_cased) -> DataFrame:
    """Every row's leaf, its proof and what the proof says of the row as ``tamper`` left it; see ``proofs``."""
    hashed = materialize(leaves(docs, tamper=tamper), "leaves")
    ranked = ranks(hashed)
    trie = _climb(materialize(ranked.withColumn("levels", _levels(F.col("size"))).drop("size"), "ranked"), "trie")
    C.discard(hashed)
    subroots = trie[-1].select("g", "leaf")
    langs = subroots.select(F.lit("").alias("g"), F.col("g").alias("lang"), "leaf", (F.row_number().over(Window.orderBy("g")) - 1).cast("long").alias("idx"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("size"))
    langs = materialize(langs.withColumn("levels", _levels(F.col("size"))).drop("size"), "languages")
    crown = _climb(langs, "crown")
    above = crown[-1].select("g", "idx", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.lit("").alias("subroot"), F.lower(F.hex("leaf")).alias("root"))
    for i in reversed(range(len(crown) - 1)):
        above = paths(crown[i], i * DEPTH, above)
    above = above.join(langs.select("idx", "lang", "leaf"), "idx").select(F.col("lang").alias("g"), F.lit(0).cast("long").alias("idx"), "path", F.lower(F.hex("leaf")).alias("subroot"), "root")
    for i in reversed(range(1, len(trie) - 1)):
        above = paths(trie[i], i * DEPTH, above)
    return proofs(trie[0], materialize(above, "paths"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(C.documents(spark, sf_dir))


def _oracle(levels: int = 7) -> str:
    """SQL for trees of up to FANOUT**levels leaves a language and FANOUT**2 languages."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""
WITH RECURSIVE crc AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, s, i + 1, xor(x >> 1, (x & 1) * 3988292384) FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(s, i // 8 + 1, 1))) ELSE c END AS x FROM crc WHERE i < 8 * length(s))
), hit AS (
  SELECT doc_id FROM crc WHERE i = 8 * length(s) AND xor(c, 4294967295) % 3 = 0
), d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, {leaf("text")} AS h, CASE WHEN doc_id IN (SELECT doc_id FROM hit) THEN {leaf(low)} END AS o FROM documents
), t0 AS (
  SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n, h, doc_id, o FROM d
)"""

    def climb(t: str, n: int) -> str:
        out = ""
        for k in range(n):
            out += f""", {t}r{k} AS (
  SELECT g, idx // 8 AS run, any_value(n) AS n, list(h ORDER BY idx) AS hs FROM {t}{k} GROUP BY g, idx // 8
), {t}{k + 1} AS (
  SELECT g, run AS idx, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {t}r{k}
)"""
        return out

    def fold(name: str, start: str, t: str, n: int, extra: str) -> str:
        out = f", {name}0 AS ({start})"
        for k in range(n):
            left, right = (f"CASE WHEN r.n > 1 THEN array_to_string({x}, '') ELSE '' END" for x in ("r.hs[1:f.idx % 8]", "r.hs[f.idx % 8 + 2:]"))
            out += f""", {name}{k + 1} AS (
  SELECT {extra}, f.g, f.idx // 8 AS idx, f.proof || {left} || {right} AS proof, CASE WHEN r.n > 1 THEN sha256({left} || f.now || {right}) ELSE f.now END AS now
  FROM {name}{k} f JOIN {t}r{k} r ON f.g = r.g AND f.idx // 8 = r.run
)"""
        return out

    sql += climb("t", levels)
    sql += f", c0 AS (SELECT '' AS g, g AS lang, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n, h FROM t{levels})" + climb("c", 2)
    sql += fold("f", "SELECT doc_id, h AS leaf, g AS lang, g, idx, '' AS proof, coalesce(o, h) AS now FROM t0", "t", levels, "f.doc_id, f.leaf, f.lang")
    sql += fold("e", f"SELECT f.doc_id, f.leaf, c0.h AS subroot, c0.g, c0.idx, f.proof, f.now FROM f{levels} f JOIN c0 ON f.lang = c0.lang", "c", 2, "f.doc_id, f.leaf, f.subroot")
    return sql + """
SELECT doc_id, leaf, subroot, (SELECT h FROM c2) AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = (SELECT h FROM c2) AS verified FROM e2
"""


ORACLE = _oracle()
