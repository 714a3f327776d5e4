r"""How far the sources of a language differ in the terms they use: an audit over deduplicated count columns.

Terms are maximal runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms in at
least ``LEAST`` of its documents (rows). A term's *count column* is its sparse vector of (source, count). Most terms
are rare and share their column with many others, so terms are grouped by identical columns and every pair of
sources is evaluated once per distinct column and multiplied by the number of terms that have it.

1. Tasks count terms per (lang, source) in dictionaries of bounded size; the shuffle sees partial counts alone.
2. One shuffle by (lang, term) builds the columns; those of kept terms are written.
3. Distinct columns with their multiplicity (a counted group, combined before the shuffle) meet the language's
   profile: sources and totals, in blocks of ``BLOCK`` x ``BLOCK`` sources, so a row stays bounded however many
   sources a language has. Matrices of a block are evaluated in whole numbers.
4. Terms are ranked from the distinct columns too. Terms of one column tie, so a column needs no more than its first
   ``TOP`` terms; ranks are taken in shares of a source first, then over the shares' best.

All arithmetic is exact while a source has fewer than 9 * 10**15 term occurrences. Null text, lang and source count as
empty. Repeated rows and repeated ids are documents of their own. Texts without terms, and languages without kept
terms, still give their groups' pairs, with value 0. A language of one source has no pairs. No documents: no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize
from . import common as C

#: A kept term is in so many documents of its language; ranks of terms that are returned.
LEAST, TOP = 3, 200
#: Shares are in parts of a billion.
UNIT = 1_000_000_000
#: Sources in a block of a profile; entries of a dictionary before it is passed on; shares that a source's terms are ranked in.
BLOCK, ENTRIES, SALTS = 128, 200_000, 32

#: Bytes as terms have them: letters lower-cased, all that separates terms a space, the rest as it is.
_FOLD = np.array([i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256)], np.uint8)


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): partial counts; n occurrences in df rows. A (lang, source, term) may come in several rows."""
    own = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in found.items():
                if n:
                    term = pa.array(n.keys(), pa.binary()).cast(pa.string())
                    same = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(n), np.int32)), pa.array([x])).dictionary_decode() for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*same, term, pa.array(n.values(), pa.int64()), pa.array([df[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "df"])
            found.clear()

        for batch, data, off in C.slices(batches):
            plain = _FOLD[data].tobytes()
            for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                terms = plain[off[i] : off[i + 1]].split()
                if group not in found:
                    found[group] = Counter(), Counter()
                n, df = found[group]
                held -= len(n)
                n.update(terms)
                df.update(set(terms))
                held += len(n)
            if held > ENTRIES:
                yield from passed_on()
                held = 0
        yield from passed_on()

    return own.mapInArrow(C.lean(run), "lang string, source string, term string, n long, df long")


def columns(counts: DataFrame, *, least: int = LEAST) -> DataFrame:
    """(lang, term, of, total): the kept terms with their count columns, of = array of (source, n) by source."""
    dealt = counts.repartition("lang", "term")  # both groupings below keep to it
    per = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    whole = per.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("of"), F.sum("n").alias("total"), F.sum("df").alias("df"))
    return whole.where(F.col("df") >= least).drop("df")


def profiles(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, size, lang_size, kept): of each (lang, source) that occurs: occurrences of kept terms there and in the language, terms kept."""
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sizes = terms.select("lang", F.explode("of").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("size"))
    langs = terms.groupBy("lang").agg(F.sum("total").alias("lang_size"), F.count("*").alias("kept"))
    got = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    return got.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("size", "lang_size", "kept")])


def share(n: Column, size: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (size + kept)), exact."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (size + kept).cast("decimal(20,0)"))


def _shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same of whole columns; thrice three digits of a long division, so that nothing leaves 64 bits."""
    rest, out = n + 1, np.zeros_like(n)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def blocks(profile: DataFrame) -> DataFrame:
    """(lang, kept, a, b): pairs of blocks of a language's sources; a and b arrays of (source, size) by source."""
    w = Window.partitionBy("lang").orderBy("source")
    one = profile.select("lang", "kept", F.struct("source", "size").alias("x"), F.floor((F.row_number().over(w) - 1) / BLOCK).alias("k"))
    one = one.groupBy("lang", "kept", "k").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return one.select("lang", "kept", F.col("x").alias("a"), F.col("k").alias("i")).join(one.select("lang", F.col("x").alias("b"), F.col("k").alias("j")), "lang")


def pair_values(distinct: DataFrame, sides: DataFrame) -> DataFrame:
    """(lang, source, item, value): over the distinct columns (lang, of, m), the sum of m * floor((p - q)^2 / q) for every two sources.

    Sums are partial per task; a task holds those of the blocks it meets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], tuple[list, list, np.ndarray]] = {}
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in (0, 5, 6)), strict=True))
            for key in dict.fromkeys(keys):
                part = batch.filter(pa.array([k == key for k in keys]))
                kept, a, b = part.column(3)[0].as_py(), part.column(4)[0].as_py(), part.column(7)[0].as_py()
                if key not in sums:
                    sums[key] = [x["source"] for x in a], [x["source"] for x in b], np.zeros((len(a), len(b)), np.int64)
                total = sums[key][2]
                step = max(1, (1 << 20) // total.size)
                for start in range(0, part.num_rows, step):
                    some = part.slice(start, step)
                    p, q = (_dense(some.column(1), side, kept) for side in (a, b))
                    d = p[:, :, None] - q[:, None, :]
                    total += np.einsum("r,rij->ij", some.column(2).to_numpy(), d * d // q[:, None, :])
        for (lang, *_), (a, b, total) in sums.items():
            x, y = np.divmod(np.arange(total.size), len(b))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * total.size), pa.array(a).take(pa.array(x)), pa.array(b).take(pa.array(y)), pa.array(total.ravel())], ["lang", "source", "item", "value"])

    met = distinct.join(sides, "lang").select("lang", "of", "m", "kept", "a", "i", "j", "b")
    got = met.mapInArrow(C.lean(run), "lang string, source string, item string, value long")
    return got.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _dense(of: pa.ListArray, side: list[dict], kept: int) -> np.ndarray:
    """Shares (column x source of ``side``) of sparse columns; a source that is not in a column has count 0 there."""
    row = np.repeat(np.arange(len(of)), of.value_lengths().to_numpy(zero_copy_only=False))
    flat = of.flatten()
    at = pc.index_in(flat.field("source"), value_set=pa.array([x["source"] for x in side], pa.string()))
    mine = at.is_valid().to_numpy(zero_copy_only=False)
    n = np.zeros((len(of), len(side)), np.int64)
    n[row[mine], at.drop_null().to_numpy()] = flat.field("n").to_numpy()[mine]
    return _shares(n, np.array([x["size"] for x in side], np.int64)[None, :] + kept)


def term_values(terms: DataFrame, profile: DataFrame, *, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): a source's terms that it uses more than its language does, the ``top`` furthest ones."""
    first = terms.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "of", "total").orderBy("term"))).where(F.col("nth") <= top)
    distinct = first.groupBy("lang", "of", "total").agg(F.sort_array(F.collect_list("term")).alias("terms"))  # at most ``top`` each
    each = distinct.select("lang", "total", "terms", F.explode("of").alias("x")).select("lang", "total", "terms", "x.*").join(profile, ["lang", "source"])
    p, q = share(F.col("n"), F.col("size"), F.col("kept")), share(F.col("total"), F.col("lang_size"), F.col("kept"))
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    each = each.select("lang", "source", "terms", p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "terms", value.alias("value"))
    rows = each.select("lang", "source", "value", F.explode("terms").alias("item")).withColumn("salt", F.pmod(F.hash("item"), F.lit(SALTS)))
    order = F.desc("value"), F.asc("item")
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)


def audit(docs: DataFrame, *, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of the module's doc: parts ``pair`` (all other sources) and ``term`` (the ``top`` terms)."""
    terms = materialize(columns(count_terms(docs), least=least), "count-columns")
    profile = materialize(profiles(docs, terms).coalesce(1), "profiles")
    distinct = terms.groupBy("lang", "of").agg(F.count("*").alias("m"))
    sides = materialize(blocks(profile), "sides")  # written, so that Spark knows their size: small ones are broadcast and no language is dealt to one task
    a, b = (profile.select("lang", F.col("source").alias(c)) for c in ("source", "item"))
    pairs = a.join(b, "lang").where("source <> item").join(pair_values(distinct, sides), ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(term_values(terms, profile, top=top).withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(C.documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), size AS (
  SELECT lang, CAST(sum(total) AS HUGEINT) AS nl, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang
), grp AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY w.lang, w.source, w.term
), gs AS (
  SELECT grp.lang, grp.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS ng FROM grp LEFT JOIN c ON grp.lang = c.lang AND grp.source = c.source GROUP BY grp.lang, grp.source
), p AS (
  SELECT gs.lang, gs.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gs.ng + size.v) AS p,
         1 + (1000000000::HUGEINT * (kept.total + 1)) // (size.nl + size.v) AS pl
  FROM gs JOIN kept ON gs.lang = kept.lang JOIN size ON gs.lang = size.lang
  LEFT JOIN c ON c.lang = gs.lang AND c.source = gs.source AND c.term = kept.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pr AS (
  SELECT x.lang, x.source, y.source AS item, coalesce(f.value, 0) AS value
  FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
), t AS (
  SELECT lang, source, term AS item, CAST((p - pl) * (p - pl) // pl AS BIGINT) AS value FROM p WHERE n > 0 AND p > pl
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pr
  UNION ALL
  SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM t
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
