"""Quality rules with adaptive thresholds per language and source.

Base rules are fixed: at least 50 words, and at most half of the words in
repeated three-word windows. All other limits adapt: each group (lang, source)
keeps a mergeable quantile sketch per metric, a histogram over logarithmic
buckets with relative error ``ERROR``, as plain rows (group, metric, bucket,
count). Counts add, so sketches of partitions, sources and languages merge
exactly and any partitioning gives the same thresholds.

A metric is a count over a size (symbols over words, for one). Of its sketch come
the median and an outer quantile, and

    limit = q50 + reach * (outer - q50)

A group's quantiles are weighed against its language's by its number of documents,
a language's against those of all documents likewise (``PRIOR`` documents' worth), so
small groups shrink towards their language without a switch. A document's count then
may lie three standard deviations of such a count, and ``events`` more, beyond

    size * limit + 3 * sqrt(size * limit) + events

which lets short documents vary as much as short documents do. Word length has a
lower limit as well, mirrored.

Documents join their group's limits. Null or empty text has no words and
fails the base rules. Null lang or source is a group of its own. Repeated rows each
get a result; the filter keeps all columns, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from . import common as C
from .common import U64

MIN_WORDS, MAX_REPEAT, PRIOR, ERROR = 50, 50, 100, 0.01
#: metric: (count, size, outer quantile, reach, events, whether it has a lower limit). Repeats come in bursts and most
#: documents have none, so their outer quantile lies in the tail.
METRICS = {
    "word_length": ("word_chars", "n_words", 0.75, 4, 0, True), "symbols": ("n_symbols", "n_words", 0.75, 4, 3, False), "capitals": ("n_capitals", "word_chars", 0.75, 4, 3, False),
    "repeats": ("n_repeat_words", "n_words", 0.99, 2, 6, False), "line_repeats": ("n_dup_lines", "n_lines", 0.99, 2, 2, False),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
SYMBOL = np.zeros(256, np.int64)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def base_counts(data: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """The counts in BASE for each text."""
    rows = len(off) - 1

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[off[1:]] - total[off[:-1]]

    starts, ends, at = C.words(data, off)
    n_words = np.diff(at)
    inside = ~C.SPACE[data] & (data & 0xC0 != 0x80)
    # lines with a word: spans between line feeds that hold a word's start
    feed = data == 10
    cut = np.unique(np.concatenate([off[:-1], np.flatnonzero(feed) + 1]))
    cut = cut[cut < len(data)]
    nxt = np.r_[cut[1:], len(data)]
    stop = nxt - ((nxt > cut) & feed[np.minimum(nxt, len(data)) - 1]) if len(cut) else nxt
    row = np.searchsorted(off, cut, "right") - 1
    has = np.searchsorted(starts, stop) > np.searchsorted(starts, cut)
    cut, stop, row = cut[has], stop[has], row[has]
    n_lines = np.bincount(row, minlength=rows)
    key = C.mix(C.span_hash(data, cut, stop) ^ C.mix(row.astype(U64) + U64(1)))
    _, first = np.unique(key, return_index=True)
    n_dup = n_lines - np.bincount(row[first], minlength=rows)
    # three-word windows found twice
    h = C.span_hash(data, starts, ends)
    n = len(h)
    repeat = np.zeros(rows, np.int64)
    if n >= 3:
        word_row = np.repeat(np.arange(rows), n_words)
        w = C.mix(h[:-2] * U64(3) ^ C.mix(h[1:-1] * U64(5) + C.mix(h[2:] + word_row[2:].astype(U64))))
        same = word_row[2:] == word_row[:-2]
        pos = np.flatnonzero(same)
        w = w[pos]
        s = np.sort(w)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if len(twice):
            p = np.searchsorted(twice, w)
            p[p == len(twice)] = 0
            hit = pos[twice[p] == w]
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + 3, -1)
            repeat = np.bincount(word_row[np.cumsum(edge[:-1]) > 0], minlength=rows)
    return {
        "n_words": n_words, "word_chars": per_row(inside), "n_symbols": per_row(SYMBOL[data]), "n_dup_lines": n_dup,
        "n_repeat_words": repeat, "n_lines": n_lines, "n_capitals": per_row((data >= 65) & (data <= 90)),
    }


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of the documents under the names c0, c1, ..., and BASE. A text goes to Python once."""
    cols = [*keep, *([] if "text" in keep else ["text"])]
    text = f"c{cols.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in C.slices(batches, name=text):
            got = base_counts(data, off)
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], *(pa.array(got[k].astype(np.int64)) for k in BASE)], [*rows.schema.names[: len(keep)], *BASE])

    out = StructType()
    for i, k in enumerate(keep):
        out = out.add(f"c{i}", docs.schema[k].dataType)
    for k in BASE:
        out = out.add(k, "long")
    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(C.lean(run), out)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


GROWTH = (1 + ERROR) / (1 - ERROR)


def sketches(counted: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, metric, bucket, n): sketches of the documents that pass the base rules. Bucket -9999 holds zeros."""
    rates = {m: F.col(count) / F.greatest(F.col(size), F.lit(1)) for m, (count, size, *_) in METRICS.items()}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.when(x > 1e-9, F.ceil(F.log(x) / math.log(GROWTH)).cast("int")).otherwise(-9999).alias("bucket")) for m, x in rates.items()]))
    return counted.where(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), each.alias("x")).groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def _wanted(metric: str) -> list[float]:
    _, _, outer, _, _, low = METRICS[metric]
    return [0.5, outer, *([1 - outer] if low else [])]


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Per group: docs, and the quantiles that each metric needs, as columns <metric>_q50 ..."""
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    part = Window.partitionBy(*by, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(part.orderBy("bucket"))).withColumn("all", F.sum("n").over(part))
    value = F.when(F.col("bucket") == -9999, 0.0).otherwise(2 * F.pow(F.lit(GROWTH), F.col("bucket")) / (GROWTH + 1))
    wanted = [F.min(F.when((F.col("metric") == m) & (F.col("upto") >= q * F.col("all")), value)).alias(f"{m}_q{round(100 * q)}") for m in METRICS for q in _wanted(m)]
    return ranked.groupBy(*by).agg(F.max("all").alias("docs"), *wanted)


def limits(counted: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, <metric>_low, <metric>_high) for every group among the documents that pass the base rules."""
    sketch = C.materialize(sketches(counted, lang, source), "sketches")
    fine, by_lang, whole = quantiles(sketch, ["lang", "source"]), quantiles(sketch, ["lang"]), quantiles(sketch.withColumn("everything", F.lit(1)), ["everything"])
    names = [f"{m}_q{round(100 * q)}" for m in METRICS for q in _wanted(m)]
    by_lang = by_lang.select(F.col("lang").alias("l"), F.col("docs").alias("l_docs"), *[F.col(k).alias(f"l_{k}") for k in names])
    whole = whole.select(*[F.col(k).alias(f"w_{k}") for k in names])
    got = fine.join(by_lang, F.col("lang").eqNullSafe(F.col("l"))).join(F.broadcast(whole), F.lit(True))  # one row

    def towards(own: Column, docs: Column, other: Column) -> Column:
        return (docs * own + PRIOR * other) / (docs + PRIOR)

    q = {k: towards(F.col(k), F.col("docs"), towards(F.col(f"l_{k}"), F.col("l_docs"), F.col(f"w_{k}"))) for k in names}
    out = []
    for m, (_, _, outer, reach, _, low) in METRICS.items():
        middle = q[f"{m}_q50"]
        out.append((middle + reach * (q[f"{m}_q{round(100 * outer)}"] - middle)).alias(f"{m}_high"))
        if low:
            out.append(F.greatest(F.lit(0.0), middle - reach * (middle - q[f"{m}_q{round(100 * (1 - outer))}"])).alias(f"{m}_low"))
    return C.materialize(got.select("lang", "source", *out), "limits")


def judged(counted: DataFrame, found: DataFrame, lang: str, source: str, broadcast_groups: int = 100_000) -> DataFrame:
    """``counted`` with base_failed and kept."""
    side = F.broadcast(found) if found.count() <= broadcast_groups else found
    joined = counted.join(side, F.col(lang).eqNullSafe(F.col("lang")) & F.col(source).eqNullSafe(F.col("source")), "left")
    fits = F.lit(True)
    for m, (count, size, _, _, events, low) in METRICS.items():
        count, size = F.col(count), F.greatest(F.col(size), F.lit(1))
        high = size * F.col(f"{m}_high")
        ok = count <= high + 3 * F.sqrt(high) + events
        if low:
            least = size * F.col(f"{m}_low")
            ok &= count >= least - 3 * F.sqrt(least) - events
        fits &= F.coalesce(ok, F.lit(True))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & fits)


def rules(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, kept."""
    counted = C.materialize(with_counts(docs, ["doc_id", "lang", "source"]), "counts")
    got = judged(counted, limits(counted, "c1", "c2"), "c1", "c2")
    return got.select(F.col("c0").alias("doc_id"), *BASE[:5], "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns."""
    found = limits(with_counts(docs, ["lang", "source"]), "c0", "c1")
    lang, source = (f"c{docs.columns.index(c)}" for c in ("lang", "source"))
    got = judged(with_counts(docs, docs.columns), found, lang, source)
    return got.where("kept").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(C.documents(spark, sf_dir))
