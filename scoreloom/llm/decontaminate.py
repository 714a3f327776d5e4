"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Words are maximal runs of ASCII letters and digits or other non-ASCII
characters, with A-Z lower-cased. An item's windows are its runs of 10 words
(fewer words: one window of all). A document holds a window if the same words
stand in it one after another; containment is 1, so the prefix of a window is
one shingle, and the rarest does.

1. Windows are cut into three-word shingles (shorter windows: one shingle of all
   their words). One pass over the documents finds the positions of any of them.
2. Those positions give each shingle's count over all documents. A window's
   necessary prefix token is its rarest shingle.
3. Positions of prefix tokens place candidate windows; a candidate that would
   begin before the document's first word or end behind its last is dropped
   (positional and length bounds); the others are verified shingle by shingle:
   all must stand at their places. Shingles are compared by 64-bit hashes: a window of one
   shingle meets other words at a place with a chance of 2**-64, a longer one needs that of each.

The benchmark side is broadcast while it has at most ``broadcast_rows`` shingles,
and joined by shuffle beyond. Null or empty texts have no words: n_words and
n_hit are 0. Rows that repeat (doc_id, text) get one result each. Items without
words match nothing; repeated items with one item_id count once.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, SHINGLE = 10, 3
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: str | Column) -> Column:
    """Words of a text; lower() serves plain ASCII, where it equals the A-Z rule."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, BREAK), "")


def _hash_at(words: Column, i: Column, k: int) -> Column:
    """Hash of the k words from the 0-based place i."""
    return F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)])


def _hashes(words: Column, count: Column, k: int, wrap=lambda i, h: h) -> Column:
    """wrap(place, hash) for each of the first ``count`` places."""
    return F.transform(_places(count), lambda i: wrap(i, _hash_at(words, i, k)))


def _places(n: Column) -> Column:
    """0 .. n - 1; empty if n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Distinct windows: (window, len, k, hashes, items); hashes in order, k words each."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), word_array("text").alias("w")).where("size(w) > 0")
    w = w.withColumn("len", F.least(F.size("w"), F.lit(window)))
    w = w.select("item_id", "len", "w", F.explode(_places(F.size("w") - F.col("len") + 1)).alias("s"))
    w = w.select("item_id", "len", F.slice("w", F.col("s") + 1, F.col("len")).alias("words")).withColumn("k", F.least("len", F.lit(shingle)))
    sized = [F.when(F.col("k") == k, _hashes(F.col("words"), F.col("len") - k + 1, k)) for k in range(1, shingle + 1)]
    w = w.withColumn("hashes", F.coalesce(*sized))
    return w.groupBy("words").agg(F.first("len").alias("len"), F.first("k").alias("k"), F.first("hashes").alias("hashes"), F.array_sort(F.collect_set("item_id")).alias("items")).select(F.monotonically_increasing_id().alias("window"), "len", "k", "hashes", "items")


def matches(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, shingle: int = SHINGLE, broadcast_rows: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): (doc_id, th, copies, n_words), and (doc_id, th, start, len, items) for each window a document holds."""
    win = C.materialize(windows(items, window, shingle), "windows")
    tokens = win.select(F.explode("hashes").alias("h"), "k").distinct()
    kinds = [r.k for r in win.select("k").distinct().collect()]  # at most ``shingle`` numbers
    small = tokens.count() <= broadcast_rows

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    d = docs.select("doc_id", F.xxhash64("text").alias("th"), word_array("text").alias("w"))
    # place -1 stands for the document itself, so that one pass also gives its words
    own = F.array(F.struct(F.lit(-1).alias("p"), F.size("w").cast("long").alias("h")))
    found = [_hashes(F.col("w"), F.size("w") - k + 1, k, lambda i, h: F.struct(i.alias("p"), h.alias("h"))) for k in sorted(kinds)]
    d = d.select("doc_id", "th", F.explode(F.concat(own, *found)).alias("x")).select("doc_id", "th", "x.p", "x.h")
    known = tokens.select(F.col("h").alias("known")).distinct()
    seen = d.join(side(known), (F.col("h") == F.col("known")) & (F.col("p") >= 0), "left").where("p < 0 or known is not null").drop("known")
    seen = C.materialize(seen, "seen")
    whole = seen.where("p < 0").groupBy("doc_id", "th").agg(F.count("*").alias("copies"), F.first("h").alias("n_words"))
    at = seen.where("p >= 0")
    rarity = at.groupBy("h").agg(F.count("*").alias("seen"))
    listed = win.select("window", "len", F.posexplode("hashes").alias("off", "h"))
    prefix = listed.join(rarity, "h", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "off", "len")).alias("x"))
    # a window with a shingle that no document holds is held by none
    prefix = prefix.where("x.seen > 0").select("window", "x.h", "x.off", "x.len")
    cand = at.join(side(prefix), "h").where("p >= off").select("doc_id", "th", (F.col("p") - F.col("off")).alias("start"), "window", "len")
    need = win.select("window", F.posexplode("hashes").alias("off", "h"))
    asked = cand.distinct().join(side(need), "window").select("doc_id", "th", "start", "window", "len", (F.col("start") + F.col("off")).alias("p"), "h")
    got = asked.join(at.distinct(), [asked.doc_id.eqNullSafe(at.doc_id), asked.th == at.th, asked.p == at.p, asked.h == at.h], "left_semi")
    held = got.groupBy("doc_id", "th", "start", "window", "len").agg(F.count("*").alias("n"))
    hits = held.join(side(win.select("window", F.size("hashes").alias("all"), "items")), "window").where("n = all")
    return whole, hits.select("doc_id", "th", "start", "len", "items")


def contamination(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and th, the hash of its text."""
    whole, hits = matches(docs, items, **kw)
    per = hits.groupBy("doc_id", "th").agg(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    cover = F.aggregate("spans", start, lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).cast("long").alias("n"), F.greatest(s["end"], a["upto"]).alias("upto")))
    per = per.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), cover["n"].alias("n_hit"), "items")
    out = whole.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """Documents that hold no benchmark window."""
    _, hits = matches(docs, items, **kw)
    gone = hits.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct()
    return C.rows_of(docs).join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_anti").select(*C.columns_of(docs))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("th")
