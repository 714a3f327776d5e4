"""TF-IDF over word n-grams in long form: one row per document and term."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grams import Words, tally
from ..functions.numbers import let

#: Characters of a block of whole documents, which one task weighs at once.
BLOCK = 8_000_000
WORD = r"(?U)\b\w\w+\b"


def word_grams(text: Column, low: int = 1, high: int = 2) -> Column:
    """Lower-cased words of two or more characters, as n-grams joined by a space."""

    def grams(w: Column) -> Column:
        parts = []
        for n in range(low, high + 1):
            at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
            parts.append(w if n == 1 else F.transform(at, _gram(w, n)))
        return F.concat(*parts)

    # bound once: a lambda would split the text again for every n-gram
    return let(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), grams)


def char_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of the lower-cased text, white space runs as one space."""
    t = F.regexp_replace(F.lower(text), r"(?U)\s\s+", " ")
    parts = []
    for n in range(low, high + 1):
        at = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(at, _piece(t, n)))
    return F.concat(*parts)


def _gram(w: Column, n: int):
    return lambda i: F.array_join(F.slice(w, i, n), " ")


def _piece(t: Column, n: int):
    return lambda i: F.substr(t, i, F.lit(n))


def counts(df: DataFrame, key: str, grams: Column) -> DataFrame:
    """(key, term, n)."""
    return df.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def vocabulary(counted: DataFrame, *, min_df: int = 1, cap: int | None = None) -> DataFrame:
    """(term, df, tf): terms in ``min_df`` documents or more; ``cap`` keeps the most frequent, ties by term."""
    v = counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf")).where(F.col("df") >= min_df)
    return v if cap is None else v.orderBy(F.desc("tf"), "term").limit(cap)


def tfidf(counted: DataFrame, vocab: DataFrame, documents: Column, key: str) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1), each document scaled to length one."""
    w = counted.join(vocab.select("term", "df"), "term").withColumn("weight", (1 + F.log("n")) * (F.log((1 + documents) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("__norm"))
    return w.join(norm, key).select(key, "term", (F.col("weight") / F.col("__norm")).alias("weight"))


def document_weights(df: DataFrame, key: str, text: str = "text", *, low: int = 1, high: int = 2, block: int = BLOCK) -> DataFrame:
    """(key, term, weight) as by ``tfidf`` over word n-grams of whole texts, all terms kept; rows of equal keys are one document's.

    Documents are dealt into blocks by key. A block sends its distinct terms, compressed, to the tasks that add up
    document frequencies, and these answer with numbers in the block's order alone, so no row per document and term is shuffled.
    """
    d = df.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = dict(d.dtypes)["__key"]
    size = d.agg(F.count("*").alias("n"), F.sum(F.length("__text")).alias("chars")).first()
    rows, blocks = size.n, int((size.chars or 0) // block + 1)
    d = d.withColumn("__block", F.pmod(F.xxhash64("__key"), F.lit(blocks)).cast("int"))

    def ask(t: pa.Table) -> pa.Table:
        b = _Block(t, low, high, blocks)
        parts = [(i, j) for i, j in zip(b.edges[:-1], b.edges[1:], strict=True) if j > i]
        terms = ["\n".join(b.terms[i:j].to_pylist()).encode() for i, j in parts]
        return pa.table({
            "bucket": pa.array([int(b.bucket[i]) for i, _ in parts], pa.int32()), "block": pa.array([t.column("__block")[0].as_py()] * len(parts), pa.int32()), "size": pa.array(map(len, terms), pa.int64()), "n": pa.array([int(j - i) for i, j in parts], pa.int64()),
            "terms": pa.array([_squeezed(x) for x in terms], pa.binary()), "df": pa.array([_squeezed(b.df[i:j].tobytes()) for i, j in parts], pa.binary()),
        })

    def answer(t: pa.Table) -> pa.Table:
        terms, own = [], []
        for size, n, x, f in zip(*(t.column(c).to_pylist() for c in ("size", "n", "terms", "df")), strict=True):
            terms += _spread(x, size).decode().split("\n")
            own.append(np.frombuffer(_spread(f, 8 * n), np.int64))
        place = np.asarray(pa.array(terms, pa.large_string()).dictionary_encode().indices)
        whole = np.zeros(int(place.max()) + 1, np.int64)
        np.add.at(whole, place, np.concatenate(own))
        ends = np.cumsum(t.column("n").to_numpy())
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "n": t.column("n"), "df": pa.array([_squeezed(whole[place[j - n : j]].tobytes()) for j, n in zip(ends, t.column("n").to_numpy(), strict=True)], pa.binary())})

    def weigh(t: pa.Table, got: pa.Table) -> pa.Table:
        b = _Block(t, low, high, blocks)
        got = got.sort_by("bucket")
        whole = [np.frombuffer(_spread(x, 8 * n), np.int64) for n, x in zip(got.column("n").to_pylist(), got.column("df").to_pylist(), strict=True)]
        idf = np.log((1 + rows) / (1 + np.concatenate([*whole, np.zeros(0, np.int64)]))) + 1
        w = (1 + np.log(b.n)) * idf[b.term]
        w /= np.sqrt(np.bincount(b.owner, w * w, len(b.keys)))[b.owner]
        return pa.table({"key": b.keys.take(pa.array(b.owner)), "term": b.terms.take(pa.array(b.term)).cast(pa.string()), "weight": pa.array(w)})

    asked = d.groupBy("__block").applyInArrow(ask, "bucket int, block int, size long, n long, terms binary, df binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, n long, df binary")
    return d.groupBy("__block").cogroup(answers.groupBy("block")).applyInArrow(weigh, f"key {kind}, term string, weight double").withColumnRenamed("key", key)


class _Block:
    """Counts of a block of documents, in an order that the set of its texts fixes: distinct terms by bucket, then n and words; (term, owner, n) per document and term."""

    def __init__(self, t: pa.Table, low: int, high: int, buckets: int) -> None:
        t = t.combine_chunks()
        words = Words(t.column("__text").to_pylist())
        order = np.argsort(np.array(words.known.to_pylist(), object))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words.ids, words.known = place[words.ids], words.known.take(pa.array(order))
        of_word = np.array([zlib.crc32(w.encode()) for w in words.known.to_pylist()], np.uint64)
        keys = t.column("__key").dictionary_encode("encode").combine_chunks()
        self.keys, of_text = keys.dictionary, np.asarray(keys.indices, np.int64)
        terms, bucket, term, owner, count, so_far = [], [], [], [], [], 0
        for n in range(low, high + 1):
            got = tally(words.ids, words.owner, n)
            h = np.zeros(len(got.grams), np.uint64)
            for g in got.grams.T:
                h = h * np.uint64(0x9E3779B97F4A7C15) + of_word[g]
            terms.append(words.terms(got.grams))
            bucket.append(((h ^ h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
            term.append(got.term + so_far)
            owner.append(of_text[got.owner])
            count.append(got.n)
            so_far += len(got.grams)
        bucket, term, owner, count = map(np.concatenate, (bucket, term, owner, count))
        by = np.argsort(bucket, kind="stable")
        back = np.empty(so_far, np.int64)
        back[by] = np.arange(so_far)
        self.terms, self.bucket, self.term, self.owner, self.n = pa.concat_arrays(terms).take(pa.array(by)), bucket[by], back[term], owner, count
        if len(self.keys) < len(of_text):  # texts of one key
            both, at = np.unique(self.term * len(self.keys) + owner, return_inverse=True)
            self.term, self.owner, self.n = both // len(self.keys), both % len(self.keys), np.bincount(at, count, len(both)).astype(np.int64)
        self.df = np.bincount(self.term, minlength=so_far).astype(np.int64)
        self.edges = np.searchsorted(self.bucket, np.arange(buckets + 1))


def _squeezed(x: bytes) -> bytes:
    return pa.Codec("zstd").compress(x, asbytes=True)


def _spread(x: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(x, size, asbytes=True)
