"""Batches of two rows of one prompt with a real difference in score, without listing pairs.

A prompt of n rows gives ceil(n / 2) batches. Rows are matched in rounds: the rows that are not yet covered are dealt to
small groups by a seeded hash, and neighbours in the hash's order that differ by more than the gap become a batch of two
new rows. Rounds go on while a prompt holds two rows that differ and rounds find some; what is left meets one of its prompt's
extremes (the rows with the least and the most of a trait): a row that differs from any row differs from one of those.
So the work is that of n rows a round, rounds shrink, and a hot prompt is spread over its groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import discard, materialize

#: Rows of a group in which neighbours are sought; rounds at most.
GROUP, ROUNDS = 512, 24


def _order(seed: int, epoch: int, turn: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(epoch), F.lit(turn), F.col("key"))


def _differ(a: str, b: str, gap: float) -> Column:
    return F.exists(F.zip_with(a, b, lambda x, y: F.abs(x - y) > gap), lambda d: d)


def _matched(open_: DataFrame, sizes: DataFrame, seed: int, epoch: int, turn: int, gap: float) -> DataFrame:
    """(prompt, l, r): neighbours of one round that differ; a row is in one of them at most."""
    h = _order(seed, epoch, turn)
    dealt = open_.join(sizes, "prompt").withColumn("h", h).withColumn("g", F.pmod(F.shiftrightunsigned("h", 8), F.ceil(F.col("n") / GROUP)))
    # rounds take turns: by the hash alone, and by one trait after the other, with the upper half of a group against its lower half
    by = F.col("h") if turn % 4 < 2 else F.get("scores", F.lit(turn // 4 % 3))
    w = Window.partitionBy("prompt", "g")
    ranked = dealt.withColumn("k", F.row_number().over(w.orderBy(by, "h", "key")) - 1).withColumn("m", F.count("*").over(w))
    half = F.ceil(F.col("m") / 2)
    place = F.floor(F.col("k") / 2) if turn % 4 < 2 else F.when(F.col("k") < half, F.col("k")).otherwise(F.col("k") - half)
    two = ranked.withColumn("p", place).groupBy("prompt", "g", "p").agg(F.sort_array(F.collect_list(F.struct("key", "scores"))).alias("x"))
    two = two.where("size(x) = 2").select("prompt", F.get("x", F.lit(0)).alias("l"), F.get("x", F.lit(1)).alias("r"))
    return two.where(_differ("l.scores", "r.scores", gap)).select("prompt", F.col("l.key").alias("l"), F.col("r.key").alias("r"))


def _extremes(rows: DataFrame, traits: int) -> DataFrame:
    """(prompt, ends): for each trait the rows with the least and the most, the smaller key where they tie; ends an array of (key, scores)."""
    x = F.struct("key", "scores")
    ends = [f("__x", F.struct(*by)) for t in range(traits) for f, by in ((F.min_by, [F.get("scores", t).alias("s"), F.col("key")]), (F.min_by, [(-F.get("scores", t)).alias("s"), F.col("key")]))]
    return rows.withColumn("__x", x).groupBy("prompt").agg(F.array(*ends).alias("ends"))


def pair_batches(df: DataFrame, *, prompt: str, key: str, scores: list[str], seed: int = 42, epoch: int = 0, gap: float = 0.0, rounds: int = ROUNDS) -> DataFrame:
    """(batch, prompt, l, r): the batches of an epoch in order of ``batch``, a seeded number; each epoch has other ones.

    ``df``: unique keys, no null scores. Pairs cover as many rows as matching finds: a row stays out only if it differs from no
    other of its prompt by more than ``gap``, or if single rows are more than the batches left. Where all rows are covered by
    fewer batches than ceil(n / 2), further pairs of the first round's kind fill up. A prompt without a pair is an error when rows are read.
    """
    if gap < 0:
        raise ValueError("the gap is not negative")
    rows = materialize(df.select(F.col(prompt).alias("prompt"), F.col(key).alias("key"), F.array(*[F.col(s).cast("double") for s in scores]).alias("scores")), "pair-rows")
    whole = rows.groupBy("prompt").agg(F.count("*").alias("n"))
    spread = [F.max(F.get("scores", t)) - F.min(F.get("scores", t)) > gap for t in range(len(scores))]
    found, open_, last = [], rows, None
    for turn in range(rounds):
        alive = open_.groupBy("prompt").agg(F.count("*").alias("n"), reduce(Column.__or__, spread).alias("more")).where("more").drop("more")
        now = materialize(_matched(open_, alive, seed, epoch, turn, gap), "pairs")
        found.append(now)
        used = now.select(F.explode(F.array("l", "r")).alias("key"))
        rest = materialize(open_.join(used, "key", "left_anti").select("prompt", "key", "scores"), "open-rows")
        if last is not None:
            discard(last)
        open_ = last = rest
        if rest.groupBy("prompt").agg(reduce(Column.__or__, spread).alias("more")).where("more").isEmpty():
            break
    ends = _extremes(rows, len(scores))
    near = F.filter("ends", lambda e: F.exists(F.zip_with(F.col("scores"), e["scores"], lambda x, y: F.abs(x - y) > gap), lambda d: d))
    lone = open_.join(ends, "prompt").withColumn("of", near).where("size(of) > 0")
    mate = F.get("of", F.pmod(_order(seed, epoch, -1), F.greatest(F.size("of"), F.lit(1))).cast("int"))["key"]
    singles = lone.select("prompt", F.least("key", mate).alias("l"), F.greatest("key", mate).alias("r"))
    h = F.xxhash64(F.lit(seed), F.lit(epoch), "l", "r")
    pairs = reduce(DataFrame.unionAll, found).withColumn("class", F.lit(0)).unionAll(singles.distinct().withColumn("class", F.lit(1)))
    # rows that no pair covers leave batches to fill: matchings of all rows in other orders
    more = _matched(rows, whole, seed, epoch, rounds, gap).unionAll(_matched(rows, whole, seed, epoch, rounds + 1, gap)).distinct()
    more = more.join(pairs.select("l", "r"), ["l", "r"], "left_anti").select("prompt", "l", "r", F.lit(2).alias("class"))
    best = _extremes(rows, len(scores)).select("prompt", F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(scores) - 1)), lambda t: F.struct(F.get("ends", 2 * t).alias("a"), F.get("ends", 2 * t + 1).alias("b")))).alias("e")).where(_differ("e.a.scores", "e.b.scores", gap))
    best = best.groupBy("prompt").agg(F.min(F.struct(F.least("e.a.key", "e.b.key").alias("l"), F.greatest("e.a.key", "e.b.key").alias("r"))).alias("e"))
    have = materialize(pairs.unionAll(more).withColumn("h", h), "pair-batches")
    kept = _smallest(have, whole)
    short = whole.join(kept.groupBy("prompt").agg(F.count("*").alias("got")), "prompt", "left").join(best, "prompt", "left")
    short = short.withColumn("lack", F.ceil(F.col("n") / 2) - F.coalesce("got", F.lit(0)))
    none = F.when(F.col("e").isNull(), F.raise_error(F.concat(F.lit("no pair of different scores for prompt "), F.col("prompt"))).cast("boolean")).otherwise(True)
    fill = short.where(none).where("lack > 0").select("prompt", "e.l", "e.r", F.explode(F.sequence(F.lit(1).cast("long"), "lack")).alias("again"))
    got = kept.select("prompt", "l", "r", F.lit(0).cast("long").alias("again")).unionAll(fill)
    return got.select(F.xxhash64(F.lit(seed), F.lit(epoch), "again", "r", "l").alias("batch"), "prompt", "l", "r")


def _smallest(have: DataFrame, whole: DataFrame) -> DataFrame:
    """The ceil(n / 2) first pairs of each prompt by (class, h): class by class, and within the one that is cut by ranges of the hash, so that no prompt is sorted whole."""
    slots = 1024
    cell = have.withColumn("slot", F.floor((F.shiftrightunsigned("h", 32) * slots) / (1 << 32)).cast("int") + F.col("class") * slots)
    before = cell.groupBy("prompt", "slot").agg(F.count("*").alias("c")).withColumn("start", F.coalesce(F.sum("c").over(Window.partitionBy("prompt").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    placed = cell.join(before, ["prompt", "slot"]).withColumn("k", F.row_number().over(Window.partitionBy("prompt", "slot").orderBy("h", "l", "r")) + F.col("start"))
    return placed.join(whole, "prompt").where(F.col("k") <= F.ceil(F.col("n") / 2)).select("prompt", "l", "r")
