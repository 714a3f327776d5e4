"""Fold assignment, hold-out splits and balanced samples: deterministic and independent of row order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import blake2b_hex, keyed_blake2b, sha_parts


def score_bands(df: DataFrame, score: str, bins: int, out: str = "band") -> DataFrame:
    """Number of interior quantile cut points (linear) at or below the score."""
    if bins == 1:
        return df.withColumn(out, F.lit(0))
    cuts = df.agg(F.percentile(score, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("__cuts"))
    return df.join(F.broadcast(cuts)).withColumn(out, F.size(F.filter("__cuts", lambda c: c <= F.col(score)))).drop("__cuts")


def stratified_folds(df: DataFrame, key: str = "id", strata: tuple[str, ...] = ("prompt_num", "cohort", "band"), *, folds: int = 5, seed: int = 42) -> DataFrame:
    """(key, fold): greedy, balanced within strata and overall.

    Dealing a stratum's members one by one to the fold with the fewest of the
    stratum, then the smallest fold, then the smallest hash, visits the folds in the
    same order round after round. So a stratum needs one permutation, which depends
    on the fold sizes before it alone; rows take their fold by their rank in the
    stratum. Only strata (not rows) pass through one task.
    """
    rows = df.select(key, *strata, keyed_blake2b(F.lit(seed), F.col(key)).alias("__h"))
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("__n")).withColumn("__one", F.lit(1))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [repr(tuple(x.item() if hasattr(x, "item") else x for x in row)) for row in pdf[list(strata)].itertuples(index=False, name=None)]
        pdf = pdf.assign(__name=names)
        pdf["__key"] = [blake2b_hex(seed, n) for n in names]
        pdf = pdf.sort_values(["__n", "__key"], ascending=[False, True])
        total, orders = [0] * folds, []
        for name, n in zip(pdf["__name"], pdf["__n"], strict=True):
            order = sorted(range(folds), key=lambda f: (total[f], blake2b_hex(seed, f"{name}\0{f}")))
            for i, f in enumerate(order):
                total[f] += n // folds + (i < n % folds)
            orders.append(order)
        pdf["order"] = orders
        return pdf[[*strata, "order"]]

    kinds = ", ".join(f"{s} {dict(rows.dtypes)[s]}" for s in strata)
    orders = sizes.groupBy("__one").applyInPandas(deal, f"{kinds}, order array<int>")
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("__h", key)) - 1
    return rows.withColumn("__r", rank).join(orders, list(strata)).select(key, F.get("order", F.col("__r") % folds).alias("fold"))


def validate_folds(folds: DataFrame, key: str, k: int) -> DataFrame:
    """One row: rows, distinct ids, folds outside 0..k-1, folds without rows; all right if rows = ids and the rest 0."""
    return folds.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("ids"), F.count_if(~F.col("fold").between(0, k - 1)).alias("outside"), (F.lit(k) - F.count_distinct(F.when(F.col("fold").between(0, k - 1), F.col("fold")))).alias("empty"))


def lopo_folds(df: DataFrame, key: str = "id", prompt: str = "prompt_num") -> DataFrame:
    """Leave one prompt out: the fold is the prompt's place in code-point order. Only distinct prompts are ranked."""
    ranks = df.select(prompt).distinct().withColumn("fold", F.dense_rank().over(Window.orderBy(prompt)) - 1)
    return df.select(key, prompt).join(ranks, prompt).select(key, prompt, "fold")


def holdout(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """Adds ``validation``: the round(n * fraction) rows (at least one) of the smallest sha256 of the key; half to even."""
    h = df.withColumn("__h", F.sha2(F.col(key).cast("string"), 256))
    n = h.agg(F.greatest(F.lit(1), F.rint(F.count("*") * fraction)).cast("long").alias("__want"))
    # two levels: hash prefixes are counted and ranked, rows only within the prefix at the edge
    p = h.withColumn("__p", F.substring("__h", 1, 4))
    counts = p.groupBy("__p").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__p", before.alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__p").orderBy("__h", key))
    return p.withColumn("__i", inner).join(counts, "__p").join(F.broadcast(n)).withColumn("validation", F.col("__before") + F.col("__i") <= F.col("__want")).drop("__h", "__p", "__i", "__before", "__want")


def balanced_sample(df: DataFrame, size: int, *, seed: int, key: str = "id", groups: tuple[str, ...] = ("prompt_num", "band"), sep: str = "\0") -> DataFrame:
    """Round-robin over groups: each group's rows by hash, groups by hash within a round; adds review_id in that order."""
    s = F.lit(str(seed))
    own = sha_parts(s, F.col(key).cast("string"), sep=sep)
    turn = sha_parts(s, *[F.col(g).cast("string") for g in groups], sep=sep)
    picked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*groups).orderBy(own, key))).withColumn("__t", turn).orderBy("__rn", "__t", key).limit(size)
    at = F.row_number().over(Window.orderBy("__rn", "__t", key))
    return picked.withColumn("review_id", F.format_string("R%04d", at)).drop("__rn", "__t")


def group_batches(df: DataFrame, size: int, *, group: str = "prompt_num", order: Column, tail: int = 2) -> DataFrame:
    """Adds ``batch`` within each group: consecutive rows by ``order``; a last batch under ``tail`` rows joins the one before."""
    w = Window.partitionBy(group)
    rank = F.row_number().over(w.orderBy(order)) - 1
    n = F.count("*").over(w)
    raw = F.floor(rank / size)
    last = F.floor((n - 1) / size)
    short = (n - last * size < tail) & (last > 0)
    return df.withColumn("batch", F.when(short & (raw == last), last - 1).otherwise(raw).cast("int"))
