"""Prompt-aware nearest neighbours over embeddings.

Queries and bank rows meet in blocks of a prompt: a unit of work multiplies one
block of queries with one block of the bank and returns each query's best k, so no
pair is ever a row, and a hot prompt spreads over many units. The best of all units
then merge by rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import TRAITS

K, TEMPERATURE, BLOCK = 8, 0.07, 4096


def _units(queries: DataFrame, bank: DataFrame, block: int) -> DataFrame:
    """Rows of both sides, copied to the units (group, query block, bank block) that need them."""
    def cuts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    both = cuts(queries, "nq").join(cuts(bank, "nb"), "grp")
    q = queries.join(both, "grp").withColumn("qb", F.pmod(F.xxhash64("id"), F.col("nq"))).withColumn("bb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb").cast("long") - 1)))
    b = bank.join(both, "grp").withColumn("bb", F.pmod(F.xxhash64("id"), F.col("nb"))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nq").cast("long") - 1)))
    cols = ["grp", "qb", "bb", "id", "fold", "embedding"]
    none = F.lit(None).cast("array<double>")
    return q.select(*cols, none.alias("scores"), F.lit(True).alias("query")).unionByName(b.select(*cols, "scores", F.lit(False).alias("query")))


def _first(sim: np.ndarray, k: int) -> np.ndarray:
    """Each row's k largest finite entries; of equal ones the earlier, so copies of a vector give no more than k."""
    keep = np.isfinite(sim)
    if sim.shape[1] <= k:
        return keep
    least = np.partition(sim, -k, axis=1)[:, -k, None]
    keep &= sim >= least
    for i in np.flatnonzero(keep.sum(1) > k):
        above = sim[i] > least[i]
        tied = np.flatnonzero(keep[i] & ~above)
        keep[i, tied[k - int(above.sum()) :]] = False
    return keep


def knn(queries: DataFrame, bank: DataFrame, *, k: int = K, temperature: float = TEMPERATURE, block: int = BLOCK, unknown: str = "global", other_folds: bool = False) -> DataFrame:
    """Per query: id, pred (array of traits), mean_distance, variance, fallback, neighbours.

    ``queries``: id, prompt_hash, embedding, fold; ``bank``: also scores (array of traits).
    A query never meets itself, nor, with ``other_folds``, its own fold. Ties in similarity go to the smaller id.
    A query whose prompt has no candidate uses the whole bank (``global``) or is an error.
    """

    def best(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q, b = pdf[pdf["query"]], pdf[~pdf["query"]].sort_values("id")
        if not len(q) or not len(b):
            return pd.DataFrame({"id": q["id"][:0].reset_index(drop=True), "near": b["id"][:0].reset_index(drop=True), "sim": np.zeros(0), "scores": pd.Series([], dtype=object)})

        def unit(v):
            m = np.stack(v.to_numpy()).astype(float)
            n = np.linalg.norm(m, axis=1, keepdims=True)
            if (n == 0).any():
                raise ValueError("zero norm embedding")
            return m / n

        sim = unit(q["embedding"]) @ unit(b["embedding"]).T
        ids, folds, mine = b["id"].to_numpy(), b["fold"].to_numpy(), q["id"].to_numpy()
        sim[mine[:, None] == ids] = -np.inf
        if other_folds:
            sim[q["fold"].to_numpy()[:, None] == folds] = -np.inf
        i, j = np.nonzero(_first(sim, k))
        return pd.DataFrame({"id": mine[i], "near": ids[j], "sim": sim[i, j], "scores": pd.Series([list(x) for x in b["scores"].to_numpy()[j]], dtype=object)})

    kind = dict(queries.dtypes)["id"]
    schema = f"id {kind}, near {kind}, sim double, scores array<double>"

    def search(q: DataFrame, b: DataFrame) -> DataFrame:
        return _units(q, b, block).groupBy("grp", "qb", "bb").applyInPandas(best, schema)

    own = search(queries.withColumn("grp", F.col("prompt_hash").cast("string")), bank.withColumn("grp", F.col("prompt_hash").cast("string"))).withColumn("fallback", F.lit(False))
    lost = queries.join(own.select("id").distinct(), "id", "left_anti")
    if unknown == "global":
        found = own.unionByName(search(lost.withColumn("grp", F.lit("*")), bank.withColumn("grp", F.lit("*"))).withColumn("fallback", F.lit(True)))
    else:
        found = own.unionByName(lost.select("id", F.raise_error(F.lit("unknown prompt")).cast(kind).alias("near"), F.lit(0.0).alias("sim"), F.array().cast("array<double>").alias("scores"), F.lit(True).alias("fallback")))
    top = found.withColumn("__r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "near"))).where(F.col("__r") <= k)
    w = Window.partitionBy("id")
    e = top.withColumn("__e", F.exp((F.col("sim") - F.max("sim").over(w)) / temperature)).withColumn("__w", F.col("__e") / F.sum("__e").over(w))
    means = [F.sum(F.col("__w") * F.get("scores", i)) for i in range(len(TRAITS))]
    squares = [F.sum(F.col("__w") * F.get("scores", i) * F.get("scores", i)) for i in range(len(TRAITS))]
    return e.groupBy("id").agg(
        F.array(*[F.least(F.greatest(m, F.lit(1.0)), F.lit(5.0)) for m in means]).alias("pred"), F.sum(F.col("__w") * (1 - F.col("sim"))).alias("mean_distance"),
        F.array(*[F.greatest(s - m * m, F.lit(0.0)) for s, m in zip(squares, means, strict=True)]).alias("variance"), F.max("fallback").alias("fallback"),
        F.transform(F.array_sort(F.collect_list(F.struct("__r", "near"))), lambda x: x["near"]).alias("neighbours"),
    )
