"""The union of train and validation rows, refused where they collide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.control import require_acknowledged


def collisions(rows: DataFrame) -> DataFrame:
    """(field, value, kind): ids and document ids that occur twice, and essays in both splits. kind: duplicate or conflicting."""
    whole = F.sha2(F.to_json(F.struct("id", "document_id", "prompt_num", "essay")), 256)
    out = None
    for field in ("id", "document_id"):
        g = rows.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n"), F.count_distinct(whole).alias("d")).where("n > 1")
        g = g.select(F.lit(field).alias("field"), "value", F.when(F.col("d") == 1, "duplicate").otherwise("conflicting").alias("kind"))
        out = g if out is None else out.unionAll(g)
    e = rows.groupBy(F.sha2("essay", 256).alias("value")).agg(F.count_distinct("split").alias("s")).where("s > 1")
    return out.unionAll(e.select(F.lit("essay").alias("field"), "value", F.lit("duplicate").alias("kind")))


def combine(train: DataFrame, validation: DataFrame, *, acknowledged: bool) -> DataFrame:
    """Train rows, then validation rows, in their order (split, ordinal); the caller checks ``collisions`` is empty before writing."""
    require_acknowledged(acknowledged)
    return train.withColumn("split", F.lit("train")).withColumn("split_order", F.lit(0)).unionByName(validation.withColumn("split", F.lit("validation")).withColumn("split_order", F.lit(1)))


def merge_oof(parts: list[DataFrame], expected: DataFrame, key: str = "id") -> DataFrame:
    """Disjoint fold parts as one table; an id missing, extra or in two parts is an error when read."""
    from .metrics import align

    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return align(expected.select(key), all_, key)
