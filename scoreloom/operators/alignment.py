"""Rows of many sources by id: what differs between them, and one row an id where nothing does.

Sources are compared by order-free digests first (rows, and the sum and exclusive or of the rows' hashes), a number each.
Only where digests differ are rows compared: all sources are one union, grouped by id in one shuffle, whatever their number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ids that a report or an error names.
FIRST = 5


def set_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, total, mixed. Equal for equal bags of rows in any order and partitioning; others differ but for a chance of about 2**-64."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(20,0)")).alias("total"), F.bit_xor(h).alias("mixed"))


def _union(sources: dict[str, DataFrame], key: str, columns: list[str]) -> DataFrame:
    parts = [d.select(F.col(key).alias("id"), F.lit(i).alias("source"), *[F.col(c) if c in d.columns else F.lit(None).alias(c) for c in columns]) for i, d in enumerate(sources.values())]
    return reduce(DataFrame.unionByName, parts)


def _mine(i: int, c: str) -> Column:
    return F.when(F.col("source") == i, F.col(c))


def differences(sources: dict[str, DataFrame], key: str, equal: list[str]) -> DataFrame:
    """(source, kind, n, ids): ids of each source that are ``missing`` or ``extra`` against the first, ``repeated``, or have another value of an ``equal`` column (its name is the kind).

    Null values are equal to null. ids: the first ``FIRST``, in order. A column that a source lacks counts as null. Nothing differs: no rows.
    """
    names = list(sources)
    per = [F.struct(F.lit(s).alias("source"), F.count(F.when(F.col("source") == i, 1)).alias("n"), *[F.struct(F.min(_mine(i, c)).alias("low"), F.max(_mine(i, c)).alias("high")).alias(f"c{j}") for j, c in enumerate(equal)]).alias(f"s{i}") for i, s in enumerate(names)]
    each = _union(sources, key, equal).groupBy("id").agg(*per)
    kinds = []
    for i, s in enumerate(names):
        x, first = F.col(f"s{i}"), F.col("s0")
        tests = [("repeated", x["n"] > 1)]
        if i:
            tests += [("missing", (x["n"] == 0) & (first["n"] > 0)), ("extra", (x["n"] > 0) & (first["n"] == 0))]
            both = (x["n"] > 0) & (first["n"] > 0)
            tests += [(c, both & ~(x[f"c{j}"]["low"].eqNullSafe(first[f"c{j}"]["low"]) & x[f"c{j}"]["high"].eqNullSafe(first[f"c{j}"]["high"]))) for j, c in enumerate(equal)]
        kinds += [F.when(t, F.struct(F.lit(s).alias("source"), F.lit(k).alias("kind"))) for k, t in tests]
    bad = each.select("id", F.explode(F.array_compact(F.array(*kinds))).alias("x")).select("id", "x.*")
    named = bad.withColumn("k", F.row_number().over(Window.partitionBy("source", "kind").orderBy("id"))).where(F.col("k") <= FIRST).groupBy("source", "kind").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return bad.groupBy("source", "kind").agg(F.count("*").alias("n")).join(named, ["source", "kind"])


def align(sources: dict[str, DataFrame], key: str, values: list[str], *, equal: list[str] = ()) -> DataFrame:
    """(key, equal columns, <value>_<source>): one row an id.

    The sources must have the same ids, once each, with the same ``equal`` values (prompt, input hash, outer fold); else a
    ValueError tells each source's defects and its first ids.
    """
    equal, columns = list(equal), [key, *equal]
    told = {s: tuple(set_digest(d.select([c for c in columns if c in d.columns]), [c for c in columns if c in d.columns]).first()) for s, d in sources.items()}
    lacking = {s: [c for c in [*columns, *values] if c not in d.columns] for s, d in sources.items()}
    if any(lacking.values()):
        raise ValueError("columns missing: " + "; ".join(f"{s}: {', '.join(c)}" for s, c in lacking.items() if c))
    if len(set(told.values())) > 1:
        bad = differences(sources, key, equal).orderBy("source", "kind").collect()  # a row a source and kind
        raise ValueError("sources differ: " + "; ".join(f"{r.source} {r.kind} {r.n} ({', '.join(map(str, r.ids))})" for r in bad))
    names = list(sources)
    got = [F.max(_mine(i, v)).alias(f"{v}_{s}") for i, s in enumerate(names) for v in values]
    wide = _union(sources, key, [*equal, *values]).groupBy("id").agg(*[F.max(c).alias(c) for c in equal], *got, *[F.count(F.when(F.col("source") == i, 1)).alias(f"__n{i}") for i in range(len(names))])
    once = reduce(Column.__and__, [F.col(f"__n{i}") == 1 for i in range(len(names))])
    bad = F.raise_error(F.concat(F.lit("repeated id "), F.coalesce(F.col("id").cast("string"), F.lit("null")))).cast("boolean")
    return wide.where(F.when(once, True).otherwise(bad)).drop(*[f"__n{i}" for i in range(len(names))]).withColumnRenamed("id", key)
